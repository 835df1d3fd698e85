"""Plain models of the contracts, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from corvid.llm import secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def quality(rows):
    out = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        count = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        marked = [False] * len(w)
        for j in range(len(w) - 4):
            if count[tuple(w[j : j + 5])] > 1:
                marked[j : j + 5] = [True] * 5
        seen, again = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        n, r = len(w), sum(marked)
        out.append((i, n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), again, r, n < 10 or 100 * r > 20 * n))
    return out


def without_repeats(rows, n=35):
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[j : j + n]) for w in words for j in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if count[tuple(w[j : j + n])] > 1:
                gone[j : j + n] = [True] * n
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def shingles(t, k=5):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    where = defaultdict(list)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, s in enumerate(sets):
        both = Counter(o for x in s for o in where[x])
        for x in s:
            where[x].append(k)
        for o, b in both.items():
            if 100 * b >= percent * (len(s) + len(sets[o]) - b) and (a := root(k)) != (c := root(o)):
                up[max(a, c)] = min(a, c)
    best = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            best[root(k)] = min(best.get(root(k), i), i)
    return [(i, len(sets[k]), best.get(root(k))) for k, (i, _) in enumerate(rows)]


_PATTERNS = (
    (re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 8, 2),
    (re.compile(r"AKIA[A-Z0-9]+"), 16, 0),
    (re.compile(r"[0-9a-f]+"), 32, 0),
)


def base_secrets(t):
    return sorted((m.start(), k, m.end()) for k, (p, least, g) in enumerate(_PATTERNS) for m in p.finditer(t or "") if len(m[g]) >= least)


LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def licences(t):
    w = LICENCE_WORD.findall((t or "").translate(LOWER))
    found = [(j, label) for p, label in ((["mit", "license"], "mit"), (["apache", "license"], "apache"), (["general", "public", "license"], "gpl")) for j in range(len(w)) if w[j : j + len(p)] == p]
    starts = [j for j, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def chats(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, all_turns in turns.items():
        all_turns.sort()
        said = "".join(text for _, _, role, text in all_turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in all_turns)
        out.append((conv, len(all_turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return out


def all_secrets(t):
    """base_secrets and the entropy finds, each window's entropy by its definition."""
    t = t or ""
    base = base_secrets(t)
    known = {x for a, _, b in base for x in range(a, b)}
    found = list(base)
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", t):
        s = m[0]
        if secret_scan.ALLOWED.fullmatch(s):
            continue
        words = [w.span() for w in re.finditer(r"[A-Za-z0-9]+", s) if re.search("example|sample|dummy|placeholder|changeme", w[0].lower())]
        held = {x for a, b in words for x in range(a, b)}
        for a, b in runs(x for x in range(len(s)) if x not in held):
            part = s[a:b]
            kind = secret_scan.class_of(part)
            if len(part) < 20 or kind is None or held and secret_scan.ALLOWED.fullmatch(part):
                continue
            bits, hot = getattr(secret_scan.EntropyRule(), kind), set()
            for i in range(len(part) - 19):
                count = Counter(part[i : i + 20])
                if -sum(n / 20 * math.log2(n / 20) for n in count.values()) >= bits - 1e-9:
                    hot |= set(range(m.start() + a + i, m.start() + a + i + 20))
            for w in re.finditer(r"[A-Za-z0-9]+", part):  # the rest of the runs of letters and digits that they stand in
                places = set(range(m.start() + a + w.start(), m.start() + a + w.end()))
                hot |= places if hot & places else set()
            found += [(x, 3, y) for x, y in runs(hot - known)]
    return sorted(found)


def runs(places):
    out = []
    for x in sorted(places):
        if out and out[-1][1] == x:
            out[-1][1] = x + 1
        else:
            out.append([x, x + 1])
    return out


def joined(found):
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in found)


def quality_stage(rows):
    """What rows (doc_id, text, host) become: kept ones without lines that stand in over 10 texts and 1 % of a host's."""
    normal = lambda line: " ".join(WORD.findall(re.sub("[0-9]", "0", line.translate(LOWER))))
    texts = {(h or "", t or "") for _, t, h in rows}
    hosts, count = Counter(h for h, _ in texts), Counter()
    for h, t in texts:
        count.update((h, x) for x in {normal(line) for line in t.split("\n")} if x)
    out = []
    for i, t, h in rows:
        failed = quality([(i, t)])[0][6]
        lines, words = (t or "").split("\n"), len(WORD.findall(t or ""))
        gone = [bool(x := normal(line)) and count[h or "", x] > max(10, hosts[h or ""] / 100) for line in lines]
        left = words - sum(len(WORD.findall(line)) for line, g in zip(lines, gone, strict=True) if g)
        if not failed and 100 * left >= 30 * words:
            out.append((i, t if not any(gone) else "\n".join(line for line, g in zip(lines, gone, strict=True) if not g)))
    return out


def near_duplicate_stage(rows):
    """One row (doc_id, text) of each component, by ids alone; rows without words stay once each."""
    named = {i: c for i, n, c in components(rows) if n}
    return sorted({(i, t or "") for i, t in rows if i is not None and (named.get(i, i) == i)})


def leaks(text, item):
    grams = lambda t, k: {tuple(w[j : j + k]) for w in [LICENCE_WORD.findall((t or "").lower())] for j in range(len(w) - k + 1)}
    k = min(5, len(LICENCE_WORD.findall((item or "").lower())))
    wanted = grams(item, k) if k else set()
    return bool(wanted) and 100 * len(wanted & grams(text, k)) >= 75 * len(wanted)


def redacted(t):
    out, at = [], 0
    for a, b in runs({x for a, _, b in all_secrets(t) for x in range(a, b)}):
        out += [t[at:a], "[SECRET]"]
        at = b
    return "".join([*out, t[at:]]) if out else t
