"""Secret scan: keyword and key-format patterns, and sliding-window Shannon entropy with an allow-list."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.shared import in_slices, table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Runs that may be random strings; `=` is padding at their end, else it parts a name from its value.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: One word of a path or a name, with a short number behind it, or such a number. A word can be read in one way alone,
#: so that many of them in a row are no work.
NAME = r"(?:(?:[A-Za-z][a-z]*(?:[A-Z][a-z]{2,})*|[A-Z]{2,})(?:(?<=[A-Za-z]{3})[0-9]{1,4})?|[0-9]{1,4}s?)"
#: Candidates that are no secrets: UUIDs, the key that public manuals show, one repeated unit, numbers, plain paths and dashed words.
ALLOWED = re.compile(
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY|(.{1,8}?)\1{2,}|[0-9_=/+-]+"
    rf"|[-_/]?{NAME}(?:[-_/]{NAME})*[-_/]?"
)
#: Parts of a candidate, between separators, that hold one of these words are placeholders; what is beside them is scanned.
PLACEHOLDER = re.compile(r"(?ai)example|sample|dummy|placeholder|changeme")
SHORTEST = 20


@dataclass(frozen=True)
class EntropyRule:
    """Bits in a window of `window` characters from which a candidate of a class counts as random."""

    window: int = 20
    hexadecimal: float = 3.1
    alphanumeric: float = 3.75
    base64: float = 3.75
    letters: float = 3.9


def class_of(s: str) -> str | None:
    """hexadecimal, alphanumeric, base64 or letters; None if s can't be told from words.

    Letters alone count as random if at least two in five neighbours differ in case, which words and joined words don't;
    letters of one case never do.
    """
    digits = sum(c.isdigit() for c in s)
    mixed = any(c.isupper() for c in s) and any(c.islower() for c in s)
    if digits == len(s):
        return None
    if not digits:
        turns = sum(x.isupper() != y.isupper() for x, y in zip(s, s[1:], strict=False) if x.isalpha() and y.isalpha())
        return "letters" if mixed and 5 * turns >= 2 * (len(s) - 1) else None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return "hexadecimal"
    if s.isalnum():
        return "alphanumeric" if mixed or digits >= len(s) // 8 else None
    return "base64" if mixed else None


def entropy_spans(s: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Where windows of s have `bits` of Shannon entropy or more, overlapping ones joined.

    H = log2 w - sum(c log2 c) / w; one character enters and one leaves at each step, so two counts change.
    """
    w = min(window, len(s))
    cost = [0.0] + [c * math.log2(c) for c in range(1, w + 1)]
    counts: dict[str, int] = {}
    total, least, spans = 0.0, (math.log2(w) - bits) * w, []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        if i >= w:
            gone = s[i - w]
            m = counts[gone]
            counts[gone] = m - 1
            total += cost[m - 1] - cost[m]
            n = counts.get(c, 0)
        counts[c] = n + 1
        total += cost[n + 1] - cost[n]
        if i >= w - 1 and total <= least + 1e-9:
            if spans and spans[-1][1] >= i - w + 1:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((i - w + 1, i + 1))
    return spans


def _candidates(text: str) -> Iterator[tuple[int, str]]:
    """Start and text of each string whose entropy is looked at: candidates without what the allow-list takes away."""
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if ALLOWED.fullmatch(s):
            continue
        if not PLACEHOLDER.search(s):
            yield m.start(), s
            continue
        at = 0
        for part in [*re.finditer(r"[A-Za-z0-9]+", s), None]:
            if part is None or PLACEHOLDER.search(part[0]):
                end = part.start() if part else len(s)
                if end - at >= SHORTEST and not ALLOWED.fullmatch(s, at, end):
                    yield m.start() + at, s[at:end]
                at = part.end() if part else end


def _widened(s: str, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The spans as far as the letters and digits that they begin and end in go on, ones that meet then joined."""
    last: tuple[int, int] | None = None
    for a, b in spans:
        if last and a < last[1]:
            a = last[0]
        while a > 0 and s[a - 1].isalnum() and s[a].isalnum() and not (last and a <= last[1]):
            a -= 1
        while b < len(s) and s[b - 1].isalnum() and s[b].isalnum():
            b += 1
        if last and a <= last[1]:
            last = last[0], max(last[1], b)
            continue
        if last:
            yield last
        last = a, b
    if last:
        yield last


def _union(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """What the sorted spans (start, kind, end) cover, as intervals in order."""
    out: list[list[int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def scan_text(text: str | None, rule: EntropyRule = EntropyRule()) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of each find, sorted; entropy finds, with the rest of the letters and digits that
    they begin and end in, without what patterns have found.

    One sweep over the text's candidates and the patterns' finds, both in order.
    """
    text = text or ""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    known = _union(sorted(found))
    k = 0
    for start, s in _candidates(text):
        kind = class_of(s)
        if kind is None:
            continue
        for a, b in _widened(s, entropy_spans(s, rule.window, getattr(rule, kind))):
            a, b = a + start, b + start
            while k < len(known) and known[k][1] <= a:
                k += 1
            j = k
            while j < len(known) and known[j][0] < b:
                if a < known[j][0]:
                    found.append((a, 3, known[j][0]))
                a = known[j][1]
                j += 1
            if a < b:
                found.append((a, 3, b))
    return sorted(found)


def find_secrets(docs: DataFrame, rule: EntropyRule = EntropyRule(), text: str = "text") -> DataFrame:
    """docs' rows with spans array<struct<kind,start,end>> (code points, end exclusive) in place of all other columns but doc_id.

    A null or empty text has no spans; repeated rows and null ids stay as they are; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in in_slices(batches, "text"):
            rows = [[{"kind": KINDS[k], "start": a, "end": e} for a, k, e in scan_text(t, rule)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    kept = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    return kept.mapInArrow(scan, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, rule: EntropyRule = EntropyRule(), mark: str = "[SECRET]") -> DataFrame:
    """docs with each span of its texts replaced by `mark`, spans that overlap or touch as one; n_chars follows, all else stays.

    Null and empty texts stay as they are, and so do repeated rows; no rows give no rows.
    """

    def clean(t: str | None) -> str | None:
        found = scan_text(t, rule)
        if not found:
            return t
        out, at = [], 0
        for a, b in _union(found):
            out += [t[at:a], mark]
            at = b
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "text"):
            at = b.schema.get_field_index("text")
            old = b.column(at)
            arrays = list(b.columns)
            arrays[at] = pa.array([clean(t) for t in old.to_pylist()], old.type)
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of find_secrets over all documents."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    line = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *(number(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
