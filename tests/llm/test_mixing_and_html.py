"""Mixing with weights of zero, and the main text of pages, against plain models."""

import random
import time
from collections import defaultdict

import pytest

from corvid.llm import html_extract, mixing

# --- mixing


def fill(budget, rooms):
    """Water filling: rooms by name as (room, weight), until no child with room is left or the budget is."""
    got, open_ = dict.fromkeys(rooms, 0.0), {n for n, (room, w) in rooms.items() if room > 0 and w > 0}
    while open_ and budget > 1e-9:
        unit = budget / sum(rooms[n][1] for n in open_)
        full = {n for n in open_ if rooms[n][0] - got[n] <= unit * rooms[n][1] + 1e-9}
        for n in full or open_:
            step = rooms[n][0] - got[n] if full else unit * rooms[n][1]
            got[n] += step
            budget -= step
        open_ -= full
        if not full:
            break
    return got


def quotas(leaves, weights, budget, epochs):
    def go(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        rooms = defaultdict(float)
        for *path, tokens in leaves:
            if tuple(path[:depth]) == prefix and all(weights[d].get(path[d], 1.0) > 0 for d in range(depth, 3)):
                rooms[path[depth]] += tokens * epochs
        shares = fill(budget, {n: (room, weights[depth].get(n, 1.0)) for n, room in rooms.items()})
        return {k: v for n, b in shares.items() for k, v in go((*prefix, n), b).items()}

    return go((), budget)


@pytest.mark.parametrize("seed", range(6))
def test_budgets_equal_water_filling(spark, seed):
    rng = random.Random(seed)
    weight = lambda: rng.choice([0.0, 0.5, 1.0, 3.0])
    domains, langs, sources = (tuple((n, weight()) for n in names) for names in (("a", "b", "c"), ("en", "fr", "de"), ("s0", "s1", "s2", "s3")))
    leaves = [(d, lang, s, rng.choice([0, 10, 300, 5000])) for d, _ in domains for lang, _ in langs for s, _ in sources if rng.random() < 0.7]
    mixture = mixing.Mixture(domains=tuple((n, "^$", w) for n, w in domains), languages=langs, sources=sources, percent=rng.choice([5, 40, 90]), epochs=rng.choice([1, 2]))
    budget = sum(x[3] for x in leaves) * mixture.percent // 100
    expected = quotas(leaves, [dict(domains), dict(langs), dict(sources)], budget, mixture.epochs)
    df = spark.createDataFrame([(*x, 1) for x in leaves], "domain string, lang string, source string, tokens bigint, documents bigint")
    got = {(r["domain"], r["lang"], r["source"]): r["quota"] for r in mixing.quotas(df, mixture).collect()}
    assert {k: v for k, v in got.items() if v} == {k: int(v + 1e-6) for k, v in expected.items() if int(v + 1e-6)}


def test_what_a_zero_weight_leaves_goes_to_others(spark):
    leaves = spark.createDataFrame([("a", "en", "a1", 500, 1), ("a", "en", "a2", 500, 1), ("b", "en", "b1", 1000, 1)], "domain string, lang string, source string, tokens bigint, documents bigint")
    mixture = mixing.Mixture(domains=(("a", "^a", 1.0), ("b", "^b", 1.0)), languages=(), sources=(("a2", 0.0),), percent=70, epochs=1)
    assert {r["source"]: r["quota"] for r in mixing.quotas(leaves, mixture).collect()} == {"a1": 500, "b1": 900}


# --- pages

LONG = "A, long, enough, paragraph of the page, with text and commas, and more of it."
TEXT = f"<p>{LONG}</p>"


@pytest.mark.parametrize(
    ("part", "text"),
    [
        ("<section id='search'><h2>Search</h2><p>Find it.</p></section>", "Search\n\nFind it."),
        ("<div id='login'><p>How we log in.</p></div>", "How we log in."),
        ("<div class='social-science'><p>On society.</p></div>", "On society."),
        ("<p class='skip-para'>A paragraph.</p>", "A paragraph."),
        ("<h2 class='search-title'>A title</h2>", "A title"),
        ("<div class='wp-widget-text'><p>A text.</p></div>", "A text."),
        ("<div class='notice-periods'><p>On notice.</p></div>", "On notice."),
        ("<blockquote><p>Q</p><footer>Someone</footer></blockquote>", "Q\n\nSomeone"),
        ("<div id='login'><form><input><p>Log in, please</p></form></div>", ""),
        ("<div class='social'><a href=x>One</a> <a href=y>Two</a></div>", ""),
        ("<div class='search'><input><p>Search this site</p></div>", ""),
        ("<section class='social-links'><p><a href=x>One of many</a> at</p></section>", ""),
        ("<div class='notice'><p>We use cookies.</p></div>", ""),
        ("<section><h2>3 Comments</h2><p>I like it.</p></section>", ""),
        ("<div><h3>Leave a reply</h3><p>Your address is not published.</p></div>", ""),
        ("<footer>Share</footer>", ""),
    ],
)
def test_parts_of_an_article_go_only_if_they_are_none(part, text):
    assert html_extract.extract(f"<body><nav>x</nav><article><h1>T</h1>{TEXT}{part}{TEXT}</article></body>") == "\n\n".join(x for x in ("T", LONG, text, LONG) if x)


def test_comments_beside_an_article_without_a_name():
    assert html_extract.extract(f"<body><article><h1>T</h1>{TEXT}</article><section><h2>3 Comments</h2>{TEXT * 4}</section></body>") == f"T\n\n{LONG}"


PAGES = {
    "articles and adverts": lambda n: "<article><p>x</p></article>" * n + "<div class=ad>x</div>" * n,
    "ends that cross a cell": lambda n: "<b><table><td>" + "<i>" * n + "</b>" * n,
    "blocks in a button": lambda n: "<p><button>" + "<span>" * n + "<div></div>" * n,
    "items under inline elements": lambda n: "<li><ul>" + "<i>" * n + "<li></li>" * n,
    "terms under lists": lambda n: "<dl><dt><dl>" + "<ul>" * n + "<dt></dt>" * n,
    "deep with siblings": lambda n: "<div><p>a</p>" * n,
    "named, deep": lambda n: "<div class='widget'>" * n + "x",
    "cells, deep": lambda n: "<table><tr><td>" * n + "x",
    "open quotes": lambda n: '<a "' * n,
}


@pytest.mark.parametrize("name", PAGES)
def test_long_pages_take_time_in_proportion(name):
    page, took = PAGES[name], []
    unit = len(page(1000)) / 1000
    for size in (100_000, 500_000):
        start = time.process_time()
        html_extract.extract(page(int(size / unit)))
        took.append(time.process_time() - start)
    assert took[1] < 15 * took[0] + 1, took


class Model:
    """A plain tree: its html, and the article by the rules for pages without names."""

    def __init__(self, rng, depth=0):
        self.tag = "body" if not depth else rng.choice(["div", "div", "section", "p", "a", "span"] if depth < 4 else ["p", "a", "span"])
        words = lambda: " ".join(rng.choice(["word", "long", "and,", "more,", "text"]) for _ in range(rng.randrange(1, 25)))
        self.children = []
        for _ in range(rng.randrange(1, 5)):
            if self.tag in ("p", "a", "span") or rng.random() < 0.25:
                self.children.append(words() if self.tag != "p" or rng.random() < 0.7 else Model.link(words()))
            else:
                self.children.append(Model(rng, depth + 1))
        self.score = 0.0

    @classmethod
    def link(cls, text):
        out = cls.__new__(cls)
        out.tag, out.children, out.score = "a", [text], 0.0
        return out

    def html(self):
        return f"<{self.tag}>{''.join(c if isinstance(c, str) else c.html() for c in self.children)}</{self.tag}>"

    def all(self):
        return [self, *(y for c in self.children if isinstance(c, Model) for y in c.all())]

    def length(self):
        return sum(len(c.strip()) if isinstance(c, str) else c.length() for c in self.children)

    def linked(self):
        return sum(0 if isinstance(c, str) else c.length() if c.tag == "a" else c.linked() for c in self.children)


BLOCK = ("body", "div", "section", "p")


def runs(x):
    """(block, text) of each run of text between the borders of blocks, in page order; inline elements don't part a run."""
    out = [[None, ""]]

    def go(x, block, owner):
        if x.tag in BLOCK:
            out.append([None, ""])
        for c in x.children:
            if isinstance(c, str):
                out[-1] = [block if block is not None else owner, out[-1][1] + c]
            else:
                go(c, c if c.tag in BLOCK else block, owner)
        if x.tag in BLOCK:
            out.append([None, ""])

    go(x, x if x.tag in BLOCK else None, x)
    return [(b, " ".join(t.split())) for b, t in out if t.split()]


def article(root):
    parent = {id(c): x for x in root.all() for c in x.children if isinstance(c, Model)}
    for block, text in runs(root):
        points = 1 + text.count(",") + min(len(text) / 100, 3.0)
        up = parent.get(id(block)) if block.tag == "p" else block
        for share in (1.0, 0.5, 0.25, 0.15):
            if up is not None:
                up.score += points * share
                up = parent.get(id(up))
    for x in root.all():
        x.score *= 1 - x.linked() / max(1, x.length())
    # Of equal scores the first in the order of a walk that takes the last child first.
    best, walk = None, [root]
    while walk:
        x = walk.pop()
        walk += [c for c in x.children if isinstance(c, Model)]
        best = x if best is None or x.score > best.score else best
    if best.score <= 0:
        best = root
    least, x, before, after = max(10.0, best.score * 0.2), best, [], []
    beside = lambda c: isinstance(c, str) or c.score >= least or (c.tag in ("p", "span") and 2 * c.linked() <= c.length())
    while x is not root and (x is best or parent[id(x)] is not root):
        up = parent[id(x)]
        at = next(k for k, c in enumerate(up.children) if c is x)
        before, after, x = [c for c in up.children[:at] if beside(c)] + before, after + [c for c in up.children[at + 1 :] if beside(c)], up
    top = Model.link("")
    top.tag, top.children = "span", [*before, best, *after]
    return "\n\n".join(t for _, t in runs(top))


def test_scores_equal_a_plain_model():
    rng, some = random.Random(8), 0
    for _ in range(400):
        root = Model(rng)
        got, expected = html_extract.extract(root.html()), article(root)
        assert got == expected, root.html()
        some += got != "\n\n".join(t for _, t in runs(root))
    assert some > 50
