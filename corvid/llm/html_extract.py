"""Main text of web pages by tree scoring.

Paragraphs give points for length and commas to their ancestors (all to the parent, half to its parent, then less);
an element's points are discounted by the share of its text that stands in links. Elements named as no article (sidebar,
header, comments and so on) and forms are left out, but not those that hold the page's article, nor those whose name may
as well be its subject (`social-science`, a section `search`) and that hold prose: these lose points alone. The best element, widened to the
article or main element around it, and siblings that score well themselves are the article; without such an element, so
are headings, lists, tables and other text beside the best one and those around it, unless half of it stands in links.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.shared import in_slices, table

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript noembed noframes iframe xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
UNWANTED = frozenset("applet audio button canvas datalist dialog embed footer frame frameset head iframe input label map menu nav noscript object option script select style svg template textarea title video aside".split())
CLOSES_P = BLOCKS - frozenset("html body caption option summary tbody td tfoot th thead tr".split())
#: An element of these ends open elements of the second list, up to one of the third.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)), "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",)),
}
#: For each tag the entries of IMPLIED in which it stands.
GROUPS: dict[str, list[str]] = {}
for _tag, (_ends, _stops) in IMPLIED.items():
    for _x in (*_ends, *_stops):
        GROUPS.setdefault(_x, []).append(_tag)
CELLS = frozenset(("table", "td", "th"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Words of class, id and the like that mark what is no article.
NAMES = frozenset(
    "ad ads adsbygoogle adsense adslot adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices announcement disclaimer alert popup modal "
    "overlay newsletter subscribe subscription signup share sharing social related recommended recommendations sidebar sidenav rail widget comment comments commentlist respond disqus reply replies menu nav navbar "
    "navigation navlinks breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar login search skip paywall outbrain taboola tags".split()
)
#: Words that may stand beside these in an id or a label. Other words make it a heading's own (`share-prices`), which marks nothing.
COMMON = frozenset(
    "area article articles bar block body bottom box button buttons center col column container content div element entry fixed form global google gpt group inner item items left link links list main mobile module more "
    "number outer page panel post posts primary reader readers right row secondary section site slot sticky stories story top user users view wrap wrapper zone".split()
)
NAMING = frozenset("class id itemprop itemtype aria-label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Those of NAMES that stay what they are however much text they hold.
COMMENTS = frozenset("comment comments commentlist respond disqus reply replies".split())
#: Those that may name what an article's part is about: such an element goes only if it holds no prose.
SUBJECTS = frozenset("search login social skip".split())
#: The same for these where other words stand beside them (`notice-periods`).
MIXED = SUBJECTS | frozenset("alert announcement announcements banner disclaimer header masthead menu menus nav navigation notice notices overlay pager promotion rail reply replies respond related share sharing signup subscription toolbar widget".split())
CONTROLS = frozenset("input select textarea button form".split())
#: Headings of readers' comments, in parts of a page that have no name.
COMMENTS_HEADING = re.compile(r"\s*(?:\d+\s+)?comments?(?:\s*\(\d+\))?:?\s*|\s*leave a (?:comment|reply)\s*", re.I)
#: Where a capital begins a word: `userComments`.
CAPITAL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: `with-sidebar` and the like tell what stands beside an article.
BESIDE = re.compile(r"\b(?:has|with|no|without)[-_]+[a-z]+")
WANTED = frozenset(("article", "main", "body", "html"))
PARAGRAPHS = frozenset("p pre blockquote td li dd figcaption".split())
#: Blocks that are of the article where they stand beside its text.
PROSE = frozenset("p pre blockquote ul ol dl table figure h1 h2 h3 h4 h5 h6 hgroup header details".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
LOOSE = re.compile(r"</?[A-Za-z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass(eq=False, slots=True)
class Node:
    tag: str
    parent: Node | None = None
    unwanted: bool = False
    named: str = ""
    weak: bool = False
    children: list = field(default_factory=list)
    score: float = 0.0
    length: int = 0
    linked: int = 0
    plain: int = 0
    holds: bool = False
    controls: bool = False
    prose: bool = False


def _unwanted(tag: str, rest: str, inside: bool, quoted: bool) -> bool:
    if tag in UNWANTED and not (quoted and tag == "footer") or tag == "header" and not inside:
        return True
    if not rest or tag in WANTED and tag != "article":
        return False
    for m in ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _named(tag: str, rest: str, inside: bool) -> tuple[str, bool]:
    """The word that marks the element as no article, if any, and whether it is a weak mark; `form` for forms.

    Inside an article a header is its own. One word of a class is enough. Ids and labels are often made of a heading's text,
    so all their words must be of NAMES and COMMON, and a heading's id marks comments alone.
    """
    if tag == "form":
        return tag, False
    if not rest or tag in WANTED and tag != "article":
        return "", False
    weak = ""
    for m in ATTRIBUTE.finditer(rest):
        name = m[1].lower()
        if name not in NAMING:
            continue
        value = html.unescape(m[2] or m[3] or m[4] or "")
        if name == "itemtype":
            value = value.rsplit("/", 1)[-1]
        for token in BESIDE.sub(" ", CAPITAL.sub("-", value).lower()).split() if name == "class" else [BESIDE.sub(" ", CAPITAL.sub("-", value).lower())]:
            parts = re.findall(r"[a-z]+", token)
            words, whole = NAMES.intersection(parts), (NAMES | COMMON).issuperset(parts)
            if name != "class" and not whole:
                continue
            if tag in HEADINGS and name == "id":
                words &= COMMENTS
            if tag in HEADINGS or "header" in words and inside:
                words -= {"header", "masthead"}
            if sure := words - (SUBJECTS if whole else MIXED):
                return min(sure, key=lambda w: (w not in COMMENTS, w)), False
            weak = weak or min(words, default="")
    return weak, weak != ""


def _drop_named(root: Node) -> None:
    """Marks named elements as unwanted but those that are or hold the page's article, judged by text outside links."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in x.children if isinstance(c, Node) and not c.unwanted]
    for x in reversed(order):
        inner = [c for c in x.children if isinstance(c, Node)]
        x.plain = sum(len(c.strip()) if isinstance(c, str) else 0 if c.unwanted or c.tag == "a" else c.plain for c in x.children)
        x.linked = sum(c.linked if c.tag != "a" else c.plain for c in inner if not c.unwanted)
        x.holds = x.tag in ("article", "main") or any(not c.unwanted and c.holds for c in inner)
        x.controls = x.tag in CONTROLS or any(c.controls or c.tag in CONTROLS for c in inner)
        x.prose = (x.tag in PARAGRAPHS or x.tag in HEADINGS) and x.plain > 0 or any(not c.unwanted and c.prose for c in inner)
        if inner and inner[0].tag in HEADINGS and x.tag in ("section", "div", "aside", "ol", "ul") and not x.holds and COMMENTS_HEADING.fullmatch("".join(c for c in inner[0].children if isinstance(c, str))):
            x.named, x.weak = "comments", False
        if x.weak and x.prose and not x.controls and x.plain >= 2 * x.linked:
            x.named = ""
    for x in order:
        x.linked = 0
    # Articles under no named element, the outermost ones: what they hold speaks against a named element beside them.
    beside, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.tag in ("article", "main"):
            beside.append(x)
        elif not x.named:
            stack += [c for c in x.children if isinstance(c, Node) and not c.unwanted]
    stack, total = [(root, None)], sum(a.plain for a in beside)
    outer = set(map(id, beside))
    while stack:
        x, around = stack.pop()
        if x.named and not (x.tag == "article" and (around is None or around.tag == "main")):
            others = total - (around.plain if id(around) in outer else 0)
            least = 0.8 * around.plain if around is not None else root.plain / (4 if x.holds and not others else 2)
            if x.named in COMMENTS or x.plain <= least or 4 * others >= x.plain:
                x.unwanted = True
                continue
        inner = x if x.tag == "article" or x.tag == "main" and around is None else around
        stack += [(c, inner) for c in x.children if isinstance(c, Node) and not c.unwanted]


def parse(page: str) -> Node:
    """A tree of elements and texts; unclosed, misplaced and cut off tags do no harm."""
    root = now = Node("#root")
    # Of what is open: how many elements of each tag, in all and since the innermost table or cell; the blocks; and for
    # the elements that end others, what they end and where they stop. So nothing is looked for where it isn't.
    opened: defaultdict[str, int] = defaultdict(int)
    scopes: list[defaultdict[str, int]] = [defaultdict(int)]
    blocks: list[Node] = []
    groups: dict[str, list[Node]] = {tag: [] for tag in IMPLIED}

    def enter(x: Node) -> None:
        opened[x.tag] += 1
        scopes[-1][x.tag] += 1
        if x.tag in CELLS:
            scopes.append(defaultdict(int))
        if x.tag in BLOCKS or x.tag == "button":
            blocks.append(x)
        for g in GROUPS.get(x.tag, ()):
            groups[g].append(x)

    def back(to: Node) -> Node:
        up = now
        while up is not to:
            opened[up.tag] -= 1
            if up.tag in CELLS:
                scopes.pop()
            scopes[-1][up.tag] -= 1
            if up.tag in BLOCKS or up.tag == "button":
                blocks.pop()
            for g in GROUPS.get(up.tag, ()):
                groups[g].pop()
            up = up.parent
        return up

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            now.children.append(html.unescape(page[at:]))
            break
        if lt > at:
            now.children.append(html.unescape(page[at:lt]))
        m = TOKEN.match(page, lt) or LOOSE.match(page, lt)
        if m is None:
            now.children.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m.re is LOOSE:
            m = re.match(r"<(/?)([A-Za-z][^\s/>]*)()", m[0])
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            up = now if (opened if tag in BLOCKS else scopes[-1])[tag] else root
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                now = back(up.parent)
            elif tag in ("p", "br"):
                now.children.append(Node("br", now))
            continue
        if tag in CLOSES_P and blocks and blocks[-1].tag == "p":
            now = back(blocks[-1].parent)
        if tag in IMPLIED:
            last, ends = None, IMPLIED[tag][0]
            for x in reversed(groups[tag]):
                if x.tag not in ends:
                    break
                last = x
            if last is not None:
                now = back(last.parent)
        inside, rest = opened["article"] + opened["main"] > 0, m[3].strip()
        unwanted = now.unwanted or _unwanted(tag, rest, inside, opened["blockquote"] > 0)
        new = Node(tag, now, unwanted, *(("", False) if unwanted else _named(tag, rest, inside)))
        now.children.append(new)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
        elif tag not in VOID and not m[3].endswith("/") or tag in BLOCKS:
            now = new
            enter(new)
    return root


def _blocks(top: list, kept) -> list[tuple[str, list, Node]]:
    """(text, ...) of each block below `top` in page order, as lists of strings with the element that they stand in."""
    out: list[tuple[Node | None, list[str], int]] = []
    current: list = [None, [], 0]

    def flush(owner: Node | None) -> None:
        nonlocal current
        out.append(tuple(current))
        current = [owner, [], 0]

    stack: list = [(x, None) for x in reversed(list(top))]
    while stack:
        x, owner = stack.pop()
        if x is None:
            flush(owner)
        elif isinstance(x, str):
            current[0] = owner
            current[1].append(x)
        elif x.unwanted or not kept(x):
            continue
        elif x.tag in BLOCKS:
            flush(x)
            stack.append((None, owner))
            stack += [(c, x) for c in reversed(x.children)]
        elif x.tag in ("br", "hr", "wbr", "img"):
            current[1].append("" if x.tag == "wbr" else " ")
        else:
            stack += [(c, owner or x) for c in reversed(x.children)]
    flush(None)
    return [(text, owner) for owner, parts, _ in out if (text := " ".join("".join(parts).split()))]


def _measure(root: Node) -> list[Node]:
    """Text and link lengths of all wanted elements, children before parents."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in x.children if isinstance(c, Node) and not c.unwanted]
    for x in reversed(order):
        for c in x.children:
            if isinstance(c, str):
                x.length += len(c.strip())
            elif not c.unwanted:
                x.length += c.length
                x.linked += c.length if c.tag == "a" else c.linked
    return order


def extract(page: str | None) -> str:
    """The article's blocks, joined by empty lines; "" if the page has no text. Names count for nothing if they leave none."""
    root = parse(page or "")
    _drop_named(root)
    return _article(root) or _article(parse(page or ""))


def _beside(x: Node | str, least: float) -> bool:
    """Whether x beside the best element or one around it is of the article: by its score, or as text that is not mostly links."""
    if isinstance(x, str):
        return True
    return not x.unwanted and (x.score >= least or (x.tag in PROSE or x.tag not in BLOCKS) and 2 * x.linked <= x.length and x.tag != "a")


def _article(root: Node) -> str:
    order = _measure(root)
    for text, owner in _blocks([root], lambda x: True):
        if owner is None or owner.tag not in PARAGRAPHS and owner.tag not in ("div", "section", "article", "main", "body"):
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3.0)
        up = owner.parent if owner.tag in PARAGRAPHS else owner
        for share in (1.0, 0.5, 0.25, 0.15):
            if up is None:
                break
            up.score += points * share
            up = up.parent
    for x in order:
        x.score *= (1 - x.linked / max(1, x.length)) / (2 if x.weak else 1)
    best = max(order, key=lambda x: x.score, default=root)
    if best.score <= 0:
        best = next((x for x in order if x.tag in ("article", "main")), None) or next((x for x in order if x.tag == "body"), root)
    up = best
    while up is not None:  # a section of an article stands for the article
        if up.tag == "article" or up.tag == "main":
            best = up
        up = up.parent
    top = deque([best])
    if best.tag not in ("article", "main"):
        least, x = max(10.0, best.score * 0.2), best
        while x.parent is not None and x.tag not in WANTED and x.tag != "#root" and (x is best or x.parent.tag not in WANTED and x.parent.tag != "#root"):
            at = next(k for k, c in enumerate(x.parent.children) if c is x)
            before, after = ([c for c in part if _beside(c, least)] for part in (x.parent.children[:at], x.parent.children[at + 1 :]))
            top.extendleft(reversed(before))
            top.extend(after)
            x = x.parent
    elif best.parent is not None and best.tag == "article":
        least = max(10.0, best.score * 0.2)
        top = [c for c in best.parent.children if c is best or isinstance(c, Node) and not c.unwanted and (c.score >= least or c.tag == "p" and c.length > 80 and c.linked < 0.25 * c.length)]
    return "\n\n".join(text for text, _ in _blocks(top, lambda x: True))


def extract_pages(pages: DataFrame, source: str = "html") -> DataFrame:
    """page_id, url, text per row of pages.

    Null or empty html gives an empty text; broken markup and cut off pages give what they have; repeated rows and null
    ids and urls stay; other columns are not read. Each page is one row's work: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "html"):
            texts = [extract(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kept = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col(source).cast("string").alias("html"))
    return kept.mapInArrow(run, f"page_id {kept.schema['page_id'].dataType.simpleString()}, url string, text string")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages and their lengths in code points."""
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
