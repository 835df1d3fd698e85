"""n-gram Jaccard join: documents linked when their sets of word 5-grams overlap enough.

Candidates: sets that are similar at t have at least c = t n of the tokens of either one, n being its size. So of a set's
tokens in the order of their hashes, the first n - c + s hold the s smallest common ones: similar sets of any size share
s tokens or more of their sketches, which have that length, with s = SHARED (c in smaller sets). Sets that share fewer
with all others go. The rest have longer sketches, with s = LONGER % of c; of their tokens, in order of their frequency
there, the s - 1 most frequent ones aren't needed: similar sets meet at another. That keeps passages that many documents
share out of the search; no link is missed, as c - s never falls with n.
Sets that share one of the others form a group; groups with one smallest member are taken together, and cut into blocks
of bounded rows and bytes.
In a block a signature tree is built: leaves and inner nodes hold the OR of token bitmaps and the range of set sizes. Two
trees (or one with itself) are walked together; node pairs whose largest possible overlap is too small are left out, as
are pairs already joined. What remains is verified on the exact sets. Two passes contract groups of copies: one in the
parts of a group alone, each set in one group, and one with a set per component and group. The last looks at all
documents of the groups that still hold several components; the largest of these isn't compared with itself, so copies
of a row grow with what stands outside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.shared import content_key, discard, in_slices, mix, small, table, utf8, window_hashes, with_keys, word_hashes, written

SHARED, LONGER = 20, 35
BLOCK_ROWS, BLOCK_TOKENS = 2048, 1 << 20
LEAF, FAN = 8, 8
#: Bytes of texts that a worker hashes at once: its memory grows with them.
SLICE = 1 << 18
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles, end to end, and where each text's begin."""
    words, first = word_hashes([t.translate(_LOWER) for t in texts])
    h, ok = window_hashes(words, first, k)
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), sizes)
    h, doc = h[ok], doc[ok]
    for short in range(1, k):  # fewer words than k: the whole sequence is the one shingle
        which = np.flatnonzero(sizes == short)
        if len(which):
            h = np.concatenate((h, window_hashes(words, first, short)[0][first[which]]))
            doc = np.concatenate((doc, which))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
    return h[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def _exploded(percent: int):
    """(cid, h) for each token in the longer sketches of sets (cid, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "tokens", SLICE):
            h = [np.frombuffer(x, np.int64) for x in b.column("tokens").to_pylist()]
            h = [x[: len(x) - common + _longer(common)] for x in h for common in [-(-len(x) * percent // 100)]]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column("cid")), [len(x) for x in h])), pa.array(np.concatenate(h) if h else np.zeros(0, np.int64))], ["cid", "h"])

    return run


def _longer(common: int) -> int:
    """How many tokens similar sets share in the longer sketches, `common` being those that they share at all."""
    return max(min(common, SHARED), -(-common * LONGER // 100))


def _fingerprints(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """16 bytes for each set, equal for equal sets."""
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64))) for salt in (0x51ED, 0xA3B1C7)]
    halves = np.stack([mix(s[first[1:]] - s[first[:-1]]) for s in sums], axis=1).astype(">u8")
    return [x.tobytes() for x in halves]


def sketches(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, __k1, __k2 (of the text), n, print (the set's fingerprint), sketch (its smallest hashes).

    Of n tokens, a similar set has c = percent % or more; the sketch holds n - c + min(c, SHARED).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "text", SLICE):
            h, first = shingle_sets(utf8(b, "text"), k)
            n = np.diff(first)
            common = -(-n * percent // 100)
            small = [h[a : a + m].view(np.int64) for a, m in zip(first, n - common + np.minimum(common, SHARED), strict=False)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("__k1"), b.column("__k2"), pa.array(n), pa.array(_fingerprints(h, first), pa.binary()), pa.array(small, pa.list_(pa.int64()))],
                ["doc_id", "__k1", "__k2", "n", "print", "sketch"],
            )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, __k1 bigint, __k2 bigint, n bigint, print binary, sketch array<bigint>")


class Tree:
    """Signature tree over sets sorted by size; level 0 has the sets, each level above nodes of FAN (LEAF at first)."""

    def __init__(self, sets: list[np.ndarray], width: int, met: np.ndarray):
        bits = np.zeros((len(sets), width // 8), np.uint8)
        for row, s in zip(bits, sets, strict=True):
            at = (s & np.uint64(width - 1)).astype(np.int64)
            np.bitwise_or.at(row, at >> 3, (1 << (at & 7)).astype(np.uint8))
        n = np.array([len(s) for s in sets], np.int64)
        #: tokens of a set less its bits: what several tokens at one bit can add to an overlap
        spare = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, n, n, spare)]
        #: bits that all rows below a node have in `met`: nodes with a common one hold pairs that have met alone
        self.met = [met]
        while len(self.levels[-1][1]) > 1:
            bits, lo, hi, spare = self.levels[-1]
            at = np.arange(0, len(lo), LEAF if len(self.levels) == 1 else FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(spare, at)))
            self.met.append(np.bitwise_and.reduceat(self.met[-1], at))

    def children(self, level: int, node: int) -> np.ndarray:
        fan = LEAF if level == 1 else FAN
        return np.arange(node * fan, min((node + 1) * fan, len(self.levels[level - 1][1])))


class Joined:
    """Union-find over the rows of a block."""

    def __init__(self, labels: list[int]):
        seen: dict[int, int] = {}
        self.up = [seen.setdefault(x, i) for i, x in enumerate(labels)]

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def all_one(self, rows: list[int]) -> bool:
        return len({self.root(int(r)) for r in rows}) == 1

    def join(self, i: int, j: int, sets: list[np.ndarray], percent: int) -> bool:
        """Joins rows i and j if they are apart and similar, and says so."""
        ri, rj = self.root(i), self.root(j)
        if ri == rj or not similar(sets[i], sets[j], percent):
            return False
        self.up[max(ri, rj)] = min(ri, rj)
        return True


def _possible(a: Tree, la: int, xs: np.ndarray, b: Tree, lb: int, ys: np.ndarray, percent: int) -> np.ndarray:
    """Which of the node pairs (xs[i], ys[i]) can hold sets that are similar enough and haven't met, by sizes and bitmaps."""
    (bits_a, lo_a, hi_a, spare_a), (bits_b, lo_b, hi_b, spare_b) = a.levels[la], b.levels[lb]
    ok = (100 * hi_a[xs] >= percent * lo_b[ys]) & (100 * hi_b[ys] >= percent * lo_a[xs]) & ~(a.met[la][xs] & b.met[lb][ys]).any(axis=1)
    at = np.flatnonzero(ok)
    if len(at):
        x, y = xs[at], ys[at]
        most = np.bitwise_count(bits_a[x] & bits_b[y]).sum(axis=1, dtype=np.int64) + np.minimum(spare_a[x], spare_b[y])
        most = np.minimum(most, np.minimum(hi_a[x], hi_b[y]))
        ok[at] = (100 + percent) * most >= percent * (lo_a[x] + lo_b[y])
    return ok


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _masks(earlier: list[np.ndarray]) -> np.ndarray:
    """For each row the bits of its groups before this one: rows with a common bit have met there."""
    known, at = np.unique(np.concatenate(earlier), return_inverse=True)
    bits = np.zeros((len(earlier), max(1, -(-len(known) // 8))), np.uint8)
    row = np.repeat(np.arange(len(earlier)), [len(x) for x in earlier])
    np.bitwise_or.at(bits, (row, at >> 3), (1 << (at & 7)).astype(np.uint8))
    return bits


def join_block(sets: list[np.ndarray], labels: list[int], side: np.ndarray, crossed: bool, percent: int, earlier: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that join the block's labels: all pairs of the rows, or those of side 0 with side 1 if crossed.

    earlier: the groups before this one in which each row is; pairs that have one in common are left to it.
    """
    links: list[tuple[int, int]] = []
    joined = Joined(labels)
    met = _masks(earlier) if earlier is not None else np.zeros((len(sets), 1), np.uint8)
    # Within a factor of 2 in size bitmaps have one width; larger sets stand beside smaller ones of the class below too.
    sizes = np.array([len(s) for s in sets])
    classes = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for c in np.unique(classes):
        near = np.flatnonzero((classes == c) | (classes == c + 1) & (percent * sizes <= 100 * 2.0**c))
        near = near[np.argsort(sizes[near], kind="stable")]
        left, right = (near[side[near] == 0], near[side[near] == 1]) if crossed else (near, near)
        if not len(left) or not len(right):
            continue
        width = max(64, 8 << int(c))
        a = Tree([sets[i] for i in left], width, met[left])
        b = Tree([sets[i] for i in right], width, met[right]) if crossed else a
        stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
        while stack:
            la, x, lb, y = stack.pop()
            if la == 0 and lb == 0:
                i, j = int(left[x]), int(right[y])
                if (classes[i] == c or classes[j] == c) and (crossed or x != y) and joined.join(i, j, sets, percent):
                    links.append((i, j))
                continue
            if la <= 1 and lb <= 1 and joined.all_one([left[v] for v in (a.children(1, x) if la else [x])] + [right[v] for v in (b.children(1, y) if lb else [y])]):
                continue
            open_a, open_b = la >= lb and la > 0, not crossed or lb > la
            xs, na = (a.children(la, x), la - 1) if open_a else (np.array([x]), la)
            ys, nb = (b.children(lb, y), lb - 1) if open_b else (np.array([y]), lb)
            xs, ys = np.repeat(xs, len(ys)), np.tile(ys, len(xs))
            if not crossed:  # one tree: both nodes open at once, each pair of nodes is met once
                xs, ys = xs[xs <= ys], ys[xs <= ys]
            fit = _possible(a, na, xs, b, nb, ys, percent)
            stack += [(na, int(p), nb, int(q)) for p, q in zip(xs[fit][::-1], ys[fit][::-1], strict=True)]
    return links


def _block_links(percent: int):
    """Links found in each block; a block's rows, (h, p, q, side, cid, label, earlier, tokens), stand together."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        h, p, q = rows[0][:3]
        sets, earlier = [np.frombuffer(r[7], np.uint64) for r in rows], [np.array(r[6], np.int64) for r in rows]
        side = np.array([r[3] for r in rows])
        found = join_block(sets, [r[5] for r in rows], side, p != q, percent, earlier)
        return [(rows[i][4], rows[j][4]) for i, j in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in in_slices(batches, "tokens", SLICE):  # a worker holds a block's rows and a slice's
            links: list[tuple[int, int]] = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and rows[-1][:3] != r[:3]:
                    links += solve(rows)
                    rows = []
                rows.append(r)
            yield pack(links)
        yield pack(solve(rows) if rows else [])

    def pack(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def blocks_of(groups: DataFrame, alone: bool = False) -> DataFrame:
    """Rows (h, p, q, side, cid, label, earlier) of blocks (h, p, q) for groups (h, cid, label, n, earlier), of which one may hold any share.

    A group's rows of the label that has most, and all others, are each cut by a hash of cid into parts of about BLOCK_ROWS
    rows and BLOCK_TOKENS tokens. Each pair of parts but those of that label's is a block, so a task holds two parts at
    most, no pair of different labels is lost, and rows of one label are copied once for each part of the others. With
    `alone`, each part is a block and no pair of parts is: for a first contraction.
    """
    if alone:
        size = groups.groupBy("h").agg(F.lit(None).cast("bigint").alias("main"), F.lit(0).alias("large"), F.count("*").alias("rows"), F.sum("n").alias("tokens"))
        size = size.select("h", "main", "large", _parts("rows", "tokens").alias("small"), "rows")
    else:
        labels = groups.groupBy("h", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"))
        size = labels.groupBy("h").agg(F.max(F.struct("rows", "label", "tokens")).alias("x"), F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"))
        size = size.select("h", F.col("x.label").alias("main"), _parts("x.rows", "x.tokens").alias("large"), _parts(F.col("rows") - F.col("x.rows"), F.col("tokens") - F.col("x.tokens")).alias("small"), "rows")
    cut = groups.drop("n").join(size.where("rows > 1").drop("rows"), "h")
    main, place = F.coalesce(F.col("label") == F.col("main"), F.lit(False)), F.xxhash64(F.lit(5), "cid")
    mine = F.when(main, F.col("small") + F.pmod(place, "large")).otherwise(F.pmod(place, "small")).cast("int")
    if alone:
        others = F.array("mine")
    else:
        others = F.sequence(F.lit(0), F.when(F.col("mine") >= F.col("small"), F.col("small")).otherwise(F.col("small") + F.col("large")) - 1)
    dealt = cut.withColumn("mine", mine).withColumn("other", F.explode(others))
    return dealt.select("h", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "cid", "label", "earlier")


def block_links(groups: DataFrame, sets: DataFrame, percent: int, alone: bool = False) -> DataFrame:
    """Links (a, b) among the sets of each group, as far as they join labels and stand in one of the group's blocks."""
    # Few rows of hashes go to the sets, instead of all sets to them; many meet in a shuffle.
    blocks = small(written(blocks_of(groups, alone), "blocks"), 200_000)
    full = sets.select("cid", "tokens").join(blocks, "cid").select("h", "p", "q", "side", "cid", "label", "earlier", "tokens")
    return full.repartition("h", "p", "q").sortWithinPartitions("h", "p", "q").mapInArrow(_block_links(percent), "a bigint, b bigint")


def _parts(rows, tokens) -> Column:
    """Into how many parts so many rows and tokens are cut; one at least."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.greatest(F.ceil(col(rows) / BLOCK_ROWS), F.ceil(col(tokens) / BLOCK_TOKENS), F.lit(1)).cast("int")


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(cid, root) for each end of links (a, b): root is the smallest cid reachable.

    Large-star and small-star steps on tables: each round every node's larger neighbours, then its smaller ones, are tied
    to the smallest neighbour, until nothing changes. Nothing but two figures a round comes to the driver.
    """
    edges, before = written(links.where("a != b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), label), None
    while True:
        figures = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(figures) == before:
            return edges.select(F.col("u").alias("cid"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("cid"), F.col("v").alias("root")).distinct())
        before = tuple(figures)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        old, edges = edges, written(small, label)
        discard(old)


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "cid", "left").withColumn("label", F.coalesce("root", "cid")).drop("root")


def _tied(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots with further links."""
    links = written(links, "links")
    if links.isEmpty():
        return roots
    return components(roots.select(F.col("cid").alias("a"), F.col("root").alias("b")).unionByName(links))


def _several(rows: DataFrame) -> DataFrame:
    """Rows (h, cid, n, label) of groups with several labels."""
    several = rows.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x != y").select("h", "n")
    return written(with_keys(rows, written(several, "several"), ["h"], "n", ["cid"]), "open")


def _gathered(rows: DataFrame) -> DataFrame:
    """Rows (h, cid, n, label) of groups, those with one smallest member taken together under it as h.

    Groups that hold much the same sets mostly share it, so a set is in few groups then, and each group is still whole.
    """
    least = rows.groupBy("h").agg(F.min("cid").alias("least"), F.count("*").alias("n"))
    named = with_keys(rows, written(least, "least"), ["h"], "n", ["cid"], keep=["least"])
    return named.select(F.col("least").alias("h"), "cid", "n", "label").distinct()


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 75, text: str = "text", inside: bool = False) -> DataFrame:
    """doc_id, __k1, __k2 (content_key of the text), n_shingles, component_id (smallest doc_id reachable) per row of docs.

    Words split at ASCII white space, A-Z lower-cased; a text of fewer than k words is one shingle; null, empty and blank
    texts have empty sets, are linked with nothing and keep their own id. Rows with equal sets are one class and always
    linked. Null ids are passed over for the smallest id (null if a component has no other). Other columns are not read.
    No rows give no rows. With `inside` there is a column label too, a number of the component (null for empty sets).
    """
    source = docs.select("doc_id", *content_key(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    whole = written(sketches(source, k, percent), "sketches")
    base = written(whole.drop("sketch"), "sets")
    row = F.struct("doc_id", "__k1", "__k2")
    classes = whole.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("least"), F.min(row).alias("row"), F.min("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")  # as written, the numbers stay
    discard(whole)
    needed = F.least(F.lit(SHARED), F.ceil(F.col("n") * percent / 100)).cast("int")
    tokens = classes.select("cid", F.explode("sketch").alias("h"))
    often = written(tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "often")
    hits = with_keys(tokens, often, ["h"], "df", ["cid"]).groupBy("cid").agg(F.count("*").alias("hits"), F.min("h").alias("least"))
    hits = hits.join(classes.select("cid", "n", needed.alias("needed"), F.size("sketch").alias("length")), "cid").where("hits >= needed")
    enough = written(hits.select("cid", "n", (F.col("hits") * 2 >= F.col("length")).alias("strong"), "least"), "enough")
    discard(often)
    old, classes = classes, written(classes.drop("sketch"), "classes")
    discard(old)
    # The exact sets of all classes with enough shared hashes, each from one row's text.
    same = [*content_key(F.col("text")), F.xxhash64("doc_id").alias("__i")]
    need = enough.select("cid").join(classes.select("cid", "row"), "cid").select("cid", F.col("row.__k1").alias("__k1"), F.col("row.__k2").alias("__k2"), F.xxhash64("row.doc_id").alias("__i"))
    key, need = ["__k1", "__k2", "__i"], small(written(need, "need"))
    texts = source.select(*same, "text").join(need, key).groupBy(*key, "cid").agg(F.first("text").alias("text")).select("cid", "text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "text", SLICE):
            h, first = shingle_sets(utf8(b, "text"), k)
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array([h[a:z].tobytes() for a, z in zip(first, first[1:], strict=False)], pa.binary())], ["cid", "tokens"])

    sets = written(texts.mapInArrow(full, "cid bigint, tokens binary"), "sets")
    # The tokens of a set's longer sketch that others' have, without the most frequent s - 1 of all of them.
    tokens = sets.mapInArrow(_exploded(percent), "cid bigint, h bigint")
    often = written(tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "often")
    hits = with_keys(tokens, often, ["h"], "df", ["cid"], keep=["df"]).groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("x")).join(enough.select("cid", "n"), "cid")
    common = F.ceil(F.col("n") * percent / 100)
    unshared = F.col("n") - common + F.greatest(F.least(common, F.lit(SHARED)), F.ceil(common * LONGER / 100)) - F.size("x")
    rarest = (F.col("n") - common + 1 - unshared).cast("int")
    shared = written(hits.where(rarest > 0).select("cid", "n", F.explode(F.slice("x.h", F.lit(1), rarest)).alias("h")), "shared")
    discard(often)
    # First pass: sets with half their sketch shared, each in the group of its smallest shared hash alone.
    none = F.array().cast("array<bigint>")
    strong = enough.where("strong").select("cid", "n", F.col("least").alias("h"), F.col("cid").alias("label"), none.alias("earlier"))
    roots = components(block_links(strong, sets, percent, alone=True))
    # Second pass: of each group one set of each component, another one in each group.
    some = _gathered(_several(_labelled(shared, roots))).groupBy("h", "label").agg(F.min_by(F.struct("cid", "n"), F.xxhash64("h", "cid")).alias("x")).select("h", "label", "x.cid", "x.n")
    roots = _tied(roots, block_links(some.withColumn("earlier", none), sets, percent))
    # Last pass: all sets of the groups that hold several components; two sets are compared in the first group of both.
    rest = written(_gathered(_several(_labelled(shared, roots))), "rest")
    before = rest.groupBy("cid").agg(F.sort_array(F.collect_list("h")).alias("all"))
    rest = rest.join(before, "cid").withColumn("earlier", F.filter("all", lambda x: x < F.col("h"))).drop("all")
    roots = _tied(roots, block_links(rest, sets, percent))
    for x in (enough, sets, shared):
        discard(x)
    labelled = _labelled(classes.select("cid", "least"), roots)
    ids = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(ids, "label").select("cid", "component_id", "label").join(classes.select("cid", "print"), "cid")
    out = base.join(named, "print", "left")
    columns = ["doc_id", "__k1", "__k2", F.col("n").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id")]
    return out.select(*columns, *(["label"] if inside else []))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at five words and a similarity of 0.75."""
    return ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """docs with one row of each component: the one with the smallest id, of several the first by its text's hash.

    Null ids come last; rows without any other are told apart by their component alike. Of rows that are repeated, with one
    id and text, one stays, also of those with empty sets, which are linked with nothing and all stay. No rows give no rows.
    """
    names = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = ngram_components(docs, k, percent, inside=True).select("doc_id", "__k1", "__k2", F.col("label").alias("__to"))
    mine = F.struct(F.col("doc_id").isNull().alias("__last"), "doc_id", "__k1", "__k2")
    one = found.where("__to is not null").groupBy("__to").agg(F.min(mine).alias("x")).select("x.doc_id", "x.__k1", "x.__k2")
    kept = one.unionByName(found.where("__to is null").select("doc_id", "__k1", "__k2")).select("__k1", "__k2", F.xxhash64("doc_id").alias("__i")).distinct()
    # Repeated rows meet at the join's key; the first of them, as the rows stand in their table, is kept.
    whole = F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row")
    keyed = docs.select(whole, *content_key(text), F.xxhash64("doc_id").alias("__i"))
    key = ["__k1", "__k2", "__i"]
    return keyed.join(kept, key, "left_semi").groupBy(*key).agg(F.first("__row").alias("__row")).select("__row.*")
