"""Removal of repeated passages by level-wise doubling.

Window lengths double up to the wanted one (9, 18, 35). At each length a window is stood for by its minimiser: the place of
the smallest sub-window hash of that length. Equal windows have equal minimisers, so a window whose minimiser occurs once
in the corpus is unique and goes; only what is left is looked at at twice the length, until nothing is left or the wanted
length is reached. There neighbouring windows that share their minimisers are one run: runs of equal words are classes,
and a class that occurs twice repeats all its windows. The windows of runs that occur once are compared one by one with
those of one run of each other class that has their minimiser.
Words and windows are compared by hashes: 64 bits a word, two hashes of these, 128 bits, for runs and whole windows.
Texts are moved once to those documents that the first length leaves; beyond that only hashes and places are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.shared import SPACES, content_key, discard, in_slices, mix, sliding, span_hashes, table, utf8, window_hashes, with_keys, word_hashes, written

_MAX = np.iinfo(np.uint64).max


def levels(window: int, first: int = 9) -> list[int]:
    """Window lengths, each at most twice the one before."""
    out = [window]
    while out[0] > first and out[0] > 1:
        out.insert(0, -(-out[0] // 2))
    return out


def _places(words: np.ndarray, first: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of `length` words, each window's smallest, which windows count, and which places are minimisers of these."""
    hashes, ok = window_hashes(words, first, length)
    hashes = np.where(ok, hashes, _MAX)
    whole = np.arange(len(words)) + window <= np.repeat(first[1:], np.diff(first))
    w = window - length + 1
    least = np.full(len(words), _MAX, np.uint64)
    least[: max(0, len(words) - w + 1)] = sliding(hashes, w)
    most = sliding(np.concatenate((np.zeros(w - 1, np.uint64), np.where(whole, least, 0).astype(np.uint64))), w, np.maximum)
    return hashes, least, whole, ok & (most == hashes)


def _minimisers(length: int, window: int):
    """Per text its distinct minimisers at this length and their number of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "text"):
            words, first = word_hashes(utf8(b, "text"))
            hashes, _, _, chosen = _places(words, first, length, window)
            at = np.flatnonzero(chosen)
            doc = np.searchsorted(first, at, "right") - 1
            h = hashes[at]
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))))
            keys = [pa.array(np.asarray(b.column(k), np.int64)[doc[new]]) for k in ("__k1", "__k2")]
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(np.diff(np.append(new, len(h)))), *keys], ["h", "n", "__k1", "__k2"])

    return run


def _first_places(words: np.ndarray, first: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `length` words, and for each whole window the first place of its smallest."""
    hashes, ok = window_hashes(words, first, length)
    order = np.argsort(np.where(ok, hashes, _MAX), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    out = np.zeros(len(words), np.int64)
    w = window - length + 1
    out[: max(0, len(words) - w + 1)] = order[sliding(rank, w)]
    return hashes, out


_RUN = pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("m", pa.list_(pa.int64())), ("e1", pa.int64()), ("e2", pa.int64())])
_RUN_SQL = "struct<lo:int,hi:int,m:array<bigint>,e1:bigint,e2:bigint>"


def _runs(length: int, inner: list[int], window: int):
    """Texts with runs of the windows whose minimisers at `length` are in column found.

    lo, hi: a run's first and last start; m: its minimisers at each of the inner lengths; e1, e2: hash of its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "text"):
            words, first = word_hashes(utf8(b, "text"))
            _, least, whole, _ = _places(words, first, length, window)
            for k, found in enumerate(b.column("found")):
                lo, hi = first[k], first[k + 1]
                whole[lo:hi] &= np.isin(least[lo:hi], np.asarray(found.values, np.int64).view(np.uint64))
            at = np.flatnonzero(whole)
            doc = np.searchsorted(first, at, "right") - 1
            level = [_first_places(words, first, x, window) for x in inner]
            apart = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
            for _, place in level:
                apart |= place[at[1:]] != place[at[:-1]]
            new = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), apart)))
            lo, hi = at[new], at[np.append(new[1:], len(at)) - 1] if len(at) else at
            marks = np.stack([h[place[lo]] for h, place in level], axis=1)
            # The minimiser's place in the run counts too: equal words elsewhere may be cut into runs at other places.
            lead = sum((place[lo] - lo).astype(np.uint64) * np.uint64(1009**k) for k, (_, place) in enumerate(level))
            ends = [(mix(span_hashes(words, lo, hi + window, salt) + lead)).view(np.int64) for salt in (7, 8)]
            flat = pa.array(marks.ravel().view(np.int64))
            ms = pa.ListArray.from_arrays(pa.array(np.arange(len(lo) + 1, dtype=np.int32) * len(inner)), flat)
            own = first[doc[new]]
            cells = pa.StructArray.from_arrays([pa.array((lo - own).astype(np.int32)), pa.array((hi - own).astype(np.int32)), ms, *map(pa.array, ends)], fields=list(_RUN))
            cut = np.searchsorted(doc[new], np.arange(b.num_rows + 1)).astype(np.int32)
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in ("__k1", "__k2", "copies", "text")), pa.ListArray.from_arrays(pa.array(cut), cells)], ["__k1", "__k2", "copies", "text", "runs"])
            yield out.filter(pa.array(np.diff(cut) > 0))

    return run


def _windows(window: int):
    """The 128-bit hashes of all windows in a text's spans (lo, hi, alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "text", 1 << 20):
            words, first = word_hashes(utf8(b, "text"))
            spans = b.column("spans")
            row = np.repeat(np.arange(b.num_rows), np.asarray(spans.value_lengths(), np.int64))
            lo, hi, alone = (np.asarray(spans.flatten().field(k)) for k in range(3))
            n = (hi - lo + 1).astype(np.int64)
            start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo, n)
            doc = np.repeat(row, n)
            at = first[doc] + start
            hashes = [pa.array(window_hashes(words, first, window, salt)[0][at].view(np.int64)) for salt in (0, 7)]
            yield pa.RecordBatch.from_arrays([*hashes, pa.array(np.asarray(b.column("rid"), np.int64)[doc]), pa.array(start.astype(np.int32)), pa.array(np.repeat(alone, n))], ["h", "g", "rid", "start", "alone"])

    return run


def _kept(window: int):
    """Words covered by the windows that start in runs (lo, hi), as spans in words, and the text of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "text"):
            removed, kept, spans = [], [], []
            for text, runs in zip(utf8(b, "text"), b.column("gone"), strict=True):
                words = text.split()  # of bytes: white space is \x20 and \x09-\x0D alone
                lo, hi = (np.asarray(runs.values.field(k), np.int64) for k in range(2))
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, lo, 1)
                np.add.at(edges, hi + window, -1)
                gone = np.cumsum(edges[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(words[i] for i in np.flatnonzero(~gone)).decode())
                spans.append([{"start": int(x), "end": int(y)} for x, y in turn.reshape(-1, 2)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("__k1"), b.column("__k2"), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)], ["__k1", "__k2", "n_removed", "kept", "spans"])

    return run


def _repeated(rows: DataFrame, on: list[str], label: str) -> DataFrame:
    """The keys of rows whose n add up to more than one, written: (on, n)."""
    return written(rows.groupBy(*on).agg(F.sum("n").alias("n")).where("n > 1"), label)


def find_repeats(docs: DataFrame, window: int = 35, text: str = "text") -> DataFrame:
    """The distinct texts of docs that have words in a window whose word sequence also starts elsewhere.

    Columns: __k1, __k2 (content_key of the text), n_removed, kept (the other words, joined by one space), spans in
    words. A text that occurs twice repeats itself; texts shorter than a window, null and empty ones have no windows;
    no rows give no rows. Only the text column is read, so ids and other columns don't matter.
    """
    lengths = levels(window)
    length, inner = lengths[0], lengths[1:-1] or lengths[:1]
    source = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = source.select(*content_key(F.col("text")), "text")
    key = ["__k1", "__k2"]
    # The first length. Computed for the counts and for the join: a table of the marks would take more disk.
    marks = keyed.mapInArrow(_minimisers(length, window), "h bigint, n bigint, __k1 bigint, __k2 bigint")
    again = _repeated(marks, ["h"], f"again-{length}")
    found = written(with_keys(marks.select("h", *key), again, ["h"], "n", key).groupBy(*key).agg(F.collect_set("h").alias("found")), f"found-{length}")
    discard(again)
    texts = keyed.groupBy(*key).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    texts = texts.join(found, key).mapInArrow(_runs(length, inner, window), f"__k1 bigint, __k2 bigint, copies bigint, text string, runs array<{_RUN_SQL}>")
    texts = written(texts.withColumn("rid", F.monotonically_increasing_id()), "candidates")  # as written, the numbers stay
    discard(found)
    runs = texts.select("rid", F.col("copies").alias("n"), F.explode("runs").alias("x")).select("rid", "n", "x.*")
    # The lengths between: runs whose minimiser occurs once go.
    for k, length in enumerate(inner[:-1]):
        at = runs.withColumn("h", F.col("m")[k])
        again = _repeated(at, ["h"], f"again-{length}")
        runs = written(with_keys(at, again, ["h"], "n", ["rid", "lo"]).drop("h"), f"runs-{length}")
        discard(again)
    runs = runs.select("rid", "n", "lo", "hi", F.col("m")[len(inner) - 1].alias("h"), "e1", "e2")
    # The wanted length: classes of equal runs, and the minimisers of which one class stands alone among others.
    same = ["h", "e1", "e2"]
    classes = written(runs.groupBy(*same).agg(F.sum("n").alias("n"), F.min(F.struct("rid", "lo", "hi")).alias("one")), "classes")
    several = classes.groupBy("h").agg(F.count("*").alias("n"), F.max((F.col("n") == 1).cast("int")).alias("alone")).where("n > 1 and alone = 1")
    several = written(several.select("h", "n"), "several")
    probes = with_keys(classes.select("h", "one", (F.col("n") == 1).alias("alone")), several, ["h"], "n", ["one"])
    probes = probes.groupBy("one.rid").agg(F.collect_list(F.struct("one.lo", "one.hi", "alone")).alias("spans"))
    windows = written(texts.select("rid", "text").join(probes, "rid").mapInArrow(_windows(window), "h bigint, g bigint, rid bigint, start int, alone boolean"), "windows")
    again = windows.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("alone").alias("alone")).where("n > 1 and alone")
    again = written(again.select("h", "g", "n"), "again-windows")
    single = with_keys(windows.where("alone"), again, ["h", "g"], "n", ["rid", "start"]).select("rid", F.col("start").alias("lo"), F.col("start").alias("hi"))
    whole = with_keys(runs, written(classes.where("n > 1").select(*same, "n"), "whole"), same, "n", ["rid", "lo"]).select("rid", "lo", "hi")
    gone = written(whole.unionByName(single).groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("gone")), "gone")
    for x in (classes, several, windows, again):
        discard(x)
    return texts.drop("runs").join(gone, "rid").mapInArrow(_kept(window), "__k1 bigint, __k2 bigint, n_removed bigint, kept string, spans array<struct<start:bigint,end:bigint>>")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated windows of 35 words."""
    docs = table(spark, sf_dir, "documents")
    found = find_repeats(docs).select("__k1", "__k2", "n_removed", F.sha2("kept", 256).alias("__kept"))
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " "))
    all_docs = docs.select("doc_id", *content_key(F.col("text")), plain.alias("__plain")).select(
        "doc_id", "__k1", "__k2", F.when(F.col("__plain") == "", 0).otherwise(F.size(F.split("__plain", " "))).cast("long").alias("n_words"), F.sha2("__plain", 256).alias("__all")
    )
    return all_docs.join(found, ["__k1", "__k2"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("__kept", "__all").alias("kept_sha256"))
