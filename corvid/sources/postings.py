"""Postings as compressed blocks: one binary row a term and block of documents, coded and decoded in Arrow batches.

A row holds its postings' gaps, counts and document lengths as varints, each kind as one run of bytes: with the lengths, which
are a third of it, ranking joins no table of documents. Long rows also have their first and last id, and say, for each range of documents in them, which (count, length) no other posting there exceeds in both: whatever the
parameters of the ranking, the range's largest part is that of one of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.text import slices, split_words
from corvid.operators.lexical import BLOCK, RANGE_BITS

#: Bytes of texts of which a task makes runs at once, and what a run holds: a row of some documents, not yet of the whole block.
CUT = 4 << 20
RUN = "term string, block bigint, n bigint, ids binary, tfs binary, dls binary"
#: Parts into which a bucket's terms are dealt, so that few blocks keep all cores busy.
PARTS = 4
#: Rows of fewer postings carry no points and no first and last id: they are decoded to know their parts.
LONG = 64
ROW = "term string, block bigint, n bigint, first_id bigint, last_id bigint, ids binary, tfs binary, dls binary, points array<struct<range:bigint,tf:bigint,dl:bigint>>, tokens bigint"
_POINT = pa.struct([("range", pa.int64()), ("tf", pa.int64()), ("dl", pa.int64())])


def varints(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary per segment of non-negative values (ends: where segments end): 7 bits a byte, the high bit if more follow."""
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        sizes += values >= 1 << bits
    to = np.cumsum(sizes)
    out = np.zeros(int(to[-1]) if len(to) else 0, np.uint8)
    left, at, live = values.astype(np.uint64), to - sizes, np.arange(len(values))
    while len(live):
        more = left[live] >= 128
        out[at[live]] = (left[live] & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        live = live[more]
        left[live] >>= np.uint64(7)
        at[live] += 1
    offsets = np.concatenate(([0], to))[np.concatenate(([0], ends))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def from_varints(data: bytes | np.ndarray) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128) + 1
    if not len(ends):
        return np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    raw = raw[: ends[-1]]
    shift = (np.arange(len(raw)) - np.repeat(starts, ends - starts)) * 7
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, starts)


def _bytes(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column, one value after the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def coded_gaps(lists: DataFrame) -> DataFrame:
    """(term, block, data): the gaps of each postings block (term, block, doc_id, gap) as varints; a block is one row of BLOCK
    gaps at most."""

    def coded(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        codes = t.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        block = np.asarray(t.column("block"))
        first = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (block[1:] != block[:-1]))))
        data = varints(np.asarray(t.column("gap"), np.int64), np.append(first[1:], len(codes)))
        return pa.RecordBatch.from_arrays([t.column("term").combine_chunks().take(pa.array(first)), pa.array(block[first]), data], ["term", "block", "data"])

    return lists.select("term", "block", "doc_id", "gap").sortWithinPartitions("term", "block", "doc_id").mapInArrow(lambda batches: (coded(t) for t in _whole(batches)), "term string, block bigint, data binary")


def decoded_gaps(rows: DataFrame) -> DataFrame:
    """(term, block, n, gaps, bytes) of coded_gaps' rows: how many gaps stand in the bytes, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(pc.binary_length(b.column("data")), np.int64)
            upto, at = np.cumsum(sizes), 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 20), "right")))
                part, here, at = b.slice(at, to - at), sizes[at:to], to
                raw = np.frombuffer(b"".join(part.column("data").to_pylist()), np.uint8)
                ends = np.cumsum(here)
                upto_n = np.concatenate(([0], np.cumsum(raw < 128)))[np.concatenate(([0], ends))]
                sums = np.concatenate(([0], np.cumsum(from_varints(raw))))[upto_n]
                yield pa.RecordBatch.from_arrays([part.column("term"), part.column("block"), pa.array(np.diff(upto_n)), pa.array(np.diff(sums)), pa.array(here)], ["term", "block", "n", "gaps", "bytes"])

    return rows.select("term", "block", "data").mapInArrow(run, "term string, block bigint, n bigint, gaps bigint, bytes bigint")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole (term, block) groups, from rows in that order."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = b.slice(b.num_rows - 1).to_pylist()[0]
        here = np.asarray(pc.and_(pc.equal(b.column("term"), last["term"]), pc.equal(b.column("block"), last["block"])))
        other = np.flatnonzero(~here)
        if len(other):
            cut = int(other[-1]) + 1
        else:
            first = held[0].slice(0, 1).to_pylist()[0] if held else last
            cut = 0
            if (first["term"], first["block"]) != (last["term"], last["block"]):
                yield pa.Table.from_batches(held)
                held = []
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held, b = [], b.slice(cut)
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _points(seg: np.ndarray, doc: np.ndarray, tf: np.ndarray, dl: np.ndarray, n: np.ndarray) -> pa.Array:
    """Per segment the points of its ranges, null for short ones."""
    long = n >= LONG
    pick = np.flatnonzero(long[seg])
    s, r, t, d = seg[pick], doc[pick] >> RANGE_BITS, tf[pick], dl[pick]
    order = np.lexsort((d, -t, r, s))
    s, r, t, d = s[order], r[order], t[order], d[order]
    if len(s):
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (r[1:] != r[:-1])))
        # The least length so far within a range: each range's lengths lie below those of the range before.
        low = d - np.cumsum(new) * (int(d.max()) + 1)
        best = np.minimum.accumulate(low)
        keep = new | np.concatenate(([True], low[1:] < best[:-1]))
        s, r, t, d = s[keep], r[keep], t[keep], d[keep]
    ends = np.concatenate(([0], np.searchsorted(s, np.arange(len(n)), "right")))
    values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (r, t, d)], ["range", "tf", "dl"])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), pa.int32(), mask=np.concatenate((~long, [False]))), values)


def _runs(term: pa.Array, codes: np.ndarray, block: np.ndarray, doc: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Where each (term, block) of sorted postings begins, and the columns of RUN; codes number the terms."""
    first = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (block[1:] != block[:-1])))[: len(doc)])
    ends = np.append(first[1:], len(doc))[: len(first)]
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first] - block[first] * BLOCK
    return first, [term.take(pa.array(codes[first])), pa.array(block[first]), pa.array(ends - first), varints(gap, ends), varints(tf, ends), varints(dl, ends)]


def _rows(term: pa.Array, codes: np.ndarray, block: np.ndarray, doc: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> pa.RecordBatch:
    """Rows for whole (term, block) groups of sorted postings."""
    first, (terms, blocks, sizes, ids, tfs, dls) = _runs(term, codes, block, doc, tf, dl)
    n = np.asarray(sizes)
    ids_at = [pa.array(doc[at], mask=n < LONG) for at in (first, first + n - 1)]
    tokens = pa.array(np.add.reduceat(tf, first) if len(first) else tf)
    return pa.RecordBatch.from_arrays([terms, blocks, sizes, *ids_at, ids, tfs, dls, _points(np.repeat(np.arange(len(first)), n), doc, tf, dl, n), tokens], [x.split(" ")[0] for x in ROW.split(", ")])


def encode(tf: DataFrame, buckets: int) -> DataFrame:
    """tf (term, doc_id, tf, dl; doc_ids are whole numbers, one row a term and document) as rows of ROW, and their bucket.

    A row has at most BLOCK postings, so a common term's lie in many rows and tasks; a task holds a row's postings at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            t = t.combine_chunks()
            term = t.column("term").combine_chunks().dictionary_encode()
            yield _rows(term.dictionary, *(np.asarray(x, np.int64) for x in (term.indices, *(t.column(c) for c in ("block", "doc_id", "tf", "dl")))))

    rows = tf.select(bucket_of(buckets), "term", F.floor(F.col("doc_id") / BLOCK).cast("long").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"))
    dealt = rows.repartition("bucket", "block").sortWithinPartitions("term", "block", "doc_id").drop("bucket")
    return dealt.mapInArrow(run, ROW).withColumn("bucket", bucket_of(buckets))


def encode_texts(docs: DataFrame, buckets: int) -> DataFrame:
    """encode() of the words of docs (doc_id, text): rows with one doc_id and length count as one document.

    It is the runs of text_runs() that are shuffled and sorted, and not postings. A task decodes whole blocks of them, of some
    2 * BLOCK postings at once.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            t = t.combine_chunks()
            term, block, n = t.column("term").combine_chunks().dictionary_encode(), np.asarray(t.column("block")), np.asarray(t.column("n"))
            code = np.asarray(term.indices, np.int64)
            first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (block[1:] != block[:-1]))))
            ends, upto, at = np.append(first[1:], len(n)), np.cumsum(n), 0
            while at < len(n):
                fit = int(np.searchsorted(upto[ends - 1], (upto[at - 1] if at else 0) + 2 * BLOCK, "right"))
                to = int(ends[max(fit - 1, int(np.searchsorted(ends, at, "right")))])
                gap, tf, dl = (from_varints(_bytes(t.column(c).combine_chunks().slice(at, to - at))) for c in ("ids", "tfs", "dls"))
                sizes = n[at:to]
                sums = np.concatenate(([0], np.cumsum(gap)))
                begins = np.cumsum(sizes) - sizes
                b, c = np.repeat(block[at:to], sizes), np.repeat(code[at:to], sizes)
                doc = sums[1:] - np.repeat(sums[begins], sizes) + b * BLOCK
                group = np.repeat(np.searchsorted(first, np.arange(at, to), "right"), sizes)
                order = np.lexsort((dl, doc, group))
                b, c, doc, tf, dl, group = (x[order] for x in (b, c, doc, tf, dl, group))
                new = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (doc[1:] != doc[:-1]) | (dl[1:] != dl[:-1]))))
                yield _rows(term.dictionary, c[new], b[new], doc[new], np.add.reduceat(tf, new), dl[new])
                at = to

    part = F.pmod(F.shiftright(F.xxhash64("term"), 32), F.lit(PARTS))
    dealt = text_runs(docs).repartition(bucket_of(buckets), F.col("block"), part).sortWithinPartitions("term", "block")
    return dealt.mapInArrow(merge, ROW).withColumn("bucket", bucket_of(buckets))


def text_runs(docs: DataFrame) -> DataFrame:
    """Rows of RUN: of each CUT bytes of texts that a task reads, the postings of a term and block."""

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column("doc_id").null_count:
                raise ValueError("a document of an index has a doc_id")
            for at, n in slices(batch.column("text"), CUT):
                here = batch.slice(at, n)
                found, dl = split_words(here.column("text"))
                ids = np.asarray(here.column("doc_id"), np.int64)
                order = np.argsort(ids, kind="stable")
                place = np.empty(n, np.int64)
                place[order] = np.arange(n)
                term = found.dictionary_encode()
                key, tf = np.unique(np.asarray(term.indices, np.int64) * n + np.repeat(place, dl), return_counts=True)
                doc = ids[order][key % n]
                yield pa.RecordBatch.from_arrays(_runs(term.dictionary, key // n, doc // BLOCK, doc, tf, dl[order][key % n])[1], RUN.replace(",", "").split(" ")[::2])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return texts.mapInArrow(invert, RUN)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")


def decode(rows: DataFrame) -> DataFrame:
    """The postings (term, range, doc_id, tf, dl) of rows, some 2 * BLOCK at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            upto, at = np.cumsum(np.asarray(b.column("n"))), 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 2 * BLOCK, "right")))
                part, at = b.slice(at, to - at), to
                lists = [[from_varints(x) for x in part.column(c).to_pylist()] for c in ("ids", "tfs", "dls")]
                docs = [np.cumsum(x) + block * BLOCK for x, block in zip(lists[0], part.column("block").to_pylist(), strict=True)]
                of = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in docs]))
                doc = np.concatenate(docs)
                yield pa.RecordBatch.from_arrays([part.column("term").take(of), pa.array(doc >> RANGE_BITS), pa.array(doc), pa.array(np.concatenate(lists[1])), pa.array(np.concatenate(lists[2]))], ["term", "range", "doc_id", "tf", "dl"])

    return rows.select("term", "block", "n", "ids", "tfs", "dls").mapInArrow(run, "term string, range bigint, doc_id bigint, tf bigint, dl bigint")


def best_points(rows: DataFrame) -> DataFrame:
    """(term, range, tf, dl): of each range the postings that can be its best; long rows aren't decoded for them."""
    points = rows.where("points is not null").select("term", F.explode("points").alias("p")).select("term", "p.range", "p.tf", "p.dl")
    return points.unionByName(decode(rows.where("points is null")).drop("doc_id"))
