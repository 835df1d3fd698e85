"""Vector code compression: vectors become codes of eight bytes, one nearest codebook entry per part, in whole numbers.

The integer codebooks are broadcast. Arrow batches compute the distances of all parts to all entries by expanding
|x - c|^2 = |x|^2 - 2 x.c + |c|^2 with int64 matrix products and take the first smallest. Each task adds up its own parts by
entry and gives one row an entry; a grouped shuffle merges these rows, so what a round moves and what comes to the driver
depends on the codebooks' size and the tasks, not on the vectors, however often one vector is repeated.

Whole numbers of 64 bits wrap, so sums of the expansion are exact wherever the distances themselves are below 2^63: a
component x of absolute value over 2^13 is refused with an error where a distance could be more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.shared import table, with_keys, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Up to so many labels their table of sums is broadcast.
MOST_LABELS = 100_000


class Codebooks(NamedTuple):
    """One array (entries, width) of whole numbers a part, and the dimension of the vectors they were made from."""

    parts: list[np.ndarray]
    dim: int

    def sha256(self) -> str:
        """The digest of all components, in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(v) for book in self.parts for v in book.ravel().tolist()).encode()).hexdigest()


def whole(batch: pa.RecordBatch, column: str, dim: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and their vectors in whole numbers: floor(scale * x), in int64."""
    lists = batch.column(column)
    if pa.types.is_null(lists.type):
        return np.zeros(batch.num_rows, bool), np.zeros((0, dim), np.int64)
    lengths = np.asarray(lists.value_lengths().fill_null(-1))
    of_dim = np.flatnonzero(lengths == dim)
    values = lists.take(pa.array(of_dim)).flatten()
    x = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(of_dim), dim)
    good = np.isfinite(x).all(axis=1)
    keep = np.zeros(batch.num_rows, bool)
    keep[of_dim[good]] = True
    x = np.floor(x[good] * scale)
    if x.size and 4 * dim * float(np.abs(x).max()) ** 2 >= 2.0**63:
        raise ValueError(f"a component of {np.abs(x).max() / scale:g} is too large for exact distances in 64 bits over {dim} components")
    return keep, x.astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """The batches cut to some 4 MB of components."""
    step = max(1, (1 << 19) // max(1, dim))
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first entry of the book at the least squared distance, and that distance."""
    far = (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)[None, :]
    first = far.argmin(axis=1)
    return first, far[np.arange(len(x)), first]


def _kept(column: Column, dim: int) -> Column:
    """Whether a row is kept, by the same rule as whole()."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return column.isNotNull() & (F.size(column) == dim) & ~F.exists(column, odd)


def _seeds(vectors: DataFrame, entries: int) -> np.ndarray:
    """The vectors of the smallest ids, in whole numbers (entries or fewer, dimension); their length is the table's."""
    finite = F.col("v").isNotNull() & (F.size("v") > 0) & _kept(F.col("v"), F.size("v"))
    rows = vectors.where(finite).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not rows:
        return np.zeros((0, 0), np.int64)
    dim = len(rows[0]["v"])
    if any(len(r["v"]) != dim for r in rows):  # some are of another length: they are dropped
        rows = vectors.where(_kept(F.col("v"), dim)).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    return whole(pa.RecordBatch.from_pydict({"v": pa.array([r["v"] for r in rows], pa.list_(pa.float64()))}), "v", dim)[1]


def _split(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """x cut into equal consecutive parts; zeros fill up a length that they don't divide, which changes no distance."""
    wide = np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))
    return np.split(wide, parts, axis=1)


def train(vectors: DataFrame, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks from all vectors (vec_id, column).

    A codebook starts as the part of the vectors of the smallest ids; each round gives every part its nearest entry (ties:
    the lower index) and each entry the componentwise floor of its parts' mean; unused entries stay. Rows whose vector is
    null, holds null or non-finite components, is empty or of another length than that of the smallest kept id are left
    out; repeated rows count each; null ids come after all others; other columns are not read. Without rows the books are
    empty; with fewer rows than entries they have as many entries as rows.
    """
    rows = vectors.select("vec_id", F.col(column).alias("v"))
    seeds = _seeds(rows, entries)
    n, dim = seeds.shape
    books = _split(seeds, parts)
    if not n:
        return Codebooks(books, 0)
    width = books[0].shape[1]
    for _ in range(rounds):
        sent = vectors.sparkSession.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            totals, counts = np.zeros((parts, n, width), np.int64), np.zeros((parts, n), np.int64)
            done = []
            for b in _batches(batches, dim):
                _, x = whole(b, "v", dim)
                for p, (part, book) in enumerate(zip(_split(x, parts), sent.value, strict=True)):
                    entry, _ = nearest(part, book)
                    counts[p] += np.bincount(entry, minlength=n)
                    order = np.argsort(entry, kind="stable")
                    used, first = np.unique(entry[order], return_index=True)
                    if len(used):
                        totals[p, used] += np.add.reduceat(part[order], first, axis=0)
                if np.abs(totals).max() >= 1 << 61:  # beyond any likely task; the sums then go on in further rows
                    done.append((totals.copy(), counts.copy()))
                    totals[:], counts[:] = 0, 0
            for t, c in [*done, (totals, counts)]:
                p, e = np.nonzero(c)
                columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(c[p, e]), pa.array(list(t[p, e]), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "total"])

        partial = rows.select("v").mapInArrow(sums, "part int, entry int, n bigint, total array<bigint>")
        total = [F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
        for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # parts * entries rows
            books[r["part"]][r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
        sent.destroy()
    return Codebooks(books, dim)


def encode(vectors: DataFrame, books: Codebooks, column: str = "embedding") -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (the squared distances added up) of the rows that are kept.

    Rows are left out by the rules of train(); null ids and labels stay; without books there are no rows.
    """
    seen = vectors.select("vec_id", F.col("label"), F.col(column).alias("v"))
    schema = f"vec_id {seen.schema['vec_id'].dataType.simpleString()}, label {seen.schema['label'].dataType.simpleString()}, code string, error bigint"
    if not books.dim:
        return vectors.sparkSession.createDataFrame([], schema)
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, dim = sent.value
        for b in _batches(batches, dim):
            keep, x = whole(b, "v", dim)
            codes, error = np.empty((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for p, (part, book) in enumerate(zip(_split(x, len(books)), books, strict=True)):
                codes[:, p], far = nearest(part, book)
                error += far
            digits, size = codes.tobytes().hex(), 2 * len(books)
            text = [digits[i : i + size] for i in range(0, len(digits), size)]
            kept = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return seen.mapInArrow(run, schema)


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes (a written table) with label_error, the error added up over the rows of the same label; null labels are one.

    Sums are made in the map tasks first. The labels' table goes to the codes by a broadcast while it is small, else by a
    join in which labels with many rows are dealt over tasks.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("__label")
    keyed = codes.withColumn("__label", key)
    sums = written(keyed.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count("*").alias("__n")), "label-errors")
    if sums.limit(MOST_LABELS + 1).count() <= MOST_LABELS:
        out = keyed.join(F.broadcast(sums), "__label")
    else:
        out = with_keys(keyed, sums, ["__label"], "__n", ["vec_id", "code"], ["label_error"])
    return out.drop("__label", "__n")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of all vectors that are kept, their errors and the digest of the codebooks."""
    vectors = table(spark, sf_dir, "embeddings")
    books = train(vectors)
    codes = written(encode(vectors, books), "codes")
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
