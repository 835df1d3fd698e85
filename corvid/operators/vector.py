"""Nearest neighbours by L2 distance: exact in blocks, and through an index of coarse cells; graph.py has the layered graph.

Vectors and queries without an embedding are left out everywhere; embeddings of several lengths raise an error where
they meet. Ids that are repeated are rows of their own. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.operators.lexical import top_k

#: Distances that the kernel holds at a time (8 MB of doubles), however many queries and vectors there are.
HELD = 1 << 20
#: Queries that are sent to all executors at once; beyond, blocks of queries and parts of vectors meet in a shuffle.
SENT_QUERIES = 4096
PLACES = 6


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of a matrix."""
    if not len(column):
        return np.zeros((0, 0))
    sizes = np.unique(np.asarray(column.value_lengths(), np.int64))
    if len(sizes) > 1:
        raise ValueError(f"embeddings of several lengths: {sizes[:5].tolist()}")
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def squares(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of q to all of v."""
    if q.shape[1] != v.shape[1]:
        raise ValueError(f"embeddings of several lengths: {q.shape[1]}, {v.shape[1]}")
    out = q @ v.T
    out *= -2
    out += (q * q).sum(1)[:, None]
    out += (v * v).sum(1)[None, :]
    return out


def distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rounded distances of all rows of q to all of v."""
    return np.round(np.sqrt(np.maximum(squares(q, v), 0)), PLACES)


def _nearest(ids: np.ndarray, q: np.ndarray, k: int, with_self: bool, labels: np.ndarray | None = None):
    """Per batch of vectors, the k nearest of each query; with labels (of the queries), among vectors of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vec, v = np.asarray(b.column("vec_id"), np.int64), matrix(b.column("embedding"))
            theirs = None if labels is None else np.asarray(b.column("label").to_pylist(), object)
            block = max(1, HELD // b.num_rows)
            for at in range(0, len(ids), block):
                mine = ids[at : at + block]
                d = squares(q[at : at + block], v)
                if not with_self:
                    d[mine[:, None] == vec[None, :]] = np.inf
                if labels is not None:
                    own = labels[at : at + block]
                    d[(own[:, None] != theirs[None, :]) | np.equal(own, None)[:, None]] = np.inf
                # Only what is as near as the k-th, as far as places tell, is rounded and sorted, ties by vec_id.
                kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if k < d.shape[1] else np.full((len(mine), 1), np.inf)
                row, col = np.nonzero((d <= (np.sqrt(np.maximum(kth, 0)) + 2 * 10.0**-PLACES) ** 2) & np.isfinite(d))
                dist = np.round(np.sqrt(np.maximum(d[row, col], 0)), PLACES)
                near = np.lexsort((vec[col], dist, row))
                row, col, dist = row[near], col[near], dist[near]
                ok = np.arange(len(row)) - np.searchsorted(row, row) < k
                yield pa.RecordBatch.from_arrays([pa.array(mine[row[ok]]), pa.array(vec[col[ok]]), pa.array(dist[ok])], ["query_id", "vec_id", "distance"])

    return run


def knn_exact(vectors: DataFrame, queries: DataFrame, k: int = 10, with_self: bool = False, label: str | None = None) -> DataFrame:
    """(query_id, rank, vec_id, distance) over all vectors (vec_id, embedding) for each query (query_id, embedding).

    With `label`, a column of both, only vectors of the query's label count; a null label matches none. Ties are broken by
    vec_id. A stated query set against all rows, in blocks: up to SENT_QUERIES queries go to the executors with the one
    scan of the vectors, which keeps k rows a query and batch. Of more, each block of queries meets each part of the
    vectors in a task, and k rows a query are kept there.
    """
    vectors, queries = vectors.where("embedding is not null"), queries.where("embedding is not null")
    extra = [] if label is None else [F.col(label).alias("label")]
    v, q = vectors.select("vec_id", "embedding", *extra), queries.select("query_id", "embedding", *extra)
    sent = q.limit(SENT_QUERIES + 1).toArrow().combine_chunks()
    if sent.num_rows <= SENT_QUERIES:
        if not sent.num_rows:
            return queries.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, distance double")
        ids, rows = np.asarray(sent.column("query_id"), np.int64), matrix(sent.column("embedding").combine_chunks())
        labels = None if label is None else np.asarray(sent.column("label").to_pylist(), object)
        near = v.mapInArrow(_nearest(ids, rows, k, with_self, labels), "query_id bigint, vec_id bigint, distance double")
    else:
        if label is not None:
            v, q = v.where("label is not null"), q.where("label is not null")
        blocks, parts = -(-q.count() // SENT_QUERIES), max(1, -(-v.count() // (4 * PART)))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        group = lambda block: F.xxhash64(block, *(["label"] if label else []))
        placed = v.withColumn("block", every(blocks)).select(group("block").alias("cell"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("side"), F.col("vec_id").alias("id"), "embedding")
        asked = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).select(group("block").alias("cell"), every(parts).alias("part"), F.lit(1).alias("side"), F.col("query_id").alias("id"), "embedding")
        both = placed.unionByName(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", "side", "id")
        near = both.mapInArrow(search_parts(k, with_self), "query_id bigint, vec_id bigint, distance double")
    return top_k(near, ["query_id"], [F.asc("distance"), F.asc("vec_id")], k).select("query_id", "rank", "vec_id", "distance")


def _sample(vectors: DataFrame, most: int = 20_000) -> np.ndarray:
    """The vectors with the smallest hashes of their ids: a bounded sample for fitting."""
    rows = vectors.where("embedding is not null").select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow().combine_chunks()
    return matrix(rows.column("embedding").combine_chunks()) if rows.num_rows else np.zeros((0, 0))


def fit_cells(x: np.ndarray, cells: int | None = None, rounds: int = 8) -> np.ndarray:
    """Coarse centroids of a sample by k-means."""
    cells = min(len(x), cells or max(1, round(len(x) ** 0.5)))
    centres = x[:cells].copy()
    for _ in range(rounds):
        near = distances(x, centres).argmin(1)
        for c in range(cells):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
    return centres


def fit_share(x: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int = 256) -> float:
    """The least share of the cells, nearest first, in which the first `asked` vectors of the sample find that much of
    their k nearest others there, as an average less two standard errors."""
    asked = min(asked, len(x))
    d = distances(x[:asked], x)
    d[np.arange(asked), np.arange(asked)] = np.inf
    k = min(k, len(x) - 1)
    if k < 1 or len(centres) < 2:
        return 1.0
    true = np.argpartition(d, k - 1, axis=1)[:, :k]
    cell = distances(x, centres).argmin(1)
    place = np.argsort(np.argsort(distances(x[:asked], centres), axis=1), axis=1)
    needed = place[np.arange(asked)[:, None], cell[true]]  # how many cells come before that of each true neighbour
    for n in range(1, len(centres) + 1):
        found = (needed < n).mean(1)
        if found.mean() - 2 * found.std() / asked**0.5 >= recall:
            return n / len(centres)
    return 1.0


def _cells(centres: np.ndarray, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near = np.argsort(distances(matrix(b.column("embedding")), centres), axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("embedding"), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["id", "embedding", "cells"])

    return run


def knn_ivf(vectors: DataFrame, queries: DataFrame, k: int = 10, share: float | None = None, cells: int | None = None, with_self: bool = False, recall: float = 0.93) -> DataFrame:
    """As knn_exact, but a query looks only at that share of the cells that is nearest to it; every vector is in the index.

    Cells, and the share if none is given, are fitted on 20,000 vectors at most: the least share that gives the recall
    asked for there. Vectors without structure need more than half of the cells, clustered ones few.
    Cells are cut into parts of about PART vectors by a hash of vec_id, and each (query, cell) goes to each part, so a
    cell of any size is spread over tasks. Queries and vectors meet in a join on (cell, part) and k rows a query are kept there.
    """
    vectors, queries = vectors.where("embedding is not null"), queries.where("embedding is not null")
    sample = _sample(vectors)
    if not len(sample):
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, distance double")
    centres = fit_cells(sample, cells)
    share = fit_share(sample, centres, k, recall) if share is None else share
    kind = vectors.schema["embedding"].dataType.simpleString()
    put = lambda df, key, n: df.select(F.col(key).alias("id"), "embedding").mapInArrow(_cells(centres, n), f"id bigint, embedding {kind}, cells array<int>").select("id", "embedding", F.explode("cells").alias("cell"))
    indexed = put(vectors, "vec_id", 1)
    sizes = indexed.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    rows = indexed.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"), "id", "embedding")
    asked = put(queries, "query_id", max(1, round(share * len(centres)))).join(F.broadcast(sizes), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "id", "embedding")
    both = rows.unionByName(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", "side", "id")
    near = both.mapInArrow(search_parts(k, with_self), "query_id bigint, vec_id bigint, distance double")
    return top_k(near, ["query_id"], [F.asc("distance"), F.asc("vec_id")], k).select("query_id", "rank", "vec_id", "distance")


#: Vectors to a part of a cell, about.
PART = 8192


def search_parts(k: int, with_self: bool):
    """Vectors of a (cell, part) come first and stay, queries stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows = None, [], []
        for b in batches:
            cell, part, side, at = (np.asarray(b.column(c)) for c in ("cell", "part", "side", "id"))
            m = matrix(b.column("embedding"))
            edges = np.flatnonzero(np.diff(cell) | np.diff(part) | np.diff(side)) + 1
            for lo, hi in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(at)])), strict=True):
                if lo == hi:
                    continue
                if (cell[lo], part[lo]) != now:
                    now, ids, rows = (cell[lo], part[lo]), [], []
                if side[lo] == 0:
                    ids.append(at[lo:hi].copy())
                    rows.append(m[lo:hi].copy())
                    continue
                if not ids:
                    continue
                found = pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(rows).ravel()), m.shape[1])], ["vec_id", "embedding"])
                yield from _nearest(at[lo:hi], m[lo:hi], k, with_self)(iter([found]))

    return run


def recall_at(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, hits, recall): share of the first k of truth that are among the first k found; 0 without truth."""
    a, b = (x.where(F.col("rank") <= k).select("query_id", "vec_id") for x in (found, truth))
    size = b.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = a.join(b, ["query_id", "vec_id"]).groupBy("query_id").agg(F.count("*").alias("hits"))
    return size.join(hits, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("recall"))


def recall_summary(recalls: DataFrame) -> DataFrame:
    """One row: queries, mean, median and 5th percentile (interpolated) of recall, from the counts of its distinct values."""
    r = lambda c, name: F.round(c, 6).alias(name)
    pct = F.percentile("recall", F.array(F.lit(0.5), F.lit(0.05)))
    return recalls.agg(F.count("*").alias("n_queries"), F.avg("recall").alias("mean"), pct.alias("p")).select("n_queries", r(F.col("mean"), "mean_recall"), r(F.get("p", F.lit(0)), "p50_recall"), r(F.get("p", F.lit(1)), "p5_recall"))


def level(key: Column, seed: int = 42, ml: float = 1.4426950408889634, most: int = 10) -> Column:
    """A layer for each key: geometric with p = exp(-1 / ml), at most `most`; of the first 52 bits of md5(seed:key)."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 13), 16, 10).cast("double")
    return F.least(F.floor(-F.ln((bits + 0.5) / float(1 << 52)) * ml), F.lit(most)).cast("int")
