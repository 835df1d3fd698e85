"""A written index of vectors: cells as folders and sorted runs of a table, found through centroids in two levels.

Below the index's path lie `vectors` (vec_id, embedding, attributes; by batch and group of cells, sorted by cell), `cells`
(their centroids), `sizes` (rows of each batch; a batch counts once its line is there) and `fitted` (how much of the index a
query looks at). Vectors without an embedding are left out; vec_ids that are repeated are rows of their own.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.operators import vector
from corvid.operators.lexical import top_k
from corvid.operators.vector import PART, distances, fit_cells, matrix
from corvid.plans.scratch import written

#: Vectors that centroids are fitted on, of all for the groups and of each group for its cells.
SAMPLE = 20_000
#: Groups of cells at most, which are folders and numbers in filters.
GROUPS = 1_024
#: Vectors that a cell holds at least, about.
CELL = 32
#: Vectors whose true neighbours tell how much of the index a query must look at.
ASKED = 256
FOUND = "query_id bigint, rank int, vec_id bigint, distance double"


def write_vectors(vectors: DataFrame, path: str, batch: str = "0", k: int = 10, recall: float = 0.93) -> None:
    """An index of vectors (vec_id, embedding, further columns to filter by) below path. Fails if there is one, or no vectors.

    Of n vectors there are about sqrt(n) cells of sqrt(n) vectors, in up to GROUPS groups. Groups are fitted on SAMPLE vectors,
    each group's cells on SAMPLE of its own in a task of its own, so their number grows with the data. What a query looks at is
    fitted by searching for ASKED of the vectors among all: the least share of the rows, cells nearest first, in which it finds
    that much of the k true neighbours, as an average less two standard errors.
    """
    spark = vectors.sparkSession
    try:
        _sizes(spark, path)
    except AnalysisException:  # no batch is whole there
        pass
    else:
        raise FileExistsError(path)
    vectors = vectors.where("embedding is not null")
    n = vectors.count()
    if not n:
        raise ValueError("an index is fitted on its first vectors: there are none")
    each = max(CELL, n**0.5)
    roots = fit_cells(vector._sample(vectors, SAMPLE), min(GROUPS, max(1, round((n / each) ** 0.5))))
    grouped = written(_in_groups(vectors.select("vec_id", "embedding"), roots), "grouped")
    counts = grouped.groupBy("grp").agg(F.count("*").alias("n"))
    some = top_k(grouped, ["grp"], [F.xxhash64("vec_id"), F.asc("vec_id")], SAMPLE).drop("rank").join(F.broadcast(counts), "grp")

    def fit(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        centres = fit_cells(matrix(table.column("embedding").combine_chunks()), max(1, -(-table.column("n")[0].as_py() // int(each))))
        return pa.table({"grp": pa.array([group] * len(centres), pa.int32()), "centroid": pa.array(centres.tolist(), pa.list_(pa.float64()))})

    cells = some.select("grp", "n", "embedding").groupBy("grp").applyInArrow(fit, "grp int, centroid array<double>")
    # numbers within a group and of the group, so that no task sees all
    place = F.row_number().over(Window.partitionBy("grp").orderBy("centroid")) - 1
    cells.select("grp", (F.col("grp").cast("long") * (1 << 20) + place).alias("cell"), "centroid").write.mode("overwrite").parquet(f"{path}/cells")
    _roots_out(spark, roots, path)
    _put(vectors, path, batch)
    share = _share(read_vectors(spark, path, [batch]), path, vectors, k, recall)
    spark.createDataFrame([(share, k, recall)], "share double, k int, recall double").coalesce(1).write.mode("overwrite").parquet(f"{path}/fitted")
    _count(spark, path, batch)


def append_vectors(vectors: DataFrame, path: str, batch: str | None = None) -> None:
    """Adds vectors to an index as a further batch, in the cells there are. Adding a batch again by its name replaces it.

    An index that has grown many times over is better written anew, as its cells grow with it.
    """
    spark = vectors.sparkSession
    _sizes(spark, path)
    name = uuid.uuid4().hex if batch is None else batch
    _put(vectors.where("embedding is not null"), path, name)
    _count(spark, path, name)


def _roots_out(spark: SparkSession, roots: np.ndarray, path: str) -> None:
    spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(roots)], "grp int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/groups")


def _in_groups(vectors: DataFrame, roots: np.ndarray) -> DataFrame:
    """vectors with their nearest group; of the roots there are GROUPS at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = distances(matrix(b.column("embedding")), roots).argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near)], [*b.schema.names, "grp"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{fields}, grp int")


def _nearest_cell():
    """Centroids of a (group, part) come first and stay; vectors stream past them and get the nearest's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cells, rows = None, [], []
        for b in batches:
            group, part, side = (np.asarray(b.column(c)) for c in ("grp", "part", "side"))
            cell, x = np.asarray(b.column("cell"), np.int64), matrix(b.column("embedding"))
            edges = np.flatnonzero(np.diff(group) | np.diff(part) | np.diff(side)) + 1
            for lo, hi in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(cell)])), strict=True):
                if lo == hi:
                    continue
                if (group[lo], part[lo]) != now:
                    now, cells, rows = (group[lo], part[lo]), [], []
                if side[lo] == 0:
                    cells.append(cell[lo:hi].copy())
                    rows.append(x[lo:hi].copy())
                    continue
                numbers, centres = np.concatenate(cells), np.concatenate(rows)
                near = numbers[distances(x[lo:hi], centres).argmin(1)]
                s = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([s.column("grp"), pa.array(near), s.column("row")], ["grp", "cell", "row"])

    return run


def _put(vectors: DataFrame, path: str, batch: str) -> None:
    if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
        raise ValueError(f"a batch's name is made of letters, digits and dashes: {batch!r}")
    spark = vectors.sparkSession
    roots = spark.read.parquet(f"{path}/groups").orderBy("grp").toArrow().combine_chunks()  # GROUPS rows at most
    rows = F.struct(*(F.col(c) for c in vectors.columns))
    placed = _in_groups(vectors.select("embedding", rows.alias("row")), matrix(roots.column("centroid").combine_chunks()))
    placed = written(placed.withColumn("__at", F.xxhash64("row.vec_id")), "placed")
    parts = written(placed.groupBy("grp").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "parts")
    cells = spark.read.parquet(f"{path}/cells").join(F.broadcast(parts), "grp")
    doubles = F.col("embedding").cast("array<double>").alias("embedding")
    side = F.lit(None).cast(placed.schema["row"].dataType).alias("row")
    centres = cells.select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "cell", F.col("centroid").alias("embedding"), side)
    own = placed.join(F.broadcast(parts), "grp").select("grp", F.pmod("__at", F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), F.lit(-1).cast("long").alias("cell"), doubles, "row")
    both = centres.unionByName(own).repartition("grp", "part").sortWithinPartitions("grp", "part", "side", "cell")
    kind = placed.schema["row"].dataType.simpleString()
    found = both.mapInArrow(_nearest_cell(), f"grp int, cell bigint, row {kind}").select("grp", "cell", "row.*")
    found.sortWithinPartitions("grp", "cell").write.mode("overwrite").option("compression", "zstd").partitionBy("grp").parquet(f"{path}/vectors/batch={batch}")


def _count(spark: SparkSession, path: str, batch: str) -> None:
    n = spark.read.parquet(f"{path}/vectors/batch={batch}").count() if _has_rows(spark, path, batch) else 0
    spark.createDataFrame([(n,)], "n bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes/batch={batch}")


def _has_rows(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether a batch's folder holds files; one of an empty table has none that tell its columns."""
    try:
        spark.read.parquet(f"{path}/vectors/batch={batch}")
    except AnalysisException:
        return False
    return True


def _sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("n bigint, batch string").parquet(f"{path}/sizes")


def read_vectors(spark: SparkSession, path: str, batches: list[str] | None = None) -> DataFrame:
    """The rows of the index's whole batches, with grp and cell."""
    if batches is None:
        batches = [r["batch"] for r in _sizes(spark, path).where("n > 0").select("batch").distinct().collect()]
    return spark.read.option("basePath", f"{path}/vectors").option("mergeSchema", True).parquet(*(f"{path}/vectors/batch={b}" for b in batches)).drop("batch")


def _looked_at(rows: DataFrame, path: str, queries: DataFrame) -> DataFrame:
    """(query_id, cell, before): rows that stand in the cells nearer to the query; cells without rows are left out.

    Queries meet all centroids in blocks: no vector is read for it.
    """
    filled = written(rows.groupBy("cell").agg(F.count("*").alias("n")), "filled")
    cells = written(rows.sparkSession.read.parquet(f"{path}/cells").join(filled, "cell").select(F.col("cell").alias("vec_id"), F.col("centroid").alias("embedding"), "n"), "cells")
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    near = vector.knn_exact(cells, asked, k=max(1, cells.count()), with_self=True).withColumnRenamed("vec_id", "cell").join(filled, "cell")
    before = F.sum("n").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    return near.select("query_id", "cell", F.coalesce(before, F.lit(0)).alias("before"))


def _share(rows: DataFrame, path: str, vectors: DataFrame, k: int, recall: float) -> float:
    asked = written(vectors.select(F.col("vec_id").alias("query_id"), "embedding").orderBy(F.xxhash64("query_id"), "query_id").limit(ASKED), "asked")
    n = rows.count()
    true = vector.knn_exact(vectors, asked, k).join(rows.select("vec_id", "cell").distinct(), "vec_id")
    needed = true.join(_looked_at(rows, path, asked), ["query_id", "cell"]).select("query_id", "before").toPandas()  # ASKED x k rows
    if needed.empty:
        return 1.0
    for share in np.unique(np.concatenate(((needed["before"] + 1) / n, [1.0]))):
        found = (needed["before"] < share * n).groupby(needed["query_id"]).mean()
        if found.mean() - 2 * found.std(ddof=0) / len(found) ** 0.5 >= recall:
            return float(min(1.0, share))
    return 1.0


def search_vectors(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, where: Column | None = None, with_self: bool = False) -> DataFrame:
    """As vector.knn_exact, from a written index; `where` is a condition on its columns.

    A query looks at cells, nearest first, until they hold the fitted share of all rows. Under a condition only the rows that
    meet it count, so the fewer there are the further a query looks, up to all cells, which is exact. Only groups of cells
    that some query looks at are read. Large cells are cut into parts, so that a cell of any size is spread over tasks.
    """
    queries = queries.where("embedding is not null")
    total = _sizes(spark, path).agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], FOUND)
    rows = read_vectors(spark, path)
    rows = rows if where is None else rows.where(where)
    share = spark.read.parquet(f"{path}/fitted").first()["share"]
    probes = written(_looked_at(rows, path, queries).where(F.col("before") < max(share * total, k + 1)).select("query_id", "cell"), "probes")
    named = [r["grp"] for r in probes.select(F.shiftright("cell", 20).alias("grp")).distinct().collect()]  # GROUPS numbers at most
    rows = rows.where(F.col("grp").isin(named))
    parts = written(rows.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "parts")
    doubles = F.col("embedding").cast("array<double>").alias("embedding")
    placed = rows.join(parts, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"), F.col("vec_id").alias("id"), doubles)
    asked = queries.join(probes, "query_id").join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), F.col("query_id").alias("id"), doubles)
    both = placed.unionByName(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", "side", "id")
    near = both.mapInArrow(vector.search_parts(k, with_self), "query_id bigint, vec_id bigint, distance double")
    return top_k(near, ["query_id"], [F.asc("distance"), F.asc("vec_id")], k).select("query_id", "rank", "vec_id", "distance")
