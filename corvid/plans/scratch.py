"""Tables, and scratch tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_folder: str | None = None
_scopes: list[Scope] = []
#: Whether an execution's shuffle files are removed once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes to an Arrow batch, and how many they are unless the session says so itself: a batch stands several times in a task's
#: JVM and its Python worker, which keep that memory.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where none is set, one of our own in local mode alone."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="corvid-")
    return f"file://{_own_folder}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder of which there is no other; what is put there goes with the scope() around, else when the driver ends."""
    path = f"{scratch_folder(spark)}/corvid/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    else:
        atexit.register(_remove, spark, path)
    return path


@contextmanager
def sparing(spark: SparkSession) -> Iterator[None]:
    """What is written in it leaves no shuffle files, and its Arrow batches hold BATCH_BYTES."""
    before, unset = spark.conf.get(_CLEANUP, "false"), spark.conf.get(_BATCH, None) is None
    spark.conf.set(_CLEANUP, "true")
    if unset:
        spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)
        if unset:
            spark.conf.unset(_BATCH)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once.

    The shuffle files of the plan that computes it go as soon as it is written; Arrow batches hold BATCH_BYTES. The table is removed with the scope() it is
    in, else when the driver ends, as the caller's result may still read it before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with sparing(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table of written() on which nothing that is still to be computed depends."""
    _remove(df.sparkSession, df.scratch_path)


class Scope(list[str]):
    """The scratch tables written in a scope()."""

    def keep(self, df: DataFrame) -> None:
        """Leaves this table of written() to the scope around, else until the driver ends."""
        self.remove(df.scratch_path)
        if len(_scopes) > 1:
            _scopes[-2].append(df.scratch_path)
        else:
            atexit.register(_remove, df.sparkSession, df.scratch_path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Removes, at its end, the scratch tables written in it: for results that have been written themselves by then."""
    _scopes.append(Scope())
    try:
        yield _scopes[-1]
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # the JVM may have ended already; the folder is the cluster's to clear then
        pass


def global_row_number(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """df with the 1-based place of each row in a total order, without bringing all rows to one task.

    Rows are range-partitioned and written; partition sizes give each partition's offset.
    """
    parts = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__before")
    return parts.join(F.broadcast(offsets), "__part").withColumn(name, place.cast("long")).drop("__part", "__before")


#: Rows up to which a group's values may stand in one task, as a table of this size does anyway.
ONE_TASK = 2_000_000


def few_rows(df: DataFrame) -> bool:
    return df.limit(ONE_TASK + 1).count() <= ONE_TASK


def running_sum(df: DataFrame, by: list[str], order: list[Column], amount: str, name: str, total: str) -> DataFrame:
    """df with the sum of amount over the rows of the group (by; nulls are a group) up to each row, and over all of the group.

    order must be a total one within a group. Rows are range-partitioned by group and order and written, so a group with any
    share of all rows lies in as many tasks as its share; each partition's sums by group give the others' offsets.
    """
    parts = written(df.repartitionByRange(*(F.col(c) for c in by), *order).withColumn("__part", F.spark_partition_id()), "running")
    sums = parts.groupBy("__part", *by).agg(F.sum(amount).alias("__sum"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__sum").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__by{k}") for k, c in enumerate(by)), before.alias("__before"), F.sum("__sum").over(group).alias(total))
    same = F.col("__part") == F.col("__p")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__by{k}"))
    here = F.sum(amount).over(Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(offsets, same).withColumn(name, here + F.col("__before")).drop("__p", "__part", "__before", *(f"__by{k}" for k in range(len(by))))
