"""The written index of vectors: batches, conditions, recall, files read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.operators import vector
from corvid.sources import vector_index as stored


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in r], (first + i) % 7) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>, kind int")


def test_write_append_and_search_under_a_condition(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "PART", 64)
    rng = np.random.default_rng(8)
    centres = 30 * rng.normal(size=(25, 12))
    x = centres[rng.integers(0, 25, 2400)] + rng.normal(size=(2400, 12))
    path = f"file://{tmp_path}/index"
    a, b = frame(spark, x[:1200]), frame(spark, x[1200:], 1200)
    none = a.limit(0).withColumn("embedding", F.lit(None).cast("array<float>"))
    with pytest.raises(ValueError):
        stored.write_vectors(none, path)
    stored.write_vectors(a.unionByName(none), path)
    with pytest.raises(FileExistsError):
        stored.write_vectors(a, path)
    for _ in range(2):
        stored.append_vectors(b, path, "b")
    stored.append_vectors(none, path, "empty")
    everything = a.unionByName(b)
    rows = stored.read_vectors(spark, path)
    assert rows.count() == 2400 and rows.select("cell").distinct().count() >= 25
    assert sorted(map(tuple, rows.select("vec_id", "kind").collect())) == [(i, i % 7) for i in range(2400)]
    share = spark.read.parquet(f"{path}/fitted").first()["share"]
    assert share < 0.3
    q = everything.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    for where in (None, F.col("kind") == 3):
        true = vector.knn_exact(everything if where is None else everything.where(where), q)
        assert vector.recall_at(stored.search_vectors(spark, path, q, where=where), true, 10).agg(F.avg("recall")).first()[0] >= 0.9
    rare = F.col("vec_id").isin(5, 900, 2000)  # fewer than the share: all cells are looked at
    got = stored.search_vectors(spark, path, q.limit(3), where=rare)
    assert got.groupBy("query_id").count().where("count != 3").isEmpty()
    near = stored.search_vectors(spark, path, q.where("query_id = 0"))
    assert near.count() == 10
    scans = [x.split("]")[0] for x in near._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1:]]
    assert any("grp#" in x and (" IN " in x or " = " in x) for x in scans), scans
    assert stored.search_vectors(spark, path, q.limit(0)).count() == 0


def test_one_vector_many_times(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    stored.write_vectors(frame(spark, np.ones((300, 3))), path)
    q = spark.createDataFrame([(4, [1.0, 1.0, 1.0])], "query_id bigint, embedding array<float>")
    assert [r["vec_id"] for r in stored.search_vectors(spark, path, q, k=3, with_self=True).orderBy("rank").collect()] == [0, 1, 2]
