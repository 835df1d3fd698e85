"""Percentiles and running sums of groups that hold most rows."""

import random

import pytest
from pyspark.sql import functions as F

from corvid.operators import serving, stats
from corvid.plans import scratch


@pytest.fixture
def spread(spark, monkeypatch):
    """Every table counts as a large one, and small partitions stay apart."""
    monkeypatch.setattr(scratch, "ONE_TASK", 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [("hot", round(rng.expovariate(0.1), 3)) for _ in range(3000)] + [("few", float(k)) for k in range(4)] + [(None, 1.5), (None, 2.5), ("one", 7.0), ("none", None), ("hot", None)]
    return spark.createDataFrame(data, "g string, v double").repartition(3).cache()


def rounded(df):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def test_statistics_are_the_same_in_many_tasks(rows, monkeypatch, spark):
    ask = {
        "summary": lambda: stats.summary(rows, ["g"], "v"),
        "rank": lambda: stats.nearest_rank(rows, ["g"], "v", {"p50": 0.5, "p999": 0.999}),
        "tail": lambda: stats.tail_outliers(rows, ["g"], "v", 1.1),
    }
    one = {k: rounded(f()) for k, f in ask.items()}
    monkeypatch.setattr(scratch, "ONE_TASK", 0)
    assert {k: rounded(f()) for k, f in ask.items()} == one
    values = sorted(r["v"] for r in rows.where("g = 'hot' and v is not null").collect())
    assert next(r[2] for r in one["rank"] if r[0] == "hot") == round(values[1500], 5)


def test_running_sums_of_a_hot_group_lie_in_many_tasks(spark, rows, spread):
    df = rows.where("v is not null").withColumn("i", F.monotonically_increasing_id()).withColumn("x", F.lit(2))
    out = scratch.running_sum(df, ["g"], [F.col("v"), F.col("i")], "x", "upto", "all")
    got = out.collect()
    for g in ("hot", "few", "one", None):
        mine = sorted((r["v"], r["i"], r["upto"], r["all"]) for r in got if r["g"] == g)
        assert [r[2] for r in mine] == [2 * k for k in range(1, len(mine) + 1)] and {r[3] for r in mine} == {2 * len(mine)}
    spans = out.where("g = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(spans) > 1 and max(r["count"] for r in spans) < 2000


def test_caches_of_one_shard(spark, spread, monkeypatch):
    rng = random.Random(4)
    size = [rng.randrange(1, 9) for _ in range(400)]
    data = [("s", k, k // 3, item, size[item]) for k in range(4000) for item in [int(rng.paretovariate(0.5)) % 400]] + [("t", 1, 1, 5, 3)]
    df = spark.createDataFrame(data, "shard string, event_id bigint, micros bigint, item bigint, tokens bigint")
    many = [rounded(f) for f in (serving.resident(df, "shard", 300).drop("last"), serving.evicted_until(df, "shard", 300, 100).drop("last"))]
    monkeypatch.setattr(scratch, "ONE_TASK", 10**6)
    assert many == [rounded(f) for f in (serving.resident(df, "shard", 300).drop("last"), serving.evicted_until(df, "shard", 300, 100).drop("last"))]
    assert len(many[0]) > 20 and len(many[1]) > 5
