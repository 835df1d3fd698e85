"""Streaming forms give the batch forms' results over files that arrive in parts."""

import time

from pyspark.sql import functions as F

from corvid.functions.text import words
from corvid.operators import serving, sketch
from corvid.streaming import processors

SCHEMA = "key string, shard string, request_id bigint, event_id bigint, micros bigint, item bigint, tokens bigint, text string"


def rows():
    return [("k", "s", n, n, n * 300_000, n % 7, 5 + n % 3, f"a b{n % 2}") for n in range(60)]


def stream(spark, path, parts=3):
    data = rows()
    for p in range(parts):
        spark.createDataFrame(data[p * 20 : p * 20 + 20], SCHEMA).coalesce(1).write.mode("append").json(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(path)


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_admission_and_cache(spark, tmp_path):
    source = stream(spark, f"{tmp_path}/in")
    batch = spark.createDataFrame(rows(), SCHEMA)
    got = {r["request_id"]: r["decision"] for r in run(processors.admission(source, "key", 1.0, 100.0, 10.0), "adm", "append", tmp_path).collect()}
    assert len(got) == 60
    assert got == {r["request_id"]: r["decision"] for r in serving.replay_admission(batch, "key", 1.0, 100.0, 10.0).collect()}
    hits = {r["event_id"]: r["hit"] for r in run(processors.cache(source, "shard", 30), "lru", "append", tmp_path).collect()}
    assert hits == {r["event_id"]: r["hit"] for r in serving.replay_lru(batch, "shard", 30).collect()}


def test_running_aggregates(spark, tmp_path):
    source = stream(spark, f"{tmp_path}/in")
    terms = {r["term"]: r["n"] for r in run(processors.running_frequencies(source, words(F.col("text"))), "terms", "complete", tmp_path).collect()}
    assert terms == {"a": 60, "b0": 30, "b1": 30}
    cells = run(processors.running_sketch(source, "item"), "cells", "complete", tmp_path)
    batch = spark.createDataFrame(rows(), SCHEMA)
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, sketch.build(batch, "item").collect()))
    timed = source.withColumn("ts", F.timestamp_micros("micros"))
    windows = run(processors.windowed_rates(timed, "key", "5 seconds", "5 seconds"), "rates", "update", tmp_path)
    assert windows.groupBy("window").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == 60


def test_steady_arrivals_do_not_hold_back_the_oldest(spark, tmp_path):
    source = spark.readStream.format("rate").option("rowsPerSecond", 20).load().selectExpr("'k' AS key", "value AS request_id", "cast(value % 5 AS double) AS priority")
    q = processors.microbatches(source, "key", size=8, wait_ms=3000).writeStream.format("memory").queryName("batches").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    try:
        for _ in range(80):
            time.sleep(0.5)
            if spark.table("batches").count() > 100:
                break
    finally:
        q.stop()
    rows = spark.table("batches").collect()
    assert len(rows) > 100 and len({r["request_id"] for r in rows}) == len(rows)
    batches = {}
    for r in rows:
        batches.setdefault(r["batch"], []).append((r["place"], -(r["request_id"] % 5)))
    assert all(len(b) <= 8 and [p for _, p in sorted(b)] == sorted(p for _, p in b) for b in batches.values())


def test_late_rows_are_dropped(spark, tmp_path):
    for seconds in ([1, 2, 60], [3, 61], [4, 62]):
        spark.createDataFrame([("k", s * 1_000_000, 1) for s in seconds], "key string, micros bigint, tokens bigint").coalesce(1).write.mode("append").json(f"{tmp_path}/late")
        time.sleep(1.1)  # files are read in the order of their times
    source = spark.readStream.schema("key string, micros bigint, tokens bigint").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/late").withColumn("ts", F.timestamp_micros("micros"))
    windows = run(processors.windowed_rates(source, "key", "10 seconds", "10 seconds", "5 seconds"), "late", "update", tmp_path)
    first = [r["n"] for r in windows.where("window.start < timestamp_micros(10000000)").collect()]
    # 60 moves the watermark past the first window; a batch is held against the watermark known before the one ahead of it,
    # so 3 still counts and 4 doesn't.
    assert max(first) == 3
