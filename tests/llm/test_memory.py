"""What a task's Python worker holds at once doesn't grow with the batches that Spark sends."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from corvid.llm import ngram_join, quality_rules
from corvid.plans.scratch import written


def sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])


def test_written_tables_are_made_from_bounded_batches(spark):
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("0123456789"), 1000).alias("text"))
    got = written(texts.mapInArrow(sizes, "n bigint, bytes bigint"), "sizes").agg(F.sum("n"), F.max("bytes")).first()
    assert got[0] == 3000 and got[1] < 5_000_000
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    assert spark.conf.get(key, None) is None
    spark.conf.set(key, "1m")  # the session's own limit holds
    try:
        assert written(texts.mapInArrow(sizes, "n bigint, bytes bigint"), "sizes").agg(F.max("bytes")).first()[0] < 1_200_000
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_worker_looks_at_few_texts_at_once():
    texts = [" ".join(f"w{(i * 7919 + j * j) % 5003}" for j in range(400)) for i in range(1600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(["h"] * len(texts)), pa.array(texts)], ["__k1", "__k2", "host", "text"])
    assert batch.nbytes > 3_000_000
    assert peak_mb(lambda: [None for _ in quality_rules._features(iter([batch]))]) < 40
    assert peak_mb(lambda: [ngram_join.shingle_sets(ngram_join.utf8(b, "text"), 5) and None for b in ngram_join.in_slices([batch], "text", ngram_join.SLICE)]) < 20
