"""Page references kept by a stream over restarts, and chunks by the table function."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from corvid.functions import chunking
from corvid.functions import text as tx
from corvid.operators import kv
from corvid.plans import catalog
from corvid.streaming import pages as paged

DATA = "/root/testdata/sf0.001"
PAIRS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
EVENT = "page_key string, seq_id bigint, at bigint, attach boolean"


@pytest.fixture
def state(spark):
    before = {k: spark.conf.get(k, None) for k in paged.STATE}
    for k, v in paged.STATE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(spark, tmp_path, parts=16, ttl=None, wanted=0):
    """Starts the stream anew from its checkpoint, over what has come by now."""
    source = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = paged.references(source, parts, ttl).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"))
    q = q.option("checkpointLocation", f"{tmp_path}/cp")
    if ttl is None:
        assert q.trigger(availableNow=True).start().awaitTermination(200)
    else:
        running, seen, end = q.start(), {}, time.time() + 120
        while sum(seen.values()) < wanted and time.time() < end:
            seen.update((p["batchId"], p["numInputRows"]) for p in running.recentProgress if p["numInputRows"])
            time.sleep(0.2)
        running.stop()
    return paged.totals(spark.read.parquet(f"{tmp_path}/out").drop("batch"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_equals_the_batch_forms_after_restarts(spark, state, tmp_path):
    pages = catalog._pages(spark, DATA).where("seq_id < 40").cache()
    put = lambda df: df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put(paged.events_of(pages.where("seq_id % 2 = 0"), True))
    put(paged.events_of(pages.where("seq_id % 2 = 1"), True))
    shared = {r["page_key"]: r["refs"] for r in kv.shared_pages(pages).collect()}
    assert {r["page_key"]: r["refs"] for r in run(spark, tmp_path, 3).collect()} == shared
    put(paged.events_of(pages.where("seq_id % 3 = 0"), False, 1))
    gone = pages.where("seq_id % 3 = 0").select("seq_id")
    left = {r["page_key"]: r["refs"] for r in kv.detach(pages, gone).collect()}
    assert {r["page_key"]: r["refs"] for r in run(spark, tmp_path, 3).collect()} == left
    put(paged.events_of(pages, True))  # all of it again, late: nothing changes
    assert {r["page_key"]: r["refs"] for r in run(spark, tmp_path, 3).collect()} == left


def test_events_in_any_order(spark, state, tmp_path):
    rng = random.Random(2)
    events = [(f"p{rng.randrange(3)}", rng.randrange(6), at, rng.random() < 0.6) for at in range(120)]
    last = {}
    for page, seq, _, attach in events:
        last[page, seq] = attach
    rng.shuffle(events)
    for k in range(3):
        spark.createDataFrame(events[k * 40 : k * 40 + 40], EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = {r["page_key"]: r["refs"] for r in run(spark, tmp_path, 2, ttl=3_600_000, wanted=120).collect()}
    assert got == {f"p{p}": sum(a for (page, _), a in last.items() if page == f"p{p}") for p in range(3)}


def test_table_function_equals_columns_and_keeps_partitions(spark):
    docs = spark.createDataFrame([(1, "The cat and THE dog of  it"), (2, ""), (3, None), (4, "a " * 300), (5, "\t \n")], "doc_id bigint, text string").repartition(3)
    got = chunking.chunk_by(docs, chunking.compat, 8, 3)
    want = docs.select("doc_id", F.posexplode(tx.id_chunks(F.col("text"), 8, 3)).alias("chunk_idx", "chunk"))
    assert sorted(map(tuple, got.drop("n_tokens").collect())) == sorted(map(tuple, want.collect()))
    assert got.rdd.getNumPartitions() == 3
    assert chunking.chunk_by(docs.limit(0), chunking.compat).count() == 0
    with pytest.raises(ValueError):
        chunking.chunker(chunking.compat, 5, 5)


@pytest.mark.skipif(not os.path.exists(PAIRS), reason="the vocabulary isn't here")
def test_byte_pairs_round_trip(spark):
    texts = ["plain words, and more of them " * 20, "naïve 東京 text " * 30, "x" * 5_000, " \n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    encode, decode = chunking.byte_pairs(PAIRS)()
    rows = chunking.chunk_by(docs, chunking.byte_pairs(PAIRS), 32, 4).collect()
    for k, text in enumerate(texts):
        tokens = encode(text)
        assert decode(tokens) == text
        want = [(i, len(tokens[a : a + 32]), decode(tokens[a : a + 32])) for i, a in enumerate(range(0, len(tokens), 28))]
        assert sorted((r["chunk_idx"], r["n_tokens"], r["chunk"]) for r in rows if r["doc_id"] == k) == want
