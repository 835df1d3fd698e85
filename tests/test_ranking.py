"""Ranking that skips, and the compressed index."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.functions import text as tx
from corvid.operators import lexical
from corvid.plans.scratch import written
from corvid.sources import postings, sinks
from corvid.streaming import processors

QUERY = "query_id bigint, text string"


def corpus(n, seed=1):
    """Texts whose words fall off as in a language, so that all queries share common words with most documents."""
    rng = random.Random(seed)
    return [(k, " ".join(f"w{min(int(rng.paretovariate(0.6)), 20_000)}" for _ in range(rng.randrange(5, 60)))) for k in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*corpus(4000), (9_000_000, "w1 w2 rare"), (9_000_001, None), (9_000_002, "")], "doc_id bigint, text string").repartition(4).cache()


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(k, t) for k, t in corpus(30, 2)] + [(100, "w1"), (101, "rare w1 w1"), (102, "absent"), (103, None), (104, "w1 w2 w3")]
    return spark.createDataFrame(rows, QUERY)


def plain(docs, queries, k=10, k1=1.2, b=0.75):
    """All pairs of a query and a document with a word of it."""
    rows = [(r["doc_id"], (r["text"] or "").lower().split()) for r in docs.collect()]
    avgdl, df, out, pairs = sum(len(w) for _, w in rows) / len(rows), {}, [], 0
    for _, w in rows:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    for q in queries.collect():
        asked, scores = (q["text"] or "").split(), []
        for i, w in rows:
            here = [t for t in set(asked) if t in w]
            part = lambda t, w=w, asked=asked: max((len(rows) - df[t] + 0.5) / (df[t] + 0.5), 0) * w.count(t) * (k1 + 1) / (w.count(t) + k1 * (1 - b + b * len(w) / avgdl)) * asked.count(t) / (asked.count(t) + 0.5)
            if here:
                scores.append((-round(sum(map(part, here)), 6), i))
        pairs += len(scores)
        out += [(q["query_id"], rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out, pairs


def test_what_is_skipped_is_not_among_the_best(spark, docs, queries, monkeypatch):
    expected, pairs = plain(docs, queries)
    made = {}
    real = lexical.pruned_hits
    monkeypatch.setattr(lexical, "pruned_hits", lambda *a: made.setdefault("hits", real(*a)))
    got = [tuple(r) for r in lexical.bm25(docs, queries).collect()]
    assert sorted(r[:3] for r in got) == sorted(r[:3] for r in expected)
    assert np.allclose([r[3] for r in sorted(got)], [r[3] for r in sorted(expected)], atol=2e-6)
    assert made["hits"].count() < pairs / 10


def test_shuffled_terms_give_the_same(docs, queries, monkeypatch):
    expected = sorted(map(tuple, lexical.bm25(docs, queries).collect()))
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 3)
    assert sorted(map(tuple, lexical.bm25(docs, queries).collect())) == expected


def test_ids_of_any_kind_and_repeated_documents(spark):
    rows = [("a", "x y"), ("b", "x x z"), (None, "y y"), ("a", "x z z z"), ("a", "x y")]
    got = lexical.bm25(spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame([(1, "x y z")], QUERY), idf="log").collect()
    assert {r["doc_id"] for r in got} == {"a", "b", None} and [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3]


def test_varints_come_back():
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.integers(0, 1 << b, 50) for b in (1, 7, 8, 14, 15, 31, 62)] + [[0, 127, 128, 16383, 16384]])
    ends = np.array([0, 3, 3, 100, len(values)])
    back = [postings.from_varints(x).tolist() for x in postings.varints(values, ends).to_pylist()]
    assert back == [values[a:z].tolist() for a, z in zip([0, *ends[:-1]], ends, strict=True)]


def test_blocks_hold_all_postings_and_their_best_points(spark, docs):
    dl = docs.select("doc_id", F.size(F.split("text", " ")).alias("dl"))
    tf = lexical.term_frequencies(docs).join(dl, "doc_id")
    rows = written(postings.encode(tf, 8), "rows")
    back = postings.decode(rows)
    assert sorted(back.select("term", "doc_id", "tf", "dl").collect()) == sorted(tf.select("term", "doc_id", "tf", F.col("dl").cast("long")).collect())
    assert rows.where("n >= 64 and points is null or n < 64 and points is not null").count() == 0
    impact = lambda df, k1, b: {(r["term"], r["range"]): r["m"] for r in df.groupBy("term", "range").agg(F.max(F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / 30))).alias("m")).collect()}
    for k1, b in ((1.2, 0.75), (5.0, 0.1), (0.2, 1.0)):
        assert impact(postings.best_points(rows), k1, b) == impact(back, k1, b)
    assert rows.where("points is not null").select(F.explode("points")).count() < rows.where("points is not null").agg(F.sum("n")).first()[0] / 3


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_index_is_small_pruned_and_grows(spark, docs, queries, tmp_path):
    path, expected = f"file://{tmp_path}/index", sorted(map(tuple, lexical.bm25(docs, queries).collect()))
    sinks.write_index(docs.where("doc_id % 2 = 0"), path, buckets=16)
    with pytest.raises(FileExistsError):
        sinks.write_index(docs, path)
    odd = docs.where("doc_id % 2 != 0")
    for _ in range(2):  # a batch that comes again changes nothing
        sinks.append_index(odd, path, "odd")
    assert sorted(map(tuple, sinks.search_index(spark, path, queries).collect())) == expected
    sinks.append_index(odd.limit(0), path)
    assert sorted(map(tuple, sinks.search_index(spark, path, queries).collect())) == expected
    os.makedirs(f"{tmp_path}/index/postings/batch=broken/bucket=1")  # a batch that failed midway has no line in corpus
    assert sorted(map(tuple, sinks.search_index(spark, path, queries).collect())) == expected
    one = spark.createDataFrame([("rare",)], "term string")
    read = {f.split("bucket=")[1].split("/")[0] for f in sinks.read_postings(spark, path, one).inputFiles()}
    plan = sinks.read_postings(spark, path, one)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and len(read) <= 16
    lists = lexical.postings(docs).withColumn("bucket", postings.bucket_of(16))
    lists.join(docs.select("doc_id", F.size(F.split("text", " ")).alias("dl")), "doc_id").drop("bucket").sortWithinPartitions("term", "doc_id").coalesce(1).write.parquet(f"file://{tmp_path}/plain")
    sinks.write_index(docs, f"file://{tmp_path}/whole", buckets=1)
    assert folder_bytes(f"{tmp_path}/whole/postings") < 0.6 * folder_bytes(f"{tmp_path}/plain")


def test_a_stream_keeps_the_index(spark, docs, queries, tmp_path):
    path = f"file://{tmp_path}/index"
    for k in range(3):
        docs.where(f"pmod(doc_id, 3) = {k}").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    sinks.write_index(docs.limit(0), path, buckets=4)
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        processors.index(stream, path, f"file://{tmp_path}/state").awaitTermination()
    assert sorted(map(tuple, sinks.search_index(spark, path, queries).collect())) == sorted(map(tuple, lexical.bm25(docs, queries).collect()))
    first = docs.where("pmod(doc_id, 3) = 0")
    processors.index_batch(path)(first, 0)  # as after a failure between the batch's end and its commit
    assert sinks._corpus_rows(spark, path).count() == 4


def test_gaps_of_long_and_short_blocks_are_coded_and_decoded(spark):
    """A word of all documents has blocks of 65,536 gaps, each longer than an Arrow batch."""
    docs = spark.range(140_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("all x"), (F.col("id") % 30_000).cast("string")).alias("text"))
    lists = lexical.postings(docs).cache()
    got = {(r["term"], r["block"]): (r["n"], r["gaps"], r["bytes"]) for r in postings.decoded_gaps(postings.coded_gaps(lists)).collect()}
    want = lists.groupBy("term", "block").agg(F.count("*").alias("n"), F.sum("gap").alias("gaps"), F.sum(tx.varint_bytes(F.col("gap"))).alias("bytes")).collect()
    assert got == {(r["term"], r["block"]): (r["n"], r["gaps"], r["bytes"]) for r in want} and got["all", 0] == (65_536, 65_535, 65_536)
    assert postings.from_varints(b"").tolist() == [] and postings.from_varints(b"\x80").tolist() == [] and postings.from_varints(b"\x05\xac\x02").tolist() == [5, 300]


def test_a_task_of_postings_does_not_grow_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TASK_TEXT", 1000)
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" ")), 20).alias("text"))
    assert lexical.postings(docs).rdd.getNumPartitions() > 40
