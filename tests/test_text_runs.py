"""The written index from runs of postings."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvid.sources import postings, sinks

from .test_ranking import corpus


def test_runs_are_few_and_hold_all_postings(spark, tmp_path):
    """Documents of several blocks, out of order, some twice, with one length or another; null and empty texts."""
    rng = random.Random(5)
    ids = [rng.randrange(5000) + postings.BLOCK * rng.randrange(-1, 3) for _ in range(1500)]
    rows = [(i, f"W1 {t}") for i, (_, t) in zip(ids, corpus(1500), strict=True)] + [(ids[0], "w1 w1"), (ids[0], "w1 w2"), (ids[1], None), (70, ""), (80, " \t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    expected = Counter((w, i, len(words)) for i, t in rows for words in [(t or "").lower().split()] for w in words)
    found = postings.encode_texts(docs, 4)
    back = Counter({(r["term"], r["doc_id"], r["dl"]): r["tf"] for r in postings.decode(found).collect()})
    assert back == expected
    plain = spark.createDataFrame([(*key, n) for key, n in expected.items()], "term string, doc_id bigint, dl bigint, tf bigint")
    same = ["term", "block", "n", "first_id", "last_id", "tokens", "bucket", F.size("points").alias("points")]
    assert sorted(found.select(*same).collect(), key=str) == sorted(postings.encode(plain, 4).select(*same).collect(), key=str)
    common = postings.text_runs(docs).where("term = 'w1'")
    assert common.agg(F.sum("n")).first()[0] >= 1500 and common.count() <= 3 * 4  # one a task and block, not one a document
    sinks.write_index(docs, f"file://{tmp_path}/index", buckets=4)
    assert spark.read.parquet(f"file://{tmp_path}/index/corpus").select("n_docs", "total_tokens").collect() == [(len(rows), sum(expected.values()))]


def test_a_document_without_an_id_is_not_left_out_silently(spark):
    with pytest.raises(Exception, match="has a doc_id"):
        postings.encode_texts(spark.createDataFrame([(1, "a"), (None, "b")], "doc_id bigint, text string"), 2).collect()
