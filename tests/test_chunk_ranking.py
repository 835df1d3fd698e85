"""Ranking of few queries by chunks of documents."""

import pytest
from pyspark.sql import functions as F

from corvid.operators import lexical

from .test_ranking import QUERY, corpus, plain


@pytest.mark.parametrize("ids", ["doc_id", "concat('d', doc_id)"])
def test_chunks_give_the_k_best_and_no_pair_of_common_words(spark, monkeypatch, ids):
    """The words stand in most documents and many documents are alike, so that no range can be skipped."""
    rows = [(k, f"a b {'c ' * (k % 3)}{'d ' * (k % 2)}e{k % 5}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("doc_id", F.expr(ids))
    queries = spark.createDataFrame([(k, t) for k, t in enumerate(["a b", "c d", "a c d e1", "e2 e2 d", "absent", "c"] * 3)], QUERY)
    monkeypatch.setattr(lexical, "CHUNK", 2000, raising=False)
    monkeypatch.setattr(lexical, "SCORES", 3000, raising=False)
    made, real = {}, lexical.pruned_hits
    monkeypatch.setattr(lexical, "pruned_hits", lambda *a: made.setdefault("hits", real(*a)))
    expected, pairs = plain(docs, queries)
    got = sorted(map(tuple, lexical.bm25(docs, queries).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in sorted(expected)]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in sorted(expected)], abs=2e-6)
    assert made["hits"].count() < pairs / 10


def test_many_queries_are_ranked_alike(spark, monkeypatch):
    docs, queries = spark.createDataFrame(corpus(600), "doc_id bigint, text string"), spark.createDataFrame(corpus(20, 5), QUERY)
    expected = sorted(map(tuple, lexical.bm25(docs, queries).collect()))
    monkeypatch.setattr(lexical, "CHUNK_TERMS", 3, raising=False)
    assert sorted(map(tuple, lexical.bm25(docs, queries).collect())) == expected
