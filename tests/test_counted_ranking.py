"""Few queries over a table of documents: one row a document from the texts to the scores."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvid.functions import text as tx
from corvid.operators import lexical

from .test_ranking import QUERY, corpus


def test_words_in_a_task_are_those_of_the_column(spark):
    rng = random.Random(4)
    texts = ["", " ", "a", " a  b\n", "\t\r\f\n", "é x y\u000bz", *("".join(rng.choice("aB é\n\t\f\r \u000b😀") for _ in range(rng.randrange(40))) for _ in range(200)), ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", F.lower("text").alias("low"), tx.words(F.col("text")).alias("w")).orderBy("k").toArrow()
    expected = rows.column("w").to_pylist()
    for lo, hi in ((0, len(texts)), (1, 50), (3, 3), (4, 5)):
        found, sizes = tx.split_words(rows.column("low").combine_chunks().slice(lo, hi - lo))
        assert sizes.tolist() == [len(w) for w in expected[lo:hi]]
        assert found.to_pylist() == [w for ws in expected[lo:hi] for w in ws]
    assert tx.slices(pa.array(["aa", "", "aaaa", "a"]), 3) == [(0, 2), (2, 1), (3, 1)]


def test_a_row_a_document_is_written(spark, monkeypatch):
    """And not one for each document and term."""
    docs, made, real = spark.createDataFrame(corpus(500), "doc_id bigint, text string"), {}, lexical.written
    monkeypatch.setattr(lexical, "written", lambda df, label: made.setdefault(label, real(df, label)))
    lexical.bm25(docs, spark.createDataFrame(corpus(10, 3), QUERY)).collect()
    assert sum(df.count() for label, df in made.items() if label != "asked") <= 500


@pytest.mark.parametrize("terms", [tx.words, lambda text: tx.words(text)])
def test_repeated_ids_count_as_in_sql(spark, monkeypatch, terms):
    rng = random.Random(7)
    rows = [(rng.choice([None, *range(30)]), " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(9)))) for _ in range(200)]
    rows += [(100, None), (101, ""), (102, "a b")]
    asked = {1: "a b b", 2: "c", 3: "h i j", 4: "absent"}
    monkeypatch.setattr(lexical, "CHUNK", 40)
    got = lexical.bm25(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), spark.createDataFrame(list(asked.items()), QUERY), idf="log", terms=terms, k=50)
    tf = Counter((i, len((t or "").split()), w) for i, t in rows for w in (t or "").split())
    df, avgdl = Counter(w for _, _, w in tf), sum(len((t or "").split()) for _, t in rows) / len(rows)
    expected = {}
    for q, text in asked.items():
        for (i, dl, w), n in tf.items():
            qtf = text.split().count(w)
            if qtf:
                idf = np.log1p(max((len(rows) - df[w] + 0.5) / (df[w] + 0.5), 0))
                expected[q, i] = expected.get((q, i), 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * dl / avgdl)) * qtf / (qtf + 0.5)
    found = {(r["query_id"], r["doc_id"]): r["score"] for r in got.collect()}
    assert found == pytest.approx(expected, abs=2e-6) and len(found) > 40
