"""Hybrid search of many queries at once, with kept results and a sketch of what was asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.operators import fusion, lexical, sketch, vector
from corvid.plans.scratch import written

RESULTS = "key string, rank int, doc_id bigint, score double"


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, weight: float = 0.5) -> DataFrame:
    """(query_id, rank, doc_id, score): docs (doc_id, text) and vectors (vec_id = doc_id, embedding) for queries (query_id, text, embedding).

    A query or document without a vector has no dense score.
    """
    dense = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    return fusion.fuse(lexical.bm25(docs, queries.select("query_id", "text"), k=2 * k), vector.knn_exact(vectors, dense, k=2 * k, with_self=True), k, weight)


def result_key(k: int, weight: float) -> Column:
    """Of everything that a result depends on besides the corpus."""
    return F.sha2(F.concat_ws("\x1f", F.col("text"), F.array_join(F.col("embedding").cast("array<string>"), ","), F.lit(k), F.lit(weight)), 256)


def hybrid_kept(docs: DataFrame, vectors: DataFrame, queries: DataFrame, kept: DataFrame, k: int = 10, weight: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Results of queries, from kept (RESULTS) where it has them; and the rows to add to kept, which are written.

    The corpus is searched once, for new queries alone, and isn't read if there are none.
    """
    keyed = queries.withColumn("key", result_key(k, weight))
    new = written(keyed.join(kept.select("key").distinct(), "key", "left_anti").dropDuplicates(["key"]), "new")
    if new.isEmpty():
        fresh = docs.sparkSession.createDataFrame([], RESULTS)
    else:
        found = hybrid(docs, vectors, new.select("query_id", "text", "embedding"), k, weight)
        fresh = written(found.join(new.select("query_id", "key"), "query_id").select("key", "rank", "doc_id", "score"), "fresh")
    return keyed.select("query_id", "key").join(kept.unionByName(fresh), "key").select("query_id", "rank", "doc_id", "score"), fresh


def asked(queries: DataFrame) -> DataFrame:
    """The queries' texts as a Count-Min sketch, to be added to earlier ones."""
    return sketch.build(queries, "text")
