"""Fusion of lexical and dense results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.operators.lexical import top_k


def minmax(score: Column, by: list[str], inverted: bool = False) -> Column:
    """score scaled to 0..1 within its group; inverted for distances. Equal scores give 0, inverted 1."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    scaled = (score - low) / F.when(high == low, 1.0).otherwise(high - low)
    return 1 - scaled if inverted else scaled


def fuse(lexical: DataFrame, dense: DataFrame, k: int = 10, weight: float = 0.5) -> DataFrame:
    """(query_id, rank, doc_id, score) from lexical (query_id, doc_id, score) and dense (query_id, vec_id, distance)."""
    a = lexical.select("query_id", "doc_id", minmax(F.col("score"), ["query_id"]).alias("lexical"))
    b = dense.select("query_id", F.col("vec_id").alias("doc_id"), minmax(F.col("distance"), ["query_id"], inverted=True).alias("dense"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    score = F.round(weight * F.coalesce("dense", F.lit(0.0)) + (1 - weight) * F.coalesce("lexical", F.lit(0.0)), 6)
    return top_k(both.select("query_id", "doc_id", score.alias("score")), ["query_id"], [F.desc("score"), F.asc("doc_id")], k).select("query_id", "rank", "doc_id", "score")
