"""Persisted indices and results."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions.text import words
from corvid.operators import lexical
from corvid.plans.scratch import sparing, written
from corvid.sources import postings

BLOCK_BITS = lexical.BLOCK.bit_length() - 1


def write_index(docs: DataFrame, path: str, buckets: int = 64, batch: str = "0") -> None:
    """An index of docs (doc_id, text) below path: postings in compressed rows by a hash of the term, documents, corpus.

    Fails if there is an index.
    """
    try:
        _corpus_rows(docs.sparkSession, path)
    except AnalysisException:  # no batch is whole there
        _put(docs, path, buckets, batch)
    else:
        raise FileExistsError(path)


def append_index(docs: DataFrame, path: str, batch: str | None = None) -> None:
    """Adds documents, whose ids must be new, to an index, as a further batch.

    A batch counts once its line in corpus is written, which comes last. Adding a batch again by its name, after a failure or
    by a stream that repeats it, puts the same files in the place of the old ones.
    """
    known = _corpus_rows(docs.sparkSession, path)
    _put(docs, path, known.first()["buckets"], uuid.uuid4().hex if batch is None else batch)


def _put(docs: DataFrame, path: str, buckets: int, batch: str) -> None:
    if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
        raise ValueError(f"a batch's name is made of letters, digits and dashes: {batch!r}")
    out = lambda df: df.write.mode("overwrite").option("compression", "zstd")
    rows = f"{path}/postings/batch={batch}"
    with sparing(docs.sparkSession):
        out(postings.encode_texts(docs, buckets)).partitionBy("bucket").parquet(rows)
    tokens = docs.sparkSession.read.schema(postings.ROW).parquet(rows).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"))
    sizes = docs.agg(F.count("*").alias("n_docs")).crossJoin(tokens).select("n_docs", "total_tokens", F.lit(buckets).alias("buckets"))
    out(sizes.coalesce(1)).parquet(f"{path}/corpus/batch={batch}")


def _corpus_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("n_docs bigint, total_tokens bigint, buckets int, batch string").parquet(f"{path}/corpus")


def read_postings(spark: SparkSession, path: str, terms: DataFrame | None = None) -> DataFrame:
    """The index's compressed rows, of whole batches; with terms (term), of these alone, and only their buckets' files are read."""
    known = _corpus_rows(spark, path)
    batches = [r["batch"] for r in known.select("batch").distinct().collect()]
    rows = spark.read.schema(f"{postings.ROW}, batch string, bucket int").option("basePath", f"{path}/postings").parquet(*(f"{path}/postings/batch={b}" for b in batches))
    if terms is None:
        return rows
    wanted = terms.select("term", postings.bucket_of(known.first()["buckets"])).distinct()
    named = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # as many numbers as there are buckets, at most
    return rows.where(F.col("bucket").isin(named)).join(F.broadcast(wanted) if wanted.limit(lexical.BROADCAST_TERMS + 1).count() <= lexical.BROADCAST_TERMS else wanted, ["term", "bucket"], "left_semi")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """As lexical.bm25, from a written index: only the buckets of the query terms are read, and of their rows only those
    decoded that lexical.pruned_hits() can't skip."""
    asked = queries.select("query_id", F.explode(words(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = written(asked.withColumn("w", F.col("qtf") / (F.col("qtf") + 0.5)), "asked")
    corpus = _corpus_rows(spark, path).agg(F.sum("n_docs").alias("n_docs"), (F.sum("total_tokens") / F.sum("n_docs")).alias("avgdl"))
    rows = read_postings(spark, path, asked.select("term"))
    weights = written(rows.groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(corpus)).select("term", "df", "avgdl", lexical.idf_weight().alias("idf")), "weights")
    part = (F.col("idf") * lexical.tf_weight(F.col("tf"), F.col("dl"), k1, b)).alias("part")
    weighed = lambda df: df.join(F.broadcast(weights) if weights.limit(lexical.BROADCAST_TERMS + 1).count() <= lexical.BROADCAST_TERMS else weights, "term")
    peaks = written(weighed(postings.best_points(rows)).groupBy("term", "range").agg(F.max(part).alias("peak")), "peaks")

    def fetch(pairs: DataFrame) -> DataFrame:
        blocks = pairs.select("term", F.shiftright("range", BLOCK_BITS - lexical.RANGE_BITS).alias("block")).distinct()
        return weighed(postings.decode(rows.join(blocks, ["term", "block"], "left_semi"))).select("term", "range", "doc_id", part)

    hits = lexical.pruned_hits(asked.drop("qtf"), weights, peaks, fetch, k)
    return lexical.top_k(hits, ["query_id"], [F.desc("score"), F.asc("doc_id")], k).select("query_id", "rank", "doc_id", "score")


def write_embeddings(vectors: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """vectors (vec_id, embedding) as Parquet, embeddings as floats."""
    vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode(mode).parquet(path)


def write_results(detail: DataFrame, aggregated: DataFrame, path: str) -> None:
    """results and results_aggregated below path, as JSON lines and as CSV with a header; nested columns go to JSON alone."""
    for name, df in (("results", detail), ("results_aggregated", aggregated)):
        df.write.json(f"{path}/{name}.json")
        flat = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct")]
        df.select(flat).write.option("header", True).csv(f"{path}/{name}.csv")
