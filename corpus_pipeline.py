"""A corpus pipeline of five stages; each one's result is written and read again as the next one's documents.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, further columns of any name and
tables without rows, which give none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvid.llm.decontaminate import decontaminate
from corvid.llm.mixing import mix
from corvid.llm.ngram_join import representatives
from corvid.llm.quality_rules import apply_quality
from corvid.llm.secret_scan import redact
from corvid.llm.shared import scope, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others boilerplate lines go. Null and empty texts have no words and are rejected; null
    hosts are the host ''; repeated rows are judged alike and stay."""
    return apply_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that with the smallest id; rows without ids come last. Repeated rows are one;
    texts without words are linked with nothing and stay."""
    return representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Null and empty texts contain none and stay; so do repeated rows."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; all documents stay, null and empty texts as they are."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The uses of documents that make up the mixture, with their cleaned texts: doc_id, domain, lang, source, epoch,
    n_tokens, text. Null languages and sources are 'unknown'; repeated rows are documents of their own."""
    return mix(docs, texts=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("mixing", mixing),
]
#: SQL can't express the entropy scan; all five stages are tested against plain models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's scratch tables go once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scope(spark) as made:
            result = written(stage(spark, docs, sf_dir), f"stage-{k}")
            made.keep(result)
        docs = result
    return STAGES[-1][1](spark, docs, sf_dir)
