"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvid.llm import sql
from corvid.llm.chat_format import op5_chat_formatting
from corvid.llm.decontaminate import op4_benchmark_decontamination
from corvid.llm.html_extract import op10_html_extraction
from corvid.llm.license_scan import op1_license_scans
from corvid.llm.merkle import op11_merkle_manifest
from corvid.llm.mixing import mix_sql, op7_mixing
from corvid.llm.ngram_join import op6_ngram_jaccard_join
from corvid.llm.quality_rules import op2_quality_rules
from corvid.llm.secret_scan import op8_secret_scans
from corvid.llm.sentencepiece_bpe import op13_sentencepiece
from corvid.llm.substring_dedup import op3_substring_dedup
from corvid.llm.token_count import op9_token_counts
from corvid.llm.vector_codes import op12_vector_codes

OPERATORS = (
    op1_license_scans,
    op2_quality_rules,
    op3_substring_dedup,
    op4_benchmark_decontamination,
    op5_chat_formatting,
    op6_ngram_jaccard_join,
    op7_mixing,
    op8_secret_scans,
    op9_token_counts,
    op10_html_extraction,
    op11_merkle_manifest,
    op12_vector_codes,
    op13_sentencepiece,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": sql.OP2,
        "op3_substring_dedup": sql.OP3,
        "op4_benchmark_decontamination": sql.OP4,
        "op5_chat_formatting": sql.OP5,
        "op6_ngram_jaccard_join": sql.OP6,
        "op7_mixing": mix_sql(),
        "op11_merkle_manifest": sql.OP11,
        "op12_vector_codes": sql.op12(),
    }
