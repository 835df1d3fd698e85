"""Quality rules: repetition rules on each text, and line frequency across the documents of a host.

Normalised lines are hashed; a line that stands in too many different documents of its host is boilerplate and is
removed, and a document that has little left is rejected. Exact copies of a text count as one document, so that they
don't turn its lines into boilerplate; texts that differ at all, near copies too, are different documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.shared import content_key, in_slices, table, utf8, window_hashes, word_hashes, written

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_WORD = ~np.isin(np.arange(256), [32, *range(9, 14)])
#: Bytes of texts that a worker looks at at once: its memory grows with them.
SLICE = 1 << 18
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


@dataclass(frozen=True)
class Rules:
    """A line is removed in more than `documents` documents and more than `percent` % of its host's; a text with under `left` % of its words left is rejected."""

    documents: int = 10
    percent: float = 1.0
    left: int = 30
    least_words: int = 10
    repeated: int = 20


def line_hash(line: bytes) -> int:
    """Of the line in lower case, with digits as 0 and white space as one space."""
    return xxhash.xxh3_64_intdigest(b" ".join(line.translate(_NORMAL).split())) - (1 << 63)


def _lines(text: bytes) -> tuple[int, list[dict]]:
    """Lines with a word that equal an earlier one, and per distinct normalised line its hash and words."""
    seen: set[bytes] = set()
    again, words = 0, {}
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            again += line in seen
            seen.add(line)
            h = line_hash(line)
            words[h] = words.get(h, 0) + n
    return again, [{"h": h, "w": n} for h, n in words.items()]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())]))
    for b in in_slices(batches, "text", SLICE):
        texts = utf8(b, "text")
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])

        def per_text(marks: np.ndarray, ends: np.ndarray = ends) -> np.ndarray:
            return np.diff(np.concatenate(([0], np.cumsum(marks)))[np.concatenate(([0], ends))])

        chars, symbols = per_text(_WORD[data] & ((data & 0xC0) != 0x80)), per_text(SYMBOLS[data])
        words, first = word_hashes(texts)
        h, ok = window_hashes(words, first, 5)
        at = np.flatnonzero(ok)
        order = np.lexsort((at, h[at], np.searchsorted(first, at, "right")))
        at = at[order]
        same = (h[at][1:] == h[at][:-1]) & (np.searchsorted(first, at[1:], "right") == np.searchsorted(first, at[:-1], "right"))
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(at) else np.zeros(0, bool)
        edges = np.zeros(len(words) + 6, np.int64)
        np.add.at(edges, at[twice], 1)
        np.add.at(edges, at[twice] + 5, -1)
        repeated = np.diff(np.concatenate(([0], np.cumsum(np.cumsum(edges)[: len(words)] > 0)))[first])
        lines = [_lines(t) for t in texts]
        numbers = [np.diff(first), chars, symbols, np.array([x for x, _ in lines]), repeated]
        yield pa.RecordBatch.from_arrays(
            [b.column("__k1"), b.column("__k2"), b.column("host"), *(pa.array(x.astype(np.int64)) for x in numbers), pa.array([x for _, x in lines], kind)],
            ["__k1", "__k2", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
        )


def keyed(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """docs with the key of quality_verdicts, over host and text."""
    return docs.select("*", *content_key(F.coalesce(F.col(host).cast("string"), F.lit("")), F.col(text)))


def quality_verdicts(docs: DataFrame, rules: Rules = Rules(), text: str = "text", host: str = "source") -> DataFrame:
    """One row per distinct (host, text) of docs: __k1, __k2, the counts of the contract, base_failed, n_line_words (in
    removed lines), kept, gone (hashes of removed lines).

    A null text is empty, a null host is the host ''. Empty and blank texts have no words, so they fail. Repeated rows
    and exact copies count as one document; each distinct text that has a line adds one to the line's count. No rows give no rows. Other columns, ids included, are not read.
    """
    source = keyed(docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), host="host")
    counts = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
    all_rows = source.select("__k1", "__k2", "host", "text").mapInArrow(_features, f"__k1 bigint, __k2 bigint, host string, {counts}, lines array<struct<h:bigint,w:bigint>>")
    rest = [c for c in all_rows.columns if c not in ("__k1", "__k2")]
    texts = written(all_rows.groupBy("__k1", "__k2").agg(F.first(F.struct(*rest)).alias("x")).select("__k1", "__k2", "x.*"), "quality")
    lines = texts.select("__k1", "__k2", "host", F.explode("lines").alias("x")).select("__k1", "__k2", "host", "x.h", "x.w")
    hosts = texts.groupBy("host").agg((F.count("*") * rules.percent / 100).alias("share"))
    often = lines.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > rules.documents)
    often = often.join(hosts, "host").where(F.col("n") > F.col("share")).select("host", "h")
    gone = lines.join(often, ["host", "h"]).groupBy("__k1", "__k2").agg(F.sum("w").alias("n_line_words"), F.collect_list("h").alias("gone"))
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.repeated * F.col("n_words"))
    lost = F.coalesce("n_line_words", F.lit(0))
    out = texts.drop("lines", "host").join(gone, ["__k1", "__k2"], "left")
    enough = 100 * (F.col("n_words") - lost) >= rules.left * F.col("n_words")
    return out.withColumns({"base_failed": failed, "n_line_words": lost.cast("long"), "kept": ~failed & enough, "gone": F.coalesce("gone", F.array().cast("array<bigint>"))})


def apply_quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs without rejected rows, and without the boilerplate lines of the others; n_chars follows the text.

    Null and empty texts have no words and are rejected; repeated rows are judged alike and stay; columns may have any name.
    """
    verdicts = quality_verdicts(docs, rules).where("kept").select("__k1", "__k2", "gone")
    names = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row")
    key = content_key(F.coalesce(F.col("source").cast("string"), F.lit("")), F.col("text"))
    kept = docs.select(row, *key).join(verdicts, ["__k1", "__k2"]).select("__row.*", F.col("gone").alias("__removed lines"))

    def clean(text: str | None, gone: list[int]) -> str | None:
        if not gone or text is None:
            return text
        bad = set(gone)
        return "\n".join(x for x in text.split("\n") if not x.strip(" \t\n\v\f\r") or line_hash(x.encode()) not in bad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "text", SLICE):
            at = b.schema.get_field_index("text")
            *arrays, gone = b.columns
            arrays[at] = pa.array([clean(t, g) for t, g in zip(b.column("text").to_pylist(), gone.to_pylist(), strict=True)], arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, names)

    out = kept.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts for all documents."""
    docs = table(spark, sf_dir, "documents")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words"]
    return keyed(docs).select("doc_id", "__k1", "__k2").join(quality_verdicts(docs), ["__k1", "__k2"]).select("doc_id", *columns)
