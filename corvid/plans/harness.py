"""Timing and memory of queries, grids of parameters, and readers by source name."""

from __future__ import annotations

import itertools
import resource
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators import lexical
from corvid.plans import search
from corvid.plans.scratch import global_row_number, scope, written
from corvid.sources import readers


class Timer:
    """Seconds of a with-block, in elapsed."""

    elapsed = 0.0

    def __enter__(self) -> Timer:
        self._start = time.perf_counter()
        return self

    def __exit__(self, *_: object) -> None:
        self.elapsed = time.perf_counter() - self._start


class MemoryProfiler:
    """Resident MB (1024 ** 2 bytes) of the driver's Python; executors' peaks are in Spark's metrics."""

    def __init__(self) -> None:
        self.initial = self.peak = self.current

    @property
    def current(self) -> float:
        try:
            with open("/proc/self/statm") as f:
                return int(f.read().split()[1]) * resource.getpagesize() / 1024**2
        except OSError:
            return 0.0

    def sample(self) -> float:
        now = self.current
        self.peak = max(self.peak, now)
        return now

    @property
    def delta(self) -> float:
        return self.peak - self.initial


@contextmanager
def memory_profiler() -> Iterator[MemoryProfiler]:
    profiler = MemoryProfiler()
    yield profiler
    profiler.sample()


def timed(df: DataFrame) -> float:
    """Seconds to compute all rows, without keeping them."""
    with Timer() as t:
        df.write.format("noop").mode("overwrite").save()
    return t.elapsed


def run_dataset(docs: DataFrame, sample: int = 1000, queries: int = 10, dim: int = 64, k: int = 10) -> dict[str, Any]:
    """Figures of one corpus (id or doc_id, text): documents, and milliseconds to embed, to build an index of cells and to
    search; embeddings are synthetic, queries are the sample's first texts."""
    ids = docs.columns[0]
    rows = readers.sample_exact(docs.where("text is not null").select(ids, "text"), sample, ids)
    numbered = written(global_row_number(rows, [F.asc(ids)], "doc_id").select("doc_id", "text"), "sample")
    with Timer() as embed:
        vectors = written(readers.synthetic_embeddings(numbered, "doc_id", dim).withColumnRenamed("doc_id", "vec_id"), "vectors")
    with Timer() as build:
        written(lexical.postings(numbered), "postings")
    asked = numbered.where(F.col("doc_id") <= queries).withColumnRenamed("doc_id", "query_id").join(vectors.withColumnRenamed("vec_id", "query_id"), "query_id")
    found = search.hybrid(numbered, vectors, asked, k)
    return {"n_docs": numbered.count(), "embed_ms": embed.elapsed * 1000, "build_ms": build.elapsed * 1000, "search_ms": timed(found) * 1000, "num_queries": queries}


def run_datasets(spark: SparkSession, datasets: dict[str, tuple[str, str]], repetitions: int = 1, **options: Any) -> DataFrame:
    """run_dataset on each of datasets (name: source, path), one row per corpus and repetition; what can't be read says why."""
    out = []
    for name, (source, path) in datasets.items():
        for n in range(repetitions):
            try:
                with scope(spark):
                    out.append({"corpus": name, "repetition": n, "error": None} | run_dataset(read(spark, source, path), **options))
            except (AnalysisException, ValueError) as e:
                out.append({"corpus": name, "repetition": n, "error": str(e).splitlines()[0]})
    return spark.createDataFrame(out, "corpus string, repetition int, error string, n_docs bigint, embed_ms double, build_ms double, search_ms double, num_queries int")


def run_grid(spark: SparkSession, make: Callable[..., DataFrame], grid: dict[str, list[Any]], repetitions: int = 5) -> DataFrame:
    """One row per point of the grid and repetition: the parameters, repetition and elapsed_ms; input of stats.summary."""
    rows = []
    for point in itertools.product(*grid.values()):
        given = dict(zip(grid, point, strict=True))
        rows += [given | {"repetition": n, "elapsed_ms": timed(make(**given)) * 1000} for n in range(repetitions)]
    return spark.createDataFrame(rows)


def _reviews(spark: SparkSession, path: str) -> DataFrame:
    return readers.normalise_reviews(spark.read.schema("id string, review_id string, title string, text string, asin string, rating double, verified_purchase boolean").json(path))


def _business_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews and businesses from review.json and business.json below path; of a business's rows that of the greatest line counts."""
    reviews = spark.read.schema("review_id string, business_id string, text string, stars double").json(f"{path}/review.json")
    businesses = spark.read.schema("business_id string, name string, categories string").json(f"{path}/business.json")
    return readers.reviews_with_businesses(reviews, businesses, F.struct("name", "categories"))


#: Readers by the source's name; each takes (spark, path).
SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"jsonl": readers.read_jsonl, "general": readers.read_general, "passages": readers.read_passages, "warc": readers.read_warc, "wiki": readers.read_wiki_pages, "runs": readers.read_runs, "reviews": _reviews, "business_reviews": _business_reviews}


def read(spark: SparkSession, source: str, path: str) -> DataFrame:
    """`source` may have a part after a colon, which names a task and is left to the path."""
    name = source.partition(":")[0]
    if name not in SOURCES:
        raise ValueError(f"unknown source {source}; there are {', '.join(SOURCES)}")
    return SOURCES[name](spark, path)
