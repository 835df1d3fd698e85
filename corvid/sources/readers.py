"""Readers of corpus files and benchmark results, with explicit schemas; sinks beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.functions.text import strip_tags
from corvid.plans.scratch import global_row_number
from corvid.sources import warc

DOCUMENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType()))])
METRICS = ("build_p50_ms", "build_p95_ms", "build_p99_ms", "search_p50_ms", "search_p95_ms", "search_p99_ms", "avg_build_time_ms", "avg_search_time_ms", "qps", "peak_rss_mb", "build_peak_rss_mb", "build_memory_delta_mb", "search_peak_rss_mb")
RUN = T.StructType([T.StructField("corpus", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("size", "ef_search", "M", "num_queries", "repetition")), *(T.StructField(c, T.DoubleType()) for c in METRICS)])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT) -> DataFrame:
    """One JSON object a line; blank lines are skipped, fields that are absent are null."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def first_present(*columns: Column) -> Column:
    """The first that is not null: falls back where a field is absent, not where it is empty."""
    return F.coalesce(*columns)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def read_general(spark: SparkSession, path: str) -> DataFrame:
    """Documents whose id is in _id, id or doc_id, and whose text in text, body or content, with a title in meta."""
    fields = ("_id", "id", "doc_id", "title", "text", "body", "content")
    raw = spark.read.schema(T.StructType([T.StructField(f, T.StringType()) for f in fields])).json(path)
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit(""))
    text = F.trim(first_present(F.col("text"), F.col("body"), F.col("content"), F.lit("")))
    return raw.select(first_present(F.col("_id"), F.col("id"), F.col("doc_id")).alias("id"), text.alias("text"), F.create_map(F.lit("title"), title).alias("meta")).where(F.length("text") > 0)


def read_passages(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """id and text from lines of id, tab, text; lines with one field are skipped; no quoting."""
    parts = F.split(F.trim("value"), "\t", 3)
    rows = spark.read.text(path).where(F.size(parts) >= 2).select(parts[0].alias("id"), parts[1].alias("text"), F.create_map(F.lit("source"), F.lit("passages")).alias("meta"))
    return rows.orderBy("id").limit(limit) if limit else rows


def normalise_reviews(rows: DataFrame, least: int = 20) -> DataFrame:
    """id, text (title and text), meta from review rows; texts of `least` characters or fewer go."""
    has = lambda *names: F.coalesce(first_filled(*(F.col(n) for n in names if n in rows.columns)), F.lit(""))
    text = F.trim(F.concat(has("title", "Title"), F.lit(" "), has("text", "Text", "Body")))
    meta = F.struct(*((F.col(n) if n in rows.columns else F.lit(None).cast(t)).alias(a) for n, a, t in (("asin", "asin", "string"), ("rating", "rating", "double"), ("verified_purchase", "verified", "boolean"))))
    return rows.select(has("id", "review_id").alias("id"), text.alias("text"), meta.alias("meta")).where(F.length("text") > least)


def reviews_with_businesses(reviews: DataFrame, businesses: DataFrame, order: Column) -> DataFrame:
    """Reviews left-joined to their business; of several rows of one business the last in `order` counts."""
    last = businesses.groupBy("business_id").agg(F.max_by(F.struct("name", "categories"), order).alias("b"))
    joined = reviews.join(last, "business_id", "left")
    text = F.trim(F.concat(F.coalesce("b.name", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    meta = F.struct("business_id", F.col("stars").alias("rating"), F.col("b.categories").alias("category"))
    return joined.select(F.concat(F.lit("review_"), "review_id").alias("id"), text.alias("text"), meta.alias("meta")).where(F.length("text") > 0)


def html_documents(pages: DataFrame, html: str = "html", least: int = 100, most: int | None = 10_000) -> DataFrame:
    """pages with `text`: tags stripped; texts of `least` characters or fewer go, longer than `most` are cut (None: whole)."""
    rows = pages.withColumn("text", strip_tags(F.col(html))).where(F.length("text") > least)
    return rows.withColumn("text", F.substring("text", 1, most)) if most else rows


def read_warc(spark: SparkSession, path: str, split: int = warc.SPLIT) -> DataFrame:
    """id, url, html of the HTML responses in the WARC files at path: a file, a folder, or a pattern for names in a folder.

    A gzipped file of one member a record is read by a task for each `split` bytes. Records that are cut off or no HTML are
    passed over.
    """
    spark.dataSource.register(warc.WarcSource)
    return spark.read.format("warc").option("split", split).load(path).select("id", "url", "html")


def write_warc(pages: DataFrame, path: str, gzipped: bool = False) -> None:
    """pages (id, url, html) as WARC files of HTTP responses below path, plain or, added to it, gzipped by record."""
    if gzipped:
        pages.sparkSession.dataSource.register(warc.WarcSource)
        pages.select("id", "url", F.lit("response").alias("type"), "html").write.format("warc").mode("append").save(path)
        return
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.coalesce("html", F.lit("")))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: "), F.coalesce("id", F.lit("")), F.lit("\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(http).cast("string"))
    pages.select(F.concat(head, F.lit("\r\n\r\n"), http).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def read_wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """id, text, meta from the page elements of an XML dump."""
    schema = "id bigint, title string, revision struct<text: string>"
    rows = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return rows.select(F.col("id").cast("string").alias("id"), F.col("revision.text").alias("text"), F.create_map(F.lit("title"), F.col("title")).alias("meta")).where(F.length("text") > 0)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding) from Parquet; rows without a vector are left out."""
    return spark.read.schema("vec_id bigint, embedding array<float>").parquet(path).where("embedding is not null")


def read_runs(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """Benchmark runs from JSON arrays in files of such names below path, with the file each is from; columns that older files lack are null."""
    return spark.read.schema(RUN).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", names).json(path).withColumn("file", F.col("_metadata.file_path"))


def union_schemas(*tables: DataFrame) -> DataFrame:
    """All rows, with all columns in the order of their names; missing ones are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.select(sorted(out.columns))


def latency_export(results: DataFrame) -> DataFrame:
    """benchmark, p50_ms, p95_ms, p99_ms by the first of attach, search, batch and build that has a value above 0, else 0."""
    have = set(results.columns)
    pick = lambda p: F.coalesce(*(F.nullif(f"{kind}_{p}_ms", F.lit(0.0)) for kind in ("attach", "search", "batch", "build") if f"{kind}_{p}_ms" in have), F.lit(0.0)).alias(f"{p}_ms")
    return results.select("benchmark", pick("p50"), pick("p95"), pick("p99"))


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, all if there are fewer; the same at every run: those whose hashes are smallest, then keys.

    Rows are counted by the first 16 bits of their hashes. Whole ranges below the one in which the n-th row lies are taken as
    they are; only the rows of that range are put in order, over range partitions, as one key may have any share of all rows.
    """
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    place = F.substring(hashed, 1, 4)
    counts = df.groupBy(place.alias("place")).agg(F.count("*").alias("n")).orderBy("place").collect()  # 65,536 rows at most
    before, cut = 0, None
    for r in counts:
        if before + r["n"] > n:
            cut = r["place"]
            break
        before += r["n"]
    if cut is None:
        return df
    whole = df.where(place < cut)
    if before == n:
        return whole
    last = global_row_number(df.where(place == cut), [hashed.asc(), F.col(key).asc()], "__rn")
    return whole.unionByName(last.where(F.col("__rn") <= n - before).drop("__rn"))


def synthetic_documents(spark: SparkSession, n: int, words: list[str], seed: int = 42) -> DataFrame:
    """doc_id, text of 20 to 200 words; a function of seed and doc_id alone."""
    draw = lambda *x: F.xxhash64(F.lit(seed), *x)
    size = F.pmod(draw(F.col("doc_id")), F.lit(181)) + 20
    array = F.array(*(F.lit(w) for w in words))
    text = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), size), lambda i: F.get(array, F.pmod(draw(F.col("doc_id"), i), F.lit(len(words))).cast("int"))), " ")
    return spark.range(n).withColumnRenamed("id", "doc_id").select("doc_id", text.alias("text"))


def synthetic_embeddings(df: DataFrame, key: str, dim: int = 384, seed: int = 42) -> DataFrame:
    """df's key with a gaussian unit vector that depends on seed and key alone (Box-Muller on hashes)."""
    u = lambda i, s: (F.pmod(F.xxhash64(F.lit(seed + s), F.col(key).cast("string"), i), F.lit(1 << 50)) + 0.5) / float(1 << 50)
    raw = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.sqrt(-2 * F.ln(u(i, 0))) * F.cos(2 * 3.141592653589793 * u(i, 1)))
    vec = df.select(key, raw.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return vec.select(key, F.transform("v", lambda x: (x / norm).cast("float")).alias("embedding"))
