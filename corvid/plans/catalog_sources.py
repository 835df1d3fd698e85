"""Queries over files and states: the driver's tables written in each source's format and read back, indices, queues, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions import chunking
from corvid.functions import text as tx
from corvid.operators import kv, lexical, serving, stats, vector
from corvid.plans import harness, search
from corvid.plans.catalog import _KNN, _KNOWN, _POSTINGS, _W, _bm25_sql, _queries, _vectors
from corvid.plans.register import query
from corvid.plans.scratch import scratch_path, table, written
from corvid.sources import postings, readers, sinks
from corvid.sources import vector_index as stored

# --- readers ---


@query("SELECT doc_id::VARCHAR AS id, text, lang, source FROM documents")
def read_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Normalised documents, written as JSON lines and read back."""
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    path = scratch_path(spark, "jsonl")
    readers.write_jsonl(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", meta.alias("meta")), path)
    return harness.read(spark, "jsonl", path).select("id", "text", F.col("meta")["lang"].alias("lang"), F.col("meta")["source"].alias("source"))


@query("SELECT * FROM (SELECT item_id::VARCHAR AS id, trim(text) AS text, CASE WHEN item_id % 3 = 0 THEN '' ELSE 'item' END AS title FROM benchmark) WHERE length(text) > 0")
def read_general(spark: SparkSession, d: str) -> DataFrame:
    """Items under the names _id and body; some without a title."""
    path = scratch_path(spark, "general")
    items = table(spark, d, "benchmark")
    items.select(F.col("item_id").cast("string").alias("_id"), F.when(F.col("item_id") % 3 != 0, "item").alias("title"), F.col("text").alias("body")).write.json(path)
    return harness.read(spark, "general:task", path).select("id", "text", F.col("meta")["title"].alias("title"))


@query(r"SELECT item_id::VARCHAR AS id, trim(regexp_replace(text, '[\t\r\n]+', ' ', 'g')) AS text FROM benchmark WHERE length(trim(text)) > 0")
def read_passages(spark: SparkSession, d: str) -> DataFrame:
    """Lines of id, tab, text, a further field and lines without a tab between them."""
    path = scratch_path(spark, "passages")
    lines = table(spark, d, "benchmark").select(F.concat_ws("\t", F.col("item_id").cast("string"), F.trim(F.regexp_replace("text", r"[\t\r\n]+", " ")), F.lit("more")).alias("value"))
    lines.unionByName(spark.createDataFrame([("no tab",), ("",)], "value string")).write.text(path)
    return harness.read(spark, "passages", path).select("id", "text")


_REVIEW_TEXT = "trim(coalesce(lang, '') || ' ' || coalesce(text, ''))"


@query(f"SELECT doc_id::VARCHAR AS id, {_REVIEW_TEXT} AS text, source AS asin, n_chars::DOUBLE AS rating FROM documents WHERE length({_REVIEW_TEXT}) > 20")
def read_reviews(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "reviews")
    docs = table(spark, d, "documents")
    docs.select(F.col("doc_id").cast("string").alias("review_id"), F.col("lang").alias("title"), "text", F.col("source").alias("asin"), F.col("n_chars").cast("double").alias("rating")).write.json(path)
    return harness.read(spark, "reviews", path).select("id", "text", "meta.asin", "meta.rating")


@query("WITH b AS (SELECT source AS business_id, max(lang) AS name FROM documents WHERE source <> 'src3' GROUP BY source) SELECT 'review_' || doc_id AS id, trim(coalesce(name, '') || ' ' || coalesce(text, '')) AS text, source AS business_id, n_chars::DOUBLE AS rating FROM documents LEFT JOIN b ON business_id = source WHERE length(trim(coalesce(name, '') || ' ' || coalesce(text, ''))) > 0")
def read_business_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Reviews with their businesses, of which some have several rows and one is missing."""
    path = scratch_path(spark, "business")
    docs = table(spark, d, "documents")
    docs.select(F.col("doc_id").cast("string").alias("review_id"), F.col("source").alias("business_id"), "text", F.col("n_chars").cast("double").alias("stars")).write.json(f"{path}/review.json")
    docs.where("source <> 'src3'").select(F.col("source").alias("business_id"), F.col("lang").alias("name"), F.lit("x").alias("categories")).distinct().write.json(f"{path}/business.json")
    return harness.read(spark, "business_reviews", path).select("id", "text", "meta.business_id", "meta.rating")


def _warc(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    readers.write_warc(table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), "url", "html"), path)
    return harness.read(spark, "warc", f"{path}/*.txt")


@query("SELECT page_id::VARCHAR AS id, url, html FROM pages")
def read_warc(spark: SparkSession, d: str) -> DataFrame:
    return _warc(spark, d)


@query("SELECT page_id::VARCHAR AS id, url, html FROM pages")
def read_warc_split(spark: SparkSession, d: str) -> DataFrame:
    """Files of a gzip member a record, each read by several tasks."""
    path = scratch_path(spark, "warc")
    readers.write_warc(table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), "url", "html"), path, gzipped=True)
    return readers.read_warc(spark, f"{path}/*.warc.gz", split=65_536)


@query(r"SELECT page_id::VARCHAR AS id, url, left(text, 10000) AS text FROM (SELECT page_id, url, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS text FROM pages) WHERE length(text) > 100")
def warc_documents(spark: SparkSession, d: str) -> DataFrame:
    """WARC records to documents: tags stripped, short ones left out, long ones cut at 10,000 characters as the reader's format has it."""
    return readers.html_documents(_warc(spark, d)).select("id", "url", "text")


@query(r"SELECT item_id::VARCHAR AS id, 'Item ' || item_id AS title, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM benchmark WHERE length(text) > 0")
def read_wiki_pages(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "wiki")
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    pages = table(spark, d, "benchmark").select(F.concat(F.lit("Item "), F.col("item_id")).alias("title"), F.col("item_id").alias("id"), F.struct(text.alias("text")).alias("revision"))
    pages.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)
    return harness.read(spark, "wiki", path).select("id", F.col("meta")["title"].alias("title"), "text")


@query("SELECT n_name AS corpus, n_nationkey::BIGINT AS size, CASE WHEN n_regionkey > 1 THEN n_nationkey / 2.0 END::DOUBLE AS peak_rss_mb, n_nationkey * 1.5::DOUBLE AS qps FROM nation")
def read_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs in JSON arrays, a file for each region; older files have no memory column."""
    path = scratch_path(spark, "runs")
    for old in (True, False):
        rows = table(spark, d, "nation").where(F.col("n_regionkey") <= 1 if old else F.col("n_regionkey") > 1)
        more = [] if old else [(F.col("n_nationkey") / 2.0).alias("peak_rss_mb")]
        run = F.to_json(F.struct(F.col("n_name").alias("corpus"), F.col("n_nationkey").alias("size"), (F.col("n_nationkey") * 1.5).alias("qps"), *more))
        files = rows.groupBy("n_regionkey").agg(F.concat(F.lit("["), F.array_join(F.collect_list(run), ",\n"), F.lit("]")).alias("value"))
        files.select("value").write.option("maxRecordsPerFile", 1).text(f"{path}/corpus-{old}")
    return readers.read_runs(spark, path, "*.txt").select("corpus", "size", "peak_rss_mb", "qps")


@query("SELECT o_orderpriority AS benchmark, CASE WHEN o_orderpriority LIKE '1%' THEN max(o_totalprice) WHEN o_orderpriority LIKE '2%' THEN min(o_totalprice) ELSE 0 END::DOUBLE AS p50_ms, CASE WHEN o_orderpriority LIKE '3%' THEN max(o_totalprice) ELSE min(o_totalprice) END::DOUBLE AS p95_ms, 0::DOUBLE AS p99_ms FROM orders GROUP BY o_orderpriority")
def latency_export(spark: SparkSession, d: str) -> DataFrame:
    """Results that lack some kinds of latency: null, 0, or the column as a whole."""
    first = lambda n: F.col("o_orderpriority").startswith(n)
    most, least = F.max("o_totalprice").cast("double"), F.min("o_totalprice").cast("double")
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("benchmark"), first("1").alias("a"), first("2").alias("b"), first("3").alias("c")).agg(most.alias("most"), least.alias("least"))
    return readers.latency_export(rows.select("benchmark", F.when(F.col("a"), F.col("most")).alias("attach_p50_ms"), F.when(F.col("b"), F.col("least")).otherwise(0.0).alias("build_p50_ms"), F.when(F.col("c"), F.col("most")).otherwise(0.0).alias("search_p95_ms"), F.col("least").alias("batch_p95_ms")))


@query("SELECT o_orderkey, CASE WHEN k = 0 THEN n * 1000 WHEN k = 1 THEN n * 1000000 WHEN k = 2 THEN n ELSE NULL END::BIGINT AS size, CASE WHEN k = 3 THEN NULL ELSE n END::BIGINT AS trailing, CASE WHEN z >= 0 THEN 2 * z ELSE -2 * z - 1 END::BIGINT AS zigzag, z::BIGINT AS z FROM (SELECT o_orderkey, o_orderkey % 4 AS k, o_orderkey % 977 AS n, (o_orderkey % 2001 - 1000) * 1000003 AS z FROM orders)")
def numbers_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Sizes such as 10k, numbers at the end of names, and zigzag numbers with their way back."""
    n, k = (F.col("o_orderkey") % 977).cast("string"), F.col("o_orderkey") % 4
    size = F.when(k == 0, F.concat(n, F.lit("K"))).when(k == 1, F.concat(F.lit(" "), n, F.lit("m"))).when(k == 2, n).otherwise("many")
    name = F.when(k == 3, F.concat(F.lit("doc_"), n, F.lit("x"))).otherwise(F.concat(F.lit("a_doc_"), n))
    zig = tx.zigzag(((F.col("o_orderkey") % 2001 - 1000) * 1000003).cast("long"))
    return table(spark, d, "orders").select("o_orderkey", tx.parse_size(size).alias("size"), tx.trailing_id(name).alias("trailing"), zig.alias("zigzag"), tx.unzigzag(zig).alias("z"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 4) AS square FROM embeddings")
def read_embeddings(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "embeddings")
    sinks.write_embeddings(table(spark, d, "embeddings"), path)
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return readers.read_embeddings(spark, path).select("vec_id", F.round(square, 4).alias("square"))


# --- sinks ---


@query("SELECT event_type, count(*)::VARCHAR AS n, max(event_id)::VARCHAR AS last FROM events GROUP BY event_type")
def results_csv(spark: SparkSession, d: str) -> DataFrame:
    """Aggregated results as CSV with a header; the nested column goes to JSON alone."""
    path = scratch_path(spark, "results")
    events = table(spark, d, "events")
    found = events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"), F.array(F.min("event_id")).alias("ids"))
    sinks.write_results(events, found, path)
    return spark.read.option("header", True).csv(f"{path}/results_aggregated.csv")


@query(f"WITH {_bm25_sql(_W, 10)} SELECT * FROM ranked")
def bm25_index(spark: SparkSession, d: str) -> DataFrame:
    """As bm25_topk, from an index that was written with the even documents and got the odd ones later."""
    path, docs = scratch_path(spark, "index"), table(spark, d, "documents").select("doc_id", "text")
    sinks.write_index(docs.where("doc_id % 2 = 0"), path, buckets=16)
    sinks.append_index(docs.where("doc_id % 2 != 0"), path)
    return sinks.search_index(spark, path, _queries(spark, d))


@query("SELECT count(*) AS n_kept, 0::BIGINT AS n_new, true AS same FROM benchmark JOIN embeddings ON vec_id = item_id")
def hybrid_kept(spark: SparkSession, d: str) -> DataFrame:
    """Searching twice: the second time all results are kept ones, and the same."""
    docs, v = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "embeddings")
    asked = _queries(spark, d).join(v.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    first, add = search.hybrid_kept(docs, v, asked, spark.createDataFrame([], search.RESULTS))
    kept, first = written(add, "kept"), written(first, "first")
    again, more = search.hybrid_kept(docs, v, asked, kept)
    differing = first.exceptAll(again).unionByName(again.exceptAll(first))
    counts = again.agg(F.countDistinct("query_id").alias("n_kept")).crossJoin(more.agg(F.count("*").alias("n_new"))).crossJoin(differing.agg((F.count("*") == 0).alias("same")))
    return counts.select("n_kept", "n_new", "same")


# --- lookups, codecs, chunks ---


@query(f"SELECT doc_id, 'the' AS term, len(list_filter({_W}, lambda w: w = 'the'))::BIGINT AS tf FROM documents")
def term_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return lexical.lookup(lexical.term_frequencies(docs), docs.select("doc_id", F.lit("the").alias("term"))).select("doc_id", "term", "tf")


@query(f"{_POSTINGS} SELECT term, block, count(*) AS n, sum(gap)::BIGINT AS gaps, sum(1 + (gap >= 128)::INT + (gap >= 16384)::INT + (gap >= 2097152)::INT + (gap >= 268435456)::INT)::BIGINT AS bytes FROM g GROUP BY term, block")
def postings_varint(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of each postings block as varint bytes, decoded again; a block is bounded, so its bytes are too."""
    return postings.decoded_gaps(postings.coded_gaps(lexical.postings(table(spark, d, "documents"))))


_TOKENS = f"flatten(list_transform({_W}, lambda w: CASE WHEN w IN {_KNOWN} THEN [w] ELSE list_transform(range(length(w)), lambda i: '') END))"


@query(f"SELECT doc_id, (i // 112)::INTEGER AS chunk_idx, array_to_string(list_filter(list_slice(w, i + 1, i + 128), lambda x: x <> ''), ' ') AS chunk FROM (SELECT doc_id, {_TOKENS} AS w, unnest(range(0, len({_TOKENS}), 112)) AS i FROM documents)")
def chunk_token_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(tx.id_chunks(F.col("text"), 128, 16)).alias("chunk_idx", "chunk"))


@query(f"SELECT doc_id, (i // 112)::INTEGER AS chunk_idx, array_to_string(list_filter(list_slice(w, i + 1, i + 128), lambda x: x <> ''), ' ') AS chunk FROM (SELECT doc_id, {_TOKENS} AS w, unnest(range(0, len({_TOKENS}), 112)) AS i FROM documents)")
def chunk_table_function(spark: SparkSession, d: str) -> DataFrame:
    """As chunk_token_ids, by the table function that takes any tokenizer."""
    return chunking.chunk_by(table(spark, d, "documents"), chunking.compat, 128, 16).select("doc_id", "chunk_idx", "chunk")


@query()
def chunk_byte_pairs(spark: SparkSession, d: str, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> DataFrame:
    """Pieces of 512 tokens of a byte-pair vocabulary."""
    return chunking.chunk_by(table(spark, d, "documents"), chunking.byte_pairs(vocabulary))


@query("SELECT doc_id || '_chunk_' || (i // 462) AS id, substring(text, i + 1, 512) AS text, lang, (i // 462)::VARCHAR AS chunk_idx, ((length(text) + 461) // 462)::VARCHAR AS total_chunks FROM (SELECT *, unnest(range(0, length(text), 462)) AS i FROM documents)")
def chunk_documents_meta(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.create_map(F.lit("lang"), F.col("lang")).alias("meta"))
    meta = F.col("meta")
    return tx.chunk_documents(docs).select("id", "text", *(meta[c].alias(c) for c in ("lang", "chunk_idx", "total_chunks")))


# --- queues and pages ---

_LATEST = "(SELECT max(ts) FROM events)"


@query(f"WITH q AS (SELECT event_type, min(ts) AS oldest, count(*) AS n FROM events WHERE ts > {_LATEST} - INTERVAL 90 MINUTES GROUP BY event_type) SELECT event_id AS request_id FROM events JOIN q USING (event_type) WHERE event_type = 'click' AND ts > {_LATEST} - INTERVAL 90 MINUTES AND {_LATEST} - oldest >= INTERVAL 50 MILLISECONDS")
def released(spark: SparkSession, d: str) -> DataFrame:
    """Requests of a queue whose oldest has waited 50 ms by the time of the last event."""
    events = table(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))
    waiting = events.crossJoin(F.broadcast(now)).where("event_type = 'click' AND ts > now - INTERVAL 90 MINUTES").select(F.col("event_id").alias("request_id"), F.col("ts").alias("created_at"), "now")
    return serving.released(waiting, F.col("now")).select("request_id")


@query("SELECT event_id AS request_id FROM events WHERE event_type <> 'error'")
def complete(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "events").select(F.col("event_id").alias("request_id"), "event_type")
    return serving.complete(requests, requests.where("event_type = 'error'")).select("request_id")


_QUEUE = "l AS (SELECT user_id AS key, arg_max(event_type, event_id) AS op, arg_max(value, event_id) AS score FROM events GROUP BY user_id), q AS (SELECT key, score FROM l WHERE op <> 'error')"


def _queue(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").otherwise("push").alias("op")
    return serving.queue_state(table(spark, d, "events").select(F.col("event_id").alias("seq"), op, F.col("user_id").alias("key"), F.col("value").alias("score")))


@query(f"WITH {_QUEUE} SELECT count(*) AS size, arg_min(key, (score, key)) AS next_key, min(score) AS next_score FROM q")
def queue_peek(spark: SparkSession, d: str) -> DataFrame:
    return serving.queue_info(_queue(spark, d))


@query(f"WITH {_QUEUE} SELECT DISTINCT events.user_id AS key, q.key IS NOT NULL AS contained, score FROM events LEFT JOIN q ON q.key = user_id")
def queue_contains(spark: SparkSession, d: str) -> DataFrame:
    return serving.scores_of(_queue(spark, d), table(spark, d, "events").select(F.col("user_id").alias("key")))


_WANT = "w AS (SELECT conv_id AS request_id, sum(length(coalesce(text, '')) // 100 + 1)::BIGINT AS num_pages FROM conversations GROUP BY conv_id), u AS (SELECT *, sum(num_pages) OVER (ORDER BY request_id) AS upto FROM w)"


def _requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """500 pages, the odd ones free for longest, and each conversation's need of pages."""
    free = spark.range(500).select(F.col("id").alias("page"), (F.col("id") % 2 == 0).cast("int").alias("place"))
    pages = F.floor(F.length(F.coalesce("text", F.lit(""))) / 100) + 1
    return free, table(spark, d, "conversations").groupBy(F.col("conv_id").alias("request_id")).agg(F.sum(pages).cast("long").alias("num_pages"))


@query(f"WITH {_WANT}, s AS (SELECT request_id, unnest(range(upto::BIGINT - num_pages, upto::BIGINT)) AS slot FROM u WHERE upto <= 500) SELECT request_id, CASE WHEN slot < 250 THEN 2 * slot + 1 ELSE 2 * (slot - 250) END::BIGINT AS page FROM s")
def page_allocate(spark: SparkSession, d: str) -> DataFrame:
    return kv.allocate(*_requests(spark, d))


@query(f"WITH {_WANT} SELECT request_id, num_pages FROM u WHERE upto > 500")
def page_refused(spark: SparkSession, d: str) -> DataFrame:
    return kv.refused(*_requests(spark, d))


@query("SELECT event_id AS page, row_number() OVER (ORDER BY event_id) - 1 AS moved_to FROM events WHERE event_type <> 'click'")
def page_defragment(spark: SparkSession, d: str) -> DataFrame:
    """Pages in use after those of clicks were freed, and where they move."""
    pages = table(spark, d, "events").select(F.col("event_id").alias("page"), "event_type")
    return kv.defragment(kv.free_pages(pages, pages.where("event_type = 'click'")))


# --- tails ---

_RANKED = "SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL"


@query(f"SELECT event_type, max(n) AS n, {', '.join(f'max(value) FILTER (r = floor(n * {s})) AS {c}' for c, s in (('p50', 0.5), ('p95', 0.95), ('p99', 0.99), ('p999', 0.999)))} FROM ({_RANKED}) GROUP BY event_type")
def latency_tail(spark: SparkSession, d: str) -> DataFrame:
    return stats.nearest_rank(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999})


@query("SELECT event_type, round(sum(value), 4) AS total, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY event_type")
def latency_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """What each kind adds to the whole."""
    events = table(spark, d, "events")
    whole = events.agg(F.sum("value").alias("whole"))
    return events.groupBy("event_type").agg(F.sum("value").alias("t")).crossJoin(F.broadcast(whole)).select("event_type", F.round("t", 4).alias("total"), F.round(F.col("t") / F.col("whole"), 6).alias("share"))


# --- a written index of vectors ---


@query(f"WITH t AS ({_KNN.format(more=' AND v.label IN (1, 3)')}) SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_true, round(max(distance), 6) AS farthest, true AS found_nine FROM t")
def vector_index(spark: SparkSession, d: str) -> DataFrame:
    """Written from half of the vectors, the rest appended (twice, as one batch), searched among two labels; whether nine in ten
    of the true neighbours are found."""
    v, q = _vectors(spark, d)
    path = scratch_path(spark, "vectors")
    half = F.pmod(F.xxhash64("vec_id"), F.lit(2))
    stored.write_vectors(v.where(half == 0), path)
    for _ in range(2):
        stored.append_vectors(v.where(half == 1), path, "rest")
    wanted = F.col("label").isin(1, 3)
    truth = written(vector.knn_exact(v.where(wanted), q), "truth")
    recalls = vector.recall_at(stored.search_vectors(spark, path, q, where=wanted), truth, 10)
    return truth.agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_true"), F.max("distance").alias("farthest")).crossJoin(recalls.agg((F.avg("recall") >= 0.9).alias("found_nine")))
