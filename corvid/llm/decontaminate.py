"""Benchmark decontamination: test items found inside documents by size-partitioned MinHash containment search.

Items are partitioned by their number q of distinct word 5-grams, in powers of 2; a shorter item is one shingle. A
partition has one sketch length k, and an item's sketch is its k smallest shingle hashes. A document that contains a
share t of an item lacks (1 - t) q of its shingles at most, so it has k - (1 - t) q of the sketch or more, and t q shingles
itself. k is the least by which each item of the partition asks for SURE % of its shingles: none can be missed at any size,
and documents that share a few shingles with an item aren't looked at. What the search finds is verified on the
shingles themselves. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.shared import content_key, small, table, written

#: Sketch hits that make a candidate, as a percentage of an item's shingles (one at least).
SURE = 10
#: Sketch rows that are sent to all executors at once (some 30 bytes each); larger benchmarks are searched in blocks.
BLOCK = 500_000
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, in lower case; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAKS), lambda w: w != "")


def shingles(w: Column, k: int, of=lambda *s: F.concat_ws(" ", *s)) -> Column:
    """of(each k words of w), by default joined by spaces; an empty array if there are fewer than k.

    The outer transform, over an array of one, binds the words, which would else be split again for each shingle; single
    elements are taken as slice() walks the whole array each time.
    """

    def each(v: Column) -> Column:
        n = F.size(v)
        places = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: of(*(F.get(v, i + j) for j in range(k))))

    return F.element_at(F.transform(F.array(w), each), 1)


def _items(benchmark: DataFrame, k: int, percent: int) -> DataFrame:
    """The items' shingles and sketches: __i1, __i2, item_id, length (words to a shingle), shingles, n_item, least (shingles
    that a document has), sketch, hits (of the sketch that it has)."""
    w = words(F.col("text"))
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct().withColumn("length", F.least(F.size(w), F.lit(k))).where("length > 0")
    of = lambda kind: F.coalesce(*(F.when(F.col("length") == n, shingles(w, n, *kind)) for n in range(1, k + 1)))
    items = items.select(F.xxhash64("item_id", "text", F.lit(1)).alias("__i1"), F.xxhash64("text", "item_id", F.lit(2)).alias("__i2"), "item_id", "length", F.array_distinct(of(())).alias("shingles"), F.array_sort(F.array_distinct(of((F.xxhash64,)))).alias("hashes"))
    items = items.withColumn("n_item", F.size("shingles"))
    lacking = lambda n: F.floor(n * (100 - percent) / 100).cast("int")
    most = F.pow(F.lit(2), F.floor(F.log2("n_item")) + 1) - 1  # of the item's partition
    items = items.withColumn("sketch", F.slice("hashes", F.lit(1), lacking(most) + F.greatest(F.ceil(most * SURE / 100), F.lit(1)).cast("int")))
    return items.drop("hashes").withColumns({"least": F.ceil(F.col("n_item") * percent / 100), "hits": F.size("sketch") - lacking(F.col("n_item"))})


def find_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """__k1, __k2 (content_key of a document's text), item_id, n_matched, n_item, containment, one row per distinct text
    and item row that it contains.

    A document contains an item if percent % of the item's distinct shingles are among its own; an item of fewer than k
    words has one, the whole sequence, which then stands in the document. Items and documents without words, null and
    empty ones too, are never reported. Equal item rows count once, items of one id with different texts each. Either
    table may be empty. Other columns are not read, whatever their names.
    """
    items = written(_items(benchmark, k, percent), "items")
    source = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = source.select(*content_key(F.col("text")), "text")
    key = ["__k1", "__k2"]
    out = []
    for length, rows in sorted(tuple(r) for r in items.groupBy("length").agg(F.sum(F.size("sketch"))).collect()):  # k rows at most
        mine = items.where(F.col("length") == length)
        sketches = mine.select("__i1", "__i2", "least", "hits", F.explode("sketch").alias("h"))
        blocks, found = -(-rows // BLOCK), []
        each = keyed.select(*key, F.array_distinct(shingles(words(F.col("text")), length, F.xxhash64)).alias("x"))
        for block in range(blocks):  # by items, so that all hits of one are counted together
            part = F.broadcast(sketches.where(F.pmod(F.xxhash64("__i1", "__i2"), F.lit(blocks)) == block))
            marks = each.select(*key, F.size("x").alias("n"), F.explode("x").alias("h"))
            found.append(marks.join(part, "h").where("n >= least").select(*key, "__i1", "__i2", "hits", "h").distinct())
        found = reduce(DataFrame.unionByName, found).groupBy(*key, "__i1", "__i2").agg(F.count("*").alias("had"), F.first("hits").alias("hits")).where("had >= hits")
        found = written(found.select(*key, "__i1", "__i2"), "found")
        # Copies of a text are each verified, where they are: no text that a third of all rows have meets in a task.
        texts = keyed.join(small(written(found.select(*key).distinct(), "texts")), key, "left_semi")
        own = texts.select(*key, F.array_distinct(shingles(words(F.col("text")), length)).alias("own"))
        both = own.join(small(found), key).join(small(mine.select("__i1", "__i2", "item_id", "shingles", "n_item")), ["__i1", "__i2"])
        out.append(both.select(*key, "item_id", F.size(F.array_intersect("shingles", "own")).cast("long").alias("n_matched"), F.col("n_item").cast("long").alias("n_item")))
    if not out:
        item = benchmark.schema["item_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"__k1 bigint, __k2 bigint, item_id {item}, n_matched bigint, n_item bigint, containment double")
    matched = reduce(DataFrame.unionByName, out).where(F.col("n_matched") * 100 >= F.col("n_item") * percent)
    return written(matched.distinct(), "matched").withColumn("containment", F.col("n_matched") / F.col("n_item"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text contains an item; null and empty texts stay, and so do repeated rows."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    bad = written(find_contaminated(docs, benchmark).select("__k1", "__k2").distinct(), "bad")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct(*names).alias("__row"), *content_key(text)).join(small(bad), ["__k1", "__k2"], "left_anti").select("__row.*")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and an item that it contains."""
    docs = table(spark, sf_dir, "documents")
    found = find_contaminated(docs, table(spark, sf_dir, "benchmark"))
    ids = docs.select("doc_id", *content_key(F.coalesce("text", F.lit(""))))
    return ids.join(small(found), ["__k1", "__k2"]).select("doc_id", "item_id", "n_matched", "n_item", "containment")

