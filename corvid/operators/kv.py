"""Paged sequences with shared prefixes: pages are known by content, so sharing and copy-on-write need no bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.plans.scratch import global_row_number, written


def prefix_hash(tokens: Column, first: int = 100) -> Column:
    """Of the first tokens, joined by commas; prefixes that differ later share it, which the pages' contents settle."""
    return F.sha2(F.array_join(F.slice(tokens, 1, first), ","), 256)


def paginate(turns: DataFrame, page_size: int = 16) -> DataFrame:
    """(seq_id, page_idx, n_tokens, page_key, data) from turns (seq_id, turn, tokens): a page's key is that of its place and content.

    A turn's place in its sequence is a running sum; turns are cut at page ends, and a page is put together from its at
    most page_size pieces, so no sequence is held in one piece.
    """
    by = Window.partitionBy("seq_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.where(F.size("tokens") > 0).withColumn("at", F.coalesce(F.sum(F.size("tokens")).over(by), F.lit(0)))
    first, last = F.floor(F.col("at") / page_size), F.floor((F.col("at") + F.size("tokens") - 1) / page_size)
    cut = placed.select("seq_id", "tokens", "at", F.explode(F.sequence(first, last)).alias("page_idx"))
    start = F.greatest(F.col("page_idx") * page_size - F.col("at"), F.lit(0))
    end = F.least((F.col("page_idx") + 1) * page_size - F.col("at"), F.size("tokens"))
    piece = F.slice("tokens", (start + 1).cast("int"), (end - start).cast("int"))
    parts = cut.select("seq_id", "page_idx", F.struct((start + F.col("at")).alias("at"), piece.alias("piece")).alias("x"))
    data = F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["piece"]))
    pages = parts.groupBy("seq_id", "page_idx").agg(data.alias("data"))
    key = F.sha2(F.concat_ws(":", F.col("page_idx").cast("string"), F.array_join("data", ",")), 256)
    return pages.select("seq_id", "page_idx", F.size("data").cast("long").alias("n_tokens"), key.alias("page_key"), "data")


def shared_pages(pages: DataFrame) -> DataFrame:
    """(page_key, refs, n_tokens) of each distinct page."""
    return pages.groupBy("page_key").agg(F.count("*").alias("refs"), F.max("n_tokens").alias("n_tokens"))


def detach(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """(page_key, refs_before, refs): pages with their references once the sequences in gone (seq_id) are detached; 0 is free."""
    left = pages.join(gone.select("seq_id").distinct().withColumn("__gone", F.lit(1)), "seq_id", "left")
    return left.groupBy("page_key").agg(F.count("*").alias("refs_before"), F.sum(F.when(F.col("__gone").isNull(), 1).otherwise(0)).alias("refs"))


def restore(pages: DataFrame) -> DataFrame:
    """(seq_id, tokens): pages put together again in order; for callers that want whole sequences."""
    ordered = F.array_sort(F.collect_list(F.struct("page_idx", "data")))
    return pages.groupBy("seq_id").agg(F.flatten(F.transform(ordered, lambda x: x["data"])).alias("tokens"))


def page_stats(pages: DataFrame, max_pages: int = 10_000) -> DataFrame:
    """One row: pages referenced, distinct pages, shared ones, all references, share of max_pages in use."""
    keys = shared_pages(pages)
    return keys.agg(
        F.coalesce(F.sum("refs"), F.lit(0)).cast("long").alias("total_refs"), F.count("*").alias("distinct_pages"), F.coalesce(F.sum(F.when(F.col("refs") > 1, 1).otherwise(0)), F.lit(0)).cast("long").alias("shared_pages"),
        F.round(F.count("*") / max_pages, 6).alias("utilisation"),
    )


def page_numbers(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """(page_key, page): numbers from 0 in the order of keys, without gaps (a defragmented layout); fails beyond max_pages."""
    keys = pages.select("page_key").distinct()
    if max_pages is not None:
        n = keys.count()
        if n > max_pages:
            raise ValueError(f"{n} pages are needed, {max_pages} exist")
    return global_row_number(keys, [F.asc("page_key")], "page").withColumn("page", F.col("page") - 1)


def allocate(free: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, page): pages of free (page, place: since when it is free) for requests (request_id, num_pages) in order.

    Pages that are free for longest go first. A request for which not all pages are left gets none, and neither do those
    after it, as a request is never served in part; refused() names them.
    """
    want = _running(requests)
    slots = global_row_number(free, [F.asc("place"), F.asc("page")], "slot").select("slot", "page")
    served = want.where(F.col("upto") <= free.count()).select("request_id", F.explode(F.sequence(F.col("upto") - F.col("num_pages") + 1, F.col("upto"))).alias("slot"))
    return served.join(slots, "slot").select("request_id", "page")


def refused(free: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, num_pages) of the requests that allocate() leaves out."""
    return _running(requests).where(F.col("upto") > free.count()).select("request_id", "num_pages")


def _running(requests: DataFrame) -> DataFrame:
    """Requests with the pages asked for up to each, from sums of range partitions."""
    parts = written(requests.where("num_pages > 0").repartitionByRange("request_id").withColumn("part", F.spark_partition_id()), "requests")
    sums = parts.groupBy("part").agg(F.sum("num_pages").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("num_pages").over(Window.partitionBy("part").orderBy("request_id").rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(F.broadcast(sums.select("part", before.alias("before"))), "part").withColumn("upto", F.col("before") + inside).drop("part", "before")


def defragment(allocated: DataFrame) -> DataFrame:
    """(page, moved_to): the pages in use, numbered from 0 without gaps in their order; pages that stay are named too."""
    return global_row_number(allocated.select("page").distinct(), [F.asc("page")], "moved_to").withColumn("moved_to", F.col("moved_to") - 1)


def free_pages(allocated: DataFrame, freed: DataFrame) -> DataFrame:
    """Allocated pages without those freed; unknown ones are ignored."""
    return allocated.join(freed.select("page").distinct(), "page", "left_anti")


def turn_words(conversations: DataFrame) -> DataFrame:
    """(seq_id, turn, tokens): the words of each turn."""
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r\f]+"), lambda x: x != "")
    return conversations.select(F.col("conv_id").alias("seq_id"), "turn", w.alias("tokens"))


def prefixes(turns: DataFrame, first: int = 100) -> DataFrame:
    """(seq_id, prefix_hash, prefix_tokens): of each sequence's first turn."""
    start = turns.groupBy("seq_id").agg(F.min_by(F.struct(prefix_hash(F.col("tokens"), first).alias("h"), F.size("tokens").alias("n")), "turn").alias("x"))
    return start.select("seq_id", F.col("x.h").alias("prefix_hash"), F.col("x.n").cast("long").alias("prefix_tokens"))
