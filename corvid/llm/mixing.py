"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree of domains, languages and sources. At each node it is shared among the children by
weight; a child takes no more than it can give (its tokens times the epochs allowed), and what it leaves goes to its
siblings by weight, so only what a whole subtree lacks reaches the siblings of an ancestor. What stands below a weight of
zero gives nothing, to no node above it either. A leaf's quota is filled with
whole epochs and then a prefix of the documents in an order seeded by epoch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.llm.shared import SPACES, content_key, table, written

LEAF = ["domain", "lang", "source"]
#: Documents to a bucket of a leaf's order, about.
BUCKET = 512


@dataclass(frozen=True)
class Mixture:
    """Target weights. Domains are given by a pattern on the source, the first that matches; other sources are 'other'."""

    domains: tuple[tuple[str, str, float], ...] = (("web", "^src[0-4]$", 4.0), ("code", "^src[5-9]$", 2.0), ("books", "^src1[0-4]$", 3.0))
    other: float = 1.0
    languages: tuple[tuple[str, float], ...] = (("en", 6.0), ("fr", 2.0), ("de", 1.0), ("es", 1.0))
    other_language: float = 1.0
    #: Sources of equal weight but for these.
    sources: tuple[tuple[str, float], ...] = (("src0", 2.0),)
    #: Budget in tokens: this percentage of all documents' tokens.
    percent: int = 60
    epochs: int = 2
    seed: int = 17

    def domain(self, source: Column) -> Column:
        out = F
        for name, pattern, _ in self.domains:
            out = out.when(source.rlike(pattern), name)
        return out.otherwise("other") if self.domains else F.lit("other")


def _weight(key: Column, weights: tuple, rest: float) -> Column:
    out = F
    for name, w in weights:
        out = out.when(key == name, float(w))
    return out.otherwise(float(rest)) if weights else F.lit(float(rest))


def share(children: DataFrame, parent: list[str]) -> DataFrame:
    """children (parent's columns, weight: over 0, room, given: the parent's budget) with `got`: the budget shared by weight up to each child's room.

    In the order of room per weight the full children are a prefix: a child is full if what is left for it and those
    after it, by weight, is its room or more.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("room") / F.col("weight"), "name")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    taken, weights = F.coalesce(F.sum("room").over(before), F.lit(0.0)), F.sum("weight").over(rest)
    full = (F.col("given") - taken) * F.col("weight") >= F.col("room") * weights
    out = children.withColumn("full", full)
    left = F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(by), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(by)
    return out.withColumn("got", F.when(F.col("full"), F.col("room")).otherwise(left * F.col("weight") / open_weight)).drop("full")


def quotas(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """leaves (domain, lang, source, tokens, documents) with quota in tokens."""
    whole = leaves.agg((F.floor(F.sum("tokens") * mixture.percent / 100)).cast("double").alias("given"))
    weights = {"domain": _weight(F.col("domain"), tuple((n, w) for n, _, w in mixture.domains), mixture.other), "lang": _weight(F.col("lang"), mixture.languages, mixture.other_language), "source": _weight(F.col("source"), mixture.sources, 1.0)}
    live = leaves
    for w in weights.values():
        live = live.where(w > 0)
    given, nodes = whole, None
    for depth, key in enumerate(LEAF):
        path, parent = LEAF[: depth + 1], LEAF[:depth]
        level = live.groupBy(*path).agg((F.sum("tokens") * mixture.epochs).cast("double").alias("room"))
        level = level.join(given, parent) if parent else level.crossJoin(F.broadcast(given))  # one row
        nodes = share(level.withColumns({"weight": weights[key], "name": F.col(key)}), parent)
        given = nodes.select(*path, F.col("got").alias("given"))
    return leaves.join(nodes.select(*LEAF, F.floor(F.col("got") + 1e-6).cast("long").alias("quota")), LEAF)


def mix(docs: DataFrame, mixture: Mixture = Mixture(), texts: bool = False) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens: one row for each use of a document; with `texts` its text too.

    Tokens are words split at ASCII white space; null and empty texts have none and are taken while their place in the
    order lies in the prefix. Null languages and sources are called 'unknown'; null ids order as ''. Repeated rows are
    documents of their own. An empty table gives no rows; other columns are not read. The order of an epoch is that of
    md5(seed:epoch:doc_id), then of the text's hash. A leaf's order is cut into buckets, so that a prefix needs bucket sums and a
    sort of the one bucket in which it ends.
    """
    plain = F.trim(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACES, " "))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    rows = docs.select("doc_id", named("lang").alias("lang"), named("source").alias("source"), plain.alias("__plain"), *content_key(F.col("text")))
    size = F.when(F.col("__plain") == "", 0).otherwise(F.size(F.split("__plain", " "))).cast("long")
    rows = written(rows.select("doc_id", mixture.domain(F.col("source")).alias("domain"), "lang", "source", size.alias("n_tokens"), "__k1", "__k2"), "mix")
    leaves = written(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")), "leaves")
    plan = quotas(leaves, mixture)
    whole = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("quota") / F.col("tokens")), F.lit(mixture.epochs))).otherwise(0).cast("int")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("quota") - F.col("whole") * F.col("tokens"))
    plan = written(plan.select(*LEAF, "whole", "rest", F.ceil(F.col("documents") / BUCKET).cast("long").alias("buckets")), "plan")
    dealt = rows.join(plan, LEAF)
    columns = ["doc_id", *LEAF, "epoch", "n_tokens", *(["__k1", "__k2"] if texts else [])]
    full = dealt.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))).select(columns)
    key = F.md5(F.concat_ws(":", F.lit(str(mixture.seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    place = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2.0**32 * F.col("buckets")).cast("long")
    part = dealt.where(f"whole < {mixture.epochs}").withColumn("key", key).withColumn("bucket", place)
    sums = part.groupBy(*LEAF, "rest", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = F.coalesce(F.sum("in_bucket").over(Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).where("before <= rest").select(*LEAF, "bucket", "before", "in_bucket")
    near = part.join(sums, [*LEAF, "bucket"])
    inside = near.where("before + in_bucket <= rest")
    run = F.sum("n_tokens").over(Window.partitionBy(*LEAF, "bucket").orderBy("key", "__k1").rowsBetween(Window.unboundedPreceding, 0))
    edge = near.where("before + in_bucket > rest").withColumn("run", run).where("before + run <= rest")
    prefix = [x.withColumn("epoch", F.col("whole")).select(columns) for x in (inside, edge)]
    uses = full.unionByName(prefix[0]).unionByName(prefix[1])
    if not texts:
        return uses
    # Texts join by content and id, repeated rows once: a text that many documents have is dealt over tasks by their ids.
    uses, key = uses.withColumn("__i", F.xxhash64("doc_id")), ["__k1", "__k2", "__i"]
    own = docs.select(*content_key(F.col("text")), F.xxhash64("doc_id").alias("__i"), F.col("text").alias("__text"))
    return uses.join(own.groupBy(*key).agg(F.first("__text").alias("text")), key).drop(*key)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 60 % of their tokens in at most two epochs."""
    return mix(table(spark, sf_dir, "documents"))


def _case(column: str, pairs, otherwise) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else repr(float(v))
    return "CASE " + " ".join(f"WHEN {column} {op} '{a}' THEN {quote(b)}" for op, a, b in pairs) + f" ELSE {quote(otherwise)} END"


def mix_sql(m: Mixture = Mixture()) -> str:
    """The same in DuckDB SQL, with one sort of each leaf in place of buckets."""
    domain = "CASE " + " ".join(f"WHEN regexp_matches(source, '{p}') THEN '{n}'" for n, p, _ in m.domains) + " ELSE 'other' END"
    weight = {"domain": _case("domain", [("=", n, w) for n, _, w in m.domains], m.other), "lang": _case("lang", [("=", n, w) for n, w in m.languages], m.other_language), "source": _case("source", [("=", n, w) for n, w in m.sources], 1.0)}
    steps, given = [], "SELECT floor(sum(tokens) * %d / 100.0)::DOUBLE AS given FROM leaves" % m.percent
    steps.append(f"g0 AS ({given})")
    steps.append(f"live AS (SELECT * FROM leaves WHERE {' AND '.join(f'{w} > 0' for w in weight.values())})")
    for depth, key in enumerate(LEAF):
        path, parent = ", ".join(LEAF[: depth + 1]), ", ".join(LEAF[:depth])
        by = f"PARTITION BY {parent}" if parent else ""
        join = f"JOIN g{depth} USING ({parent})" if parent else f"CROSS JOIN g{depth}"
        steps += [
            f"l{depth} AS (SELECT {path}, (sum(tokens) * {m.epochs})::DOUBLE AS room, {weight[key]} AS weight FROM live GROUP BY {path})",
            f"f{depth} AS (SELECT *, (given - coalesce(sum(room) OVER ({by} ORDER BY room / weight, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight >= room * sum(weight) OVER ({by} ORDER BY room / weight, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sat FROM l{depth} {join})",
            f"g{depth + 1} AS (SELECT {path}, CASE WHEN sat THEN room ELSE (given - coalesce(sum(room) FILTER (sat) OVER ({by}), 0)) * weight / sum(weight) FILTER (NOT sat) OVER ({by}) END AS given FROM f{depth})",
        ]
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents
), r AS (SELECT *, {domain} AS domain FROM d), leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM r GROUP BY ALL),
{", ".join(steps)},
q AS (SELECT leaves.*, floor(given + 1e-6)::BIGINT AS quota FROM leaves JOIN g3 USING (domain, lang, source)),
p AS (SELECT *, CASE WHEN tokens > 0 THEN least(quota // tokens, {m.epochs}) ELSE 0 END::INTEGER AS whole FROM q),
s AS (SELECT r.doc_id, domain, lang, source, n_tokens, whole, quota - whole * tokens AS rest, md5('{m.seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM r JOIN p USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT doc_id, domain, lang, source, unnest(range(whole))::INTEGER AS epoch, n_tokens FROM s
UNION ALL SELECT doc_id, domain, lang, source, whole AS epoch, n_tokens FROM c WHERE whole < {m.epochs} AND run <= rest
"""
