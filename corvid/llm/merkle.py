"""Merkle manifest of a dataset: a leaf per row, a tree of eight-way runs per group, one root, and a proof per row.

Spark hashes the rows, ranks them within their groups and deals them into buckets of 512 consecutive leaves. As a bucket is
aligned to the runs of three levels, these levels need no other bucket: executors hand Arrow batches of whole buckets to
DuckDB, whose ordered string_agg and sha256 queries make one level after the other. Spark combines the buckets' roots, one
row in 512, up to the groups' roots and the root, and joins each bucket's outer proof to it; a second pass of the block
engine completes the proofs of the leaves and folds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.llm.shared import small, table, written
from corvid.plans.scratch import global_row_number

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels inside a bucket; a run has eight nodes, a node 64 hex digits.
LEVELS = 3
BUCKET = 8**LEVELS
#: Leaves that DuckDB gets at once: whole buckets, as many as fit.
PIECE = 16 * BUCKET
SIDES = "array<struct<before:string,after:string>>"


def digest(*values: Column) -> Column:
    """The sha256 of the values as counted text: `-` for null, else the UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _levels(n: Column) -> Column:
    """How often n nodes are grouped by eight until one is left: the octal digits of n - 1."""
    return F.when(n <= 1, 0).otherwise(F.length(F.conv((n - 1).cast("string"), 10, 8))).cast("int")


def rank_leaves(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves (key, group_key, leaf, other) with their group's number and their place in it, and the groups.

    Returns (key, leaf, other, tree, at, n) and (group_key, tree, n). Groups are numbered by name, null first, places by key,
    null first, equal keys by leaf; equal leaves by their place in the table, so that no task gets all copies of a row.
    Only sizes of range partitions are brought together, one row for each partition and group in it.
    """
    order = [F.col("group_key").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("__row")]
    rows = written(leaves.withColumn("__row", F.monotonically_increasing_id()), "leaves")
    place = F.monotonically_increasing_id()  # partition number above, place in the partition below
    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", place).drop("__row"), "ranged-leaves")
    part = F.shiftright("__at", 33).alias("__part")
    sizes = written(ranged.groupBy(part, "group_key").agg(F.min("__at").alias("__first"), F.count("*").alias("__n")), "leaf-counts")
    numbered = global_row_number(sizes.groupBy("group_key").agg(F.sum("__n").alias("n")), [F.col("group_key").asc_nulls_first()], "tree")
    groups = written(numbered.withColumn("tree", F.col("tree") - 1), "groups")
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("group_key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col("s.group_key").eqNullSafe(F.col("g.group_key"))
    offsets = sizes.withColumn("__before", before).alias("s").join(groups.alias("g"), same).select("s.group_key", "__part", "__first", "__before", "tree", "n")
    at = F.col("__at") - F.col("__first") + F.col("__before")
    same = F.col("l.group_key").eqNullSafe(F.col("o.group_key")) & (F.shiftright("__at", 33) == F.col("__part"))
    return ranged.alias("l").join(small(written(offsets, "leaf-offsets")).alias("o"), same).select("key", "leaf", "other", "tree", at.alias("at"), "n"), groups


# --- the block engine: DuckDB over whole buckets ----------------------------------------------------------------------


def _level_queries() -> str:
    """Runs r0.. and nodes n0.. of the levels inside buckets; a bucket's tree may end below the last level (levels)."""
    out = ["n0 AS (SELECT tree, bucket, pos, leaf AS node, levels FROM piece WHERE pos >= 0)"]
    for k in range(LEVELS):
        out.append(f"r{k} AS MATERIALIZED (SELECT tree, bucket, pos // 8 AS run, levels, string_agg(node, '' ORDER BY pos) AS members FROM n{k} WHERE levels > {k} GROUP BY ALL)")
        out.append(f"n{k + 1} AS (SELECT tree, bucket, run AS pos, sha256(members) AS node, levels FROM r{k})")
    return "WITH " + ", ".join(out)


ROOTS = f"{_level_queries()} " + " UNION ALL ".join(f"SELECT tree, bucket, node FROM n{k} WHERE levels = {k}" for k in range(LEVELS + 1))


def _proof_query(proof: str) -> str:
    """Every leaf's siblings inside its bucket, then the bucket's outer ones, and the root folded from `other` or the leaf."""
    place = [f"(pos // {8**k} % 8)" for k in range(LEVELS)]
    sides = ", ".join(f"coalesce(substr(r{k}.members, 1, 64 * {p}), '') AS left{k}, coalesce(substr(r{k}.members, 64 * {p} + 65), '') AS right{k}" for k, p in enumerate(place))
    joins = " ".join(f"LEFT JOIN r{k} ON r{k}.tree = l.tree AND r{k}.bucket = l.bucket AND r{k}.run = pos // {8 ** (k + 1)}" for k in range(LEVELS))
    folds = [f"f{k + 1} AS (SELECT * REPLACE (CASE WHEN levels > {k} THEN sha256(left{k} || folded || right{k}) ELSE folded END AS folded) FROM f{k})" for k in range(LEVELS)]
    inner = " || ".join(f"left{k} || right{k}" for k in range(LEVELS))
    return f"""{_level_queries()},
beyond AS MATERIALIZED (SELECT tree, bucket, sides, subroot, array_to_string(list_transform(sides, lambda z: z.before || z.after), '') AS outside FROM piece WHERE pos < 0),
f0 AS (SELECT l.tree, l.bucket, l.levels, l.key, l.leaf, coalesce(l.other, l.leaf) AS folded, {sides} FROM piece l {joins} WHERE pos >= 0),
{", ".join(folds)},
whole AS (SELECT key, leaf, subroot, {inner} || outside AS proof,
  list_reduce(list_prepend({{'before': folded, 'after': ''}}, sides), lambda h, z: {{'before': sha256(z.before || h.before || z.after), 'after': ''}}).before AS folded_root
  FROM f{LEVELS} JOIN beyond USING (tree, bucket))
SELECT key, leaf, subroot, {proof} AS proof, folded_root FROM whole"""


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows of a partition cut at bucket borders, some PIECE rows at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= PIECE:
            t = pa.Table.from_batches(held)
            last = t.slice(t.num_rows - 1).to_pylist()[0]
            cut = t.num_rows - 1
            trees, buckets = t.column("tree"), t.column("bucket")
            while cut and trees[cut - 1].as_py() == last["tree"] and buckets[cut - 1].as_py() == last["bucket"]:
                cut -= 1
            if cut:
                yield t.slice(0, cut)
            held, rows = t.slice(cut).to_batches(), t.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def _engine(sql: str):
    """The block engine as a function on Arrow batches sorted by bucket; columns that pass through keep their type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""}) as con:
            for piece in _pieces(batches):
                con.register("piece", piece)
                for out in con.sql(sql).to_arrow_reader(PIECE):
                    given = {f.name: f.type for f in piece.schema}
                    yield pa.RecordBatch.from_arrays([out.column(name).cast(given.get(name, pa.string())) for name in out.schema.names], out.schema.names)
                con.unregister("piece")

    return run


# --- above the buckets: Spark -----------------------------------------------------------------------------------------


def combine(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (tree, pos, node, n: the tree's nodes) to their trees' tops (tree, node) and the nodes' paths.

    A path (tree, pos, sides) holds, level by level, the siblings before and after, each as one text. A group of the
    shuffle is a run of eight; every level has an eighth of the rows.
    """
    level, paths, k = nodes, nodes.select("tree", "pos", F.array().cast(SIDES).alias("sides")), 0
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        members = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]), "")
        runs = written(level.where("n > 1").groupBy("tree", F.shiftright("pos", 3).alias("run"), "n").agg(members.alias("members")), "runs")
        level = level.where("n <= 1").unionByName(runs.select("tree", F.col("run").alias("pos"), F.sha2("members", 256).alias("node"), F.shiftright(F.col("n") + 7, 3).alias("n")))
        place = F.shiftright("pos", 3 * k).bitwiseAND(7).cast("int")
        side = F.struct(F.col("members").substr(F.lit(1), 64 * place).alias("before"), F.col("members").substr(64 * place + 65, F.lit(512)).alias("after"))
        grown = F.when(F.col("members").isNull(), F.col("sides")).otherwise(F.concat("sides", F.array(side)))
        paths = paths.withColumn("run", F.shiftright("pos", 3 * (k + 1))).join(runs.select("tree", "run", "members"), ["tree", "run"], "left").select("tree", "pos", grown.alias("sides"))
        most, k = -(-most // 8), k + 1
    return level.select("tree", "node"), paths


def merkle_manifest(rows: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", found: tuple[Column, dict[str, Column]] | None = None, proofs: bool = False) -> DataFrame:
    """Per row: key, leaf, subroot, root, proof_sha256, folded_root, verified; with proofs, the proof itself too.

    A leaf is the digest of the fields. A proof is the row of its siblings' digests, from its own run up to the root. found
    says which rows are found with other contents at verification, and with which values of their fields: their folded_root
    is computed from that leaf and the original proof. A null field is `-`, unlike an empty one; repeated rows are leaves of
    their own; null keys come first in their group, null groups first among the groups; other columns are not read; texts
    of any length are hashed where they are read and never moved; a lone leaf is its group's root; no rows give no rows.
    """
    other = F.lit(None).cast("string")
    if found:
        other = F.when(found[0], digest(*(found[1].get(f, F.col(f)) for f in fields)))
    leaves = rows.select(F.col(key).alias("key"), F.col(group).cast("string").alias("group_key"), digest(*map(F.col, fields)).alias("leaf"), other.alias("other"))
    placed, groups = rank_leaves(leaves)
    blocks = placed.select("key", "leaf", "other", "tree", F.shiftright("at", 3 * LEVELS).alias("bucket"), F.col("at").bitwiseAND(BUCKET - 1).cast("int").alias("pos"), F.least(_levels(F.col("n")), F.lit(LEVELS)).alias("levels"))
    roots = written(_dealt(blocks.select("tree", "bucket", "pos", "leaf", "levels")).mapInArrow(_engine(ROOTS), "tree bigint, bucket bigint, node string"), "bucket-roots")

    nodes = roots.join(groups.select("tree", "n"), "tree").select("tree", F.col("bucket").alias("pos"), "node", F.shiftright(F.col("n") + (BUCKET - 1), 3 * LEVELS).alias("n"))
    tops, paths = combine(nodes)
    subroots = written(tops.withColumnRenamed("node", "subroot"), "subroots")
    top, outer = combine(subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.col("subroot").alias("node"), F.lit(subroots.count()).cast("bigint").alias("n")))
    root = top.first()
    above = subroots.join(outer.select(F.col("pos").alias("tree"), F.col("sides").alias("more")), "tree")
    beyond = paths.join(above, "tree").select("tree", F.col("pos").alias("bucket"), F.concat("sides", "more").alias("sides"), "subroot", F.lit(-1).alias("pos"))

    sql = _proof_query("proof" if proofs else "sha256(proof)")
    kind = rows.schema[key].dataType.simpleString()
    done = _dealt(blocks.unionByName(beyond, allowMissingColumns=True)).mapInArrow(_engine(sql), f"key {kind}, leaf string, subroot string, proof string, folded_root string")
    root = F.lit(root["node"] if root else None).cast("string")
    more = [F.sha2("proof", 256).alias("proof_sha256"), "proof"] if proofs else [F.col("proof").alias("proof_sha256")]
    return done.select(F.col("key").alias(key), "leaf", "subroot", root.alias("root"), *more, "folded_root", (F.col("folded_root") == root).alias("verified"))


def _dealt(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("tree", "bucket").sortWithinPartitions("tree", "bucket")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents by language; where 3 divides crc32(doc_id), the text is found lower-cased (A-Z)."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle_manifest(table(spark, sf_dir, "documents"), found=(hit, {"text": lower}))
