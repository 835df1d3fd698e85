"""A layered proximity graph, built by inserting nodes in batches that search the graph so far, and its search.

Layer n holds the nodes of level n and more, about half as many as the layer below, so a layer is the batch that is added to
the one above it. Vectors and queries without an embedding are left out; vec_id must not be repeated (check_ids tells);
empty tables give empty results. Vectors that are equal are nodes of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.operators import vector
from corvid.operators.lexical import top_k
from corvid.operators.vector import PLACES, distances, l2, level, matrix
from corvid.plans.scratch import global_row_number, written

#: Nodes up to which a layer is compared with queries as a whole: the highest such layers are linked exactly, and a search
#: enters at the lowest of them.
ENTRY = 256
#: Nodes up to which a layer is linked from exact distances; in larger ones batches are inserted along the links.
EXACT = 131_072
#: Best candidates of a node from which its links are taken, for each link.
CANDIDATES = 3
#: Highest level, so high that the layers shrink to ENTRY nodes whatever the table.
LEVELS = 40
#: Best nodes that a node to be inserted keeps in each layer above, and the least that a search does.
WIDTH = 8
#: Links of a node that make each layer one component: to its parent, its first child and its next sibling.
TREE = 3
LINKS = "layer int, vec_id bigint, neighbour bigint, distance double"
FOUND = "query_id bigint, rank int, vec_id bigint, distance double"


def _measured(pairs: DataFrame, vectors: DataFrame, a: str = "query_id", b: str = "vec_id") -> DataFrame:
    """pairs (a, b) of ids with the rounded distance of their vectors."""
    one, two = (vectors.select(F.col("vec_id").alias(c), F.col("embedding").alias(f"__{c}")) for c in (a, b))
    return pairs.join(one, a).join(two, b).select(a, b, F.round(l2(F.col(f"__{a}"), F.col(f"__{b}")), PLACES).alias("distance"))


def _groups(batches: Iterator[pa.RecordBatch], kernel) -> Iterator[pa.RecordBatch]:
    """What kernel makes of the rows of each vec_id (ids, distances, matrix, more columns); rows come sorted by vec_id."""
    held = None
    for b in batches:
        rows = pa.Table.from_batches([b])
        held = rows if held is None else pa.concat_tables([held, rows])
        if held.num_rows:
            at = np.asarray(held.column("vec_id"), np.int64)
            last = len(at) - int(np.argmax(at[::-1] != at[-1])) if at[0] != at[-1] else 0
            if last:
                yield from kernel(held.slice(0, last).combine_chunks())
                held = held.slice(last)
    if held is not None and held.num_rows:
        yield from kernel(held.combine_chunks())


def _columns(rows: pa.Table):
    """Of whole groups: ids, neighbours, distances, the neighbours' vectors, and where groups begin and end."""
    at, other, d = np.asarray(rows.column("vec_id"), np.int64), np.asarray(rows.column("neighbour"), np.int64), np.asarray(rows.column("distance"), np.float64)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1, [len(at)]))
    return at, other, d, matrix(rows.column("embedding").combine_chunks()), list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _batch(at: np.ndarray, other: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(other), pa.array(d)], ["vec_id", "neighbour", "distance"])


def _diverse(m: int):
    """Of each node's candidates, nearest first, those nearer to the node than to any taken before; then the nearest others."""

    def taken(x: np.ndarray, d: np.ndarray) -> list[int]:
        nearer, out, free = distances(x, x) <= d[:, None], [], np.ones(len(d), bool)
        while len(out) < m and free.any():
            i = int(free.argmax())
            out.append(i)
            free[i] = False
            free &= ~nearer[:, i]
        rest = np.ones(len(d), bool)
        rest[out] = False
        return out + np.flatnonzero(rest)[: m - len(out)].tolist()

    def kernel(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        at, other, d, x, groups = _columns(rows)
        keep = np.array([lo + i for lo, hi in groups for i in taken(x[lo:hi], d[lo:hi])], np.int64)
        yield _batch(at[keep], other[keep], d[keep])

    return lambda batches: _groups(batches, kernel)


def _introduced(k: int):
    """Pairs of the candidates of one node, both ways: of each the k nearest others that are nearer than the farthest it has."""

    def kernel(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        _, other, _, x, groups = _columns(rows)
        most, out = np.asarray(rows.column("most"), np.float64), []
        for lo, hi in groups:
            d = distances(x[lo:hi], x[lo:hi])
            np.fill_diagonal(d, np.inf)
            if k < hi - lo:
                d[d > np.partition(d, k - 1, axis=1)[:, k - 1 : k]] = np.inf
            a, b = np.nonzero(d < most[lo:hi, None])
            out.append((other[lo:hi][a], other[lo:hi][b], d[a, b]))
        yield _batch(*(np.concatenate(c) for c in zip(*out, strict=True)))

    return lambda batches: _groups(batches, kernel)


PAIRS = "vec_id bigint, neighbour bigint, distance double"


def _candidates(pairs: DataFrame, most: int, both_ways: bool = True) -> DataFrame:
    """The `most` nearest of each node, from pairs (vec_id, neighbour, distance)."""
    pairs = pairs.select("vec_id", "neighbour", "distance")
    if both_ways:
        pairs = pairs.unionByName(pairs.select(F.col("neighbour").alias("vec_id"), F.col("vec_id").alias("neighbour"), "distance"))
    once = pairs.groupBy("vec_id", "neighbour").agg(F.min("distance").alias("distance"))
    return top_k(once, ["vec_id"], [F.asc("distance"), F.asc("neighbour")], most).select("vec_id", "neighbour", "distance")


def _by_node(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs with the neighbours' vectors, and what else vectors has, in order by node."""
    return pairs.join(vectors.withColumnRenamed("vec_id", "neighbour"), "neighbour").repartition("vec_id").sortWithinPartitions("vec_id", "distance", "neighbour")


def _met(near: DataFrame, vectors: DataFrame, most: int) -> DataFrame:
    """near (candidates, `most` a node at most) after the candidates of each node have met each other."""
    worst = near.groupBy("vec_id").agg(F.when(F.count("*") >= most, F.max("distance")).otherwise(float("inf")).alias("most"))
    met = _by_node(near, vectors.join(worst, "vec_id")).mapInArrow(_introduced(-(-most // 4)), PAIRS)
    return _candidates(near.unionByName(met), most, both_ways=False)


def _linked(near: DataFrame, vectors: DataFrame, m: int) -> DataFrame:
    """Links (vec_id, neighbour, distance) of candidates near, at most m a node."""
    return _by_node(near, vectors).mapInArrow(_diverse(m), PAIRS)


def _descend(found: DataFrame, links: DataFrame, vectors: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """Expands, for all queries at once, the nodes of found (query_id, vec_id, distance) that aren't yet expanded, and keeps the
    `most` best, until no query has an open one. A node that fell out can't return, so this ends.

    An open node's neighbours and the queries (asked: query_id, embedding) that have it open meet in a task, where distances
    are taken in blocks; no more than `most` a query and node go on.
    """
    place = lambda df, side, key: df.select(F.col("at").alias("cell"), F.lit(0).alias("part"), F.lit(side).alias("side"), F.col(key).alias("id"), "embedding")
    around = links.select(F.col("vec_id").alias("at"), "neighbour").join(vectors.select(F.col("vec_id").alias("neighbour"), "embedding"), "neighbour")
    around = written(place(around, 0, "neighbour"), "around")
    found = written(found.select("query_id", "vec_id", "distance").withColumn("open", F.lit(True)), "frontier")
    while True:
        open_ = found.where("open").select("query_id", F.col("vec_id").alias("at"))
        queries = place(open_.join(asked, "query_id"), 1, "query_id")
        both = around.join(open_.select(F.col("at").alias("cell")).distinct(), "cell", "left_semi").unionByName(queries)
        fresh = both.repartition("cell").sortWithinPartitions("cell", "side", "id").mapInArrow(vector.search_parts(most, with_self=True), "query_id bigint, vec_id bigint, distance double")
        every = found.withColumn("open", F.lit(False)).unionByName(fresh.withColumn("open", F.lit(True)))
        once = every.groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"), F.min("open").alias("open"))
        found = written(top_k(once, ["query_id"], [F.asc("distance"), F.asc("vec_id")], most).drop("rank"), "frontier")
        if found.where("open").isEmpty():
            return found.drop("open")


def build_graph(vectors: DataFrame, m: int = 16, refine: int = 3) -> DataFrame:
    """Links (layer, vec_id, neighbour, distance), at most m a node and layer, each layer one component.

    The highest layers, of EXACT nodes at most, are linked from exact distances. Below, the nodes of each level are a batch:
    they find the WIDTH best nodes of the layer above along its links and are tied to these, both ways; then `refine` times the
    candidates of each node of the layer meet each other, by which nodes of one batch meet. Each node keeps diverse links: one goes to a candidate only where no link taken before leads
    nearer to it. A node's parent is the nearest that it found when it was inserted; links to the parent, from it to its first
    child and on from child to child let each node of a layer be reached from each other one, in both directions, with TREE
    links a node however many children there are. Work is a constant number of rows a node and layer.
    """
    if m <= TREE:
        raise ValueError(f"m must be more than {TREE}")
    spark, near, most = vectors.sparkSession, m - TREE, CANDIDATES * (m - TREE)
    nodes = written(vectors.where("embedding is not null").select("vec_id", "embedding", level(F.col("vec_id"), most=LEVELS).alias("level")), "nodes")
    sizes = {r["level"]: r["n"] for r in nodes.groupBy("level").agg(F.count("*").alias("n")).collect()}  # levels, of which level() allows few
    if not sizes:
        return spark.createDataFrame([], LINKS)
    above = lambda n: sum(c for at, c in sizes.items() if at >= n)
    entry = next((n for n in range(max(sizes) + 1) if above(n) <= ENTRY), max(sizes))
    levels, plain = nodes.select("vec_id", "level"), nodes.select("vec_id", "embedding")
    first = nodes.where(F.col("level") >= entry)
    # all pairs of ENTRY nodes: a table of fixed size
    pairs = vector.knn_exact(first, first.select(F.col("vec_id").alias("query_id"), "embedding"), k=ENTRY)
    seen = written(pairs.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("neighbour"), "distance"), "near")
    other = levels.select(F.col("vec_id").alias("neighbour"), F.col("level").alias("other"))
    ranked = seen.join(levels, "vec_id").join(other, "neighbour")
    earlier = (F.col("other") > F.col("level")) | ((F.col("other") == F.col("level")) & (F.col("neighbour") < F.col("vec_id")))
    parents = [_nearest_of(ranked.where(earlier))]
    layers = {n: written(_linked(_candidates(ranked.where((F.col("level") >= n) & (F.col("other") >= n)), most), plain, near), "links") for n in range(entry, max(sizes) + 1)}
    found, cands = None, seen
    for n in range(entry - 1, -1, -1):
        if above(n + 1) <= EXACT:
            batch = nodes.where(F.col("level") == n) if above(n) <= EXACT else nodes.where(F.col("level") <= n)
            found = written(vector.knn_exact(nodes.where(F.col("level") > n), batch.select(F.col("vec_id").alias("query_id"), "embedding"), k=WIDTH).drop("rank"), "frontier")
        else:
            asked = nodes.where(F.col("level") <= n).select(F.col("vec_id").alias("query_id"), "embedding")
            found = _descend(found.join(asked.select("query_id"), "query_id", "left_semi"), layers[n + 1], plain, asked, WIDTH)
        tied = found.join(levels.where(F.col("level") == n).select(F.col("vec_id").alias("query_id")), "query_id", "left_semi")
        tied = tied.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("neighbour"), "distance")
        parents.append(_nearest_of(tied))
        here = plain.join(levels.where(F.col("level") >= n).select("vec_id"), "vec_id", "left_semi")
        if above(n) <= EXACT:
            all_pairs = vector.knn_exact(here, here.withColumnRenamed("vec_id", "query_id"), k=most)
            close = all_pairs.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("neighbour"), "distance")
        cands = written(_candidates(close if above(n) <= EXACT else tied.unionByName(cands), most), "candidates")
        for _ in range(0 if above(n) <= EXACT else refine):
            cands = written(_met(cands, here, most), "candidates")
        layers[n] = written(_linked(cands, here, near), "links")
    tree = _tree(reduce(DataFrame.unionByName, parents), levels, nodes)
    every = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("layer"), "vec_id", "neighbour", "distance") for n, df in layers.items()])
    return written(tree.unionByName(every).distinct(), "graph")


def _nearest_of(near: DataFrame) -> DataFrame:
    """(vec_id, parent, distance): each node's nearest."""
    best = F.min(F.struct("distance", F.col("neighbour").alias("parent"))).alias("x")
    return near.groupBy("vec_id").agg(best).select("vec_id", "x.parent", "x.distance")


def _tree(parents: DataFrame, levels: DataFrame, vectors: DataFrame) -> DataFrame:
    """The links, by layer, of nodes to their parents, of parents to their first children, and of children to the next ones.

    Children come by level, the highest first, so that those of a layer are the first of each list. The lists are one table
    in range partitions, as one node may have any share of all as its children.
    """
    placed = global_row_number(parents.join(levels, "vec_id"), [F.asc("parent"), F.desc("level"), F.asc("distance"), F.asc("vec_id")])
    placed = written(placed.select("rn", "parent", "vec_id", "level", "distance"), "children")
    before = placed.select((F.col("rn") + 1).alias("rn"), F.col("parent").alias("__parent"), F.col("vec_id").alias("__before"))
    chained = placed.join(before, "rn", "left")
    same = F.col("__parent").eqNullSafe(F.col("parent"))
    down = chained.select(F.when(same, F.col("__before")).otherwise(F.col("parent")).alias("vec_id"), F.col("vec_id").alias("neighbour"), "level")
    down = down.join(_measured(down.select("vec_id", "neighbour"), vectors, "vec_id", "neighbour"), ["vec_id", "neighbour"])
    up = placed.select("vec_id", F.col("parent").alias("neighbour"), "level", "distance")
    return up.unionByName(down).select(F.explode(F.sequence(F.lit(0), "level")).alias("layer"), "vec_id", "neighbour", "distance")


def check_ids(vectors: DataFrame) -> DataFrame:
    """(vec_id, n) of ids that stand in several rows, which a graph can't tell apart."""
    return vectors.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1")


def search_graph(graph: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, ef: int | None = None, with_self: bool = False) -> DataFrame:
    """As vector.knn_exact, along build_graph's links: from the nodes of the lowest layer that has ENTRY at most, down the layers.

    In each layer a query's frontier holds its ef best nodes (an eighth above the lowest). Without structure in the vectors a
    frontier has to grow with the table: unless given, ef is 2 * sqrt(n), 128 at least. Those not yet expanded are expanded
    together, all queries at once, until none is left. Joins on node and query ids; nothing but the layers' sizes comes to
    the driver. A graph without links (of one vector) is compared as a whole.
    """
    vectors, queries = vectors.where("embedding is not null").select("vec_id", "embedding"), queries.where("embedding is not null").select("query_id", "embedding")
    sizes = {r["layer"]: r["n"] for r in graph.select("layer", "vec_id").distinct().groupBy("layer").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return vector.knn_exact(vectors, queries, k, with_self)
    entry = next((n for n in sorted(sizes) if sizes[n] <= ENTRY), max(sizes))
    ef = max(128, round(2 * sizes[min(sizes)] ** 0.5)) if ef is None else ef
    upper = max(WIDTH, ef // 8)
    first = vectors.join(graph.where(F.col("layer") == entry).select("vec_id").distinct(), "vec_id", "left_semi")
    found = written(vector.knn_exact(first, queries, k=upper if entry else ef, with_self=True).drop("rank"), "frontier")
    for n in range(entry - 1, -1, -1):
        found = _descend(found, graph.where(F.col("layer") == n), vectors, queries, upper if n else ef)
    if not with_self:
        found = found.where("query_id != vec_id")
    return top_k(found, ["query_id"], [F.asc("distance"), F.asc("vec_id")], k).select("query_id", "rank", "vec_id", "distance")


def components(graph: DataFrame) -> DataFrame:
    """(layer, vec_id, component): the smallest id reachable in the layer, links taken both ways.

    Smallest labels are passed on along links and then looked up once more, which halves the ways that are left.
    """
    ends = graph.select("layer", F.col("vec_id").alias("a"), F.col("neighbour").alias("b"))
    ends = written(ends.unionByName(ends.select("layer", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ends")
    labels = written(ends.groupBy("layer", F.col("a").alias("vec_id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        passed = ends.join(labels.select("layer", F.col("vec_id").alias("b"), "component"), ["layer", "b"]).groupBy("layer", F.col("a").alias("vec_id")).agg(F.min("component").alias("least"))
        both = labels.join(passed, ["layer", "vec_id"]).select("layer", "vec_id", "component", F.least("component", "least").alias("least"))
        of = labels.select("layer", F.col("vec_id").alias("least"), F.col("component").alias("next"))
        now = written(both.join(of, ["layer", "least"]).select("layer", "vec_id", F.least("least", "next").alias("component"), (F.least("least", "next") != F.col("component")).alias("changed")), "labels")
        if now.where("changed").isEmpty():
            return now.drop("changed")
        labels = now.drop("changed")


def graph_stats(graph: DataFrame, m: int = 16) -> DataFrame:
    """Per layer: nodes with links, links, mean links a node, nodes with more than m, components."""
    degree = graph.groupBy("layer", "vec_id").agg(F.count("*").alias("d"))
    stats = degree.groupBy("layer").agg(F.count("*").alias("n_nodes"), F.sum("d").alias("n_links"), F.round(F.avg("d"), 6).alias("avg_links"), F.sum((F.col("d") > m).cast("long")).alias("n_over"))
    return stats.join(components(graph).groupBy("layer").agg(F.count_distinct("component").alias("n_components")), "layer")
