"""The layered graph: links, components and recall on plain, clustered and equal vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.operators import graph, vector


def frame(spark, x, *more):
    return spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)] + list(more), "vec_id bigint, embedding array<float>")


def built(spark, x, monkeypatch, entry, m=16):
    monkeypatch.setattr(graph, "ENTRY", entry)
    v = frame(spark, x, (9_000, None)).cache()
    links = graph.build_graph(v, m=m)
    rows = links.collect()
    assert {r["vec_id"] for r in rows if r["layer"] == 0} == set(range(len(x)))
    assert all(r["vec_id"] != r["neighbour"] for r in rows) and len({(r["layer"], r["vec_id"], r["neighbour"]) for r in rows}) == len(rows)
    assert not links.groupBy("layer", "vec_id").count().where(f"count > {m}").count()
    level = dict(v.select("vec_id", vector.level(F.col("vec_id"), most=graph.LEVELS)).collect())
    assert all(min(level[r["vec_id"]], level[r["neighbour"]]) >= r["layer"] for r in rows)
    for r in rows[:50]:
        assert abs(r["distance"] - np.linalg.norm(np.float32(x[r["vec_id"]]).astype(float) - np.float32(x[r["neighbour"]]))) < 1e-5
    return v, links, rows


def reached(rows, layer, start, ends=("vec_id", "neighbour")):
    out = {}
    for r in rows:
        if r["layer"] == layer:
            out.setdefault(r[ends[0]], []).append(r[ends[1]])
    seen, open_ = {start}, [start]
    while open_:
        fresh = {y for x in open_ for y in out.get(x, ())} - seen
        seen |= fresh
        open_ = list(fresh)
    return seen


def lowest(v, links, n, step):
    q = v.where(f"vec_id < {n} and vec_id % {step} = 0").withColumnRenamed("vec_id", "query_id")
    found, true = graph.search_graph(links, v, q), vector.knn_exact(v, q)
    assert found.count() == q.count() * 10
    return vector.recall_at(found, true, 10).agg(F.min("recall")).first()[0]


def test_clusters_far_apart(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = (40 * rng.normal(size=(20, 16)))[np.arange(1500) % 20] + rng.normal(size=(1500, 16))
    v, links, rows = built(spark, x, monkeypatch, 64)
    stats = graph.graph_stats(links).collect()
    assert len(stats) >= 5 and {r["n_components"] for r in stats} == {1} and {r["n_over"] for r in stats} == {0}
    for layer in {r["layer"] for r in rows}:
        nodes = {r["vec_id"] for r in rows if r["layer"] == layer}
        start = min(nodes)
        assert reached(rows, layer, start) == nodes and reached(rows, layer, start, ("neighbour", "vec_id")) == nodes
    assert lowest(v, links, 1500, 5) >= 0.9


def test_vectors_without_structure(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(1200, 8))
    v, links, _ = built(spark, x, monkeypatch, 64)
    assert lowest(v, links, 1200, 10) >= 0.9


def test_layers_linked_exactly_hold_each_nearest_neighbour(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(900, 32))
    _, _, rows = built(spark, x, monkeypatch, 64)
    links = {(r["vec_id"], r["neighbour"]) for r in rows if r["layer"] == 0}
    y = np.float32(x).astype(float)
    d = ((y[:, None] - y[None]) ** 2).sum(2) + np.diag([np.inf] * len(y))
    assert all((i, int(j)) in links for i, j in enumerate(d.argmin(1)))


def test_batches_are_inserted_along_links(spark, monkeypatch):
    monkeypatch.setattr(graph, "EXACT", 200)
    rng = np.random.default_rng(9)
    x = (40 * rng.normal(size=(8, 16)))[np.arange(1000) % 8] + rng.normal(size=(1000, 16))
    v, links, _ = built(spark, x, monkeypatch, 64)
    assert {(r["n_over"], r["n_components"]) for r in graph.graph_stats(links).collect()} == {(0, 1)}
    assert lowest(v, links, 1000, 10) >= 0.9


def test_equal_vectors_are_one_component(spark, monkeypatch):
    x = np.concatenate([np.zeros((150, 4)), np.random.default_rng(7).normal(size=(50, 4))])
    _, links, rows = built(spark, x, monkeypatch, 16, m=6)
    assert reached(rows, 0, 0) == set(range(200))
    assert {r["n_components"] for r in graph.graph_stats(links, 6).collect()} == {1}


def test_components_and_awkward_tables(spark):
    rows = [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 5, 4, 1.0), (1, 1, 3, 1.0)] + [(2, i, i + 1, 1.0) for i in range(40)]
    got = {(r["layer"], r["vec_id"]): r["component"] for r in graph.components(spark.createDataFrame(rows, graph.LINKS)).collect()}
    assert [got[0, i] for i in range(1, 6)] == [1, 1, 1, 4, 4] and got[1, 3] == 1 and {got[2, i] for i in range(41)} == {0}
    one = frame(spark, [[1.0, 2.0]])
    none, q = one.limit(0), one.select(F.lit(7).cast("long").alias("query_id"), "embedding")
    assert graph.build_graph(none).count() == 0 and graph.build_graph(one).count() == 0
    assert graph.search_graph(graph.build_graph(none), none, q).count() == 0
    assert [(r["query_id"], r["vec_id"]) for r in graph.search_graph(graph.build_graph(one), one, q).collect()] == [(7, 0)]
    assert [tuple(r) for r in graph.check_ids(one.union(one)).collect()] == [(0, 2)]
    with pytest.raises(ValueError):
        graph.build_graph(one, m=3)
