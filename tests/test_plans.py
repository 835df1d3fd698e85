"""Persisted indices, kept results and the harness."""

import pytest
from pyspark.sql import functions as F

from corvid.functions import text as tx
from corvid.operators import kv, lexical, serving, sketch
from corvid.plans import catalog, harness, scratch, search
from corvid.sources import sinks


def corpus(spark):
    texts = ["the quick brown fox", "the lazy dog", "quick quick dog", "nothing here at all", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.7, 0.7])], "vec_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(1, "quick dog", [1.0, 0.0]), (2, "the fox", None), (3, "quick dog", [1.0, 0.0])], "query_id bigint, text string, embedding array<float>")
    return docs, vectors, queries


def test_written_index_gives_the_same_ranks(spark, tmp_path):
    docs, _, queries = corpus(spark)
    sinks.write_index(docs, f"file://{tmp_path}/index", buckets=4)
    got = sinks.search_index(spark, f"file://{tmp_path}/index", queries.select("query_id", "text"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lexical.bm25(docs, queries.select("query_id", "text")).collect()))


def test_kept_results(spark):
    docs, vectors, queries = corpus(spark)
    none = spark.createDataFrame([], search.RESULTS)
    first, add = search.hybrid_kept(docs, vectors, queries, none)
    plain = sorted(map(tuple, search.hybrid(docs, vectors, queries).collect()))
    assert sorted(map(tuple, first.collect())) == plain
    again, nothing = search.hybrid_kept(docs.limit(0), vectors, queries, spark.createDataFrame(add.collect(), search.RESULTS))
    assert sorted(map(tuple, again.collect())) == plain and nothing.count() == 0
    assert sketch.estimate(search.asked(queries), queries, "text").where("text = 'quick dog'").first()["estimate"] == 2


def test_harness(spark, tmp_path):
    runs = harness.run_grid(spark, lambda n: spark.range(n), {"n": [1, 10]}, repetitions=2)
    assert runs.count() == 4 and runs.where("elapsed_ms > 0").count() == 4
    sinks.write_results(runs, runs.groupBy("n").agg(F.avg("elapsed_ms").alias("mean")), f"file://{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out/results.csv").count() == 4
    with harness.memory_profiler() as m:
        pass
    assert m.peak >= m.initial >= 0 and m.delta >= 0
    (tmp_path / "a.tsv").write_text("1\tx\n")
    assert harness.read(spark, "passages:any", f"file://{tmp_path}/a.tsv").count() == 1
    with pytest.raises(ValueError):
        harness.read(spark, "other", "x")


def test_refused_updates(spark):
    ops = [(1, "push", 1, 5.0), (2, "push", 1, 6.0), (3, "decrease", 1, 4.0), (4, "decrease", 1, 4.5), (5, "increase", 2, 1.0), (6, "delete", 1, None), (7, "increase", 1, 9.0), (8, "push", 1, 2.0), (9, "increase", 1, 2.0)]
    got = {r["seq"]: r["problem"] for r in serving.wrong_updates(spark.createDataFrame(ops, "seq bigint, op string, key bigint, score double")).collect()}
    assert got == {2: "duplicate key", 4: "not lower", 5: "unknown key", 7: "unknown key"}
    left = serving.complete(spark.createDataFrame([(1,), (2,)], "request_id bigint"), spark.createDataFrame([(2,), (9,)], "request_id bigint"))
    assert [r[0] for r in left.collect()] == [1]


def test_recall_takes_every_label(spark, tmp_path):
    rows = [(100 * k, [float(k), 1.0], label) for k, label in enumerate([3, 3, 12, 12, 12, -1, -1, None, None])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = {r["query_id"] // 100: r["hits"] for r in catalog.QUERIES["recall_at_k"](spark, f"file://{tmp_path}").collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 2, 4: 2, 5: 1, 6: 1, 7: 0, 8: 0}


def test_index_grows_by_increments(spark, tmp_path):
    docs, _, queries = corpus(spark)
    sinks.write_index(docs.where("doc_id < 2"), f"file://{tmp_path}/index", buckets=4)
    sinks.append_index(docs.where("doc_id >= 2"), f"file://{tmp_path}/index")
    got = sinks.search_index(spark, f"file://{tmp_path}/index", queries.select("query_id", "text"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lexical.bm25(docs, queries.select("query_id", "text")).collect()))


def test_run_of_several_datasets(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("".join(f"{k}\tsome text of number {k}\n" for k in range(30)))
    (tmp_path / "b.jsonl").write_text("".join(f'{{"_id": "{k}", "body": "body {k}"}}\n' for k in range(5)))
    sets = {"a": ("passages", f"file://{tmp_path}/a.tsv"), "b": ("general:task", f"file://{tmp_path}/b.jsonl"), "c": ("passages", f"file://{tmp_path}/none.tsv"), "d": ("other", "x")}
    rows = {r["corpus"]: r for r in harness.run_datasets(spark, sets, sample=20, queries=2, dim=8).collect()}
    assert rows["a"]["n_docs"] == 20 and rows["b"]["n_docs"] == 5 and rows["a"]["search_ms"] > 0
    assert rows["c"]["error"] and "unknown source" in rows["d"]["error"] and rows["d"]["n_docs"] is None


def test_scratch_scopes_and_clusters(spark, monkeypatch):
    with scratch.scope(spark) as made:
        gone, stays = scratch.written(spark.range(3), "gone"), scratch.written(spark.range(4), "stays")
        made.keep(stays)
    assert stays.count() == 4
    with pytest.raises(Exception, match="(?i)not exist|no such"):
        gone.count()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"

    class Elsewhere:
        conf = {}

        class sparkContext:  # noqa: N801
            master = "yarn"
            getConf = staticmethod(dict)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_folder(Elsewhere)


def test_codecs_pages_and_admission(spark):
    values = [0, 1, 127, 128, 300, 2**21, 2**35 + 5, 2**62]
    row = spark.createDataFrame([(values,)], "v array<bigint>")
    coded = row.select(F.unhex(F.array_join(F.transform("v", lambda x: F.hex(tx.varint_encode(x))), "")).alias("data"))
    assert coded.select(tx.varint_decode(F.col("data")).alias("v")).first()["v"] == values
    assert bytes(spark.range(1).select(tx.varint_encode(F.lit(300).cast("long")).alias("x")).first()["x"]) == b"\xac\x02"
    free = spark.createDataFrame([(5, 0), (1, 1), (2, 1)], "page bigint, place int")
    ask = spark.createDataFrame([(1, 2), (2, 0), (3, 2), (4, 1)], "request_id bigint, num_pages int")
    assert sorted(map(tuple, kv.allocate(free, ask).collect())) == [(1, 1), (1, 5)]
    assert sorted(r["request_id"] for r in kv.refused(free, ask).collect()) == [3, 4]
    gate = serving.Admission(qps=0.2, token_rate=100.0, seconds=10.0)
    gate.record(0.0, 5)
    assert gate.ask(1.0, 5) == "admitted" and gate.ask(2.0, 5) == "qps" and gate.tokens == 10


def test_kept_results_are_given_without_reading_the_corpus(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "quick dog"), (1, "slow cat")], "doc_id bigint, text string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(5, "dog", [1.0, 0.0])], "query_id bigint, text string, embedding array<float>")
    first, add = search.hybrid_kept(docs, vectors, asked, spark.createDataFrame([], search.RESULTS))
    monkeypatch.setattr(search, "hybrid", lambda *_: pytest.fail("searched again"))
    again, more = search.hybrid_kept(docs, vectors, asked, add)
    assert sorted(again.collect()) == sorted(first.collect()) != [] and not more.count()
