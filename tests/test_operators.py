"""Operators against small models and properties."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvid.functions import text as tx
from corvid.operators import fusion, kv, lexical, serving, sketch, stats, vector
from corvid.plans.scratch import global_row_number
from corvid.sources import readers


def test_chunks_cover_text_and_reject_bad_overlap(spark):
    df = spark.createDataFrame([("abcdefghij",), ("",), (None,)], "text string")
    got = [r[0] for r in df.select(tx.chunks(F.col("text"), 4, 1)).collect()]
    assert got[0] == ["abcd", "defg", "ghij", "j"] and not got[1] and not got[2]
    with pytest.raises(ValueError):
        tx.chunks(F.col("text"), 4, 4)


def test_compat_tokens(spark):
    df = spark.createDataFrame([("The quick they",), (None,)], "text string")
    ids, n, back = df.select(tx.compat_encode(F.col("text")), tx.compat_count(F.col("text")), tx.compat_decode(tx.compat_encode(F.col("text")))).first()
    assert ids == [4, 1, 1, 1, 1, 1, 51] and n == 7 and back == "the they"


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("10k", 300, -5, "a_b_12"), ("2m", 127, 7, "x"), ("7", 0, 0, "9"), ("no", 1 << 40, 1, "_")], "s string, v bigint, z bigint, id string")
    rows = df.select(tx.parse_size(F.col("s")), tx.varint_bytes(F.col("v")), tx.unzigzag(tx.zigzag(F.col("z"))), "z", tx.trailing_id(F.col("id"))).collect()
    assert [r[0] for r in rows] == [10000, 2000000, 7, None]
    assert [r[1] for r in rows] == [2, 1, 1, 6]
    assert all(r[2] == r["z"] for r in rows)
    assert [r[4] for r in rows] == [12, None, 9, None]


def test_bm25_matches_formula_and_adds_up(spark):
    texts = ["the quick brown fox", "the lazy dog", "quick quick dog", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ask = lambda q: {r["doc_id"]: r["score"] for r in lexical.bm25(docs, spark.createDataFrame([(1, q)], "query_id bigint, text string")).collect()}
    dl = [len(t.split()) for t in texts]
    avg, n = sum(dl) / 4, 4

    def part(term, i):
        tf, df = texts[i].split().count(term), sum(term in t.split() for t in texts)
        idf = max(0, (n - df + 0.5) / (df + 0.5))
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl[i] / avg)) / 1.5

    both, quick, dog = ask("quick dog"), ask("quick"), ask("dog")
    for i, s in both.items():
        assert s == pytest.approx(part("quick", i) + part("dog", i), abs=2e-6)
        assert s == pytest.approx(quick.get(i, 0) + dog.get(i, 0), abs=2e-6)
    assert set(both) == {0, 1, 2}


def test_knn_exact_and_ivf(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>")
    q = v.where("vec_id < 30").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in vector.knn_exact(v, q, 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["distance"])
    d = np.round(np.sqrt(((x[:30, None].astype(float) - x[None].astype(float)) ** 2).sum(-1)), 6)
    for i in range(30):
        order = [j for j in np.lexsort((np.arange(600), d[i])) if j != i][:5]
        assert [got[i][k + 1][0] for k in range(5)] == order
    recall = vector.recall_at(vector.knn_ivf(v, q, 5), vector.knn_exact(v, q, 5), 5).agg(F.avg("recall")).first()[0]
    assert recall >= 0.9
    whole = vector.recall_at(vector.knn_ivf(v, q, 5, share=1.0), vector.knn_exact(v, q, 5), 5).agg(F.avg("recall")).first()[0]
    assert whole == 1.0
    none = v.limit(0)
    assert vector.knn_exact(none, q).count() == 0 and vector.knn_ivf(none, q).count() == 0 and vector.knn_exact(v, q.limit(0)).count() == 0


def test_knn_in_blocks_by_label_and_without_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, r.tolist() if i % 50 else None, i % 3 if i % 7 else None) for i, r in enumerate(rng.normal(size=(400, 8)).astype(np.float32))]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    q = v.where("vec_id < 60").withColumnRenamed("vec_id", "query_id")
    x = {i: (np.array(e), lab) for i, e, lab in rows if e is not None}
    near = lambda i, keep: sorted((round(float(np.linalg.norm(x[i][0] - x[j][0])), 6), j) for j in x if j != i and keep(i, j))[:5]
    same = lambda i, j: x[i][1] is not None and x[i][1] == x[j][1]
    for sent in (vector.SENT_QUERIES, 16):
        monkeypatch.setattr(vector, "SENT_QUERIES", sent)
        for label, keep in ((None, lambda i, j: True), ("label", same)):
            got = {}
            for r in vector.knn_exact(v, q, 5, label=label).orderBy("query_id", "rank").collect():
                got.setdefault(r["query_id"], []).append(r["vec_id"])
            assert got == {i: [j for _, j in near(i, keep)] for i in range(60) if i in x and near(i, keep)}
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id bigint, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="several lengths"):
        vector.knn_exact(odd, odd.withColumnRenamed("vec_id", "query_id").where("query_id = 1")).collect()


def test_bm25_of_awkward_rows(spark):
    docs = spark.createDataFrame([(9, "a b"), (2, "a c"), (3, "a"), (4, None), (5, "a d d"), (1, "x"), (6, "")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "a d"), (2, "a"), (3, "none"), (4, None)], "query_id bigint, text string")
    got = {}
    for r in lexical.bm25(docs, queries, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == {1: [5, 3, 2], 2: [3, 2, 9]}
    assert lexical.bm25(docs.limit(0), queries).count() == 0 and lexical.bm25(docs, queries.limit(0)).count() == 0


def test_sliding_rate_keeps_rows_without_time(spark):
    rows = spark.createDataFrame([("k", 1, "2024-01-01 00:00:00"), ("k", 2, None), ("k", 3, None)], "key string, n int, t string").selectExpr("key", "n", "cast(t AS timestamp_ntz) AS ts")
    assert sorted((r["n"], r["rate"]) for r in serving.sliding_rate(rows, "key", 10).collect() if r["n"] == 1) == [(1, 0.1)]
    assert [r["rate"] for r in serving.sliding_rate(rows, "key", 10).where("ts is null").collect()] == [None, None]


def test_fusion_weights(spark):
    lex = spark.createDataFrame([(1, 10, 4.0), (1, 11, 2.0)], "query_id bigint, doc_id bigint, score double")
    den = spark.createDataFrame([(1, 11, 0.5), (1, 12, 1.5)], "query_id bigint, vec_id bigint, distance double")
    at = lambda w: {r["doc_id"]: r["score"] for r in fusion.fuse(lex, den, weight=w).collect()}
    assert at(0.0) == {10: 1.0, 11: 0.0, 12: 0.0} and at(1.0) == {10: 0.0, 11: 1.0, 12: 0.0} and at(0.5) == {10: 0.5, 11: 0.5, 12: 0.0}


def test_sketch_counts_exactly_where_all_cells_are_shared(spark):
    rows = [None if i % 50 == 3 else i % 50 for i in range(1500)] + [7] * 100
    items = spark.createDataFrame([(x,) for x in rows], "item bigint")
    for width, depth in ((4, 2), (64, 3), (2048, 4)):
        for least in (0, 31):
            got = sketch.exact(items, "item", least, width, depth).collect()
            assert {r["item"]: r["estimate"] for r in got} == {x: rows.count(x) for x in set(rows) if rows.count(x) >= least} and len(got) == len({r["item"] for r in got})
    assert sketch.exact(items.limit(0), "item").count() == 0


@pytest.mark.parametrize("held", [7, 1 << 20])
def test_nearest_holds_a_bounded_block_and_breaks_ties_by_id(monkeypatch, held):
    """Rounded distances tie where squares differ in their last places."""
    monkeypatch.setattr(vector, "HELD", held)
    rng = np.random.default_rng(3)
    v = rng.integers(0, 3, (60, 2)) + rng.normal(size=(60, 2)) * 1e-9
    ids = rng.permutation(60)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 2)], ["vec_id", "embedding"])
    out = list(vector._nearest(ids, v, 5, False)(iter([batch])))
    assert max(b.num_rows for b in out) <= 5 * max(1, held // 60)
    got = sorted((r["query_id"], r["distance"], r["vec_id"]) for b in out for r in b.to_pylist())
    d = vector.distances(v, v)
    assert got == sorted(x for i in range(60) for x in sorted((ids[i], d[i, j], ids[j]) for j in range(60) if j != i)[:5])


def test_sketch_never_counts_too_little(spark):
    rows = [(i % 97,) for i in range(3000)]
    items = spark.createDataFrame(rows, "item bigint")
    got = {r["item"]: r["estimate"] for r in sketch.estimate(sketch.build(items, "item", width=64, depth=3), items, "item", width=64, depth=3).collect()}
    for i in range(97):
        assert got[i] >= sum(r[0] == i for r in rows)


def test_sliding_rate_equals_brute_force(spark):
    rng = random.Random(3)
    times = sorted(rng.randrange(0, 4000) for _ in range(300))
    rows = [(i, "a" if i % 3 else "b", f"2024-01-01 {t // 3600:02}:{t // 60 % 60:02}:{t % 60:02}") for i, t in enumerate(times)]
    events = spark.createDataFrame(rows, "event_id bigint, k string, s string").withColumn("ts", F.col("s").cast("timestamp_ntz"))
    got = {r["event_id"]: r["rate"] for r in serving.sliding_rate(events, "k", 10).collect()}
    for i, k, _ in rows:
        assert got[i] == pytest.approx(sum(k2 == k and 0 <= times[i] - times[j] <= 10 for j, k2, _ in rows) / 10)


def test_admission_window():
    gate = serving.Admission(qps=1.0, token_rate=100.0, seconds=2.0)
    assert [gate.ask(t, n) for t, n in ((0, 10), (0.5, 10), (1, 10), (2, 1), (2.1, 500), (2.1, 5))] == ["admitted", "admitted", "qps", "qps", "tokens", "admitted"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(1, 12)), max_size=60), st.integers(1, 30))
def test_lru_stays_within_budget(ops, budget):
    cache = serving.TokenLRU(budget)
    for key, tokens in ops:
        if not cache.get(key):
            cache.put(key, tokens)
        assert cache.total == sum(cache.entries.values()) <= budget


def test_lru_relation_equals_replay(spark):
    rng = random.Random(5)
    size = {i: rng.randint(1, 12) for i in range(30)}
    rows = [("s" if rng.random() < 0.7 else "t", n, n, rng.randrange(30)) for n in range(400)]
    rows = [(*r, size[r[3]]) for r in rows]
    accesses = spark.createDataFrame(rows, "shard string, micros bigint, event_id bigint, item bigint, tokens bigint")
    held = {(r["shard"], r["item"]) for r in serving.resident(accesses, "shard", 60).collect()}
    hits = {r["event_id"]: r["hit"] for r in serving.replay_lru(accesses, "shard", 60).collect()}
    model = {"s": serving.TokenLRU(60), "t": serving.TokenLRU(60)}
    for shard, _, n, item, tokens in rows:
        hit = model[shard].get(item)
        assert hits[n] == hit
        if not hit:
            model[shard].put(item, tokens)
    assert held == {(s, i) for s, m in model.items() for i in m.entries}
    assert serving.TokenLRU(5).put("x", 9) == []


def test_admission_replay_equals_model(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), rng.randrange(60_000_000), n, rng.randrange(40)) for n in range(300)]
    df = spark.createDataFrame(rows, "k string, micros bigint, request_id bigint, tokens bigint")
    got = {r["request_id"]: r["decision"] for r in serving.replay_admission(df, "k", 0.5, 10.0, 10.0).collect()}
    for key in "ab":
        gate = serving.Admission(0.5, 10.0, 10.0)
        for _, m, n, t in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            assert got[n] == gate.ask(m / 1e6, t)
    assert set(got.values()) == {"admitted", "qps", "tokens"}


def test_release_and_queue(spark):
    df = spark.createDataFrame([(0, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:10")], "request_id bigint, s string").select("request_id", F.col("s").cast("timestamp_ntz").alias("created_at"))
    now = lambda s: F.lit(f"2024-01-01 00:00:{s}").cast("timestamp_ntz")
    assert serving.released(df, now("00.020")).count() == 0 and serving.released(df, now("00.050")).count() == 2 and serving.released(df, now("00.020"), size=2, when_full=True).count() == 2
    ops = spark.createDataFrame([(1, "push", 1, 5.0), (2, "push", 2, 3.0), (3, "update", 1, 1.0), (4, "delete", 2, None), (5, "push", 3, 1.0)], "seq bigint, op string, key bigint, score double")
    assert [(r["key"], r["place"]) for r in serving.pop_order(serving.queue_state(ops)).orderBy("place").collect()] == [(1, 1), (3, 2)]


def test_global_row_number(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r["x"] + 1 == r["rn"] for r in global_row_number(df, [F.asc("x")]).collect())


def test_pages_roundtrip_and_references(spark):
    turns = spark.createDataFrame([(1, 0, list("abcde")), (1, 1, list("fgh")), (2, 0, list("abcde")), (2, 1, ["z"]), (3, 0, [])], "seq_id bigint, turn bigint, tokens array<string>")
    pages = kv.paginate(turns, 4)
    assert {r["seq_id"]: "".join(r["tokens"]) for r in kv.restore(pages).collect()} == {1: "abcdefgh", 2: "abcdez"}
    refs = kv.shared_pages(pages)
    assert sorted(r["refs"] for r in refs.collect()) == [1, 1, 2]
    assert refs.agg(F.sum("refs")).first()[0] == pages.count()
    left = kv.detach(pages, turns.where("seq_id = 2"))
    assert sorted((r["refs_before"], r["refs"]) for r in left.collect()) == [(1, 0), (1, 1), (2, 1)]
    assert sorted(r["page"] for r in kv.page_numbers(pages, 5).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        kv.page_numbers(pages, 2)


def test_statistics_of_few_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0)], "k string, v double")
    got = {r["k"]: r for r in stats.summary(df, ["k"], "v").collect()}
    assert got["b"]["std"] is None and got["b"]["ci_lower"] is None and got["b"]["p95"] == 3.0
    half = 4.303 * np.std([1, 2, 4], ddof=1) / 3**0.5
    assert got["a"]["ci_upper"] == pytest.approx(7 / 3 + half, abs=1e-5) and got["a"]["p50"] == 2.0
    rank = {r["k"]: r for r in stats.nearest_rank(df, ["k"], "v", {"p50": 0.5}).collect()}
    assert rank["a"]["p50"] == 2.0


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"_id": "1", "title": "T", "body": " x "}\n\n{"id": "2", "text": ""}\n')
    assert [(r["id"], r["text"], r["meta"]) for r in readers.read_general(spark, f"file://{tmp_path}/a.jsonl").collect()] == [("1", "x", {"title": "T"})]
    (tmp_path / "p.tsv").write_text("7\tone two\n8\n9\ta\tb\n")
    assert sorted((r["id"], r["text"]) for r in readers.read_passages(spark, f"file://{tmp_path}/p.tsv").collect()) == [("7", "one two"), ("9", "a")]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>hello</p>"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r1>\r\nWARC-Target-URI: http://x/\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    (tmp_path / "w.warc").write_bytes(head + body + b"\r\n\r\n" + head.replace(b"response", b"request") + body + b"\r\n\r\n")
    assert [tuple(r) for r in readers.read_warc(spark, f"file://{tmp_path}/w.warc").collect()] == [("<r1>", "http://x/", "<p>hello</p>")]
    (tmp_path / "d.xml").write_text("<mediawiki><page><title>A</title><id>3</id><revision><text>body</text></revision></page></mediawiki>")
    assert [(r["id"], r["text"]) for r in readers.read_wiki_pages(spark, f"file://{tmp_path}/d.xml").collect()] == [("3", "body")]
    biz = spark.createDataFrame([("b", "Old", "c", 1), ("b", "New", "c", 2)], "business_id string, name string, categories string, n int")
    rev = spark.createDataFrame([("r", "b", "good", 4.0), ("s", "none", "bad", 1.0)], "review_id string, business_id string, text string, stars double")
    assert {r["id"]: r["text"] for r in readers.reviews_with_businesses(rev, biz, F.col("n")).collect()} == {"review_r": "New good", "review_s": "bad"}
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs/r.json").write_text('[{"corpus": "x", "size": 10, "qps": 2.0}, {"corpus": "x", "size": 20, "qps": 3.0}]')
    assert readers.read_runs(spark, f"file://{tmp_path}/runs").count() == 2
    out = readers.latency_export(spark.createDataFrame([("k", 0.0, 5.0)], "benchmark string, attach_p50_ms double, search_p50_ms double"))
    assert tuple(out.first()) == ("k", 5.0, 0.0, 0.0)


def test_generators_are_deterministic(spark):
    a = readers.synthetic_documents(spark, 5, ["x", "y", "z"]).collect()
    assert a == readers.synthetic_documents(spark, 5, ["x", "y", "z"]).collect() and all(20 <= len(r["text"].split()) <= 200 for r in a)
    e = readers.synthetic_embeddings(spark.range(3), "id", 16).collect()
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-5 for r in e)
    df = spark.range(50)
    assert readers.sample_exact(df, 7, "id").count() == 7 and readers.sample_exact(df, 70, "id").count() == 50
    jsonl = readers.normalise_reviews(spark.createDataFrame([("1", None, "a text of more than twenty"), ("2", "t", "x")], "id string, title string, text string"))
    assert [r["id"] for r in jsonl.collect()] == ["1"]
