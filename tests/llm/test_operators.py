"""Each corpus operator against a plain model, on a table with all the awkward cases."""

import hashlib
import random
import time

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from corvid.llm import chat_format, decontaminate, html_extract, license_scan, mixing, ngram_join, quality_rules, registry, secret_scan, shared, substring_dedup, token_count
from tests.llm import brute
from tests.llm.conftest import SCHEMA

key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)


def same(got, expected):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, expected), key=key)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, folder, name):
    got = registry.queries()[name](spark, f"{folder}/none")
    assert got.count() == (1 if name.startswith("op5") else 0)  # conversation -1


def test_word_and_window_hashes_tell_texts_apart():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "ab", "é", "x" * 40]) for _ in range(rng.randrange(0, 50))).encode() for _ in range(200)] + [b"  a\t\n b ", b"", b" "]
    for piece in (64, 1 << 20):
        words, first = shared.word_hashes(texts, piece)
        flat = [w for t in texts for w in t.split()]
        assert len(words) == len(flat) and list(np.diff(first)) == [len(t.split()) for t in texts]
        assert len(set(zip(words.tolist(), flat, strict=True))) == len(set(flat)) == len(set(words.tolist()))
    h, ok = shared.window_hashes(words, first, 3)
    grams = [tuple(flat[i : i + 3]) for i in np.flatnonzero(ok)]
    assert len(set(zip(h[ok].tolist(), grams, strict=True))) == len(set(grams)) == len(set(h[ok].tolist()))
    v = np.array([rng.randrange(100) for _ in range(77)], np.uint64)
    for w in (1, 2, 7, 77):
        assert shared.sliding(v, w).tolist() == [min(v[i : i + w]) for i in range(78 - w)]
        assert shared.sliding(v, w, np.maximum).tolist() == [max(v[i : i + w]) for i in range(78 - w)]


def test_license_scan(spark, folder, rows):
    got = registry.queries()["op1_license_scans"](spark, f"{folder}/all").collect()
    same([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got], [(i, *brute.licences(t)) for i, t in pairs(rows)])
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    more = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0. x"), (2, "licensed under the GNU General Public License, version 3."), (3, "Redistribution and use in source forms")], "doc_id bigint, text string")
    labels = {r["doc_id"]: sorted({p["label"] for p in r["places"]}) for r in license_scan.scan_licenses(more).collect()}
    assert labels[1] == ["cc-by-nc"] and "gpl-3.0" in labels[2] and labels[3] == []


def test_license_notices_of_many_wordings():
    index = license_scan.Index({w: 1.0 for x in license_scan.templates() for w in x.words})
    said = {
        "// SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "This code is licensed under GPLv2.": "gpl-2.0",
        "available under the Eclipse Public License v2.0": None, "available under the Eclipse Public License v 2.0": "epl-2.0", "CC0 1.0 Universal": "cc0",
        "Boost Software License - Version 1.0 - August 17th, 2003": "boost",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.": "zlib",
    }
    for text, label in said.items():
        labels = {index.templates[n].label for _, n, _ in index.scan(text)[1]}
        assert label in labels if label else not labels, text


def test_license_placements_equal_a_search_at_every_place():
    rng = random.Random(13)
    known = license_scan.templates()
    vocabulary = sorted({w for t in known for w in t.words})
    idf = {w: rng.choice([0.2, 1.0, 3.0, 7.5]) + rng.random() for w in vocabulary}
    index = license_scan.Index(idf)
    total = 0
    for _ in range(400):
        words = []
        for _ in range(rng.randrange(1, 5)):
            part = list(rng.choice(known).words)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                part[rng.randrange(len(part))] = rng.choice(vocabulary)
            words += part[rng.choice([0, 0, 0, 2]) :] + rng.choices([*vocabulary, "other", "text"], k=rng.randrange(6))
        expected = []
        for n, t in enumerate(known):
            for start in range(-len(t.words), len(words)):
                at = lambda p, start=start: words[start + p] if 0 <= start + p < len(words) else None
                share = sum(idf[w] for p, w in enumerate(t.words) if at(p) == w) / sum(idf[w] for w in t.words)
                if share >= 0.7 and all(at(p + j) == t.words[p + j] for p, k in t.mandatory for j in range(k)):
                    expected.append((start, n, round(share, 9)))
        n_words, got = index.scan(" ".join(words))
        assert n_words == len(words) and [(a, n, round(s, 9)) for a, n, s in got] == sorted(expected)
        total += len(got)
    assert total > 300


def test_quality_counts_and_verdicts(spark, folder, rows):
    got = registry.queries()["op2_quality_rules"](spark, f"{folder}/all").collect()
    same([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got], brute.quality(pairs(rows)))
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_line_frequency(spark):
    rng = random.Random(2)
    own = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    menu = "Home 12 About us contact all of the pages of this one site"
    texts = [f"{own()}\n{menu.replace('12', str(k + 10))}" for k in range(30)] + [menu.upper()] * 2 + ["\n".join([own()] + ["a line that copies share but no other text has at all"])] * 40
    docs = spark.createDataFrame([(k, t, "src0") for k, t in enumerate(texts)], "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["text"] for r in quality_rules.apply_quality(docs, quality_rules.Rules(documents=10, percent=5.0)).collect()}
    assert set(got) == set(range(30)) | set(range(32, 72))  # documents of boilerplate alone go, copies stay
    assert all("About" not in got[k] for k in range(30)) and got[40] == texts[40]
    few = docs.where("doc_id < 9")
    assert quality_rules.apply_quality(few).count() == 9


def test_quality_lines_that_stand_together(spark):
    rng = random.Random(3)
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(30)]
    menu = "\n".join(f"{x} of our {x}s" for x in ("Start", "List", "Map", "Rule", "Name", "Form", "Plan", "Event"))
    pages = [f"Page {k} of the list, one line in each of these documents here" for k in range(10, 25)]
    texts = [f"{menu}\n{o}" for o in own] + pages + own[:9]
    docs = spark.createDataFrame([(k, t, "src0") for k, t in enumerate(texts)], "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["text"] for r in quality_rules.apply_quality(docs).collect()}
    assert got == dict(enumerate(own)) | {45 + k: own[k] for k in range(9)}


def test_substring_dedup(spark, folder, rows):
    same(registry.queries()["op3_substring_dedup"](spark, f"{folder}/all").select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), brute.without_repeats(pairs(rows)))


@pytest.mark.parametrize("window", [1, 2, 5, 16])
def test_substring_dedup_at_other_lengths(spark, rows, window):
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(pairs(rows)[:40])], "doc_id bigint, text string")
    found = {(r["kept"], r["n_removed"]) for r in substring_dedup.find_repeats(docs, window).collect()}
    assert {(hashlib.sha256(k.encode()).hexdigest(), n) for k, n in found} == {(h, n) for _, _, n, h in brute.without_repeats([(r["doc_id"], r["text"]) for r in docs.collect()], window) if n}
    assert substring_dedup.levels(35) == [9, 18, 35]


def test_decontamination(spark, folder, monkeypatch):
    rng = random.Random(4)
    prose = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    items = [prose(rng.choice([1, 3, 4, 5, 20, 60, 300])) for _ in range(25)]
    texts = []
    for k in range(60):
        w, part = prose(rng.choice([0, 10, 200])), list(items[k % 25])
        if k % 3 == 0 and part:
            part[rng.randrange(len(part))] = "other"
        if k % 4 == 0:
            part = part[: len(part) * 3 // 5]
        at = rng.randrange(len(w) + 1)
        texts.append(" ".join(w[:at]) + "\n" + ", ".join(part).upper() + "! " + " ".join(w[at:]))
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate([*texts, None, ""])], "doc_id bigint, text string, __k2 int")
    marks = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(99, None), (0, " ".join(items[0]))], "item_id bigint, text string")
    gram = lambda t, k: {tuple(w[j : j + k]) for w in [regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())] for j in range(len(w) - k + 1)}
    expected = {(d, i, len(a & b)) for d, t in enumerate(texts) for i, w in enumerate(items) if (a := gram(" ".join(w), k := min(5, len(w)))) and 100 * len(a & (b := gram(t, k))) >= 75 * len(a)}
    assert any(len(items[i]) < 5 for _, i, _ in expected)
    monkeypatch.setattr(decontaminate, "BLOCK", 50)  # searched in several blocks
    keys = docs.drop("__k2").select("doc_id", *shared.content_key(F.coalesce("text", F.lit(""))))
    found = decontaminate.find_contaminated(docs, marks).join(keys, ["__k1", "__k2"])
    assert {(r["doc_id"], r["item_id"], r["n_matched"]) for r in found.collect()} == expected and expected
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, marks).collect()} == set(range(62)) - {d for d, _, _ in expected}
    assert registry.queries()["op4_benchmark_decontamination"](spark, f"{folder}/all").count() >= 0


def test_chat_roundtrip(spark, folder):
    given = [tuple(r) for r in spark.read.parquet(f"{folder}/all/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    given += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = registry.queries()["op5_chat_formatting"](spark, f"{folder}/all").collect()
    same([r[:5] for r in got], brute.chats(given))
    formatted = chat_format.format_chat(spark.read.parquet(f"{folder}/all/conversations.parquet")).collect()
    for r in formatted:
        for s in r["loss"]:
            assert "<|im_" not in r["formatted"][s["start"] : s["end"]] and "[INST]" not in r["formatted"][s["start"] : s["end"]]
    lengths = {}
    for r in formatted:
        lengths[r["conv_id"]] = lengths.get(r["conv_id"], 0) + len(r["formatted"])
    assert all(lengths[r["conv_id"]] == r["formatted_chars"] for r in got if r["conv_id"] != -1)


def test_chat_of_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        chat = [(k % 3, k, ("user", "assistant")[k % 2], f"t{k} <|") for k in range(100)]
        df = spark.createDataFrame(chat, "conv_id bigint, turn bigint, role string, text string")
        same([r[:5] for r in chat_format.read_back(chat_format.format_chat(df)).collect()], brute.chats(chat))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_escape_is_reversible():
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["".join(rng.choice(["<", "[", "\\", "|", "INST]", "/INST]", "s>", "/s>", "im_end|>", "a", "\n"]) for _ in range(rng.randrange(12))) for _ in range(3000)]
    for t, e in zip(texts, chat_format.escape(pa.array(texts)).to_pylist(), strict=True):
        assert chat_format.unescape(e) == t and not any(x in e for x in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def test_ngram_components(spark, folder, rows):
    same(registry.queries()["op6_ngram_jaccard_join"](spark, f"{folder}/all").select("doc_id", "n_shingles", "component_id").collect(), brute.components(pairs(rows)))


def test_ngram_components_of_families(spark, monkeypatch):
    rng = random.Random(8)
    texts = []
    for _ in range(8):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 90, 250]))]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w[: rng.randrange(len(w) * 3 // 4, len(w) + 1)]))
    given = [(k * 3 % 1009, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(given, "doc_id bigint, text string")
    columns = ["doc_id", "n_shingles", "component_id"]
    same(ngram_join.ngram_components(docs).select(columns).collect(), brute.components(given))
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 16)  # groups cut into many blocks
    same(ngram_join.ngram_components(docs).select(columns).collect(), brute.components(given))
    one = ngram_join.representatives(docs)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for _, _, c in brute.components(given)})


def test_representatives_of_repeated_rows_and_null_ids(spark):
    long = "one text of a few words that is long enough for shingles"
    given = [(1, long, "a"), (1, long, "a"), (1, long, "b"), (2, long, "c"), (3, "other words here in this one row", "d"), (3, "", "x"), (3, "", "x"), (4, None, "y")]
    given += [(None, f"no id here but {k} twice a text of many words in one row, all of them alike", "z") for k in (1, 1)] + [(None, "no id, another text of which there is one row", "z")]
    docs = spark.createDataFrame(given, "doc_id bigint, text string, __k1 string")
    got = ngram_join.representatives(docs).collect()
    same([(r["doc_id"], r["text"] or "") for r in got], [(1, long), (3, given[4][1]), (3, ""), (4, ""), (None, given[8][1]), (None, given[10][1])])
    assert ngram_join.representatives(docs.limit(0)).count() == 0 and got[0].__fields__ == docs.columns


def test_blocks_grow_in_proportion_to_a_group(spark):
    def dealt(n):
        rows = spark.range(n).select(F.lit(1).alias("h"), F.col("id").alias("cid"), F.when(F.col("id") < 7, F.col("id")).otherwise(7).alias("label"), F.lit(50).alias("n"), F.array().cast("array<bigint>").alias("earlier"))
        first = ngram_join.blocks_of(rows.withColumn("label", F.col("cid")), alone=True).groupBy("p", "q").count()
        blocks = ngram_join.blocks_of(rows).groupBy("p", "q").count()
        assert max(r["count"] for r in blocks.collect()) < 2 * ngram_join.BLOCK_ROWS
        return sum(r["count"] for r in first.collect()), sum(r["count"] for r in blocks.collect())

    assert dealt(100_000) == (100_000, 100_000 - 7 + 7 * (1 + -(-(100_000 - 7) // 2048)))


@pytest.mark.parametrize("crossed", [False, True])
def test_block_finds_all_links(crossed):
    rng = random.Random(9)
    for n in (1, 2, 9, 70, 300):
        sets, bases = [], [{rng.randrange(1 << 63) for _ in range(rng.choice([1, 4, 40, 400]))} for _ in range(max(1, n // 8))]
        for _ in range(n):
            base = list(rng.choice(bases))
            keep = base[: max(1, len(base) - rng.randrange(0, len(base) // 3 + 1))] + [rng.randrange(1 << 63) for _ in range(rng.randrange(0, len(base) // 5 + 1))]
            sets.append(np.array(sorted(keep), np.uint64))
        side = np.array([rng.randrange(2) for _ in range(n)])
        links = ngram_join.join_block(sets, list(range(n)), side, crossed, 75)
        assert all(ngram_join.similar(sets[i], sets[j], 75) for i, j in links)
        join = lambda edges: [min(c) for c in _classes(n, edges)]
        every = [(i, j) for i in range(n) for j in range(i) if (not crossed or side[i] != side[j]) and ngram_join.similar(sets[i], sets[j], 75)]
        assert join(links) == join(every)


def _classes(n, edges):
    of = [{i} for i in range(n)]
    for a, b in edges:
        if of[a] is not of[b]:
            of[a] |= of[b]
            for x in of[b]:
                of[x] = of[a]
    return of


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["cid"]: r["root"] for r in ngram_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}
    assert ngram_join.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_mixing_fills_quotas(spark, docs, rows):
    leaves = spark.createDataFrame([("a", "en", "x", 100, 1), ("a", "en", "y", 1000, 1), ("a", "fr", "z", 50, 1), ("b", "en", "q", 5000, 1)], "domain string, lang string, source string, tokens bigint, documents bigint")
    mixture = mixing.Mixture(domains=(("a", "^.$", 1.0),), other=1.0, languages=(), sources=(), percent=50, epochs=1)
    got = {r["source"]: r["quota"] for r in mixing.quotas(leaves, mixture).collect()}
    # 3075 tokens: 'a' has 1150 at most, so 'b' gives the rest
    assert got == {"x": 100, "y": 1000, "z": 50, "q": 1925}
    half = mixing.Mixture(domains=(("a", "^.$", 1.0),), other=1.0, languages=(("fr", 1.0),), other_language=1.0, sources=(), percent=10, epochs=1)
    got = {r["source"]: r["quota"] for r in mixing.quotas(leaves, half).collect()}
    # 307 each: fr falls short by 103, which its sibling en takes; there x and y share 257
    assert got["z"] == 50 and got["x"] == 100 and got["y"] == 157 and got["q"] == 307
    used = mixing.mix(docs).collect()
    total = sum(len(brute.WORD.findall(t or "")) for _, t in pairs(rows))
    assert 0 < sum(r["n_tokens"] for r in used) <= total * 60 // 100 and {r["epoch"] for r in used} <= {0, 1}


def test_mixing_equals_sql(spark, folder):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder.removeprefix('file://')}/all/documents.parquet/*.parquet' WHERE doc_id IS NOT NULL")
    docs = spark.read.parquet(f"{folder}/all/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    con.sql("CREATE OR REPLACE TABLE d AS SELECT DISTINCT ON (doc_id) * FROM documents")
    con.sql("DROP VIEW documents")
    con.sql("CREATE VIEW documents AS SELECT * FROM d")
    columns = ["doc_id", "domain", "lang", "source", "epoch", "n_tokens"]
    for bucket in (4096, 2):
        mixing.BUCKET, old = bucket, mixing.BUCKET
        same(mixing.mix(docs).select(columns).collect(), con.sql(f"SELECT {', '.join(columns)} FROM ({mixing.mix_sql()})").fetchall())
        mixing.BUCKET = old


def test_secret_scan(spark, folder, rows):
    rng = random.Random(12)
    key = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    letters, word = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz0123456789"
    more = []
    for _ in range(60):
        parts = [rng.choice(["token=", "sample_access=", "/example/", "AKIA", "id-", "a dummy ", ""]) + key(rng.choice([18, 20, 32, 70]), rng.choice([letters, word, letters + "0123456789+/", "0123456789abcdef"])) for _ in range(4)]
        more.append(rng.choice([" ", "\n", "_", ": "]).join(parts))
    given = pairs(rows) + [(1000 + k, t) for k, t in enumerate(more)]
    docs = spark.createDataFrame(given, "doc_id bigint, text string")
    found = {k: [] for k in ("op", "brute")}
    found["op"] = [(r["doc_id"], [(s["start"], secret_scan.KINDS.index(s["kind"]), s["end"]) for s in r["spans"]]) for r in secret_scan.find_secrets(docs).collect()]
    found["brute"] = [(i, brute.all_secrets(t)) for i, t in given]
    same([(i, brute.joined(x)) for i, x in found["op"]], [(i, brute.joined(x)) for i, x in found["brute"]])
    assert sum(k == 3 for _, x in found["op"] for _, k, _ in x) > 60
    got, expected = registry.queries()["op8_secret_scans"](spark, f"{folder}/all").collect(), []
    for i, t in pairs(rows):
        base = brute.base_secrets(t)
        digest = hashlib.sha256(brute.joined(base).encode()).hexdigest()
        expected.append((i, *(sum(k == x for _, k, _ in base) for x in range(3)), digest, brute.joined(brute.all_secrets(t))))
    columns = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    same([tuple(r[c] for c in columns) for r in got], expected)


def test_allow_list_takes_placeholders_alone():
    key = "k9Qz7Lw2Vb0000Kt8Rm1Yp6Nc3Hd5Jf0Gs"
    assert secret_scan.scan_text(key) == [(0, 3, len(key))]
    assert secret_scan.scan_text(f"/example/{key}")[0][2] == 9 + len(key)
    assert secret_scan.scan_text(f"sample_access={key}")[0][0] == 14
    for plain in ("0" * 28, "the-quick-brown-fox-jumps", "HashMapEntryIteratorFactoryBean", f"{'example' * 4}", "550e8400-e29b-41d4-a716-446655440000"):
        assert secret_scan.scan_text(plain) == []
    assert secret_scan.scan_text("qZxKwLvBtRmYpNcHdJfGsAeUoIqWzXrTyPl") == [(0, 3, 35)]
    for path in ("/wiki/Special/Search/Category_1990s_American_films", "/articles/2024/05/How-To-Write-GoodCode-2", "/Assets/MainTheme2024/HeaderLogo"):
        assert secret_scan.scan_text(path) == []


def test_entropy_finds_take_whole_runs():
    tail = 30 * "z"
    assert secret_scan.scan_text(f"b {tail}k9Qz7Lw2Vb4Kt8Rm1Yp6Nc3Hd5{tail}-{tail} b") == [(2, 3, 88)]


def test_long_paths_are_no_work():
    start = time.perf_counter()
    secret_scan.scan_text("/".join(f"{'the-quick-brown-fox-' * 20000}{end}" for end in ("9z9Z", "Example", "xY+")))
    assert time.perf_counter() - start < 10


def test_secret_scan_and_token_trees_are_linear_in_a_text():
    lines = lambda n: "\n".join(f"{k * 7919:032x} {k * 104729:09d} a@b.org some words" for k in range(n))
    with open(token_count.VOCABULARY, "rb") as f:
        count = token_count.Counter(f.read())

    def seconds(n):
        text, start = lines(n), time.perf_counter()
        secret_scan.scan_text(text)
        tree = token_count.PieceTree(text, count)
        for change in reversed(token_count.masking_edits(text)):
            tree.edit(*change)
        return time.perf_counter() - start

    seconds(500)
    assert seconds(32_000) < 30 * seconds(4_000)  # 8 times the text


def test_entropy_spans_equal_direct_sum():
    rng = random.Random(6)
    for _ in range(200):
        s = "".join(rng.choice("abcd0123XYZ") for _ in range(rng.randrange(20, 60)))
        bits = rng.choice([2.5, 2.9, 3.1])
        hot = set()
        for i in range(len(s) - 19):
            w = s[i : i + 20]
            if -sum(w.count(c) / 20 * np.log2(w.count(c) / 20) for c in set(w)) >= bits - 1e-9:
                hot |= set(range(i, i + 20))
        assert {x for a, b in secret_scan.entropy_spans(s, 20, bits) for x in range(a, b)} == hot


def test_redaction(spark):
    texts = ["a token = q9Zx7Lw2Vb4Kt8Rm1Yp6Nc3Hd5 b", "Donaudampfschifffahrtsgesellschaft plain", None, "k9Qz7Lw2Vb4Kt8Rm1Yp6Nc3Hd5Jf0Gs", "550e8400-e29b-41d4-a716-446655440000"]
    docs = spark.createDataFrame([(k, t, 1, "c") for k, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint, other string")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secret_scan.redact(docs).collect()}
    assert got == {0: ("a [SECRET] b", 12), 1: (texts[1], len(texts[1])), 2: (None, 1), 3: ("[SECRET]", 8), 4: (texts[4], 36)}


def test_token_counts_follow_edits(spark, folder, rows):
    with open(token_count.VOCABULARY, "rb") as f:
        count = token_count.Counter(f.read())
    whole = lambda t: sum(len(count.encode(p)) for p in count.scan.findall(t))
    got = registry.queries()["op9_token_counts"](spark, f"{folder}/all").collect()
    expected = []
    for i, t in pairs(rows):
        t = t or ""
        edits, after = token_count.masking_edits(t), t
        for a, b, new in reversed(edits):
            after = after[:a] + new + after[b:]
        expected.append((i, whole(t), len(edits), whole(after)))
    same([r[:4] for r in got], expected)
    rng, alphabet = random.Random(1), "ab 's'll\n\n  1é!?\t 　x"
    for _ in range(300):
        tree = token_count.PieceTree("".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 50, 900]))), count)
        for _ in range(6):
            old = tree.text
            a, new = rng.randint(0, len(old)), "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 4)))
            b = min(len(old), a + rng.randint(0, rng.choice([0, 2, 90])))
            tree.edit(a, b, new)
            assert tree.text == old[:a] + new + old[b:]
            assert tree.total == whole(tree.text) and tree.chars[1] == len(tree.text)
            tree = token_count.PieceTree(tree.text, count, tree.kept())
    long = token_count.PieceTree("some words of text " * 5000, count)
    long.edit(40_000, 40_004, "other")
    assert long.rescanned < 600


def test_versions_are_counted_from_kept_trees(spark, rows):
    docs = spark.createDataFrame(pairs(rows), "doc_id bigint, text string")
    upper = lambda t: [(0, 1, "Now "), (len(t) // 2, len(t) // 2, " inserted 7 words")] if len(t) > 2 else []
    first = shared.written(token_count.build_trees(docs), "first")
    second = shared.written(token_count.recount(first, edits=upper), "second")
    third = token_count.recount(second.select(first.columns))
    columns = ["doc_id", "n_tokens", "lengths", "tokens"]
    for version in (second, third):
        again = token_count.build_trees(version.select("doc_id", "text"))
        same(version.select(columns).collect(), again.select(columns).collect())
    assert token_count.recount(first.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav>
<div class="cookie-notice">We use cookies, many of them, for all kinds of reasons, really.</div><aside>Side, bar, text, with, commas</aside>{body}
<div id="comments"><p>First comment, which is long, has commas, and more than enough text to score well if it were not a comment.</p></div>
<form><p>Subscribe, now, please, to the letter</p><input type=text></form><footer>&copy; 2024, all, rights</footer><script>var x = "</p><p>no</p>";</script></body></html>"""


def test_html_extraction(spark, folder):
    body = "<div class=post><h2>Head &amp; line</h2><p>One <b>bold,\n  text</b> here<br>and more &lt;3 <p>Unclosed, <i>two<p>Short.</p><ul><li>item</ul><pre>a  b</pre></div>"
    assert html_extract.extract(PAGE.format(body=body)) == "Head & line\n\nOne bold, text here and more <3\n\nUnclosed, two\n\nShort.\n\nitem\n\na b"
    article = "<article><header><h1>Title</h1></header><section><p>A, long, enough, part of the article, with text.</p></section><section><p>x</p></section><div class='ad'>buy</div></article>"
    assert html_extract.extract(PAGE.format(body=article)) == "Title\n\nA, long, enough, part of the article, with text.\n\nx"
    assert html_extract.extract("") == "" and html_extract.extract(None) == "" and html_extract.extract("<p>a<") == "a<" and html_extract.extract("plain &am") == "plain &am"
    assert html_extract.extract("<div>" * 5000 + "deep, text") == "deep, text"
    assert html_extract.extract("<article><table><tr><td>a<td>b</table><p>c") == "a\n\nb\n\nc"
    got = {(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in registry.queries()["op10_html_extraction"](spark, f"{folder}/all").collect()}
    assert got == {(1, "u", "x", 1), (2, None, "", 0), (None, "v", "", 0)}


def test_html_names_do_not_drop_the_article():
    long = "A, long, enough, paragraph of the page, with text and commas, and more of it."
    text, rest = f"<p>{long}</p>", "<div class='sidebar'><p>Aside.</p></div><div id='comments'><p>A comment, long, and longer than all else on this page, yes, by far, and on it goes, and on.</p></div>"
    for page in (
        f"<div class='content with-sidebar'><article>{text}</article></div>{rest}",
        f"<article class='post has-comments'>{text}{rest}</article>",
        f"<article class='post sidebar-left'>{text}</article>{rest}",
        f"<div id='page-header-wrap'><div>{text}</div>{rest}</div>",
        f"<div id='page-header-wrap'><article>{text}</article>{rest}</div>",
        f"<form action=x><input name=y><div>{text}</div>{rest}</form>",
        f"<main><div class='content-tags'>{text}</div></main>{rest}",
    ):
        assert html_extract.extract(f"<html><body>{page}</body></html>") == long, page
    assert html_extract.extract(f"<article><div class='entry-header'><h1>Title</h1></div>{text}<form>Mail <input></form>{rest}</article>") == f"Title\n\n{long}"
    assert html_extract.extract(f"<div class='widget'>{text}</div><div class='widget'>{text}</div>") == f"{long}\n\n{long}"
    assert html_extract.extract(f"<article>{text}</article><div class='cookie'>{text}{text}</div>") == long


@pytest.mark.parametrize("page", ["{deep}{close}x", "{named}x"])
def test_html_deep_pages_are_no_work(page):
    start = time.perf_counter()
    assert html_extract.extract(page.format(deep="<div>" * 20_000, close="</b>" * 20_000, named="<div class='header'>" * 20_000)) == "x"
    assert time.perf_counter() - start < 10


def test_html_ids_made_of_headings_drop_nothing():
    long = "A, long, enough, paragraph of the page, with text and commas, and more of it."
    text = f"<p>{long}</p>"
    page = f"<article><h1 id='search-engines'>One</h1>{text}<section id='related-work'><h2 id='related-work-1'>Two</h2><p>More.</p></section><div id='notice-periods'>Three</div><h2 id='share'>Four</h2></article>"
    assert html_extract.extract(page) == f"One\n\n{long}\n\nTwo\n\nMore.\n\nThree\n\nFour"
    assert html_extract.extract(f"<div class=content><h1 class='page-header'>One</h1>{3 * text}</div>") == "\n\n".join(["One", *[long] * 3])


@pytest.mark.parametrize("mark", ["class='userComments'", "id='readerComments'", "aria-label='Comments'", "itemprop='comment'", "itemtype='https://schema.org/Comment'", "class='relatedPosts'", "class=adsbygoogle", "id='cookie-notice'"])
def test_html_names_in_other_forms(mark):
    long = "A, long, enough, paragraph of the page, with text and commas, and more of it."
    assert html_extract.extract(f"<body><article><h1>T</h1>{3 * f'<p>{long}</p>'}<div {mark}><p>{long}</p></div></article></body>") == "\n\n".join(["T", *[long] * 3])


def test_html_text_beside_the_best_element():
    long = "A, long, enough, paragraph of the page, with text and commas, and more of it."
    links = "<ul><li><a href=x>One</a></ul><p><a href=y>Two</a></p>"
    page = f"<body><div class=site>{links}</div><div class=post><h1>T</h1><div class=wrap><ul><li>Item</ul><div class=text>{3 * f'<p>{long}</p>'}</div>loose <b>end</b><pre>code</pre><table><tr><td>Cell</table>{links}</div><p>Short end.</p></div><p>Below</p></body>"
    assert html_extract.extract(page) == f"T\n\nItem\n\n{long}\n\n{long}\n\n{long}\n\nloose end\n\ncode\n\nCell\n\nShort end."
