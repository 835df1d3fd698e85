"""The Merkle manifest, vector codes and SentencePiece pieces against plain models and the library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from corvid.llm import merkle, registry, sentencepiece_bpe, shared, vector_codes
from tests.llm.conftest import SCHEMA

key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)


def same(got, expected):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, expected), key=key)


# --- the manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The top of a list of nodes, and each node's path of (before, after)."""
    paths, spans = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + 8, len(nodes))) for a in range(0, len(nodes), 8)]
        for run in runs:
            for k in run:
                for i in spans[k]:
                    paths[i].append(("".join(nodes[run[0] : k]), "".join(nodes[k + 1 : run[-1] + 1])))
        nodes, spans = [sha("".join(nodes[k] for k in run)) for run in runs], [[i for k in run for i in spans[k]] for run in runs]
    return nodes[0], paths


def manifest(rows, hit, lower=str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups, out = defaultdict(list), []
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = [climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order]
    root, above = climb([t for t, _ in tops])
    for g, (top, paths), up in zip(order, tops, above, strict=True):
        for (_, _, h, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), paths, strict=True):
            found = leaf((*r[:4], r[4] and r[4].translate(lower))) if hit(r[0]) else h
            for a, b in path + up:
                found = sha(a + found + b)
            out.append((r[0], h, top, root, sha("".join(a + b for a, b in path + up)), found, found == root))
    return out


def of_query(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0


def test_manifest(spark, folder, rows):
    got = registry.queries()["op11_merkle_manifest"](spark, f"{folder}/all")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    same(got.collect(), manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows], of_query))


@pytest.mark.parametrize("sizes", [(1,), (8,), (9, 1), (512,), (513, 64, 65), (1400, 1), (3,) * 70])
def test_manifest_of_all_shapes(spark, sizes):
    rng = random.Random(sum(sizes))
    data = [(rng.choice([7, k]), f"s{k}", f"l{g}" if g else None, k, "Text É") for g, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame(data, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(3)
    found = (F.col("doc_id") % 2 == 0, {"text": F.lower("text")})
    got = merkle.merkle_manifest(df.withColumn("leaf", F.lit("clash")), found=found, proofs=True)
    rows = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in got.collect()]
    expected = manifest([r[:4] + ("Text É",) for r in data], lambda i: False)
    same([r[:5] for r in rows], [r[:5] for r in expected])
    assert all(r[6] == (r[5] == r[3]) == (r[0] % 2 == 1) for r in rows)
    assert all(sha(r["proof"]) == r["proof_sha256"] for r in got.collect())


def test_manifest_of_one_row_repeated(spark):
    row = (5, "s", "en", 3, "abc")
    df = spark.createDataFrame([row] * 3000, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(4)
    same(merkle.merkle_manifest(df).collect(), manifest([row] * 3000, lambda i: False))


def test_ranks_are_dealt_over_tasks(spark):
    leaves = spark.createDataFrame([(1, "g", "x" * 64, None)] * 4000, "key bigint, group_key string, leaf string, other string").repartition(4)
    placed, groups = merkle.rank_leaves(leaves)
    assert sorted(r["at"] for r in placed.collect()) == list(range(4000)) and [tuple(r) for r in groups.select("group_key", "tree", "n").collect()] == [("g", 0, 4000)]


# --- vector codes


def codes(rows, dim, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label) -> the query's rows, in plain whole numbers."""
    kept = [(i, [int(np.floor(4096 * float(np.float32(x)))) for x in v], g) for i, v, g in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    width = dim // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda v: [min((far(x, c), k) for k, c in enumerate(book)) for x, book in zip(cut(v), books, strict=True)]
    for _ in range(rounds):
        met = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in kept:
            for p, (_, k) in enumerate(assign(v)):
                met[p][k].append(cut(v)[p])
        for p in range(parts):
            for k, xs in met[p].items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, total = [], defaultdict(int)
    for i, v, g in kept:
        a = assign(v)
        out.append((i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), g))
        total[g] += out[-1][2]
    digest = sha(",".join(str(x) for book in books for c in book for x in c))
    return [(i, c, e, total[g], digest) for i, c, e, g in out]


def test_codes(spark, folder):
    got = registry.queries()["op12_vector_codes"](spark, f"{folder}/all")
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in shared.table(spark, f"{folder}/all", "embeddings").collect()]
    same(got.collect(), codes(rows, 16))


def test_codes_of_few_rows_and_odd_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0, 4.0], 1), (3, [0.0], None)], "vec_id bigint, embedding array<double>, label int")
    books = vector_codes.train(df)
    assert books.dim == 3 and [b.shape for b in books.parts] == [(2, 1)] * 8
    assert {r["vec_id"]: (r["code"], r["error"]) for r in vector_codes.encode(df, books).collect()} == {1: ("00" * 8, 0), 2: ("0000010000000000", 0)}


def test_distances_are_exact_or_refused():
    rng = np.random.default_rng(1)
    x, book = rng.integers(-(1 << 27), 1 << 27, (50, 8)), rng.integers(-(1 << 27), 1 << 27, (5, 8))
    entry, far = vector_codes.nearest(x, book)
    plain = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in book] for v in x]
    assert entry.tolist() == [d.index(min(d)) for d in plain] and far.tolist() == [min(d) for d in plain]
    with pytest.raises(ValueError, match="too large"):
        vector_codes.whole(pa.RecordBatch.from_pydict({"v": [[1e9] * 8]}), "v", 8)


def test_many_labels_meet_by_a_join(spark, monkeypatch):
    df = spark.createDataFrame([(k, k % 7 if k % 3 else None, f"{k}", k) for k in range(500)], "vec_id bigint, label int, code string, error bigint")
    expected = [tuple(r) for r in vector_codes.with_label_error(df).select("vec_id", "label", "error", "label_error").collect()]
    monkeypatch.setattr(vector_codes, "MOST_LABELS", 2)
    same(vector_codes.with_label_error(df).select("vec_id", "label", "error", "label_error").collect(), expected)
    total = defaultdict(int)
    for _, g, e, _ in expected:
        total[g] += e
    assert len(expected) == 500 and all(t == total[g] for _, g, _, t in expected)


# --- pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.VOCABULARY)


@pytest.fixture(scope="module")
def model():
    return sentencepiece_bpe.Model(sentencepiece_bpe._read(sentencepiece_bpe.VOCABULARY))


def test_pieces(spark, folder, rows, library):
    got = registry.queries()["op13_sentencepiece"](spark, f"{folder}/all").collect()
    expected = []
    for r in rows:
        ids = library.encode(r[1] or "")
        expected.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    same(got, expected)


def test_any_text_has_the_librarys_ids(model, library):
    rng = random.Random(2)
    pieces = list(model.ids)
    kinds = (
        lambda: "".join(rng.choice(" ▁  ab\n\t0") for _ in range(rng.randrange(60))),
        lambda: "".join(rng.choice(pieces) for _ in range(rng.randrange(12))),
        lambda: "".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x4E00, 0x5000), rng.randrange(0x1F600, 0x1F650), 0, 0x301])) for _ in range(rng.randrange(30))),
        lambda: " " * rng.randrange(1, 200) + rng.choice(["x", "", "\n", "<s></s><0x41><unk>"]) + " " * rng.randrange(70),
        lambda: "".join(rng.choice("etaoinshrdl") for _ in range(rng.randrange(200))),
    )
    for k in range(3000):
        text = kinds[k % len(kinds)]()
        ids = library.encode(text)
        assert model.encode(text).tolist() == ids and model.decode(ids) == library.decode(ids), text
    for _ in range(2000):  # ids that no text has
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260), 28705, 259]) for _ in range(rng.randrange(10))]
        assert model.decode(ids) == library.decode(ids), ids
    for text in ("the" * 50_000, " " * 100_000, "한글北京大学" * 20_000, "qzjx" * 30_000):
        assert model.encode(text).tolist() == library.encode(text)


def test_what_is_remembered_changes_nothing(model, library, monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "KNOWN", 7)
    words = [f"word{k % 29} other{k % 13}," for k in range(300)]
    assert model.encode(" ".join(words)).tolist() == library.encode(" ".join(words))


def test_steps_back_from_dead_ends(model):
    """A plain merge gives what backtracking does, also where the longest piece is wrong."""
    rng, wrong = random.Random(4), 0
    known = [p for p in model.ids if p.isalpha()]
    for _ in range(3000):
        text = "".join(rng.choice(known) for _ in range(3))
        ids = model.backtrack(text)
        assert [model.pieces[k] for k in ids] == model.merged(text)
        wrong += not text.startswith(max((p for p in (text[:n] for n in range(1, 17)) if p in model.ids), key=len)) or len(model.pieces[ids[0]]) < max(n for n in range(1, 17) if text[:n] in model.ids)
    assert wrong > 50


def test_decoding_takes_nulls(spark):
    df = spark.createDataFrame([(1, [22557, 28705, 1526]), (None, None), (2, [])], "doc_id bigint, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in sentencepiece_bpe.decode(df).collect()} == {1: "Hello  world", None: "", 2: ""}


def test_schema_has_no_clash(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit(1))
    assert sentencepiece_bpe.encode(df).columns == ["doc_id", "ids"]
