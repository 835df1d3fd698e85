"""The pipeline's stages against plain models, each on what its predecessor kept."""

import random

import corpus_pipeline
from corvid.llm.shared import written
from tests.llm import brute

BENCHMARK = "what is the capital of the country where the long river ends in seven arms"


def test_stages_equal_models(spark, folder, tmp_path):
    rng = random.Random(5)
    given = [tuple(r) for r in spark.read.parquet(f"{folder}/all/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta rho sigma tau phi chi psi".split()) + str(rng.randrange(300)) for _ in range(n))
    more = [f"{words(30)}\nRead page {k} of this site\n{words(20)}" for k in range(14)]  # a line of 14 documents
    more += [f"{words(15)} {BENCHMARK}? {words(9)}", f"{words(20)} the capital of the country", f"{words(20)} password = 'hunter22hunter' {words(5)} k9Qz7Lw2Vb4Kt8Rm1Yp6Nc3Hd5Jf0Gs", more[0], more[3] + " end"]
    given += [(5000 + k, t, "en", "src3", len(t)) for k, t in enumerate(more)]
    given = [(i, *r) if i is not None else (9000 + k, *r) for k, (i, *r) in enumerate(given)]  # rows without ids have a test of their own
    sf_dir = f"file://{tmp_path}"
    docs = spark.createDataFrame(given, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(1, BENCHMARK), (2, "no such text here at all, I hope"), (3, None)], "item_id bigint, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    models = {
        "quality rules": lambda rows: brute.quality_stage([(i, t, s) for i, t, s in rows]),
        "near duplicates": lambda rows: brute.near_duplicate_stage([(i, t) for i, t, _ in rows]),
        "benchmark decontamination": lambda rows: [(i, t) for i, t, _ in rows if not brute.leaks(t, BENCHMARK)],
        "secret scans": lambda rows: [(i, brute.redacted(t)) for i, t, _ in rows],
    }
    docs, columns, sizes = spark.read.parquet(f"{sf_dir}/documents.parquet"), docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        docs = written(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns, name
        got = docs.collect()
        assert sorted((r["doc_id"], r["text"] or "") for r in got) == sorted((i, t or "") for i, t in models[name](rows)), name
        assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)
        sizes.append(len(got))
    assert len(given) > sizes[0] > sizes[1] > sizes[2] == sizes[3]
    texts = {(r["doc_id"], r["text"]): len(brute.WORD.findall(r["text"])) for r in docs.collect()}
    uses = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert uses and all(texts[r["doc_id"], r["text"]] == r["n_tokens"] for r in uses)
    assert len({(r["doc_id"], r["epoch"]) for r in uses}) == len(uses) and sum(r["n_tokens"] for r in uses) <= sum(texts.values()) * 60 // 100
    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(str, again)) == sorted(map(str, uses))


def test_rows_without_ids_and_further_columns(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/all/documents.parquet")
    clash = docs.selectExpr("*", "1 AS __k1", "2 AS __k2", "3 AS __gone", "4 AS __row", "5 AS label", "6 AS `a b`")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, wide = (written(stage(spark, x, f"{folder}/all"), "test") for x in (docs, clash))
        assert wide.columns == clash.columns, name
        one = lambda df: sorted(str((r["doc_id"], r["text"])) for r in df.collect())
        assert one(plain) == one(wide), name
        docs, clash = plain, wide


def test_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
