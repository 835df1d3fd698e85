"""WARC files read in stretches, exact samples, and heavy hitters from summaries."""

import gzip
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvid.operators import sketch
from corvid.sources import readers, warc


def record(i, kind="response", size=400):
    rng = random.Random(i)
    html = f"<p>{i}</p>" + "".join(rng.choice("abcdefgh é\r\n") for _ in range(size))
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n{html}".encode()
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: r{i}\r\nWARC-Target-URI: u{i}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n", html


@pytest.mark.parametrize("split", [1, 97, 700, 5_000, 1 << 20, 0])
def test_each_record_is_read_once_however_files_are_cut(split, tmp_path):
    rows = [record(i, "request" if i % 7 == 0 else "response", 3 if i % 5 else 4_000) for i in range(60)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r, _ in rows))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(r for r, _ in rows)))  # one member
    (tmp_path / "c.warc").write_bytes(b"".join(r for r, _ in rows))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    (tmp_path / "e.warc.gz").write_bytes(b"")
    want = {(f"r{i}", f"u{i}", h) for i, (_, h) in enumerate(rows) if i % 7}
    for name in ("a.warc.gz", "b.warc.gz", "c.warc", "e.warc.gz"):
        reader = warc.WarcReader({"path": f"file://{tmp_path}/{name}", "split": str(split)})
        parts = [[(r["id"], r["url"], r["html"]) for b in reader.read(p) for r in b.to_pylist()] for p in reader.partitions()]
        got = [r for p in parts for r in p]
        assert len(got) == len(set(got)) and set(got) == (want if name[0] != "e" else set())
        if name[0] == "a" and split == 700:
            assert sum(bool(p) for p in parts) > 5


def test_damaged_and_cut_off_members(tmp_path):
    good = [gzip.compress(record(i)[0]) for i in range(6)]
    bad = bytearray(good[2])
    bad[60:70] = b"\xff" * 10
    (tmp_path / "x.warc.gz").write_bytes(good[0] + good[1] + bytes(bad) + b"\0\0" + good[3] + good[4] + good[5][:-150])
    for split in (0, 300):
        reader = warc.WarcReader({"path": str(tmp_path), "split": str(split)})
        got = [r["id"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert [x for x in got if x in ("r0", "r1", "r3", "r4")] == ["r0", "r1", "r3", "r4"] and len(got) == len(set(got))


def test_written_and_read_by_several_tasks(spark, tmp_path):
    pages = spark.range(200).select(F.concat(F.lit("p"), "id").alias("id"), F.lit("http://x/").alias("url"), F.concat(F.lit("<p>\r\n\r\n"), F.sha2(F.col("id").cast("string"), 512)).alias("html"))
    path = f"file://{tmp_path}/w"
    readers.write_warc(pages.repartition(2), path, gzipped=True)
    got = readers.read_warc(spark, f"{path}/*.warc.gz", split=4_000)
    assert got.rdd.getNumPartitions() > 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pages.collect()))
    assert readers.read_warc(spark, path).count() == 200


def test_sample_is_the_smallest_hashes(spark):
    df = spark.range(3_000).withColumn("hot", F.when(F.col("id") < 1_000, 7).otherwise(F.col("id")))
    order = [r["id"] for r in df.orderBy(F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))), "id").collect()]
    for n in (0, 1, 1_500, 2_999, 3_000, 4_000):
        assert sorted(r["id"] for r in readers.sample_exact(df, n, "id").collect()) == sorted(order[:n])
        assert readers.sample_exact(df, n, "hot").count() == min(n, 3_000)
    assert readers.sample_exact(df.limit(0), 5, "id").count() == 0


def test_heavy_hitters_with_collisions_and_nulls(spark):
    rng = random.Random(3)
    values = [None] * 300 + ["hot"] * 900 + ["warm"] * 121 + ["cool"] * 119 + [f"x{rng.randrange(4_000)}" for _ in range(10_560)]
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "item string").repartition(7)
    true = Counter(values)
    for share, size in ((0.01, None), (0.01, 110), (0.05, 25)):
        got = {r["item"]: r["n"] for r in sketch.heavy_hitters(df, "item", share, size).collect()}
        assert got == {k: n for k, n in true.items() if n >= share * len(values)}
    merged = {r["item"]: r["least"] for r in sketch.summaries(df, "item", 50).collect()}
    assert all(0 < n <= true[k] for k, n in merged.items()) and len(merged) <= 7 * 50
    assert all(true[k] - merged.get(k, 0) <= len(values) / 51 for k in true)
    narrow = sketch.build(df, "item", width=64, depth=2)  # many collisions: never too little
    told = {r["item"]: r["estimate"] for r in sketch.estimate(narrow, df.where("item is not null"), "item", 64, 2).collect()}
    assert all(told[k] >= n for k, n in true.items() if k is not None) and any(told[k] > true[k] for k in told)
    assert sketch.heavy_hitters(df.limit(0), "item", 0.1).count() == 0
    with pytest.raises(ValueError):
        sketch.heavy_hitters(df, "item", 0.01, 50)
