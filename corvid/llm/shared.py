"""What several corpus operators share: scratch tables, text keys and vectorised word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.plans.scratch import discard, scope, table, written

__all__ = ["SPACES", "content_key", "discard", "in_slices", "mix", "scope", "sliding", "small", "span_hashes", "table", "utf8", "window_hashes", "with_keys", "word_hashes", "written"]

SPACES = r"[\x20\x09-\x0D]+"


def content_key(*columns: Column) -> list[Column]:
    """Two 64-bit hashes, __k1 and __k2: together a 128-bit key of the columns' contents (null counts as '')."""
    filled = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return [F.xxhash64(F.lit(salt), *filled).alias(name) for salt, name in ((11, "__k1"), (29, "__k2"))]


#: Into how many parts the rows of frequent keys are dealt in all, at most.
PARTS = 20_000


def with_keys(rows: DataFrame, keys: DataFrame, on: list[str], n: str, spread: list[str], keep: list[str] = ()) -> DataFrame:
    """rows whose `on` is in keys: (on, n), a written table without repeated or null keys, n at least the rows of each.

    Columns `keep` of keys come along.

    A key with more than a PARTS-th of what all keys hold is dealt over tasks by `spread`, each with its copy of the key.
    There are under PARTS such keys, as their n add up to no more than the whole, and under 2 * PARTS copies: these alone
    are broadcast.
    """
    unit = keys.agg(F.ceil(F.sum(n) / PARTS).cast("long")).first()[0] or 1
    hot = keys.where(F.col(n) > unit).select(*on, F.ceil(F.col(n) / unit).cast("int").alias("__parts"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(F.lit(41), *spread), "__parts"), F.lit(0)).cast("int")).drop("__parts")
    parts = F.when(F.col(n) > unit, F.ceil(F.col(n) / unit)).otherwise(1).cast("int")
    copies = keys.select(*on, *keep, F.explode(F.sequence(F.lit(0), parts - 1)).alias("__part"))
    return dealt.join(copies, [*on, "__part"], "inner" if keep else "left_semi").drop("__part")


def small(rows: DataFrame, most: int = 500_000) -> DataFrame:
    """rows, to be broadcast if there are few: a table that is cheap to count. Beyond, the join is shuffled and AQE splits it."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def in_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice's texts hold about `most` bytes (one longer text stands alone)."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        at, ends = 0, np.cumsum(lengths, dtype=np.int64)
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


# --- vectorised hashes -------------------------------------------------------------------------------------------

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _POWERS[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


_P1, _Q1 = _inverse(_P), _inverse(_Q)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each white-space separated word of all the texts, and each text's first word (one more at the end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gaps = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gaps))))
    begin, end = edge[0::2], edge[1::2]
    out = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):  # pieces keep the power tables small; a longer single word makes its own piece
        to = max(at + 1, int(np.searchsorted(end, begin[at] + piece, "right")))
        lo, hi = int(begin[at]), int(end[to - 1])
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * _powers(_P, hi - lo), dtype=np.uint64)))
        b, e = begin[at:to] - lo, end[at:to] - lo
        out[at:to] = (sums[e] - sums[b]) * _powers(_P1, hi - lo)[b] + (e - b).astype(np.uint64)
        at = to
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return mix(out), np.searchsorted(begin, starts)


def window_hashes(words: np.ndarray, first: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each word the hash of the k words from it, and whether these lie in one text."""
    n = len(words)
    ok = np.zeros(n, bool)
    if n < k:
        return np.zeros(n, np.uint64), ok
    last = np.repeat(first[1:], np.diff(first))
    ok = np.arange(n) + k <= last
    w = mix(words + np.uint64(salt)) if salt else words
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w * _powers(_Q, n), dtype=np.uint64)))
    out = np.zeros(n, np.uint64)
    out[: n - k + 1] = (sums[k:] - sums[:-k]) * _powers(_Q1, n)[: n - k + 1]
    return mix(out + np.uint64(k)), ok


def sliding(values: np.ndarray, w: int, pick=np.minimum) -> np.ndarray:
    """pick over values[i : i + w] for each i up to len - w (running picks within blocks of w, forwards and backwards)."""
    n = len(values)
    if w == 1 or n < w:
        return values[: max(0, n - w + 1)].copy()
    fill = np.iinfo(values.dtype).max if pick is np.minimum else 0
    blocks = np.concatenate((values, np.full(-n % w, fill, values.dtype))).reshape(-1, w)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - w + 1], ahead[w - 1 : n])


def span_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of the words from each start to its end (exclusive)."""
    w = mix(words + np.uint64(salt))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w * _powers(_Q, len(words)), dtype=np.uint64)))
    return mix((sums[end] - sums[start]) * _powers(_Q1, len(words) + 1)[start] + (end - start).astype(np.uint64))


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
