"""Structured Streaming forms of the serving operators and the mergeable aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvid.operators.serving import Admission, TokenLRU
from corvid.operators.sketch import DEPTH, WIDTH, buckets
from corvid.sources import sinks


def windowed_rates(events: DataFrame, key: str, window: str = "10 seconds", slide: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(key, window, n, tokens) in event time; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(key, F.window("ts", window, slide)).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def running_frequencies(docs: DataFrame, terms) -> DataFrame:
    """(term, n): occurrences so far, for update or complete mode; counts add up over batches."""
    return docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def running_sketch(items: DataFrame, item: str, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """A Count-Min sketch so far, as (row, bucket, cnt)."""
    return items.select(F.explode(buckets(F.col(item), width, depth)).alias("b")).groupBy("b.row", "b.bucket").agg(F.count("*").alias("cnt"))


def index_batch(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a micro-batch of documents becomes the index's batch of its number; coming again, it replaces itself."""

    def add(docs: DataFrame, batch: int) -> None:
        sinks.append_index(docs.select("doc_id", "text"), path, f"stream-{batch}")

    return add


def index(docs: DataFrame, path: str, state: str) -> StreamingQuery:
    """Adds what a stream of new documents (doc_id, text) holds by now to a written index, exactly once whatever fails."""
    return docs.writeStream.foreachBatch(index_batch(path)).option("checkpointLocation", state).trigger(availableNow=True).start()


def admission(requests: DataFrame, key: str, qps: float = 10.0, token_rate: float = 10_000.0, seconds: float = 10.0) -> DataFrame:
    """Decisions on requests (key string, request_id, micros, tokens) as they come; a key's state is its admitted window."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate = Admission(qps, token_rate, seconds)
        if state.exists:
            times, tokens = state.get
            for t, n in zip(times, tokens, strict=True):
                gate.admitted.append((t, n))
            gate.tokens = sum(tokens)
        rows = pd.concat(list(frames)).sort_values(["micros", "request_id"])
        said = [gate.ask(m / 1e6, int(n)) for m, n in zip(rows["micros"], rows["tokens"], strict=True)]
        state.update(([t for t, _ in gate.admitted], [n for _, n in gate.admitted]))
        yield pd.DataFrame({"key": group[0], "request_id": rows["request_id"], "decision": said})

    return requests.groupBy(key).applyInPandasWithState(step, "key string, request_id bigint, decision string", "times array<double>, tokens array<bigint>", "append", GroupStateTimeout.NoTimeout)


def cache(accesses: DataFrame, shard: str, budget: int) -> DataFrame:
    """Hits and misses of accesses (shard string, event_id, micros, item bigint, tokens) in a token-budget LRU per shard."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lru = TokenLRU(budget)
        if state.exists:
            items, tokens = state.get
            for k, n in zip(items, tokens, strict=True):
                lru.put(k, n)
        rows = pd.concat(list(frames)).sort_values(["micros", "event_id"])
        hits = []
        for item, n in zip(rows["item"], rows["tokens"], strict=True):
            hits.append(lru.get(int(item)))
            if not hits[-1]:
                lru.put(int(item), int(n))
        state.update((list(lru.entries), list(lru.entries.values())))
        yield pd.DataFrame({"shard": group[0], "event_id": rows["event_id"], "hit": hits})

    return accesses.groupBy(shard).applyInPandasWithState(step, "shard string, event_id bigint, hit boolean", "items array<bigint>, tokens array<bigint>", "append", GroupStateTimeout.NoTimeout)


def microbatches(requests: DataFrame, key: str, size: int = 32, wait_ms: int = 50) -> DataFrame:
    """Batches of requests (key string, request_id, priority): all that wait go once the oldest has waited wait_ms of processing time, `size` at a time, best priority first.

    The oldest's arrival is kept: later ones set the timer to what is left of its wait, and if nothing is left the
    requests go with the trigger that brings them.
    """

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, priorities, batch, oldest = ([], [], 0, -1)
        if state.exists:
            ids, priorities, batch, oldest = list(state.get[0]), list(state.get[1]), state.get[2], state.get[3]
        now = state.getCurrentProcessingTimeMs()
        if not state.hasTimedOut:
            for f in frames:
                ids += f["request_id"].tolist()
                priorities += f["priority"].tolist()
            if oldest < 0 and ids:
                oldest = now
        left = oldest + wait_ms - now
        if ids and left > 0:
            state.update((ids, priorities, batch, oldest))
            state.setTimeoutDuration(max(1, left))
            return
        order = sorted(zip((-p for p in priorities), ids, strict=True))
        out: list[tuple[Any, ...]] = [(group[0], batch + i // size, i % size, rid) for i, (_, rid) in enumerate(order)]
        state.update(([], [], batch + -(-len(order) // size), -1))
        yield pd.DataFrame(out, columns=["key", "batch", "place", "request_id"])

    return requests.groupBy(key).applyInPandasWithState(step, "key string, batch bigint, place int, request_id bigint", "ids array<bigint>, priorities array<double>, batch bigint, oldest bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)
