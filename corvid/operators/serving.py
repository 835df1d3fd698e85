"""Serving control as tables: request priorities, micro-batches, admission, caches, priority queues."""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.plans.scratch import few_rows, global_row_number, running_sum


def default_priority(tokens: Column) -> Column:
    return 1.0 / (tokens + 1)


def slo_priority(tokens: Column, created: Column, slo_ms: Column, as_of: Column) -> Column:
    """Infinite once the limit has passed, else 1 / (milliseconds left + 1); without a limit the default."""
    left = slo_ms - (micros(as_of) - micros(created)) / 1000.0
    return F.when(slo_ms.isNull(), default_priority(tokens)).when(left <= 0, F.lit(float("inf"))).otherwise(1.0 / (left + 1))


def microbatches(requests: DataFrame, size: int = 32) -> DataFrame:
    """requests (request_id, priority, ...) with batch and place in it, best priority first, ties by request_id."""
    ranked = global_row_number(requests, [F.desc("priority"), F.asc("request_id")])
    return ranked.withColumn("batch", F.floor((F.col("rn") - 1) / size).cast("long")).withColumn("place", F.pmod(F.col("rn") - 1, F.lit(size)).cast("int")).drop("rn")


def released(requests: DataFrame, as_of: Column, wait_ms: float = 50.0, size: int = 32, when_full: bool = False) -> DataFrame:
    """Requests (with created_at) of a queue that are due: all once the oldest has waited wait_ms, or if full and when_full."""
    state = requests.agg(F.min("created_at").alias("__oldest"), F.count("*").alias("__n"))
    due = (micros(as_of) - micros("__oldest")) / 1000.0 >= wait_ms
    if when_full:
        due = due | (F.col("__n") >= size)
    return requests.crossJoin(F.broadcast(state)).where(due).drop("__oldest", "__n")


def micros(ts: Column | str = "ts") -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def sliding_rate(events: DataFrame, key: str, seconds: int = 10, tokens: Column | None = None) -> DataFrame:
    """events with `rate`: rows, or tokens, of the key in the last `seconds` per second, the row's own and its peers' included.

    A key's time is cut into stretches of 16 windows; the rows of a stretch's last window also go to the next stretch,
    so a key that holds a third of all rows is still spread over many tasks. Rows without ts stay, with a null rate.
    """
    width, stretch = seconds * 1_000_000, 16 * seconds * 1_000_000
    at = events.withColumn("__at", micros()).withColumn("__own", F.floor(F.col("__at") / stretch))
    again = F.when(F.col("__at").isNull(), F.array(F.lit(0).cast("bigint"))).when(F.col("__at") >= (F.col("__own") + 1) * stretch - width, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))
    spread = at.withColumn("__part", F.explode(again))
    total = F.count("*") if tokens is None else F.sum(tokens)
    # Rows without ts are dealt by themselves, so that they don't meet in one task.
    alone = F.when(F.col("__at").isNull(), F.xxhash64(*events.columns))
    w = Window.partitionBy(key, "__part", "__alone").orderBy("__at").rangeBetween(-width, 0)
    rate = F.when(F.col("__at").isNotNull(), F.round(total.over(w) / float(seconds), 6))
    rated = spread.withColumn("__alone", alone).withColumn("rate", rate).drop("__alone")
    return rated.where((F.col("__own") == F.col("__part")) | F.col("__at").isNull()).drop("__at", "__own", "__part")


class Admission:
    """A sliding window over admitted requests, by request rate first, then by token rate."""

    def __init__(self, qps: float, token_rate: float, seconds: float):
        self.qps, self.token_rate, self.seconds = qps, token_rate, seconds
        self.admitted: deque[tuple[float, int]] = deque()
        self.tokens = 0

    def ask(self, now: float, tokens: int) -> str:
        while self.admitted and now - self.admitted[0][0] > self.seconds:
            self.tokens -= self.admitted.popleft()[1]
        if len(self.admitted) / self.seconds >= self.qps:
            return "qps"
        if (self.tokens + tokens) / self.seconds > self.token_rate:
            return "tokens"
        self.record(now, tokens)
        return "admitted"

    def record(self, now: float, tokens: int) -> None:
        """Counts a request that was let in without asking."""
        self.admitted.append((now, tokens))
        self.tokens += tokens


class TokenLRU:
    """Least recently used entries go while the budget is exceeded; an entry above the budget empties the cache."""

    def __init__(self, budget: int):
        self.budget, self.total = budget, 0
        self.entries: OrderedDict[object, int] = OrderedDict()

    def get(self, key: object) -> bool:
        if key not in self.entries:
            return False
        self.entries.move_to_end(key)
        return True

    def put(self, key: object, tokens: int) -> list[object]:
        """Stores an entry; says which ones went."""
        self.total -= self.entries.pop(key, 0)
        gone = self.shrink(self.budget - tokens)
        if tokens <= self.budget:
            self.entries[key] = tokens
            self.total += tokens
        return gone

    def shrink(self, to: int) -> list[object]:
        gone = []
        while self.entries and self.total > to:
            key, tokens = self.entries.popitem(last=False)
            self.total -= tokens
            gone.append(key)
        return gone


def _in_order(rows: DataFrame, key: str, order: list[str], make: Callable, step: Callable, out: list[tuple[str, str]]) -> DataFrame:
    """Rows of each key in order through a state: make() at a key's first row, then step(state, row) gives output values.

    Rows stream through sorted partitions, so a task holds one state, not a key's rows.
    """
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for b in batches:
            values: list[list] = [[] for _ in out]
            for row in b.to_pylist():
                if row[key] != now or state is None:
                    now, state = row[key], make()
                for o, v in zip(values, step(state, row), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(o, arrow[t]) for o, (_, t) in zip(values, out, strict=True))], [*b.schema.names, *(n for n, _ in out)])

    inner = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, inner + "".join(f", {n} {t}" for n, t in out))


def replay_admission(requests: DataFrame, key: str, qps: float = 10.0, token_rate: float = 10_000.0, seconds: float = 10.0) -> DataFrame:
    """requests (key, micros, request_id, tokens) with decision: admitted, qps or tokens. One window per key."""
    return _in_order(requests, key, ["micros", "request_id"], lambda: Admission(qps, token_rate, seconds), lambda s, r: (s.ask(r["micros"] / 1e6, r["tokens"]),), [("decision", "string")])


def replay_lru(accesses: DataFrame, shard: str, budget: int) -> DataFrame:
    """accesses (shard, micros, event_id, item, tokens) with hit, evicted and the cache's tokens after each. One cache per shard."""

    def step(cache: TokenLRU, row: dict) -> tuple:
        if cache.get(row["item"]):
            return True, 0, cache.total
        return False, len(cache.put(row["item"], row["tokens"])), cache.total

    return _in_order(accesses, shard, ["micros", "event_id"], lambda: TokenLRU(budget), step, [("hit", "boolean"), ("evicted", "int"), ("total_tokens", "bigint")])


def recency(accesses: DataFrame, shard: str) -> DataFrame:
    """(shard, item, tokens, last, above): above are the tokens of the items used later and the item's own.

    In larger tables a shard's items lie in many tasks, by their last use.
    """
    last = accesses.groupBy(shard, "item").agg(F.max(F.struct("micros", "event_id")).alias("last"), F.max("tokens").alias("tokens"))
    if not few_rows(accesses):
        return running_sum(last, [shard], [F.desc("last"), F.asc("item")], "tokens", "above", "__all").withColumn("above", F.col("above").cast("long")).drop("__all")
    w = Window.partitionBy(shard).orderBy(F.desc("last"), F.asc("item")).rowsBetween(Window.unboundedPreceding, 0)
    return last.withColumn("above", F.sum("tokens").over(w).cast("long"))


def resident(accesses: DataFrame, shard: str, budget: int) -> DataFrame:
    """What a cache holds after all accesses, for items of fixed sizes within the budget: those most recently used that fit."""
    return recency(accesses, shard).where(F.col("above") <= budget)


def evicted_until(accesses: DataFrame, shard: str, budget: int, to: int) -> DataFrame:
    """Of the resident items those that go when the cache shrinks to `to` tokens, the oldest first (place from 1)."""
    gone = resident(accesses, shard, budget).where(F.col("above") > to)
    return gone.withColumn("place", F.row_number().over(Window.partitionBy(shard).orderBy("last")))


def queue_state(operations: DataFrame) -> DataFrame:
    """(key, score) left after push, update and delete operations (seq, op, key, score), replayed by key.

    The last operation on a key decides; increases and decreases are updates, pushes of a known key too.
    """
    last = operations.groupBy("key").agg(F.max_by(F.struct("op", "score"), "seq").alias("x"))
    return last.where("x.op <> 'delete'").select("key", F.col("x.score").alias("score"))


def queue_info(queue: DataFrame, largest: bool = False) -> DataFrame:
    """One row on queue (key, score): size, and the key and score that would be popped next (null if it is empty)."""
    best = F.min(F.struct((-F.col("score") if largest else F.col("score")).alias("s"), "key", "score")).alias("x")
    return queue.agg(F.count("*").alias("size"), best).select("size", F.col("x.key").alias("next_key"), F.col("x.score").alias("next_score"))


def scores_of(queue: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, contained, score) for keys (key): whether each is in the queue, and with which score."""
    return keys.select("key").distinct().join(queue.select("key", "score", F.lit(True).alias("__in")), "key", "left").select("key", F.coalesce("__in", F.lit(False)).alias("contained"), "score")


def pop_order(queue: DataFrame, largest: bool = False) -> DataFrame:
    """queue with the place in which each key would be popped; ties by key."""
    return global_row_number(queue, [F.desc("score") if largest else F.asc("score"), F.asc("key")], "place")


def wrong_updates(operations: DataFrame) -> DataFrame:
    """(seq, key, problem) of operations (seq, op, key, score) that a strict queue refuses: pushes of a known key, changes and
    deletes of an unknown one, decreases to no lower and increases to no higher a score (an equal one is no change)."""
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.last(F.when(F.col("op").isin("push", "delete"), F.col("op")), ignorenulls=True).over(w) == "push", F.lit(False))
    score = F.last("score", ignorenulls=True).over(w)
    problem = (
        F.when((F.col("op") == "push") & known, "duplicate key")
        .when((F.col("op") != "push") & ~known, "unknown key")
        .when((F.col("op") == "decrease") & (F.col("score") > score), "not lower")
        .when((F.col("op") == "increase") & (F.col("score") < score), "not higher")
    )
    return operations.select("seq", "key", problem.alias("problem")).where(F.col("problem").isNotNull())


def complete(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Requests without those that are done (request_id)."""
    return requests.join(done.select("request_id").distinct(), "request_id", "left_anti")
