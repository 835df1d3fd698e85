"""Page references as a stream: who holds a page, kept in the state store, one entry a sequence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Session settings that the state needs: entries are read and written alone, and kept on disk.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
REFS = "page_key string, part int, refs bigint, version bigint"


class PageReferences(StatefulProcessor):
    """Events count by their number `at`: a sequence's last one on a page says whether it holds it, in whatever order they come,
    and one that comes again changes nothing. That a sequence has left a page is remembered for `ttl` milliseconds."""

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "seq_id bigint", "at bigint")
        self.left = handle.getMapState("left", "seq_id bigint", "at bigint", self.ttl)
        self.count = handle.getValueState("count", "refs bigint, version bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        refs, version = self.count.get() if self.count.exists() else (0, 0)
        for frame in rows:
            for seq, at, attach in zip(frame["seq_id"].tolist(), frame["at"].tolist(), frame["attach"].tolist(), strict=True):
                here = (seq,)
                holds, gone = self.held.containsKey(here), self.left.containsKey(here)
                last = max(self.held.getValue(here)[0] if holds else at - 1, self.left.getValue(here)[0] if gone else at - 1)
                if at <= last:
                    continue
                if attach:
                    self.held.updateValue(here, (at,))
                    self.left.removeKey(here) if gone else None
                else:
                    self.left.updateValue(here, (at,))
                    self.held.removeKey(here) if holds else None
                refs += int(attach) - int(holds)
        self.count.update((refs, version + 1))
        yield pd.DataFrame({"page_key": [key[0]], "part": [key[1]], "refs": [refs], "version": [version + 1]})

    def close(self) -> None:
        pass


def references(events: DataFrame, parts: int = 16, ttl: int | None = None) -> DataFrame:
    """(page_key, part, refs, version) after each batch, of the pages that its events (page_key, seq_id, at, attach) name.

    A page's sequences are dealt over parts, so that one that any share of all sequences hold isn't one task's. totals() adds
    parts up. The session needs STATE. With a ttl, batches go on without new events, so the caller stops the query.
    """
    dealt = events.select("page_key", F.pmod(F.xxhash64("seq_id"), F.lit(parts)).cast("int").alias("part"), "seq_id", "at", "attach")
    return dealt.groupBy("page_key", "part").transformWithStateInPandas(PageReferences(ttl), outputStructType=REFS, outputMode="Update", timeMode="ProcessingTime" if ttl else "None")


def totals(updates: DataFrame) -> DataFrame:
    """(page_key, refs) by the last update of each part; 0 is free."""
    last = updates.groupBy("page_key", "part").agg(F.max_by("refs", "version").alias("refs"))
    return last.groupBy("page_key").agg(F.sum("refs").alias("refs"))


def events_of(pages: DataFrame, attach: bool, at: int = 0) -> DataFrame:
    """Events (page_key, seq_id, at, attach) by which sequences take or leave all their pages (seq_id, page_key)."""
    return pages.select("page_key", "seq_id", F.lit(at).cast("long").alias("at"), F.lit(attach).alias("attach"))
