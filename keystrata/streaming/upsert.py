"""Continuous forms: state fold, lookups with expiring state, message routing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keystrata.functions.glob import glob_match
from keystrata.operators.changefeed import VectorTable


def latest(stream: DataFrame) -> DataFrame:
    """Streaming fold (db, key, generation, kind): newest change of each key; for update or complete mode.

    Late and repeated rows need no watermark, as the highest generation wins in any order.
    """
    return stream.groupBy("db", "key").agg(F.max(F.struct("generation", "kind")).alias("r")).select("db", "key", "r.generation", "r.kind")


def apply_to_table(stream: DataFrame, table: VectorTable, checkpoint: str):
    """A streaming query that applies each micro-batch to a `VectorTable`.

    A batch that is run again after a failure changes nothing the second time, as its generations are known by then.
    """

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            table.apply(batch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


class ExpiringState(StatefulProcessor):
    """Live value of each key under event time: a timer at the expiry of the newest image removes it and reports the key gone."""

    OUT = "key binary, generation long, value binary, event string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "generation long, value binary, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.held.get() if self.held.exists() else None
        out = None
        for pdf in rows:
            r = pdf.loc[pdf["generation"].idxmax()] if len(pdf) else None  # the newest of a batch decides
            if r is not None and (best is None or r.generation > best[0]):
                until = int(r.until_ms) if r.until_ms == r.until_ms and r.until_ms else 0
                best = (int(r.generation), None if r.kind == "DELETE" else r.value, until)
                out = (key[0], best[0], best[1], "deleted" if r.kind == "DELETE" else "set")
        if out:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.held.update(best)
            if best[2] and best[1] is not None:
                self.handle.registerTimer(best[2])
            yield pd.DataFrame([out], columns=["key", "generation", "value", "event"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        best = self.held.get() if self.held.exists() else None
        if best is not None and best[1] is not None:
            self.held.update((best[0], None, 0))
            yield pd.DataFrame([(key[0], best[0], None, "expired")], columns=["key", "generation", "value", "event"])

    def close(self) -> None:
        pass


def with_expiry(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(key, generation, value, event) from rows (key, generation, kind, value, ts TIMESTAMP, ttl_secs): set, deleted, expired.

    Needs the RocksDB state store. `ts` carries the watermark; `delay` is how late a row may be.
    """
    until = F.when(F.col("ttl_secs") > 0, F.unix_millis("ts") + F.col("ttl_secs") * 1000)
    rows = stream.withWatermark("ts", delay).withColumn("until_ms", until)
    return rows.groupBy("key").transformWithStateInPandas(ExpiringState(), ExpiringState.OUT, "Append", "EventTime")


def window_counts(stream: DataFrame, ts: str, by: list[str], width: str, delay: str) -> DataFrame:
    """Rows by tumbling window of event time; a window is closed `delay` after its end."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def route_stream(stream: DataFrame, channels: list[str], patterns: list[str]) -> DataFrame:
    """Messages (channel, payload) that one subscriber with these channels and patterns gets."""
    test = F.col("channel").isin(channels) if channels else F.lit(False)
    for p in patterns:
        test = test | glob_match(F.col("channel"), p)
    return stream.where(test)
