"""Polled feeds as streams: first-seen rows, content versions, append-only recording."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def first_seen_batch(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row id of each key; what ``first_seen`` leaves after any number of polls in this order."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


class FirstSeen(StatefulProcessor):
    """Emits a key's first row once, for ever."""

    def __init__(self, order: str):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "hit boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in rows:
            head = pdf.nsmallest(1, self.order)
            best = head if best is None or head[self.order].iloc[0] < best[self.order].iloc[0] else best
        if best is not None and not self.seen.exists():
            self.seen.update((True,))
            yield best

    def close(self) -> None:
        pass


def _micros(clock: dt.datetime | None) -> int:
    if clock is None:
        return -(1 << 63)
    return ((clock if clock.tzinfo else clock.replace(tzinfo=dt.timezone.utc)) - EPOCH) // dt.timedelta(microseconds=1)


class Versions(StatefulProcessor):
    """Classifies rows of a key as NEW, UPDATED or DUPLICATE by their content; the first observed clock stays.

    A key whose last row is more than ``keep_us`` before is NEW again. A timer on the event clock drops the state of such keys, so what is kept follows the keys of the
    last ``keep_us`` and the watermark's delay, not all keys ever seen. It takes rows, not data frames: a poll brings a key few of them, and frames cost milliseconds a key.
    """

    def __init__(self, clock: str, order: list[str], content: str, keep_us: int):
        self.clock, self.order, self.content, self.keep_us = clock, order, content, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "content string, first_us long, last_us long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = lambda value: (value is None, value)  # noqa: E731 (nulls sort last)
        found = sorted(rows, key=lambda r: [last(r[c]) for c in (self.clock, *self.order)])
        shape = Row(*found[0].__fields__, "change", "first_observed_us")
        before = held = self.last.get()
        out = []
        for row in found:
            content, at = row[self.content], _micros(row[self.clock])
            content = None if content is None else str(content)
            if held is not None and at - held[2] > self.keep_us:
                held = None
            kind = "NEW" if held is None else "DUPLICATE" if held[0] == content else "UPDATED"
            held = (content, at if held is None else held[1], at if held is None else max(at, held[2]))
            out.append(shape(*row, kind, held[1]))
        due = None if before is None else self._due(before[2])
        self.last.update(held)
        if due != self._due(held[2]):
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(self._due(held[2]))
        return iter(out)

    def _due(self, last_us: int) -> int:
        """The millisecond after which no row can belong to the key's last one."""
        return (last_us + self.keep_us) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, key: str, order: str) -> DataFrame:
    """Stream of the first row of each key (state store: RocksDB)."""
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=FirstSeen(order), outputStructType=stream.schema, outputMode="Append", timeMode="None"
    )


def content_versions(stream: DataFrame, key: str, clock: str, order: list[str], content: str, keep: str = "30 days", delay: str = "1 hour") -> DataFrame:
    """Stream of all rows with ``change`` (NEW, UPDATED, DUPLICATE) and ``first_observed_us`` of the key's run of rows without a gap above ``keep``.

    ``clock`` is a timestamp; rows later than ``delay`` behind the newest are dropped by the watermark, and rows of a key must reach the stream in the order of their clock beyond that.
    """
    schema = stream.schema.add("change", "string").add("first_observed_us", "long")
    keep_us = int(pd.Timedelta(keep).total_seconds() * 1_000_000)
    return stream.withWatermark(clock, delay).groupBy(key).transformWithState(
        statefulProcessor=Versions(clock, order, content, keep_us), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def content_versions_batch(rows: DataFrame, key: str, clock: str, order: list[str], content: str, keep: str = "30 days") -> DataFrame:
    """What ``content_versions`` leaves after all rows, as one plan."""
    keep_us = int(pd.Timedelta(keep).total_seconds() * 1_000_000)
    by_key = Window.partitionBy(key).orderBy(clock, *order)
    at = F.unix_micros(F.col(clock).cast("timestamp"))
    out = rows.withColumn("_before", F.lag(at).over(by_key)).withColumn("_content", F.lag(content).over(by_key))
    new = F.col("_before").isNull() | (at - F.col("_before") > keep_us)
    out = out.withColumn("change", F.when(new, "NEW").when(F.col("_content").eqNullSafe(F.col(content)), "DUPLICATE").otherwise("UPDATED"))
    return out.withColumn("first_observed_us", F.last(F.when(new, at), ignorenulls=True).over(by_key)).drop("_before", "_content")


def advance(build: Callable[[DataFrame], DataFrame], source: DataFrame, out: str, checkpoint: str) -> None:
    """Takes what ``source`` has now through ``build`` to Parquet files in ``out`` and stops; a later call goes on from the checkpoint, whichever session makes it."""
    spark = source.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = build(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def record(stream: DataFrame, append: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``append`` on every micro-batch that is available now; a batch id seen again must be idempotent there."""
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
