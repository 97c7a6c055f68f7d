"""Structured Streaming twins of the window, block, session, run and alarm operators."""

from __future__ import annotations

import statistics
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def tumbling_windows(stream: DataFrame, ts: str, keys: Sequence[str], width: str, late: str, value: str) -> DataFrame:
    """Event-time windows with count, mean, RMS and peak; late rows beyond the watermark are dropped."""
    x = F.col(value)
    return (stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys)
            .agg(F.count(F.lit(1)).alias("samples"), F.avg(x).alias("mean"), F.sqrt(F.avg(x * x)).alias("rms"), F.max(x).alias("peak"))
            .select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "samples", "mean", "rms", "peak"))


def sliding_windows(stream: DataFrame, ts: str, keys: Sequence[str], width: str, stride: str, late: str, value: str) -> DataFrame:
    """Overlapping event-time windows."""
    x = F.col(value)
    return (stream.withWatermark(ts, late).groupBy(F.window(ts, width, stride), *keys)
            .agg(F.count(F.lit(1)).alias("samples"), F.sqrt(F.avg(x * x)).alias("rms"))
            .select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "samples", "rms"))


def sessions(stream: DataFrame, ts: str, keys: Sequence[str], gap: str, late: str, value: str) -> DataFrame:
    """Sessions closed by a gap, with their first and largest value."""
    return (stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys)
            .agg(F.count(F.lit(1)).alias("samples"), F.min_by(value, ts).alias("first_value"), F.max(value).alias("peak"))
            .select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"),
                    "samples", "first_value", "peak"))


def with_alarm(stream: DataFrame, thresholds: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Stream-static join against a frozen threshold table; no keys means one threshold for all rows."""
    frozen = thresholds.select(*keys, "threshold")
    if keys:
        return stream.join(frozen, list(keys), "left").withColumn("alarm", F.col(score) > F.col("threshold"))
    limit = frozen.first()["threshold"]
    return stream.withColumn("threshold", F.lit(float(limit))).withColumn("alarm", F.col(score) > F.lit(float(limit)))


class SustainedRun(StatefulProcessor):
    """Per key: the current run of hot rows; the first run that is long enough is reported once."""

    def __init__(self, length: int, keep: int):
        self.length, self.keep = length, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "length long, start long, reported boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        length, start, reported = self.run.get() or (0, None, False)
        found, at = [], None
        for at, hot in sorted((r["at"], bool(r["hot"])) for r in rows):
            if not hot:
                length, start = 0, None
                continue
            length, start = length + 1, at if length == 0 else start
            if length == self.length and not reported:
                reported = True
                found.append(Row(key=key[0], start=start, confirmed=at))
        self.run.update((length, start, reported))
        keep_until(self.handle, at, self.keep)
        return iter(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.run.clear()
        return iter(())

    def close(self) -> None:
        pass


class Anchored(StatefulProcessor):
    """Per key: the first values; later rows are measured against their median."""

    def __init__(self, anchors: int, keep: int):
        self.anchors, self.keep = anchors, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("anchors", "values array<double>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.held.get()
        held = [] if state is None else list(state[0])
        ordered = sorted((r["at"], r["value"]) for r in rows if r["value"] is not None)
        take = max(0, self.anchors - len(held))
        held += [v for _, v in ordered[:take]]
        found = []
        if len(ordered) > take:
            center = statistics.median(held)
            found = [Row(key=key[0], at=at, residual=v - center) for at, v in ordered[take:]]
        self.held.update((held,))
        keep_until(self.handle, ordered[-1][0] if ordered else None, self.keep)
        return iter(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def keep_until(handle: StatefulProcessorHandle, at: int | None, keep: int) -> None:
    """One timer per key, ``keep`` microseconds of event time after its newest row; it clears the state."""
    if at is None:
        return
    due = (at + keep) // 1000 + 1
    timers = list(handle.listTimers())
    if timers and max(timers) >= due:
        return
    for timer in timers:
        handle.deleteTimer(timer)
    handle.registerTimer(due)


def _stateful(stream: DataFrame, key: str, ts: str, late: str, columns: list[Column], processor: StatefulProcessor, out: str) -> DataFrame:
    """Rows at or after the watermark, keyed, through one processor with event-time timers; later rows are dropped by Spark."""
    rows = stream.withWatermark(ts, late).select(F.col(key), F.col(ts), F.unix_micros(ts).alias("at"), *columns).filter(F.col(ts).isNotNull())
    return rows.groupBy(key).transformWithState(processor, out, "Append", "EventTime")


def _microseconds(interval: str) -> int:
    return int(pd.Timedelta(interval) / pd.Timedelta(microseconds=1))


def sustained_alarms(stream: DataFrame, key: str, ts: str, hot: Column, length: int, late: str, keep: str = "365 days") -> DataFrame:
    """First run of at least ``length`` hot rows per key, reported once.

    Rows of a micro-batch are taken in time order. Rows behind the watermark are dropped. A key that is
    silent for ``keep`` of event time after its newest row is forgotten, so a key that comes back may be
    reported again. The state store must be RocksDB, see ``replay.run_to_table``.
    """
    kind = dict(stream.dtypes)[key]
    found = _stateful(stream, key, ts, late, [hot.alias("hot")], SustainedRun(length, _microseconds(keep)),
                      f"key {kind}, start long, confirmed long")
    return found.select(F.col("key").alias(key), F.timestamp_micros("start").alias("start"), F.timestamp_micros("confirmed").alias("confirmed"))


def anchored_residuals(stream: DataFrame, key: str, ts: str, value: str, anchors: int = 2, late: str = "1 day", keep: str = "365 days") -> DataFrame:
    """Residual of each row against the median of the first rows of its key; the state holds only the anchor.

    Rows without a value take no part, late rows are dropped, and a key that is silent for ``keep`` gets new
    anchors when it comes back.
    """
    kind = dict(stream.dtypes)[key]
    found = _stateful(stream, key, ts, late, [F.col(value).cast("double").alias("value")], Anchored(anchors, _microseconds(keep)),
                      f"key {kind}, at long, residual double")
    return found.select(F.col("key").alias(key), F.timestamp_micros("at").alias("at"), "residual")


def dropped_by_watermark(query) -> int:
    """Rows the watermark has dropped so far, from the progress of a running query."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p.get("stateOperators", []))
