"""Stateful rules on streams: latched onsets and overdue identifiers, keyed per identifier."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


class PeriodLatch(StatefulProcessor):
    """Keeps an identifier's newest frame time and whether its period condition holds."""

    def __init__(self, tolerance: float):
        self.tolerance = tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latch", "ts_us long, bad boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before, bad = self.state.get() if self.state.exists() else (None, False)
        out = []
        for frame in pd.concat(list(rows)).sort_values("ord").itertuples():
            if before is not None and frame.tested and frame.period_us == frame.period_us:
                dt = frame.ts_us - before
                now = abs(dt - frame.period_us) > frame.period_us * self.tolerance
                if now and not bad:
                    out.append((frame.ord, key[0], frame.ts_us, dt))
                bad = now
            before = frame.ts_us
        self.state.update((before, bool(bad)))
        yield pd.DataFrame(out, columns=["ord", "can_id", "ts_us", "dt_us"])

    def close(self) -> None:
        pass


def period_onsets(frames: DataFrame, profile: DataFrame, tolerance: float, tested: Column) -> DataFrame:
    """Onsets of period violations as frames arrive (columns ord, can_id, ts_us).

    ``profile`` (can_id, period_us) is a static table joined to the stream; state is one row per
    identifier. Within a micro-batch frames are taken by ``ord``; micro-batches in their order,
    so any cut of an ordered stream gives the same rows as the batch operator.
    """
    rows = frames.join(profile.select("can_id", "period_us"), "can_id", "left").select("ord", "can_id", "ts_us", "period_us", tested.alias("tested"))
    return rows.groupBy("can_id").transformWithStateInPandas(PeriodLatch(tolerance), "ord long, can_id long, ts_us long, dt_us long", "Append", "None")


class Overdue(StatefulProcessor):
    """Raises one row when an identifier stays away longer than its limit of event time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "ts_us long, limit_us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values("ts_us")
        last = self.state.get() if self.state.exists() else None
        out = []
        for frame in frames.itertuples():
            if last is not None and frame.ts_us - last[0] > last[1]:
                out.append((key[0], last[0], frame.ts_us))  # it came back before a timer saw it
            if last is None or frame.ts_us > last[0]:
                last = (int(frame.ts_us), int(frame.limit_us))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update(last)
        self.handle.registerTimer((last[0] + last[1]) // 1000 + 1)
        yield pd.DataFrame(out, columns=["can_id", "last_us", "next_us"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last = self.state.get()
        self.state.clear()  # armed again by the next frame
        yield pd.DataFrame([(key[0], last[0], None)], columns=["can_id", "last_us", "next_us"])

    def close(self) -> None:
        pass


def overdue(frames: DataFrame, profile: DataFrame, multiplier: float, delay: str = "0 seconds") -> DataFrame:
    """Missing-identifier alarms by event time: ``ts`` must be a timestamp column beside ts_us."""
    rows = frames.withWatermark("ts", delay).join(profile.select("can_id", "period_us"), "can_id")
    rows = rows.withColumn("limit_us", (F.col("period_us") * multiplier).cast("long")).select("can_id", "ts_us", "ts", "limit_us")
    return rows.groupBy("can_id").transformWithStateInPandas(Overdue(), "can_id long, last_us long, next_us long", "Append", "EventTime")


def file_stream(spark, path: str, schema: StructType | str, per_batch: int = 1) -> DataFrame:
    """Parquet files as a stream, a few per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
