"""Anomaly rules as DataFrame programs: latched onsets and windowed violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeline import Timeline, join_null_safe


def period_bad(dt: Column, period: Column, tolerance: float) -> Column:
    return F.abs(dt - period) > period * tolerance


def sigma_bad(dt: Column, period: Column, std: Column, k: float) -> Column:
    return (std > 0) & (F.abs(dt - period) > std * k)


def bursts(rows: DataFrame, line: Timeline, short: Column, frames: int) -> DataFrame:
    """The frame at which ``frames`` have come in short succession (frames - 1 short intervals)."""
    return line.run_position(rows, short, "_run").filter(F.col("_run") == frames - 1).drop("_run")


def window_grid(frames: DataFrame, ids: DataFrame, start: int, end: int, width: int, key: str = "can_id", ts: str = "ts_us") -> DataFrame:
    """Counts in the closed windows of [start, end) for every id of ``ids``, zeros included.

    Frames are added up per (id, window) before anything else; the grid has one row per id and
    window, made from each id's row, without a cross join.
    """
    windows = (end - start) // width
    inside = frames.filter((F.col(ts) >= start) & (F.col(ts) < start + windows * width))
    counts = inside.groupBy(key, F.floor((F.col(ts) - start) / width).alias("window")).agg(F.count("*").alias("n"))
    grid = ids.withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(windows - 1).cast("long"))))
    return join_null_safe(grid, counts, [key, "window"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def outages(records: DataFrame, frames: Column, limit: Column, line: Timeline, clock: DataFrame, ts: str = "ts_us") -> DataFrame:
    """Frames after which their id stayed away for more than ``limit``: one row per outage with
    the time until the id's next frame (null: none came), reported only if any record was seen
    after the deadline. ``clock`` has one row, ``last_us``, the newest time of any record."""
    reverse = Timeline(line.keys, tuple(line.order), line.slice)
    ahead = reverse.previous(records.filter(frames), {"_last_us": F.col(ts), "_last_limit": limit})
    closed = ahead.filter(F.col("_last_us").isNotNull() & (F.col(ts) - F.col("_last_us") > F.col("_last_limit")))
    closed = closed.select(*line.keys, F.col("_last_us").alias("last_us"), F.col(ts).alias("next_us"))
    newest = records.filter(frames).groupBy(*line.keys).agg(F.max(ts).alias("last_us"), F.max_by(limit, F.col(ts)).alias("_limit"))
    end = newest.crossJoin(F.broadcast(clock.withColumnRenamed("last_us", "_now")))  # one row
    still = end.filter(F.col("_now") - F.col("last_us") > F.col("_limit")).select(*line.keys, "last_us", F.lit(None).cast("long").alias("next_us"))
    return closed.unionByName(still)


def unknown_runs(frames: DataFrame, known: DataFrame, line: Timeline, key: str = "can_id") -> DataFrame:
    """First frame of each run of one unknown id within the timeline's keys."""
    flagged = frames.join(known.select(F.col(key).alias("_known")).distinct(), F.col(key) == F.col("_known"), "left")
    flagged = flagged.withColumn("_unknown", F.col("_known").isNull()).drop("_known")
    rows = line.previous(flagged, {"_was": F.col("_unknown"), "_id": F.col(key)})
    fresh = ~F.coalesce(F.col("_was") & (F.col("_id") == F.col(key)), F.lit(False))
    return rows.filter(F.col("_unknown") & fresh).drop("_unknown", "_was", "_id")


def union_events(parts: list[tuple[str, DataFrame]], columns: list[str]) -> DataFrame:
    """Rule outputs one after another, with the rule's stage number and name; missing columns null."""
    out = None
    for stage, (name, df) in enumerate(parts):
        part = df.select(*[c for c in columns if c in df.columns]).withColumn("stage", F.lit(stage)).withColumn("type", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
