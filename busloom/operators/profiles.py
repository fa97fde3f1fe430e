"""Baseline profiles of identifiers, learnt from their frame intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timeline import join_null_safe


def latched_profile(rows: DataFrame, min_intervals: int, key: str = "can_id", dt: str = "dt_us") -> DataFrame:
    """Frames, positive intervals, mean period (where there are enough) and population deviation."""
    good = F.when(F.col(dt) > 0, F.col(dt))
    out = rows.groupBy(key).agg(F.count("*").alias("frame_count"), F.count(good).alias("interval_count"), F.avg(good).alias("_mean"), F.stddev_pop(good).alias("std_us"))
    period = F.when(F.col("interval_count") >= min_intervals, F.col("_mean"))
    return out.select(key, "frame_count", "interval_count", period.alias("period_us"), F.coalesce("std_us", F.lit(0.0)).alias("std_us"))


def window_counts(frames: DataFrame, width: int, key: str = "can_id", ts: str = "ts_us") -> DataFrame:
    """Frames per window of ``width``, windows anchored at the key's first frame; windows without
    a frame are there with 0. One row per key and window, so a key's rows are added up first."""
    first = frames.groupBy(key).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    window = F.floor((F.col(ts) - F.col("_first")) / width)
    counted = join_null_safe(frames.select(key, ts), first, [key]).groupBy(key, window.alias("window")).agg(F.count("*").alias("n"))
    grid = first.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_last") - F.col("_first")) / width))).alias("window"))
    return join_null_safe(grid, counted, [key, "window"], "left").select(key, "window", F.coalesce("n", F.lit(0)).alias("n"))


def full_profile(rows: DataFrame, width: int, key: str = "can_id", dt: str = "dt_us", ts: str = "ts_us") -> DataFrame:
    """Interval and window-count statistics with extremes, per key."""
    spans = rows.groupBy(key).agg(
        F.count("*").alias("frame_count"), F.count(dt).alias("interval_count"), F.avg(dt).alias("mean_us"), F.stddev_pop(dt).alias("std_us"), F.min(dt).alias("min_us"), F.max(dt).alias("max_us")
    )
    counts = window_counts(rows, width, key, ts).groupBy(key).agg(
        F.count("*").alias("windows"), F.avg("n").alias("mean_count"), F.stddev_pop("n").alias("std_count"), F.min("n").alias("min_count"), F.max("n").alias("max_count")
    )
    return spans.join(counts, key, "left")
