"""Joins of points with intervals by equi-joins on time buckets, and unions of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeline import Timeline


def in_ranges(points: DataFrame, at: str, intervals: DataFrame, low: Column, high: Column, bucket: int, on: Column | None = None, how: str = "inner") -> DataFrame:
    """Points with the intervals [low, high] (both ends included) that hold them.

    An interval is listed under each bucket of ``bucket`` units that it touches, so choose one near
    the usual interval length; a point looks into its own bucket only. ``on`` adds conditions.
    ``how`` may be inner, left, left_semi or left_anti. Column names must not clash.
    """
    ranged = intervals.withColumn("_low", low).withColumn("_high", high)
    ranged = ranged.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_low") / bucket), F.floor(F.col("_high") / bucket))))
    looked = points.withColumn("_at", F.floor(F.col(at) / bucket))
    hit = (looked["_at"] == ranged["_bucket"]) & F.col(at).between(F.col("_low"), F.col("_high"))
    out = looked.join(ranged, hit if on is None else hit & on, how)
    return out.drop("_at", "_bucket", "_low", "_high")


def count_in_ranges(points: DataFrame, at: str, intervals: DataFrame, low: Column, high: Column, keys: list[str], ident: list[str], width: int) -> DataFrame:
    """How many points of its ``keys`` (nulls equal each other) each interval [low, high] holds: ``ident`` and ``n``. Intervals
    without an end, or with none before the other, may have no row.

    An interval is two marks on the points' timeline, and its count the difference of the running sums at both, so the work grows with
    points and intervals, not with their pairs. ``width`` cuts the timeline into slices.
    """
    seen = points.filter(F.col(at).isNotNull()).groupBy(*keys, F.col(at).alias("_t")).agg(F.count("*").alias("_n"))
    mark = lambda c, sign: F.struct(c.alias("_t"), F.lit(sign).alias("_mark"))
    marks = intervals.filter(low <= high).select(*{c: None for c in [*keys, *ident]}, F.inline(F.array(mark(low, -1), mark(high, 1))))
    rows = marks.unionByName(seen.withColumn("_mark", F.lit(0)), allowMissingColumns=True)  # at one time: starts, points, ends
    rows = Timeline(tuple(keys), ("_t", "_mark"), f"floor(_t / {width})").running_sum(rows, F.col("_n"), "_so_far")
    return rows.filter("_mark <> 0").groupBy(*ident).agg(F.sum(F.col("_mark") * F.col("_so_far")).alias("n"))


def islands(intervals: DataFrame, keys: tuple[str, ...], start: str, end: str, order: tuple[str, ...], slice_: str) -> DataFrame:
    """Unions of overlapping or touching intervals: one row per key and island with its ends.

    Intervals that agree in ``order`` are put together first: two windows could sort them differently, and a new island's first row fall to
    the island before.
    """
    line = Timeline(keys, order, slice_)
    named = dict.fromkeys([*keys, *order])
    rows = intervals.groupBy(*named).agg(F.min(start).alias("_start"), F.max(end).alias("_stop"), F.count("*").alias("_times"))
    rows = rows.select(*[c for c in named if c not in (start, end)], F.col("_start").alias(start), F.col("_stop").alias(end), "_times")
    rows = line.running_max(rows, F.col(end), "_reach", inclusive=False)
    rows = line.running_sum(rows, (F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))).cast("long"), "_island")
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("_times").alias("n_intervals")).drop("_island")
