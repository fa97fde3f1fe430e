"""Tumbling feature windows and the rules over them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timeline import Timeline, join_null_safe


def windowed(rows: DataFrame, anchor: int, width: int, ts: str = "ts_us") -> DataFrame:
    return rows.withColumn("window", F.floor((F.col(ts) - anchor) / width))


def feature_windows(rows: DataFrame, keys: list[str], dt: str = "dt_us") -> DataFrame:
    """Frame count, interval count, mean, jitter (population deviation), extremes per window;
    one partial aggregate and one shuffle. A single interval has jitter 0, none has null."""
    return rows.groupBy(*keys, "window").agg(
        F.count("*").alias("frames"), F.count(dt).alias("intervals"), F.avg(dt).alias("mean_us"), F.stddev_pop(dt).alias("jitter_us"), F.min(dt).alias("min_us"), F.max(dt).alias("max_us")
    )


def outside(rows: DataFrame, profile: DataFrame, on: str, value: str, low: str, high: str) -> DataFrame:
    """Rows whose value lies outside the profile's observed extremes."""
    return rows.join(profile.select(on, low, high), on).filter((F.col(value) < F.col(low)) | (F.col(value) > F.col(high)))


def count_moments(counts: DataFrame, key: str = "can_id") -> DataFrame:
    """Windows, sum and sum of squares of the counts ``n`` per key, as longs: the same however the rows are dealt."""
    n = F.col("n").cast("long")
    return counts.groupBy(key).agg(F.count("*").alias("windows"), F.sum(n).alias("sum_n"), F.sum(n * n).alias("sum_nn"))


def count_deviations(counts: DataFrame, learnt: DataFrame, k: str, key: str = "can_id") -> DataFrame:
    """Windows whose frame count ``n`` lies outside mean +/- k population deviations of the learnt counts
    (``count_moments``), as state ``deviation``; and once per key without spread the state ``disabled``.

    ``k`` is a decimal as text. With N windows, sum S and squares Q, |n - S/N| > k * deviation is
    (N*n - S)**2 > k**2 * (N*Q - S**2): compared as exact decimals, so a count right at the bound is inside on every
    partitioning. That holds for up to 10**7 windows, sums up to 10**10 and squares that add up to a long; beyond,
    Spark's decimals raise (null without ANSI mode: no row).
    """
    windows, total = F.col("windows").cast("decimal(7,0)"), F.col("sum_n").cast("decimal(10,0)")
    spread = windows * F.col("sum_nn").cast("decimal(19,0)") - total * total
    rows = counts.join(learnt.withColumn("_spread", spread.cast("decimal(27,0)")), key)
    away = (windows * F.col("n").cast("decimal(10,0)") - total).cast("decimal(17,0)")
    squares = (F.lit(k).cast("decimal(4,2)") * F.lit(k).cast("decimal(4,2)")).cast("decimal(8,4)")
    off = (away * away).cast("decimal(38,4)") > squares * F.col("_spread")
    found = rows.filter((F.col("_spread") > 0) & off).select(key, "window", "n", F.lit("deviation").alias("state"))
    still = rows.filter("_spread = 0").select(key).distinct()
    none = F.lit(None).cast("long")
    return found.unionByName(still.select(key, none.alias("window"), none.alias("n"), F.lit("disabled").alias("state")))


def anchored_windows(frames: DataFrame, line: Timeline, session: str, width: int, ts: str = "ts_us") -> DataFrame:
    """Adds ``segment`` (1, 2, ... per key), ``anchor_us`` (its first frame's time) and ``window`` (from 0, from the anchor on).

    A segment begins with a key's first frame, where ``session`` changes (null is a session of its own), and with a frame before the
    window that is open, which is that of the newest time in its segment. Frames without a time are left out, and the last,
    partial window of a segment is there like any. ``line.slice`` has to follow the order, not the time.

    Whether a step back in time begins a segment depends on the anchor before it, so steps back are judged in
    order; but only they are (their time and the one before, which is the newest since the last step back): every other row gets its segment's
    anchor from the sliced timeline. A key's steps back stream through one task, two numbers at a time.
    """
    if width <= 0:
        raise ValueError("width must be positive")
    keys, order = list(line.keys), list(line.order)
    rows = line.previous(frames.filter(F.col(ts).isNotNull()), {"_any": F.lit(True), "_before": F.col(ts), "_session": F.col(session)})
    forced = F.col("_any").isNull() | ~F.col("_session").eqNullSafe(F.col(session))
    steps = rows.filter(forced | (F.col(ts) < F.col("_before"))).select(*keys, *order, F.col(ts).alias("_anchor"), F.coalesce("_before", F.lit(0)).alias("_before"), forced.alias("_forced"))

    def begins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchor = newest = 0
        for batch in batches:
            kept = []
            for at, before, first in zip(batch["_anchor"].tolist(), batch["_before"].tolist(), batch["_forced"].tolist(), strict=True):
                newest = max(newest, before)
                begin = first or at < anchor + (newest - anchor) // width * width
                if begin:
                    anchor = newest = at
                kept.append(begin)
            yield batch[kept]

    dealt = steps.repartition(*keys) if keys else steps.repartition(1)
    starts = dealt.sortWithinPartitions(*keys, *order).mapInPandas(begins, steps.schema).select(*keys, *order, "_anchor")
    marked = join_null_safe(rows.drop("_any", "_before", "_session"), starts, [*keys, *order], "left")
    marked = line.running_sum(marked, F.col("_anchor").isNotNull().cast("long"), "segment")
    marked = line.last_known(marked, F.col("_anchor"), "anchor_us").drop("_anchor")
    return marked.withColumn("window", F.floor((F.col(ts) - F.col("anchor_us")) / width))
