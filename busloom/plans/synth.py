"""Synthetic bus traffic as DataFrames: periodic schedules, anomaly episodes and markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def schedule(messages: DataFrame, end_us: int) -> DataFrame:
    """One row per planned frame: ``messages`` has can_id, period_us, phase_us, dlc. Slots are made
    in two steps, so a fast message's timeline never sits in one row's array."""
    step = 10_000
    slots = F.floor((F.lit(end_us) - F.col("phase_us") - 1) / F.col("period_us"))
    runs = messages.withColumn("_slots", slots).filter("_slots >= 0").withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_slots") / step))))
    rows = runs.withColumn("slot", F.explode(F.sequence(F.col("_run") * step, F.least(F.col("_slots"), F.col("_run") * step + step - 1))))
    return rows.select("can_id", "dlc", "period_us", "slot", (F.col("phase_us") + F.col("slot") * F.col("period_us")).alias("ts_us"), F.lit("normal").alias("kind"))


def apply_episodes(planned: DataFrame, episodes: DataFrame) -> DataFrame:
    """Traffic with anomalies. ``episodes`` (a small table: episode, type, can_id, start_us, end_us,
    factor) holds the kinds disappearance (frames go), delay (frames come factor periods later),
    dlc (one byte less), out_of_range (marked for the payload), burst and frequency (extra frames at
    period / factor) and unknown_id (frames of an id that nobody planned, every ``factor`` us)."""
    on = episodes.withColumnRenamed("can_id", "_id")
    hit = (F.col("can_id") == F.col("_id")) & (F.col("ts_us") >= F.col("start_us")) & (F.col("ts_us") < F.col("end_us"))
    changing = F.broadcast(on.filter(F.col("type").isin("disappearance", "delay", "dlc", "out_of_range")))
    rows = planned.join(changing, hit, "left").filter("type is null or type <> 'disappearance'")
    late = F.when(F.col("type") == "delay", (F.col("factor") * F.col("period_us")).cast("long")).otherwise(0)
    shorter = F.when((F.col("type") == "dlc") & (F.col("dlc") > 0), 1).otherwise(0)
    rows = rows.select("can_id", (F.col("dlc") - shorter).alias("dlc"), (F.col("ts_us") + late).alias("ts_us"), F.coalesce("type", "kind").alias("kind"), "episode")
    periods = planned.groupBy("can_id").agg(F.min("period_us").alias("period_us"), F.min("dlc").alias("dlc"))
    extra = episodes.filter(F.col("type").isin("burst", "frequency", "unknown_id")).join(periods, "can_id", "left")
    gap = F.greatest(F.lit(1), F.when(F.col("type") == "unknown_id", F.col("factor")).otherwise(F.col("period_us") / F.col("factor")).cast("long")).cast("long")
    extra = extra.withColumn("ts_us", F.explode(F.sequence(F.col("start_us"), F.col("end_us") - 1, gap)))
    return rows.unionByName(extra.select("can_id", F.coalesce("dlc", F.lit(8)).alias("dlc"), "ts_us", F.col("type").alias("kind"), "episode"))
