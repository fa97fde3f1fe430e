"""Profiles, ground truth, scenarios and event files as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STATS = "struct<frame_count:bigint,interval_count:bigint,period_us:double,std_us:double>"
LATCHED = f"format string, ready boolean, channel int, learning_start_us bigint, learning_end_us bigint, min_intervals int, messages map<string,{_STATS}>"
TRUTH = "session_id string, seed bigint, marker_can_id int, episodes array<struct<episode_id:string,type:string,start:double,end:double,can_id:int,parameters:map<string,string>,planned_frames:bigint,acknowledged_frames:bigint,skipped_frames:bigint>>"
EVENT = "type string, method string, ts64 bigint, absolute_time string, session_index bigint, channel int, can_id int, seq int, measured string, expected string, unit string, quality string"
SENT = "scheduled_s double, command_started_s double, adapter_ack_s double, lateness_s double, can_id int, dlc int, data string, kind string, episode_id string"


def latched_profiles(spark: SparkSession, path: str) -> DataFrame:
    """One row per identifier of ready profiles of the latched engine."""
    docs = spark.read.schema(LATCHED).option("multiLine", True).json(path).filter("format = 'can-live-baseline-v1' and ready")
    rows = docs.select("channel", "min_intervals", F.explode("messages").alias("id", "s"))
    return rows.select(F.col("id").cast("int").alias("can_id"), "channel", "min_intervals", "s.*")


def truth_episodes(spark: SparkSession, path: str) -> DataFrame:
    """One row per episode, numbered by its place; episodes that end before they start are errors."""
    docs = spark.read.schema(TRUTH).option("multiLine", True).json(path)
    rows = docs.select("session_id", "seed", "marker_can_id", F.posexplode("episodes").alias("episode", "e")).select("session_id", "seed", "marker_can_id", "episode", "e.*")
    return rows.withColumn("end", F.when(F.col("end") >= F.col("start"), F.col("end")).otherwise(F.raise_error("an episode ends before it starts").cast("double")))


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """Saved events; ``measured`` and ``expected`` keep their text, as their types vary."""
    return spark.read.schema(EVENT).json(path)


def sent_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SENT).json(path)


def write_events(events: DataFrame, path: str) -> None:
    """Events by device time, unknown times last, as JSON lines; range-partitioned, so the files
    in name order are sorted."""
    events.orderBy(F.col("ts64").asc_nulls_last(), "ord").write.mode("errorifexists").json(path)
