"""Text logs of bus frames and diagnostics, and the exports made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = r"^\s*([0-9]+)\s+([0-9A-Fa-f]{1,8})\s+((?:[0-9A-Fa-f]{2}){1,8}|0)\s+([0-9]+)\s*$"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and the file's date from its name (14 or 12 digits, else null)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    long, short = F.regexp_extract("file", r"(\d{14})", 1), F.regexp_extract("file", r"(?<!\d)(\d{12})(?!\d)", 1)
    stamp = F.when(long != "", F.try_to_timestamp(long, F.lit("yyyyMMddHHmmss"))).when(short != "", F.try_to_timestamp(short, F.lit("yyyyMMddHHmm")))
    return lines.withColumn("file_time", stamp)


def frames(lines: DataFrame, reverse: bool = True) -> DataFrame:
    """Frame rows: time_us, can_id, dlc, data, bus. Data bytes are written last first unless
    ``reverse`` is off; other lines give no row."""
    part = lambda k: F.regexp_extract("line", FRAME, k)
    rows = lines.filter(F.col("line").rlike(FRAME)).withColumn("_hex", F.when(part(3) != "0", part(3)).otherwise(""))
    pairs = F.regexp_extract_all("_hex", F.lit("(..)"), F.lit(1))
    wire = F.array_join(F.reverse(pairs) if reverse else pairs, "")
    rows = rows.withColumns({"time_us": part(1).cast("long"), "can_id": F.conv(part(2), 16, 10).cast("int"), "dlc": (F.length("_hex") / 2).cast("int"), "data": F.unhex(wire), "bus": part(4).cast("int")})
    return rows.filter("can_id between 0 and 2047 and bus >= 1").drop("_hex", "line")


def diagnostics(lines: DataFrame) -> DataFrame:
    """``#TYPE key=value ...`` rows with a numeric t: kind, time_us and the fields as a map in
    which the last of repeated keys counts."""
    words = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    rows = lines.filter(F.col("line").startswith("#")).withColumn("_w", words).filter(F.length(F.col("_w")[0]) > 1)
    pairs = F.filter(F.slice("_w", 2, F.size("_w")), lambda t: t.rlike("^[^=]+="))
    entries = F.transform(pairs, lambda t: F.struct(F.substring_index(t, "=", 1).alias("key"), F.regexp_replace(t, "^[^=]+=", "").alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    rows = rows.withColumns({"kind": F.expr("substring(_w[0], 2)"), "fields": F.map_from_entries(last)})
    return rows.withColumn("time_us", F.expr("try_cast(fields['t'] as bigint)")).filter("time_us is not null").drop("_w")


def to_log_line(frames_: DataFrame) -> DataFrame:
    """Frames as version-2 log lines (time modulo a day, data in the order given)."""
    data = F.when(F.length("data") > 0, F.hex("data")).otherwise("0")
    return frames_.select(F.format_string("%011d %04X %s %d", F.pmod("time_us", F.lit(86_400_000_000)), "can_id", data, "bus").alias("value"))


def asc_lines(frames_: DataFrame, start: str) -> DataFrame:
    """Lines of a Vector ASC export, numbered by ``line_no`` so that a sorted write keeps them:
    header 0 to 3, frames by time from 4 on, footer last. ``start`` is the measurement's date text."""
    head = frames_.sparkSession.createDataFrame([(0, f"date {start}"), (1, "base hex timestamps absolute"), (2, "internal events logged"), (3, f"Begin Triggerblock {start}")], "line_no long, value string")
    pairs = F.array_join(F.regexp_extract_all(F.hex("data"), F.lit("(..)"), F.lit(1)), " ")
    line = F.format_string("%11.6f %d  %-15s Rx   d %d %s", F.col("time_us") / 1e6, "bus", F.format_string("%X", "can_id"), "dlc", pairs)
    body = frames_.select((F.col("time_us") * 4 + 4).alias("line_no"), F.rtrim(line).alias("value"))
    foot = frames_.sparkSession.createDataFrame([(2**62, "End TriggerBlock")], "line_no long, value string")
    return head.unionByName(body).unionByName(foot)


def write_sorted_signals(values: DataFrame, path: str, files: int = 1) -> None:
    """One folder per signal and bus with its lines in time order. ``files`` > 1 splits each
    signal's timeline into that many ranges, so a frequent signal isn't one task's work."""
    line = F.concat_ws(" ", F.col("time_us").cast("string"), F.format_string("%.10g", "value"))
    rows = values.select("signal", "bus", "time_us", line.alias("value"))
    if files > 1:
        rows = rows.repartitionByRange(files, "signal", "bus", "time_us")
    else:
        rows = rows.repartition("signal", "bus")
    rows.sortWithinPartitions("signal", "bus", "time_us").drop("time_us").write.partitionBy("signal", "bus").text(path)
