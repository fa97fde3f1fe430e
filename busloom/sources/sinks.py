"""Reports, CSV tables, annotated profiles, scenarios and file identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header and exactly these columns; columns that ``df`` lacks are empty. Nested values are
    written as JSON text."""
    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType)}
    cell = lambda c: F.to_json(c).alias(c) if c in nested else F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
    df.select(*[cell(c) for c in columns]).write.mode("errorifexists").option("header", True).csv(path)


def write_union_csv(tables: list[DataFrame], path: str) -> None:
    """Tables with different columns in one CSV, whose header is the union of theirs in order of appearance."""
    columns = list(dict.fromkeys(c for t in tables for c in t.columns))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    write_csv(out, path, columns)


def session_report(events: DataFrame, frames: DataFrame, counters: DataFrame) -> DataFrame:
    """One row, ``report``: counts of alarms by type, frames, identifiers, the time covered and the
    decoder's counters as JSON. Only aggregates (a row per rule and status) meet in one row."""
    kinds = events.groupBy("type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("alarms"))
    seen = frames.agg(F.count("*").alias("frames"), F.countDistinct("can_id").alias("identifiers"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    pieces = counters.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "records")))).alias("decoder"))
    row = seen.crossJoin(kinds).crossJoin(pieces)  # one row each
    return row.select(F.to_json(F.struct(*row.columns)).alias("report"))


def write_report(report: DataFrame, path: str) -> None:
    """Replaces the report as a whole: readers trust the folder only once it holds ``_SUCCESS``."""
    report.coalesce(1).write.mode("overwrite").text(path)  # one row


def write_profile(profile: DataFrame, path: str, key: str, notes: dict[str, tuple[str, str]]) -> None:
    """A profile that people can edit: JSON lines, each scalar with its unit and description."""
    lift = lambda c: F.struct(F.col(c).alias("value"), *[F.lit(x).alias(n) for n, x in zip(("unit", "description"), notes.get(c, ("", "")), strict=True)]).alias(c)
    profile.select(key, *[lift(c) for c in profile.columns if c != key]).write.mode("errorifexists").json(path)


def read_profile(spark: SparkSession, path: str, key: str, columns: dict[str, str]) -> DataFrame:
    """The plain profile from ``write_profile``'s files, edited or not (column: its type)."""
    schema = f"{key} bigint, " + ", ".join(f"{c} struct<value:{t}>" for c, t in columns.items())
    return spark.read.schema(schema).json(path).select(key, *[F.col(f"{c}.value").alias(c) for c in columns])


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Anomaly scenarios: one row per episode of each JSON file, numbered by its place."""
    item = "array<struct<type:string,start:double,end:double,can_id:int,parameters:map<string,string>>>"
    docs = spark.read.schema(f"episodes {item}").option("multiLine", True).json(path)
    return docs.select(F.col("_metadata.file_path").alias("scenario"), F.posexplode("episodes").alias("episode", "e")).select("scenario", "episode", "e.*")


def write_truth(episodes: DataFrame, path: str) -> None:
    """Ground truth, one JSON document per session: its episodes (tens of them) in order."""
    own = [c for c in episodes.columns if c not in ("session_id", "seed", "episode")]
    docs = episodes.groupBy("session_id", "seed").agg(F.array_sort(F.collect_list(F.struct("episode", *own))).alias("episodes"))
    docs.write.mode("errorifexists").json(path)


def file_identities(spark: SparkSession, path: str, text: bool = False) -> DataFrame:
    """SHA-256 of every file; with ``text`` line ends count as LF, so checkouts agree."""
    content = F.col("content")
    if text:
        content = F.encode(F.replace(F.decode(content, "ISO-8859-1"), F.lit("\r\n"), F.lit("\n")), "ISO-8859-1")
    return spark.read.format("binaryFile").load(path).select("path", F.sha2(content, 256).alias("sha256"))
