"""Shared helpers: scratch tables in the cluster's shared folder, row numbering, text blocks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Words are maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is missing, a local session gets a temporary folder; a cluster must
    name one, as a machine-local folder would lose rows with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="busloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends there,
    and a lost executor costs at most the tasks that read it."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def dealt_rows(df: DataFrame, text: str, block_bytes: int, name: str = "_block", by: list[str] | None = None) -> tuple[DataFrame, int]:
    """``df`` with an int block number, so that a block holds about ``block_bytes`` of text, and the
    bytes of text (16 more a row) in all.

    The block follows from a row's own columns alone, so a recomputed task deals every row to the
    same block; rows that share an id, or have none, are dealt by their other columns. Only rows that
    agree in every column (or in those of ``by``) always meet. One aggregate over the text lengths sets the number of blocks.
    """
    total = df.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    size = (total[0] or 0) + 16 * total[1]
    return df.withColumn(name, F.pmod(F.xxhash64(*(by or df.columns)), F.lit(size // block_bytes + 1)).cast("int")), size


def numbered(thin: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Adds the 0-based position of every row in the order of the given columns (nulls last).

    No single task sees all rows: rows are range-partitioned and written once, numbered within
    their partition, and shifted by the sizes of the partitions before it (one row each).
    Rows that tie in all order columns get adjacent numbers.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    parts = materialize(thin.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = parts.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy(*keys)))
    return (
        local.join(F.broadcast(offsets), "_part")  # one row per range partition
        .withColumn(name, (F.col("_before") + F.col("_at") - 1).cast("long"))
        .drop("_part", "_before", "_at")
    )
