"""Tables in the folder that the cluster shares, and streams run to their end over them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="busloom-")
    return f"{root}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: what several plans use is worked out once, and lineage ends."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_once(spark: SparkSession, rows: DataFrame, schema: StructType, query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Writes ``rows`` as the stream's input, runs ``query`` on the stream until nothing is left,
    and returns what it appended. State and results lie in the shared folder."""
    root = shared_folder(spark)
    rows.write.parquet(f"{root}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    stream = spark.readStream.schema(schema).parquet(f"{root}/in")
    result = query(stream)
    running = result.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out")
    running.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{root}/out")
