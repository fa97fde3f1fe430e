"""Sharding by a Feistel permutation of global row numbers with cycle walking."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered

#: splitmix64's finaliser (public constants).
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def permute(row: np.ndarray, n: int, seed: int, rounds: int = 6) -> np.ndarray:
    """A bijection of 0..n-1: a balanced Feistel network over the next even number of bits; a
    value that falls outside walks along its cycle until it is inside (under 4 steps expected)."""
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    mask, shift = np.uint64(2**half - 1), np.uint64(half)
    keys = _mix(np.arange(rounds, dtype=np.uint64) + np.uint64(seed) * np.uint64(rounds))
    x = np.asarray(row, dtype=np.uint64).copy()
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = x[todo] >> shift, x[todo] & mask
            for k in keys:
                left, right = right, left ^ (_mix(right ^ k) & mask)
            x[todo] = (left << shift) | right
            todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def feistel_shards(docs: DataFrame, shards: int, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``text_crc32``, ``shard`` and ``slot``.

    Rows are numbered 0..n-1 by (id, crc, size), nulls last; the permuted number p gives shard
    p mod ``shards`` and slot p div ``shards``. So shard counts differ by one at most, slots have
    no gaps, and any row's place can be computed from its number, n and the seed alone. Texts
    never move: only (id, crc, size) is numbered. A null text counts as empty. Rows that agree in
    all three are interchangeable and get different slots. No row order or partitioning matters.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    thin = docs.select(F.col(id_col), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = numbered(thin, [id_col, "text_crc32", "size"])
    n = docs.count()

    @F.pandas_udf(T.LongType())
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    placed = rows.withColumn("_p", place("row_no"))
    return placed.select(
        id_col, "size", "text_crc32", (F.col("_p") % shards).cast("int").alias("shard"), F.floor(F.col("_p") / shards).cast("long").alias("slot")
    )


def op10_sharding(docs: DataFrame) -> DataFrame:
    """All documents into 40 shards under law ``rows``; equal texts are spread like any rows."""
    out = feistel_shards(docs, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
