"""Sessions, epochs, restored time, sequence gaps, counter deltas and intervals of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeline import Timeline

U16, U32 = 1 << 16, 1 << 32


def intervals(frames: DataFrame, line: Timeline, ts: str = "ts_us", name: str = "dt_us") -> DataFrame:
    """Time since the key's frame before, in the timeline's order."""
    return line.previous(frames, {"_before": F.col(ts)}).withColumn(name, F.col(ts) - F.col("_before")).drop("_before")


def session_index(records: DataFrame, line: Timeline, starts: Column) -> DataFrame:
    """Numbers sessions: the records that start one after the first record count."""
    return line.running_sum(records, starts.cast("long"), "session_index")


def reset_epochs(records: DataFrame, line: Timeline, resets: Column, restarts_learning: Column) -> DataFrame:
    """Two running counts: of resets of any kind, and of those that restart learning too."""
    rows = line.running_sum(records, resets.cast("long"), "epoch")
    return line.running_sum(rows, (resets & restarts_learning).cast("long"), "learning_epoch")


def restore_time(ts32: Column, sync: Column, reject_ambiguous: bool = False) -> Column:
    """The 64-bit time nearest to the newest sync whose low 32 bits are ``ts32``. A difference of
    exactly 2**31 is ambiguous: taken as earlier, or as unknown with ``reject_ambiguous``."""
    ahead = F.pmod(ts32 - F.pmod(sync, F.lit(U32)), F.lit(U32))
    signed = F.when(ahead >= U32 // 2, ahead - U32).otherwise(ahead)
    time = F.when(sync.isNotNull(), sync + signed)
    return F.when(ahead != U32 // 2, time) if reject_ambiguous else time


def absolute_us(ts: Column, device_us: Column, rtc_us: Column) -> Column:
    """Wall time of a record: the session's clock and the device time passed since; null where the
    session's clock isn't trusted (null) or the record has no time."""
    return rtc_us + (ts - device_us)


def sequence_gaps(records: DataFrame, line: Timeline, seq: str, largest: int = U16 - 1) -> DataFrame:
    """Adds ``missing``: records lost before this one, by 16-bit sequence numbers. A gap beyond
    ``largest`` is a step backwards and counts as none; sessions belong into the keys."""
    rows = line.previous(records, {"_seq": F.col(seq)})
    gap = F.pmod(F.col(seq) - F.col("_seq") - 1, F.lit(U16))
    return rows.withColumn("missing", F.when(F.col("_seq").isNull() | (gap > largest), F.lit(0)).otherwise(gap).cast("long")).drop("_seq")


def counter_deltas(stats: DataFrame, line: Timeline, counters: list[str]) -> DataFrame:
    """Adds ``<c>_delta`` and ``<c>_wrapped`` of 32-bit counters since the row before (null at first)."""
    rows = line.previous(stats, {f"_{c}": F.col(c) for c in counters})
    out = {f"{c}_delta": F.pmod(F.col(c) - F.col(f"_{c}"), F.lit(U32)) for c in counters}
    out |= {f"{c}_wrapped": F.col(c) < F.col(f"_{c}") for c in counters}
    return rows.withColumns(out).drop(*[f"_{c}" for c in counters])


def transitions(rows: DataFrame, line: Timeline, state: str) -> DataFrame:
    """Rows whose state differs from the one before; ``before`` is that state."""
    return line.previous(rows, {"before": F.col(state)}).filter(F.col(state) != F.col("before"))


def midnight_rollover(rows: DataFrame, line: Timeline, ts: str, day: int, name: str = "unrolled") -> DataFrame:
    """Adds a day's length whenever time of day falls by more than half a day: a monotone time."""
    stepped = line.previous(rows, {"_before": F.col(ts)})
    stepped = line.running_sum(stepped, (F.col("_before") - F.col(ts) > day // 2).cast("long"), "_days")
    return stepped.withColumn(name, F.col(ts) + F.col("_days") * day).drop("_before", "_days")
