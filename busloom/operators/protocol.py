"""Protocol-layer rules over controller statistics and rejected frames, and rules latched per identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .enrich import counter_deltas, transitions
from .timeline import Timeline


def rearmed_onsets(frames: DataFrame, line: Timeline, bad: Column, gap_us: int, ts: str = "ts_us") -> DataFrame:
    """Onsets of ``bad``, latched until it clears or the key's frame before is more than ``gap_us``
    older. Frames without a time count as frames, but end no silence."""
    rows = line.previous(frames.withColumn("_bad", F.coalesce(bad, F.lit(False))), {"_was": F.col("_bad"), "_before": F.col(ts)})
    silent = F.coalesce(F.col(ts) - F.col("_before") > gap_us, F.lit(False))
    return rows.filter(F.col("_bad") & (~F.coalesce("_was", F.lit(False)) | silent)).drop("_bad", "_was", "_before")


def counter_increases(stats: DataFrame, line: Timeline, counters: list[str], keep: list[str]) -> DataFrame:
    """One row per statistics row and counter that grew (modulo 2**32) since the row before: the kept
    columns, ``counter`` and ``increment``. The first row of a key only sets the base."""
    rows = counter_deltas(stats, line, counters)
    grown = F.array(*[F.struct(F.lit(c).alias("counter"), F.col(f"{c}_delta").alias("increment")) for c in counters])
    return rows.select(*keep, F.inline(F.filter(grown, lambda x: x["increment"] > 0)))


def frame_losses(stats: DataFrame, line: Timeline, counters: list[str], ring: str, last_id: str, keep: list[str]) -> DataFrame:
    """One row per statistics row in which any loss counter grew: ``loss_increments`` (those that grew),
    ``frame_id`` and its source. Only drops from the ring buffer (``ring``) name an identifier."""
    rows = counter_deltas(stats, line, counters)
    grown = F.map_filter(F.create_map(*[x for c in counters for x in (F.lit(c), F.col(f"{c}_delta"))]), lambda _, v: v > 0)
    dropped = F.coalesce(F.col(f"{ring}_delta") > 0, F.lit(False))
    source = F.when(dropped, "ram_buffer_rejection").otherwise("untrusted")
    rows = rows.withColumn("loss_increments", grown).filter(F.size("loss_increments") > 0)
    return rows.select(*keep, "loss_increments", F.when(dropped, F.col(last_id)).alias("frame_id"), source.alias("frame_id_source"))


def state_changes(stats: DataFrame, line: Timeline, state: str, targets: tuple[str, ...] = ("warning", "passive", "bus_off")) -> DataFrame:
    """Statistics rows at which the controller enters one of ``targets``; ``before`` is the state left."""
    return transitions(stats, line, state).filter(F.col(state).isin(*targets))


def rejected(events: DataFrame, reason: str, reasons: dict[int, str], suppressed: str = "suppressed") -> DataFrame:
    """Events about frames that the controller rejected, with ``rejection_reason`` and how many they
    stand for. Their identifier isn't trusted: the frame may have come in only in part."""
    names = F.create_map(*[x for k, v in reasons.items() for x in (F.lit(k).cast("long"), F.lit(v))])
    rows = events.withColumn("rejection_reason", names[F.col(reason).cast("long")]).filter("rejection_reason is not null")
    return rows.withColumn("rejected_events", 1 + F.coalesce(F.col(suppressed), F.lit(0)))


def have_problems(records: DataFrame, keys: list[str], flags: Column, counters: list[str], peak: str, capacity: str, share: float = 0.8) -> DataFrame:
    """Per key whether any diagnostic row reports a problem: a flag, a counter above 0, or a ring
    buffer filled to ``share`` of its capacity. One partial aggregate."""
    counted = F.lit(False)
    for c in counters:
        counted = counted | (F.coalesce(F.col(c), F.lit(0)) > 0)
    full = F.coalesce((F.col(capacity) > 0) & (F.col(peak) >= F.col(capacity) * share), F.lit(False))
    return records.groupBy(*keys).agg(F.bool_or(F.coalesce(flags, F.lit(False)) | counted | full).alias("problems"))
