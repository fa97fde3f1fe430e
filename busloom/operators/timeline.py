"""Ordered operators over long timelines, split into slices so that no key needs one task.

A window over a key alone puts all of the key's rows into one task. Here a key's timeline is cut
into slices (say, days); windows run within (key, slice), one summary row per slice carries the
state over slice borders, and rows get their slice's carry by an equi-join on (key, slice).
Rows move once, by (key, slice); only the summaries meet by key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the left side's keys stay."""
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & left[c].eqNullSafe(right[f"_r_{c}"])
    return left.join(right, same, how).drop(*[f"_r_{c}" for c in on])


@dataclass(frozen=True)
class Timeline:
    """``keys`` split the rows, ``order`` (without ties within a key) sorts them, and ``slice``
    is an SQL expression that never falls along that order."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    slice: str

    def _sliced(self, df: DataFrame, value: Column) -> DataFrame:
        """``_cell``, the row's keys and slice, is never null and equal to those with the same nulls, so windows and the join below share one
        shuffle and one sort."""
        return df.withColumn("_cell", F.struct(*self.keys, F.expr(self.slice).alias("_slice"))).withColumn("_v", value)

    def _within(self):
        return W.partitionBy("_cell").orderBy(*self.order)

    def _slices(self):
        return W.partitionBy(*self.keys).orderBy("_slice")

    def _carried(self, rows: DataFrame, summary: Column, carry) -> DataFrame:
        ends = rows.groupBy("_cell").agg(summary.alias("_end")).select("_cell", "_cell.*", "_end")
        ends = ends.select(F.col("_cell").alias("_of"), carry("_end").alias("_carry"))
        return rows.join(ends, F.col("_cell") == F.col("_of")).drop("_of")

    def previous(self, df: DataFrame, values: dict[str, Column]) -> DataFrame:
        """Adds each named value of the key's row before (null for the first one)."""
        packed = F.struct(F.lit(1).alias("_there"), *[c.alias(n) for n, c in values.items()])
        rows = self._sliced(df, packed)
        rows = rows.withColumn("_p", F.lag("_v").over(self._within()))
        rows = self._carried(rows, F.max_by("_v", F.struct(*self.order)), lambda c: F.lag(c).over(self._slices()))
        found = F.coalesce("_p", "_carry")
        return rows.withColumns({n: found[n] for n in values}).drop("_cell", "_v", "_p", "_carry")

    def running_sum(self, df: DataFrame, value: Column, name: str) -> DataFrame:
        """Adds the sum of ``value`` (null: 0) up to and including the row."""
        rows = self._sliced(df, F.coalesce(value.cast("long"), F.lit(0)))
        rows = rows.withColumn("_s", F.sum("_v").over(self._within().rowsBetween(W.unboundedPreceding, 0)))
        before = self._slices().rowsBetween(W.unboundedPreceding, -1)
        rows = self._carried(rows, F.sum("_v"), lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)))
        return rows.withColumn(name, F.col("_s") + F.col("_carry")).drop("_cell", "_v", "_s", "_carry")

    def last_known(self, df: DataFrame, value: Column, name: str) -> DataFrame:
        """Adds the newest non-null ``value`` up to and including the row (an as-of join)."""
        rows = self._sliced(df, value)
        rows = rows.withColumn("_l", F.last("_v", ignorenulls=True).over(self._within().rowsBetween(W.unboundedPreceding, 0)))
        before = self._slices().rowsBetween(W.unboundedPreceding, -1)
        newest = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*self.order)))
        rows = self._carried(rows, newest, lambda c: F.last(c, ignorenulls=True).over(before))
        return rows.withColumn(name, F.coalesce("_l", "_carry")).drop("_cell", "_v", "_l", "_carry")

    def running_max(self, df: DataFrame, value: Column, name: str, inclusive: bool = True) -> DataFrame:
        """Adds the largest ``value`` up to the row, itself included or not."""
        rows = self._sliced(df, value)
        rows = rows.withColumn("_m", F.max("_v").over(self._within().rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)))
        before = self._slices().rowsBetween(W.unboundedPreceding, -1)
        rows = self._carried(rows, F.max("_v"), lambda c: F.max(c).over(before))
        return rows.withColumn(name, F.greatest("_m", "_carry")).drop("_cell", "_v", "_m", "_carry")

    def onsets(self, df: DataFrame, bad: Column) -> DataFrame:
        """The rows at which ``bad`` becomes true: an alarm latched until the condition clears."""
        rows = self.previous(df.withColumn("_bad", F.coalesce(bad, F.lit(False))), {"_was": F.col("_bad")})
        return rows.filter(F.col("_bad") & ~F.coalesce("_was", F.lit(False))).drop("_bad", "_was")

    def run_position(self, df: DataFrame, inside: Column, name: str) -> DataFrame:
        """Adds the row's 1-based position in its run of consecutive ``inside`` rows (else 0)."""
        rows = self.running_sum(df.withColumn("_in", F.coalesce(inside, F.lit(False))), F.col("_in").cast("long"), "_so_far")
        rows = self.last_known(rows, F.when(~F.col("_in"), F.col("_so_far")), "_base")
        return rows.withColumn(name, F.when(F.col("_in"), F.col("_so_far") - F.coalesce("_base", F.lit(0))).otherwise(0)).drop("_in", "_so_far", "_base")
