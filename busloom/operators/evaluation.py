"""Matching events with episodes, detection metrics and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from busloom.sources.streams import stored

from .ranges import in_ranges
from .timeline import Timeline, join_null_safe


def match_episodes(events: DataFrame, episodes: DataFrame, tolerance: int, bucket: int) -> DataFrame:
    """Each event with the episode that it belongs to, or null.

    ``events``: event_id, can_id, ts_us; ``episodes``: episode, start_us, end_us, episode_can_id
    (null: any id). Among the episodes whose range, widened by ``tolerance``, holds the event, the
    one with the nearest start counts, then the smaller number.

    Events and episodes meet on one timeline for each id and one for episodes of any id, cut into buckets of ``bucket`` units (an
    episode is in all that it touches). There an event looks at the newest start before it and the first after it, so work grows with the
    rows, not with their pairs. Only where the newest episode has ended and an earlier one lasts are all pairs looked at.
    """
    own = F.col("episode_can_id")
    spans = episodes.filter(F.col("start_us").isNotNull() & F.col("end_us").isNotNull())
    spans = spans.select(own.isNull().alias("_any"), own.alias("_id"), F.col("start_us").alias("_t"), (F.col("end_us") + tolerance).alias("_high"), "episode")
    # ``_sure``: up to then all episodes of that start last.
    starts = spans.groupBy("_any", "_id", "_t").agg(F.min("episode").alias("_episode"), F.min("_high").alias("_sure"), F.max("_high").alias("_high"))
    low = F.col("_t") - tolerance
    starts = starts.filter(low <= F.col("_high")).withColumn("_bucket", F.explode(F.sequence(F.floor(low / bucket), F.floor(F.col("_high") / bucket))))
    asks = events.filter(F.col("event_id").isNotNull() & F.col("ts_us").isNotNull())
    asks = asks.select("event_id", "can_id", F.col("ts_us").alias("_t"), F.floor(F.col("ts_us") / bucket).alias("_bucket"), F.explode(F.array(F.lit(True), F.lit(False))).alias("_any"))
    asks = asks.filter(F.col("_any") | F.col("can_id").isNotNull()).withColumn("_id", F.when(~F.col("_any"), F.col("can_id"))).drop("can_id")
    rows = starts.withColumn("_ask", F.lit(0)).unionByName(asks.withColumn("_ask", F.lit(1)), allowMissingColumns=True)
    key = W.partitionBy("_any", "_id", "_bucket")
    ahead, back = (w.rowsBetween(W.unboundedPreceding, 0) for w in (key.orderBy("_t", "_ask"), key.orderBy(F.desc("_t"), "_ask")))
    start = F.when(F.col("_ask") == 0, F.struct("_t", "_episode", "_sure"))
    rows = rows.withColumns({
        "_before": F.last(start, ignorenulls=True).over(ahead), "_reach": F.max("_high").over(ahead), "_after": F.last(start, ignorenulls=True).over(back),
    }).filter("_ask = 1")
    t = F.col("_t")
    holds = lambda c: (t >= c["_t"] - tolerance) & (t <= c["_sure"])
    choice = lambda c: F.when(holds(c), F.struct(F.abs(t - c["_t"]).alias("d"), c["_episode"].alias("episode")))
    before, after = F.col("_before"), F.col("_after")
    unsure = (before.isNotNull() & ~holds(before) & (F.col("_reach") >= t)) | (after.isNotNull() & (t >= after["_t"] - tolerance) & (t > after["_sure"]))
    found = rows.select("event_id", "_any", "_id", t.alias("_at_us"), F.least(choice(before), choice(after)).alias("_b"), F.coalesce(unsure, F.lit(False)).alias("_unsure"))
    found = stored(found.filter("_b is not null or _unsure"))
    same = F.col("_any").eqNullSafe(F.col("_e_any")) & F.col("_id").eqNullSafe(F.col("_e_id"))
    whole = spans.withColumnsRenamed({"_any": "_e_any", "_id": "_e_id", "_t": "_start"})
    rest = in_ranges(found.filter("_unsure").drop("_b"), "_at_us", whole, F.col("_start") - tolerance, F.col("_high").alias("_end"), bucket, same)
    rest = rest.select("event_id", F.struct(F.abs(F.col("_at_us") - F.col("_start")).alias("d"), "episode").alias("_b"))
    best = found.filter("not _unsure").select("event_id", "_b").unionByName(rest).groupBy("event_id").agg(F.min("_b").alias("_b"))
    return events.join(best.select("event_id", F.col("_b.episode").alias("episode")), "event_id", "left")


def first_hits(matched: DataFrame, episodes: DataFrame, by: list[str]) -> DataFrame:
    """Per episode and method: hits, first hit and latency."""
    hits = matched.filter(F.col("episode").isNotNull()).groupBy("episode", *by).agg(F.count("*").alias("hits"), F.min("ts_us").alias("first_us"))
    return hits.join(episodes.select("episode", "start_us"), "episode").withColumn("latency_us", F.col("first_us") - F.col("start_us"))


def medians(rows: DataFrame, keys: list[str], value: str, name: str, width: int) -> DataFrame:
    """Per key the median of the whole numbers ``value`` (nulls left out; of an even number the mean of the middle two), as ``percentile``
    gives it, but no task gets all values of a key: equal ones are counted, and the middle is found by running sums over
    slices of ``width``.
    """
    seen = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    line = Timeline(tuple(keys), (value,), f"floor({value} / {width})").running_sum(seen, F.col("_n"), "_upto")
    line = join_null_safe(line, seen.groupBy(*keys).agg(F.sum("_n").alias("_all")), keys)
    middle = [F.floor((F.col("_all") + k) / 2) for k in (1, 2)]  # places from 1
    here = sum(F.when((m > F.col("_upto") - F.col("_n")) & (m <= F.col("_upto")), F.col(value) / 2).otherwise(0.0) for m in middle)
    return line.groupBy(*keys).agg(F.sum(here).alias(name))


def scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 from tp, fp, fn; 0 where a denominator is 0."""
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp = F.col("tp").cast("double")
    return counts.withColumns({"precision": safe(tp, F.col("tp") + F.col("fp")), "recall": safe(tp, F.col("tp") + F.col("fn")), "f1": safe(2 * tp, 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def occurrence_join(left: DataFrame, right: DataFrame, signature: list[str], order_left: list[str], order_right: list[str]) -> DataFrame:
    """Pairs the n-th occurrence of each signature on either side; unpaired rows stay."""
    number = lambda df, order: df.withColumn("occurrence", F.row_number().over(W.partitionBy(*signature).orderBy(*order)))
    return number(left, order_left).join(number(right, order_right), [*signature, "occurrence"], "full")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in which two tables differ, as multisets, with how often on which side."""
    columns = a.columns
    both = a.withColumn("_n", F.lit(1)).unionByName(b.select(*columns).withColumn("_n", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("_n").alias("surplus")).filter("surplus <> 0")
