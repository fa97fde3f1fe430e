"""Mixing sources to target weights with hash-threshold histograms (native Spark operators only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, materialize

BITS, LEVELS = 16, 3


def source_targets(totals: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Words to take from every source: shares by weight of ``share`` times all words, where a
    source gives at most ``most`` times its own words and the excess goes to the others.

    ``totals`` has one row per source (``_key``, ``source_size``), so the two ordered windows
    over it are the only unpartitioned ones. Filling by weight is min(cap, weight * level) with
    one level for all sources; ordered by cap/weight, that level is found with running sums.
    """
    ranked = totals.withColumn("_rank", F.row_number().over(W.orderBy("_key")) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    everything = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))) / F.sum("_w").over(rest)
    leveled = ranked.withColumn("_level", F.when(F.col("_cap") / F.col("_w") >= level, level))
    target = F.least("_cap", F.coalesce(F.col("_w") * F.max("_level").over(everything), "_cap"))
    return leveled.select("_key", "source_size", target.alias("target"))


def _boundary(histogram: DataFrame, over: list[str], bucket: str) -> DataFrame:
    """The bucket of every source in which its budget runs out, and what is left of it there."""
    upto = W.partitionBy(*over).orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)
    run = histogram.withColumn("_upto", F.sum("_words").over(upto))
    out = run.filter((F.col("_upto") > F.col("_need")) & (F.col("_upto") - F.col("_words") <= F.col("_need")))
    return out.select(*over, bucket, "_words", (F.col("_need") - (F.col("_upto") - F.col("_words"))).alias("_need"))


def _tied(sized: DataFrame, edge: DataFrame) -> DataFrame:
    """The rows that hold a source's threshold itself (``_row``), and whether they still go in (``_in``: with
    half of the row or more within what is open). Repeated rows can be many: they are added up within the parts of the written table first."""
    rows = sized.join(edge, ["_key", "_h"]).withColumn("_part", F.shiftrightunsigned("_row", 33))
    upto = W.partitionBy("_key", "_part").orderBy("_row").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("_key", "_part").agg(F.sum("size").alias("_words"))
    parts = parts.select("_key", "_part", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_before"))
    run = rows.withColumn("_upto", F.sum("size").over(upto)).join(parts, ["_key", "_part"])
    return run.select("_row", (2 * (F.col("_before") + F.col("_upto")) - F.col("size") <= 2 * F.col("_open")).alias("_in"))


def mix_to_targets(
    docs: DataFrame, weights: list[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0, keep: list[str] = ("doc_id",),
) -> DataFrame:
    """One row per row of ``docs`` with ``size`` (its words), ``source_size``, ``target``,
    ``taken`` (words the mix takes from it, repeats counted) and ``copies`` (taken / size).

    Sources are ordered by code point, null last, and take the weights in turn. A source whose
    target is at least its size is taken whole once (or more often), and what is missing comes
    from the rows whose hash lies under the source's threshold. The threshold is found level by
    level: words are summed by source and hash bucket, and only the bucket in which the budget
    runs out is split into finer buckets. Every histogram has at most 2**16 rows per source,
    pre-aggregated before its shuffle; rows join their decision on (source, bucket), so a source
    with a third of all rows is spread over many keys. Nothing is sorted by hash but histograms.

    The hash covers ``keep``, the text and the seed, so reruns and other partitionings agree. Rows that
    agree in all of these (repeated rows) and hold the threshold are counted off, by running sums within
    a written file's part and over the parts, until the budget is met: which of the equal rows are taken may
    differ between runs, how many doesn't. Null or empty texts have size 0 and
    take part with 0 words; an empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keep, "text"), 64 - BITS * LEVELS)
    key = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source"))
    sized = materialize(docs.select(*keep, key.alias("_key"), size.alias("size"), h.alias("_h"), F.monotonically_increasing_id().alias("_row")))
    for k in range(LEVELS):
        b = F.shiftrightunsigned("_h", BITS * (LEVELS - 1 - k)).bitwiseAND(2**BITS - 1)
        sized = sized.withColumn(f"_b{k}", b.cast("int"))

    first = sized.groupBy("_key", "_b0").agg(F.sum("size").alias("_words"))
    totals = first.groupBy("_key").agg(F.sum("_words").alias("source_size"))
    plan = source_targets(totals, list(weights), share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("_whole", whole.cast("long"))
    plan = plan.withColumn("_need", F.col("target") - F.col("_whole") * F.col("source_size"))

    edge = _boundary(first.join(plan.select("_key", "_need"), "_key"), ["_key"], "_b0").withColumnRenamed("_words", "_w0")
    for k in range(1, LEVELS):
        over = ["_key", *[f"_b{j}" for j in range(k)]]
        finer = sized.join(edge.select(*over, "_need"), over).groupBy(*over, f"_b{k}")
        edge = _boundary(finer.agg(F.sum("size").alias("_words"), F.max("_need").alias("_need")), over, f"_b{k}")
    cut = sum((F.col(f"_b{k}").cast("long") * 2 ** (BITS * (LEVELS - 1 - k)) for k in range(LEVELS)), F.lit(0))
    edge = edge.select("_key", cut.alias("_cut"), F.col("_need").alias("_open"))
    plan = plan.join(edge, "_key", "left").drop("_need")

    decided = first.select("_key", "_b0").join(plan, "_key")
    counted = _tied(sized, edge.withColumnRenamed("_cut", "_h"))
    under = F.coalesce((F.col("_h") < F.col("_cut")) | F.col("_in"), F.lit(False)).cast("long")
    out = sized.join(decided, ["_key", "_b0"]).join(counted, "_row", "left").withColumn("copies", F.col("_whole") + under)
    return out.select(*keep, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op6_mixing(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``mix_to_targets`` for all documents."""
    return mix_to_targets(docs).drop("copies")
