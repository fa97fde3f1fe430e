"""SimHash document fingerprints and permuted block tables (native Spark operators only)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, numbered

SHINGLE, BITS = 5, 64
LANES = 0x0000000100000001  # two 32-bit counters in a long


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per key with ``fp``, the 64-bit SimHash of the text's word five-grams.

    Each occurrence of a term votes with its hash's bits, so a term weighs its frequency; a
    bit is set where more than half of the votes set it. A text of one to four words has one
    term, an empty text none (fingerprint 0). Keys must identify a row. Votes of 32 pairs of
    bits are summed in 32 longs, partially before the only shuffle.
    """
    words = texts.select(*keys, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"))
    hashed = words.select(*keys, F.transform("_w", lambda w: F.xxhash64(w)).alias("_w"))
    at = ", ".join(f"get(_w, i + {k})" for k in range(SHINGLE))
    terms = F.expr(f"if(size(_w) = 0, array(), transform(sequence(0, greatest(size(_w) - {SHINGLE}, 0)), i -> xxhash64({at})))")
    votes = hashed.select(*keys, F.explode_outer(terms).alias("_h"))
    lanes = [F.sum(F.shiftrightunsigned("_h", j).bitwiseAND(LANES)).alias(f"_{j}") for j in range(32)]
    sums = votes.groupBy(*keys).agg(F.count("_h").alias("_n"), *lanes)
    low, high = F.lit(0).cast("long"), F.lit(0).cast("long")
    for j in range(32):
        low = low.bitwiseOR(F.when(F.col(f"_{j}").bitwiseAND(0xFFFFFFFF) * 2 > F.col("_n"), F.lit(1 << j)).otherwise(F.lit(0)).cast("long"))
        high = high.bitwiseOR(F.when(F.shiftrightunsigned(f"_{j}", 32) * 2 > F.col("_n"), F.lit(1 << j)).otherwise(F.lit(0)).cast("long"))
    return sums.select(*keys, F.coalesce(F.shiftleft(high, 32).bitwiseOR(low), F.lit(0).cast("long")).alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def near_fingerprints(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """All pairs (``q``, ``fp``) of a query and an indexed fingerprint within ``radius`` bits.

    ``queries`` has a column ``q`` and ``index`` a column ``fp``, distinct values. The 64 bits
    are cut into ``blocks`` blocks. Fingerprints within the radius agree in at least
    blocks - radius of them, so a table for every choice of that many blocks, keyed by their
    bits, finds each such pair; the distance check keeps only true ones. Copies are one value
    here, and the queries are a stated set, so a bucket never yields all pairs of its rows.
    """
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    tables = list(combinations(range(blocks), blocks - radius))
    masks = [sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen) for chosen in tables]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]

    def keyed(df: DataFrame, value: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col(value).bitwiseAND(F.lit(m).cast('long')).alias("k")) for t, m in enumerate(signed)])
        return df.select(value, F.inline(keys))

    found = keyed(queries, "q").hint("merge").join(keyed(index, "fp"), ["t", "k"])  # neither side has a bound
    return found.filter(F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= radius).select("q", "fp").distinct()


def with_next(docs: DataFrame) -> DataFrame:
    """Each distinct (doc_id, text) with the text of its last quarter replaced by the start of
    the next one's, by ascending doc_id (then text hash; nulls last, the last one's next is the
    first). Texts move once, and of the next text only the part that is needed moves again.

    Returns doc_id, _th (text hash), n_chars, edited, next_id, next_th, _rows, _kind. Of m rows repeated with
    the same doc_id and text, m - 1 are each followed by the next of them and the last one by the next
    document: such rows come in two kinds, ``_rows`` says how many rows are of the kind.
    """
    full = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    full = full.withColumn("_th", F.xxhash64("text"))
    thin = full.select("doc_id", "_th", F.length("text").cast("long").alias("n_chars")).groupBy("doc_id", "_th").agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("_m"))
    rows = numbered(thin, ["doc_id", "_th"])
    total = F.broadcast(rows.agg(F.count("*").alias("_total")))  # one row
    ring = rows.crossJoin(total).withColumn("_next", (F.col("row_no") + 1) % F.col("_total"))
    follows = ring.select(F.col("doc_id").alias("prev_id"), F.col("_th").alias("prev_th"), F.floor(F.col("n_chars") / 4).alias("_q"), F.col("_next").alias("row_no"))
    thin = ring.select("row_no", "doc_id", "_th", "n_chars", "_m").join(follows, "row_no")
    placed = thin.withColumnRenamed("doc_id", "_id").withColumnRenamed("_th", "_h")
    located = full.join(placed, full["doc_id"].eqNullSafe(placed["_id"]) & (full["_th"] == placed["_h"])).drop("_id", "_h")
    starts = located.select(
        "prev_id", "prev_th", F.col("doc_id").alias("next_id"), F.col("_th").alias("next_th"), F.expr("substring(text, 1, int(_q))").alias("_start")
    ).groupBy("prev_id", "prev_th").agg(*[F.first(c).alias(c) for c in ("next_id", "next_th", "_start")])  # repeated rows say the same
    here = located.drop("prev_id", "prev_th", "_q", "row_no")
    joined = here.join(starts, here["doc_id"].eqNullSafe(starts["prev_id"]) & (here["_th"] == starts["prev_th"]))
    head, own = F.expr("substring(text, 1, int(n_chars - floor(n_chars / 4)))"), F.expr("substring(text, 1, int(floor(n_chars / 4)))")
    last = F.struct(F.concat(head, "_start").alias("edited"), "next_id", "next_th", F.lit(1).cast("long").alias("_rows"), F.lit(0).alias("_kind"))
    others = F.struct(F.concat(head, own).alias("edited"), F.col("doc_id").alias("next_id"), F.col("_th").alias("next_th"), (F.col("_m") - 1).alias("_rows"), F.lit(1).alias("_kind"))
    kinds = F.when(F.col("_m") > 1, F.array(last, others)).otherwise(F.array(last))
    return joined.select("doc_id", "_th", "n_chars", F.inline(kinds))


def hex_print(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op5_fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's digest, one row per row of ``docs`` (repeated rows and rows without an id
    included; the latter come last in the order), and for rows whose doc_id is divisible by 50 the number of other
    fingerprints within three bits of theirs (``near_fingerprints``; null for other rows)."""
    full = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("_th", F.xxhash64("text"))
    own = materialize(fingerprints(full, ["doc_id", "_th"], "text"))
    changed = with_next(docs).withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["doc_id", "_th", "n_chars", "edited_sha256", "next_id", "next_th", "_rows", "_kind"]
    after = fingerprints(changed, keys, "edited").withColumnRenamed("fp", "fp_edited")
    mine = own.select(F.col("doc_id").alias("_id"), F.col("_th").alias("_h"), F.col("fp"))
    other = own.select(F.col("doc_id").alias("_id2"), F.col("_th").alias("_h2"), F.col("fp").alias("fp_next"))
    out = after.join(mine, after["doc_id"].eqNullSafe(mine["_id"]) & (after["_th"] == mine["_h"]))
    out = out.join(other, out["next_id"].eqNullSafe(other["_id2"]) & (out["next_th"] == other["_h2"]))
    asked = own.filter(F.col("doc_id") % 50 == 0).select(F.col("fp").alias("q")).distinct()
    near = near_fingerprints(asked, own.select("fp").distinct())
    counts = near.groupBy("q").agg((F.count("*") - 1).alias("_near"))
    query = F.when(F.col("doc_id") % 50 == 0, F.col("fp"))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_rows")))).withColumn("_q", query).join(counts, F.col("_q") == counts["q"], "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hex_print(F.col("fp")).alias("fingerprint"), hex_print(F.col("fp_edited")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("fp_edited")).alias("near_edited"), likeness(F.col("fp"), F.col("fp_next")).alias("near_next"), F.col("_near").alias("near_fingerprints"),
    )
