"""A training corpus from raw documents in five stages, each written before the next one reads it.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``, so stages can be left out or reordered. Extra columns of the input are
not carried along. Rows without a doc_id, and rows that repeat one, are judged each for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busloom.llm import minhash, mixture, packing, substring, toxicity
from busloom.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents whose score reaches the threshold go. The classifier learns from the
    labelled rows of ``docs`` outside the held-out fold; if these tell it nothing, all documents stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(toxicity.labelled_rows(docs, labels), texts=docs)
    if not len(model.slots):
        return docs.select(*COLUMNS)
    return toxicity.score_toxicity(docs, model, COLUMNS).filter(F.col("score") < TOXIC).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each class of near copies one row stays, that with the smallest doc_id (a row
    without one only if the class has none). Rows are told apart by a number of their own, so a
    row repeated whole or a copy without a doc_id is a copy like any other."""
    rows = materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))
    found = minhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "class_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    kept = found.join(rows.select("_row", "doc_id"), "_row").groupBy("class_id").agg(first.alias("_first")).select(F.col("_first._row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: passages of 35 words or more that occur twice are cut out. A document without
    such a passage keeps its text as it is; one that loses all its words goes."""
    out = substring.dedup_substrings(docs.select(*COLUMNS)).filter("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    length = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", text.alias("text"), "lang", "source", length.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the mix doesn't take go, those it takes twice are there twice. Rows
    are told apart by doc_id, source and text; rows that agree in these are taken alike."""
    key = ["doc_id", "source", "_text"]
    rows = docs.withColumn("_text", F.xxhash64("text"))
    plan = mixture.mix_to_targets(rows, keep=key).groupBy(*key).agg(F.max("copies").alias("_copies")).filter("_copies > 0")
    plan = plan.select(*[F.col(c).alias(f"_{c}") for c in key], "_copies")
    same = [rows[c].eqNullSafe(plan[f"_{c}"]) for c in key]
    taken = rows.join(plan, same[0] & same[1] & same[2])
    repeats = F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))).alias("_copy")
    return taken.select(*COLUMNS, repeats).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one row per piece of a document in a sequence of at most 2048 tokens."""
    return packing.op2_packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the trained classifier or the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
