"""Bounded, reproducible samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's decimal digits modulo ``folds`` (a null id: of the empty string)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def sample_per_class(rows: DataFrame, label: str, id_col: str, most: int, share: bool, text: str | None = None, most_bytes: int = 0) -> DataFrame:
    """About ``most`` rows of each class (or of all, keeping the classes' shares), and of a class about
    ``most_bytes`` of ``text`` at most where that is given, chosen by a hash of the id (and of the text, where it is given:
    ids may be null or repeated; of rows that agree in both one is taken), so that the choice doesn't depend
    on partitions. Class counts cover all rows and are a small table; no row is sorted."""
    size = F.sum(F.octet_length(text)) if text else F.lit(0)
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"), size.alias("_b")).collect()  # one row per class
    total = sum(r["_n"] for r in counts)
    by = [id_col, text] if text else [id_col]
    unit = F.shiftrightunsigned(F.xxhash64(*by, F.lit(11)), 12) / F.lit(float(2**52))
    keep = F.lit(False)
    for r in counts:
        rate = min(1.0, most / max(1, total if share else r["_n"]), most_bytes / max(1, r["_b"] or 0) if text else 1.0)
        keep = keep | ((F.col(label) == F.lit(r[label])) & (unit < rate))
    chosen = rows.filter(keep)
    return chosen.dropDuplicates([label, *by]) if text else chosen
