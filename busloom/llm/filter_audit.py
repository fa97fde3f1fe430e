"""Filter interaction audit: Shapley values of filters from the multilinear extension of their removals."""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD

FILTERS = "ABCDE"
_FULL = (1 << len(FILTERS)) - 1
_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


class Removals:
    """The removal polynomial of a part: R(x) is the number of rows that go when filter i is on with probability x_i.

    A row that fails the filters of mask m adds 1 - prod over i in m of (1 - x_i); written out, the
    coefficient of prod over i in S of x_i is (-1)**(|S|+1) times the rows whose mask holds S.
    """

    def __init__(self, counts: dict[int, int]):
        self.total = sum(counts.values())
        self.terms = {}
        for s in range(1, _FULL + 1):
            holders = sum(n for mask, n in counts.items() if mask & s == s)
            self.terms[s] = holders if s.bit_count() % 2 else -holders

    def corner(self, on: int) -> int:
        """R where the filters of ``on`` are on and the others off: the rows these remove together."""
        return sum(a for s, a in self.terms.items() if s & ~on == 0)

    def shapley(self, i: int) -> Fraction:
        """Integral over t from 0 to 1 of the partial derivative by x_i at x = (t, ..., t), exactly."""
        return sum((Fraction(a, s.bit_count()) for s, a in self.terms.items() if s >> i & 1), Fraction(0))


def audit_part(part: str, rows: Removals, good: Removals, toxic: Removals) -> list[tuple]:
    """The rows of one part: every order of the filters, every step."""
    values = [rows.shapley(i) * 120 for i in range(len(FILTERS))]
    alone = [rows.corner(_FULL) - rows.corner(_FULL & ~(1 << i)) for i in range(len(FILTERS))]
    at = [[p.corner(on) for on in range(_FULL + 1)] for p in (rows, good, toxic)]
    out = []
    for order in permutations(range(len(FILTERS))):
        name, on = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = on | 1 << i
            gone, good_gone, toxic_gone = (v[after] - v[on] for v in at)
            out.append((part, name, step, rows.total - at[0][after], gone, at[0][1 << i] - gone, alone[i], good_gone, toxic_gone, int(values[i])))
            on = after
    return out


def _flag(failed: Column, name: str) -> Column:
    return F.when(failed, 1 << FILTERS.index(name)).otherwise(0)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows per ``part``, ``mask`` of failed filters, ``good`` and ``toxic`` label.

    Only (digest, mask, part, id) of a row is shuffled, never its text. Equal rows of these are counted before they
    move, so a text that makes up a third of the corpus is one row a task. Rows without an id get their text's digest
    into the join's key, so they spread though they meet no label.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    body = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("t")).withColumn(
        "w", F.regexp_extract_all("t", F.lit(f"({WORD})"), 1)
    )
    words, distinct = F.size("w"), F.size(F.array_distinct("w"))
    mask = (
        _flag(words < 200, "A") + _flag(100 * distinct < 50 * words, "B")
        + _flag(100 * F.length(F.regexp_replace("t", "[^A-Z]", "")) > 3 * F.length("t"), "C") + _flag(F.col("t").rlike(r"[#$%&*|]"), "D")
    )  # fmt: skip
    rows = body.select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), mask.alias("mask")).groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )  # fmt: skip
    marked = rows.join(marks.withColumn("spread", F.lit(0).cast("long")), ["id", "spread"], "left").fillna(False, ["good", "toxic"])
    cell = marked.groupBy("part", "digest", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
    )  # fmt: skip
    # at most four cells a language and text: one window holds few rows however common the text is
    cell = cell.withColumn("smallest", F.min("first.id").over(W.partitionBy("digest")))
    clean = F.col("nameless") + F.when(F.col("first.id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct("mask", clean.alias("n")), F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - clean).alias("n")))
    return cell.select("part", "good", "toxic", F.explode(both).alias("b")).groupBy("part", "b.mask", "good", "toxic").agg(F.sum("b.n").alias("n"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (language), order of the five filters and step.

    Null texts count as empty ones, null languages as the empty string. Filter E fails rows whose text a row of
    a smaller id has; rows without an id are neither smaller nor larger than any, so E never fails them, and
    rows that repeat an id and its text don't fail each other. An id that ``labels`` repeats is good or toxic
    if any of its rows says so; labels without an id mark nothing. No documents: no parts, so no rows. Other columns are ignored.
    A task of the last step holds one part's counts: 128 at most.
    """

    def audit(key: tuple, counts: pd.DataFrame) -> pd.DataFrame:
        def removals(chosen: pd.DataFrame) -> Removals:
            return Removals({int(m): int(n) for m, n in chosen.groupby("mask")["n"].sum().items()})

        rows = audit_part(key[0], removals(counts), removals(counts[counts["good"]]), removals(counts[counts["toxic"]]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    return mask_counts(docs, labels).groupBy("part").applyInPandas(audit, _SCHEMA)


def op13_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of all documents."""
    return filter_audit(docs, labels)


#: Brute force: every row through every order.
SQL = r"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS l FROM documents),
g AS (SELECT doc_id AS label_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
k AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (CASE WHEN len(l) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(l)) < 50 * len(l) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
  || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails FROM w LEFT JOIN g ON doc_id = label_id),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM f a JOIN f b ON b.x <> a.x JOIN f c ON c.x NOT IN (a.x, b.x) JOIN f d ON d.x NOT IN (a.x, b.x, c.x) JOIN f e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
m AS (SELECT part, filter_order, step, x, contains(fails, x) AS hit, len(list_filter(string_split(earlier, ''), lambda y: y <> '' AND contains(fails, y))) > 0 AS gone, fails, good, toxic FROM k, s),
r AS (SELECT part, filter_order, step, x, count(*) FILTER (WHERE NOT hit AND NOT gone) AS kept, count(*) FILTER (WHERE hit AND NOT gone) AS removed, count(*) FILTER (WHERE hit AND gone) AS redundant,
  count(*) FILTER (WHERE fails = x) AS unique_fails, count(*) FILTER (WHERE hit AND NOT gone AND good) AS good_lost, count(*) FILTER (WHERE hit AND NOT gone AND toxic) AS toxic_lost FROM m GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r"""
