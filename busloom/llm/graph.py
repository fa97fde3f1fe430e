"""Connected components of links between ids, with joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b", jumps: int = 3) -> DataFrame:
    """One row per linked id: ``id`` and ``component``, the smallest id reachable from it.

    Each round points every vertex to its smallest neighbour, follows these pointers a few
    steps, and replaces vertices by what they point to; links that become loops and repeats go,
    so the links shrink in every round and end after about log(diameter) of them. Every table
    lies in the shared folder; only the number of links left reaches the driver. A vertex with
    very many links is pre-aggregated for its pointer and split by skew-join handling.
    """
    edges = materialize(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    label = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("to"))
        for _ in range(jumps):
            ahead = to.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
            to = materialize(to.join(ahead, to["to"] == ahead["_id"]).select("id", F.col("_to").alias("to")))
        step = to.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
        if label is None:
            label = to.select("id", F.col("to").alias("component"))
        else:
            moved = label.join(step, label["component"] == step["_id"], "left")
            label = materialize(moved.select("id", F.coalesce("_to", "component").alias("component")))
        edges = edges.join(step, edges["a"] == step["_id"]).select(F.col("_to").alias("a"), "b")
        edges = edges.join(step, edges["b"] == step["_id"]).select("a", F.col("_to").alias("b"))
        edges = materialize(edges.filter("a <> b").distinct())
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")) if label is None else label


def mixed_blocks(members: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Lays out the groups (``keys``) of ``members`` (with ``id`` and ``part``) whose members are of several parts, so that
    two members of different parts meet in one place (keys, ``_low``, ``_high``) of about 2 x ``block`` members.

    Members of a group's largest part are sent once to each block of the others, the strays; these go to
    the largest part's blocks and to each other's. A group of one part isn't laid out at all.
    """
    parts = members.groupBy(*keys, "part").agg(F.count("*").alias("m"))
    largest = F.max(F.struct("m", (-F.col("part")).alias("part")))
    split = parts.groupBy(*keys).agg(F.count("*").alias("parts"), F.sum("m").alias("all"), largest.alias("top")).filter("parts > 1")
    blocks = lambda n: F.ceil(n / block).cast("int")
    split = split.select(*keys, (-F.col("top.part")).alias("top"), blocks(F.col("top.m")).alias("mains"), blocks(F.col("all") - F.col("top.m")).alias("strays"))
    mixed = members.join(split, keys)
    h = F.xxhash64("id")
    main, stray = F.pmod(h, "mains").cast("int"), F.pmod(h, "strays").cast("int")
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at_main = F.transform(to("strays"), lambda j: F.struct(main.alias("_low"), j.alias("_high")))
    at_stray = F.concat(
        F.transform(to("mains"), lambda i: F.struct(i.alias("_low"), stray.alias("_high"))),
        F.transform(to("strays"), lambda j: F.struct((-1 - F.least(stray, j)).alias("_low"), F.greatest(stray, j).alias("_high"))),
    )
    return mixed.select(*members.columns, F.inline(F.when(F.col("part") == F.col("top"), at_main).otherwise(at_stray)))
