"""Near-duplicate documents by DartMinHash signatures, banded joins and an exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .graph import components, mixed_blocks
from .words import Words, mix, slices, words

SHINGLE, BANDS, ROWS = 5, 32, 8
_COPY, _DART, _SPOT, _SEED2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def elements(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each unit of weight: a shingle that occurs x times gives units 1 to x.

    Shingles are five consecutive words; a text of one to four words is one shingle.
    """
    n = np.diff(w.ptr)
    hashed, inside = w.windows(SHINGLE)
    text = w.text
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    h, of = hashed[inside], text[inside]
    for k in range(1, SHINGLE):
        of_k = short[n[short] == k]
        h, of = np.concatenate([h, w.windows(k)[0][w.ptr[of_k]]]), np.concatenate([of, of_k])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    at = np.arange(len(h))
    copy = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(h + copy.astype(np.uint64) * _COPY), of


def dart_signatures(units: np.ndarray, of: np.ndarray, texts: int, k: int) -> np.ndarray:
    """A (texts, k) array of signature values; rows of texts without units are 0.

    Every unit of weight is hit by darts at the arrivals of a rate-1 Poisson process in rank,
    drawn by hashing (unit, number), so two texts see the same darts on the units they share.
    Only darts of rank up to t / weight matter, t = k (ln k + 2) of them expected whatever the
    weight; each falls on one of k coordinates, which keeps its earliest. A text with an empty
    coordinate is done again up to twice the rank. Coordinates of two texts agree with
    the probability of their weighted Jaccard similarity.
    """
    out = np.zeros((texts, k), dtype=np.uint64)
    weight = np.bincount(of, minlength=texts)
    todo, t = np.flatnonzero(weight), k * (np.log(k) + 2)
    while len(todo):
        number = np.full(texts, -1)
        number[todo] = np.arange(len(todo))
        live = number[of] >= 0
        unit, text = units[live], number[of[live]]
        limit = (t / weight[todo])[text]
        rank, m = np.zeros(len(unit)), 0
        spots, ranks, darts = [], [], []
        while len(unit):
            m += 1
            dart = mix(unit + np.uint64(m * int(_DART) % 2**64))
            rank = rank - np.log((dart >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
            hit = np.flatnonzero(rank <= limit)
            unit, text, rank, limit, dart = unit[hit], text[hit], rank[hit], limit[hit], dart[hit]
            spots.append(text * k + (mix(dart ^ _SPOT) % np.uint64(k)).astype(np.int64))
            ranks.append(rank)
            darts.append(dart)
        spot, rank, dart = np.concatenate(spots), np.concatenate(ranks), np.concatenate(darts)
        first = np.full(len(todo) * k, np.inf)
        np.minimum.at(first, spot, rank)
        best = rank == first[spot]
        found = np.zeros(len(todo) * k, dtype=np.uint64)
        found[spot[best]] = dart[best]
        out[todo] = found.reshape(-1, k)
        todo = todo[np.isinf(first.reshape(-1, k)).any(axis=1)]
        t *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    keys = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], len(signatures), axis=0)
    for column in np.moveaxis(signatures.reshape(len(signatures), bands, -1), 2, 0):
        keys = mix(keys * _DART + column)
    return keys


def multiset_keys(unit: np.ndarray, of: np.ndarray, n: int) -> list[pa.Array]:
    """The multiset of shingles of each of ``n`` texts in 128 bits."""
    sums = []
    for seed in (_COPY, _SEED2):
        total = np.zeros(n, dtype=np.uint64)
        np.add.at(total, of, mix(unit ^ seed))
        sums.append(pa.array(total.view(np.int64)))
    return sums


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            unit, of = elements(words(part.column("text")))
            n = part.num_rows
            keys = band_keys(dart_signatures(unit, of, n, BANDS * ROWS), BANDS)
            sums = multiset_keys(unit, of, n)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            weight = pa.array(np.bincount(of, minlength=n).astype(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), weight, *sums, rows], ["doc_id", "weight", "f1", "f2", "keys"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's units as ascending unsigned 32-bit numbers, with the key of its multiset."""
    for batch in batches:
        for part in slices(batch, "text"):
            unit, of = elements(words(part.column("text")))
            low = (unit >> np.uint64(32)).astype(np.uint32)
            low = low[np.lexsort((low, of))]
            to = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=part.num_rows))]).astype(np.int64) * 4
            body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(to), pa.py_buffer(low.tobytes())])
            yield pa.RecordBatch.from_arrays([*multiset_keys(unit, of, part.num_rows), body.cast(pa.binary())], ["f1", "f2", "units"])


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    both = np.sort(np.concatenate([x, y]))
    return int((both[1:] == both[:-1]).sum())


@F.pandas_udf(T.DoubleType())
def weighted_jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: bytes, y: bytes) -> float:
        x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
        shared = _shared(x, y)
        return shared / max(1, len(x) + len(y) - shared)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def cross_links(table: pa.Table, threshold: float) -> pa.Table:
    """Links between rows of different parts of one bucket (or of two blocks of it): each row
    outside the largest part is compared with all others through the bucket's inverted index."""
    rep, part = table.column("rep").to_numpy(), table.column("part").to_numpy()
    units = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("units")]
    size = np.array([len(x) for x in units])
    kinds, at, times = np.unique(part, return_inverse=True, return_counts=True)
    ask = np.flatnonzero(at != times.argmax()) if len(kinds) > 1 else np.zeros(0, np.int64)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(ask):
        _, unit = np.unique(np.concatenate(units), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(size)])
        order = np.argsort(unit, kind="stable")
        holder = np.repeat(np.arange(len(rep)), size)[order]
        first = np.searchsorted(unit[order], np.arange(int(unit.max()) + 2))
        for i in ask:
            own = unit[begin[i] : begin[i + 1]]
            n = first[own + 1] - first[own]
            to = np.cumsum(n)
            shared = np.bincount(holder[np.repeat(first[own] - (to - n), n) + np.arange(to[-1])], minlength=len(rep))
            hit = np.flatnonzero((shared >= threshold * (size[i] + size - shared)) & (part != part[i]))
            out_a.append(np.minimum(rep[i], rep[hit]))
            out_b.append(np.maximum(rep[i], rep[hit]))
    pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)]), axis=1)
    return pa.table({"a": pairs[0], "b": pairs[1]})


def near_duplicates(docs: DataFrame, threshold: float = 0.8, block: int = 1000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id``, ``weight`` (shingles), ``class_id``
    (the smallest doc_id linked to it, itself included) and ``kept`` (doc_id = class_id).

    Two documents are linked when the weighted Jaccard similarity of their word five-grams is at
    least ``threshold``; classes are the connected components. Candidates agree in one of 32
    bands of 8 signature values: a pair at 0.8 is found with probability 0.997, at 0.85 with
    0.99996; every candidate is then checked on its full shingle multisets.

    Documents with the same shingle multiset are one vertex, so a large group of copies costs one row. In a band's bucket each member is first checked against the
    smallest one. What that leaves in different components, though it shares a bucket, is then
    compared within the bucket, so no link that could join two classes is lost; a group of near
    copies that the first step has joined isn't compared with itself, pairs that don't link are
    never rows, and a large bucket is compared in blocks of about ``block`` members: those of its largest
    part are sent once to each block of the strays, which are few.

    Rows with null or empty text, or without words, link with nothing. Rows with a null doc_id
    are kept and belong to no class unless an equal document has an id. Rows repeated with the
    same doc_id and shingles count as one document; where an id has different texts, each text has its
    own links, and a row of its own in its own class (``kept`` then holds for every row with the class's id).
    """
    sig = materialize(docs.select("doc_id", "text").mapInArrow(_signed, "doc_id long, weight long, f1 long, f2 long, keys array<long>"))
    reps = sig.filter("weight > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"))
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()))  # a written number: an id may have several texts
    entries = reps.filter("first is not null").select("rep", F.explode("keys").alias("key"))
    hubs = entries.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    shared = materialize(entries.join(hubs, "key"))
    asked = reps.join(shared.select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("id"), "first", "f1", "f2").hint("merge")  # the same plan at every size
    text = docs.select("doc_id", "text")
    listed = text.join(asked, text["doc_id"] == asked["first"], "left_semi").mapInArrow(_listed, "f1 long, f2 long, units binary")
    listed = listed.groupBy("f1", "f2").agg(F.first("units").alias("units"))
    listed = materialize(listed.join(asked, ["f1", "f2"]).select("id", "units"))
    units = lambda c, u: listed.select(F.col("id").alias(c), F.col("units").alias(u)).hint("merge")

    stars = shared.filter("rep > hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    both = stars.join(units("a", "_ua"), "a").join(units("b", "_ub"), "b")
    links = materialize(both.filter(weighted_jaccard("_ua", "_ub") >= threshold).select("a", "b"))
    label = components(links)
    named = shared.join(label, shared["rep"] == label["id"], "left").select("key", "rep", F.coalesce("component", "rep").alias("part"))
    placed = mixed_blocks(named.select("key", F.col("rep").alias("id"), "part"), ["key"], block).withColumnRenamed("id", "rep")
    compared = placed.join(units("rep", "units"), "rep").groupBy("key", "_low", "_high")
    more = compared.applyInArrow(lambda t: cross_links(t, threshold), "a long, b long")
    label = components(links.unionByName(more))

    named = reps.select("f1", "f2", "first", "rep").join(label, reps["rep"] == label["id"], "left")
    smallest = named.filter("component is not null").groupBy("component").agg(F.min("first").alias("_least"))
    classes = named.join(smallest, "component", "left").select("f1", "f2", F.coalesce("_least", "first").alias("_class"))
    out = sig.select("doc_id", "weight", "f1", "f2").join(classes, ["f1", "f2"], "left")
    class_id = F.when(F.col("weight") > 0, F.col("_class")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "weight", class_id.alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def op1_near_duplicates(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
