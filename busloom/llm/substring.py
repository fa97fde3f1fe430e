"""Substring deduplication with difference-cover anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, dealt_rows
from .words import Words, member, slices, words

#: A perfect difference cover. Every residue modulo PERIOD is a difference of two of COVER.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
_COVERED = np.isin(np.arange(PERIOD), COVER)
_SALT = 0x5851F42D4C957F2D


def _anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors: word windows at the cover positions of a text.

    Two equal windows at i and j share an aligned anchor: some d < PERIOD has i+d and j+d both
    at cover positions, and an anchor of window - PERIOD + 1 words from there lies inside.
    """
    hashed, inside = w.windows(window - PERIOD + 1)
    at = np.flatnonzero(inside & _COVERED[w.place % PERIOD])
    return at, hashed[at]


def _candidates(w: Words, window: int, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that hold a repeated anchor, with two hashes of their words each."""
    at, hashed = _anchors(w, window)
    hits = np.zeros(len(w.start) + 1, dtype=np.int64)
    hits[at[member(hashed, repeated)] + 1] = 1
    hits = np.cumsum(hits)
    first, inside = w.windows(window)
    begin = np.flatnonzero(inside)
    begin = begin[hits[begin + PERIOD] > hits[begin]] if len(begin) else begin
    if not len(begin):
        return begin, first[begin], first[begin]
    second, _ = w.windows(window, salt=_SALT)
    return begin, first[begin], second[begin]


def _found(h1: np.ndarray, h2: np.ndarray, in1: np.ndarray, in2: np.ndarray) -> np.ndarray:
    """Whether each pair (h1, h2) occurs in the pairs (in1, in2), which are sorted by in1."""
    at, out = np.searchsorted(in1, h1), np.zeros(len(h1), dtype=bool)
    todo = np.arange(len(h1))
    while len(todo):
        todo = todo[(at[todo] < len(in1))]
        todo = todo[in1[at[todo]] == h1[todo]]
        out[todo] |= in2[at[todo]] == h2[todo]
        at[todo] += 1
    return out


def _unsigned(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().view(np.uint64)


def dedup_substrings(docs: DataFrame, window: int = 35, block_bytes: int = 4 << 20) -> DataFrame:
    """Adds to each row ``n_words``, ``n_removed`` and ``kept_text``: its words, without those
    covered by a window of ``window`` words that also starts elsewhere, joined by one space.

    All windows are judged on the input, so every copy of a repeated passage goes, the same
    text's own repeats and overlaps included. Null and empty texts have no words; a text shorter
    than the window stays. Rows repeated whole are copies of each other like any others.

    Texts are dealt once into blocks of about ``block_bytes`` by doc_id and read from there three
    times: (1) each block names its distinct anchors (5 of 21 positions), and those seen twice
    anywhere go back to the blocks that hold them; (2) only windows around such anchors are
    hashed (128 bits) and counted in the same way, and a block gets back those of its windows that
    occur once, which are few; (3) words covered by the other such windows go. A window that occurs in very many texts makes one row per block, not one per text or pair.
    The plan needs window > PERIOD. ``docs`` must have doc_id and text; other columns of any type are kept, but for
    those of the new names, which are replaced. Rows that agree in doc_id and text share a block.
    """
    if window <= PERIOD:
        raise ValueError(f"the window must have more than {PERIOD} words")
    docs = docs.drop("n_words", "n_removed", "kept_text")
    names = docs.columns
    own = {c: f"{c}{'_' * (1 + max(map(len, names)))}" for c in names if c.lower() == "_block"}  # gets its name back at the end
    docs = docs.withColumnsRenamed(own)
    schema = docs.schema
    # texts without a window, nulls and empty ones among them, need no block, however often they repeat
    long = F.coalesce(F.octet_length("text") >= 2 * window - 1, F.lit(False))
    found = F.coalesce(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    short = docs.filter(~long).withColumns({"n_words": F.size(found).cast("long"), "n_removed": F.lit(0).cast("long"), "kept_text": F.array_join(found, " ")})
    dealt, _ = dealt_rows(docs.filter(long), "text", block_bytes, by=["doc_id", "text"])

    def anchors(table: pa.Table) -> pa.Table:
        found = [_anchors(words(part.column("text")), window)[1] for part in slices(table, "text")]
        h, n = np.unique(np.concatenate(found), return_counts=True)
        block = np.full(len(h), table.column("_block")[0].as_py(), dtype=np.int32)
        return pa.table({"h": h.view(np.int64), "_block": block, "many": n > 1})

    def windows(table: pa.Table, repeated: pa.Table) -> pa.Table:
        known = np.sort(_unsigned(repeated, "h"))
        found = [_candidates(words(part.column("text")), window, known)[1:] for part in slices(table, "text")]
        h1, h2 = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (zip(*found) if found else ((), ())))
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(h1))) > 1
        block = np.full(len(first), table.column("_block")[0].as_py() if table.num_rows else 0, dtype=np.int32)
        return pa.table({"h1": h1[first].view(np.int64), "h2": h2[first].view(np.int64), "_block": block, "many": many})

    def clean(table: pa.Table, anchored: pa.Table, single: pa.Table) -> list[pa.Table]:
        known = np.sort(_unsigned(anchored, "h"))
        in1, in2 = _unsigned(single, "h1"), _unsigned(single, "h2")
        order = np.argsort(in1)
        in1, in2 = in1[order], in2[order]
        out = []
        for part in slices(table, "text"):
            w = words(part.column("text"))
            at, h1, h2 = _candidates(w, window, known)
            at = at[~_found(h1, h2, in1, in2)]
            edge = np.zeros(len(w.start) + 1, dtype=np.int64)
            edge[at] += 1
            edge[at + window] -= 1
            kept = np.cumsum(edge[:-1]) == 0
            chosen = np.flatnonzero(kept)
            text, to = w.bytes_of(chosen)
            ptr = np.concatenate([[0], np.cumsum(kept)])[w.ptr]
            # without the space after a text's last word
            drop = np.ones(len(text), dtype=bool)
            last = ptr[1:][np.diff(ptr) > 0]
            drop[to[last] - 1] = False
            size = to[ptr[1:]] - to[ptr[:-1]] - (np.diff(ptr) > 0)
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            body = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(text[drop].tobytes()))
            rows = part.drop_columns(["_block"])
            for name, values in (("n_words", np.diff(w.ptr)), ("n_removed", np.diff(w.ptr) - np.diff(ptr))):
                rows = rows.append_column(name, pa.array(values, pa.int64()))
            out.append(rows.append_column("kept_text", body.cast(pa.string())))
        return out

    by_block = lambda df: df.groupBy("_block")
    seen = by_block(dealt).applyInArrow(anchors, "h long, _block int, many boolean")
    times = F.sum(F.when(F.col("many"), 2).otherwise(1))
    anchored = seen.withColumn("_n", times.over(W.partitionBy("h"))).filter("_n > 1").select("h", "_block")
    around = by_block(dealt).cogroup(by_block(anchored)).applyInArrow(windows, "h1 long, h2 long, _block int, many boolean")
    single = around.withColumn("_n", times.over(W.partitionBy("h1", "h2"))).filter("_n = 1").select("h1", "h2", "_block")
    # the last step needs both tables of a block: they travel as one, told apart by h2 and kind
    both = anchored.select("_block", F.col("h").alias("h1"), F.lit(None).cast("long").alias("h2")).unionByName(single)
    added = ", n_words long, n_removed long, kept_text string"
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

    def last(table: pa.Table, known: pa.Table) -> pa.Table:
        whole = known.column("h2").is_valid()
        parts = clean(table, known.filter(pc.invert(whole)).select(["h1"]).rename_columns(["h"]), known.filter(whole))
        return pa.concat_tables(parts) if parts else pa.table({f: [] for f in [*schema.names, "n_words", "n_removed", "kept_text"]})

    cleaned = by_block(dealt).cogroup(by_block(both)).applyInArrow(last, names + added)
    return cleaned.unionByName(short).withColumnsRenamed({new: old for old, new in own.items()})


def op4_substring(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``dedup_substrings`` for all documents."""
    out = dedup_substrings(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
