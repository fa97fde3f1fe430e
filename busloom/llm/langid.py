"""Language identification by prediction by partial matching (PPM) with frozen statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import fold, sample_per_class
from .words import Table, Words, distinct, rolling, slices, words

ORDER = 4
_BASE = 0xE7037ED1A0B428DB


def _nodes(w: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For the bytes of the chosen words, each word's last space included: the word's number,
    the byte's position, and for each order k the hash of (k bytes before it, itself) and
    whether these are there. The context of a word's first byte is one space."""
    raw, to = w.bytes_of(chosen)
    data = np.concatenate([[32], raw]).astype(np.uint64) + np.uint64(1)
    at = np.arange(1, len(data))
    size = np.diff(to)
    word = np.repeat(np.arange(len(size)), size)
    place = at - 1 - np.repeat(to[:-1], size)
    keys, there = [], []
    for k in range(ORDER + 1):
        ok = place + 1 >= k  # the space before the word counts as context
        keys.append(rolling(data, _BASE, np.where(ok, at - k, at), at + 1))
        there.append(ok)
    return word, at, keys, there


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            for lang in part.column("lang").unique().to_pylist():
                own = part.filter(pa.array([x == lang for x in part.column("lang").to_pylist()]))
                w = words(own.column("text"), lower=True)
                first, number = distinct(w)
                times = np.bincount(number, minlength=len(first))
                word, _, keys, there = _nodes(w, first)
                before = np.zeros(len(word), dtype=np.uint64)
                for k in range(ORDER + 1):
                    # the context of order k is the node of order k-1 at the byte before
                    parent = before if k == 0 else np.concatenate([before[:1], keys[k - 1][:-1]])
                    if k == 1:
                        parent = np.where(np.concatenate([[True], word[1:] != word[:-1]]), np.uint64(1), parent)
                    if k > 1:
                        parent = np.where(np.concatenate([[True], word[1:] != word[:-1]]), np.uint64(0), parent)
                    ok = there[k]
                    yield from _grouped(lang, k, keys[k][ok], parent[ok], times[word[ok]])


def _grouped(lang: str, order: int, key: np.ndarray, parent: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys, first, at = np.unique(key, return_index=True, return_inverse=True)
    n = np.bincount(at, times, len(keys)).astype(np.int64)
    arrays = [pa.array([lang] * len(keys)), pa.array(np.full(len(keys), order, np.int32)), pa.array(keys.view(np.int64)), pa.array(parent[first].view(np.int64)), pa.array(n)]
    yield pa.RecordBatch.from_arrays(arrays, ["lang", "k", "key", "parent", "n"])


@dataclass
class Model:
    """Per node and language: log2 probability of the byte in its context (nan: not seen), and
    log2 probability of an escape from the node as a context (0: context not seen)."""

    langs: list[str]
    keys: np.ndarray
    seen: np.ndarray
    escape: np.ndarray
    root: np.ndarray
    start: np.ndarray


def train(labelled: DataFrame, sample_rows: int = 1_500, sample_bytes: int = 6 << 20) -> Model:
    """Byte context trees of every language from about ``sample_rows`` rows of it (doc_id, text,
    lang), chosen by a hash of the id: the documented bound of the model and of what reaches the
    driver; where these rows hold more than ``sample_bytes`` of text, fewer are taken.

    Escapes follow method C: in a context seen n times with d different bytes, a byte seen c
    times has probability c / (n + d), and an escape to the next shorter context d / (n + d).
    """
    chosen = sample_per_class(labelled, "lang", "doc_id", sample_rows, share=False, text="text", most_bytes=sample_bytes)
    parts = chosen.select("text", "lang").mapInArrow(_counted, "lang string, k int, key long, parent long, n long")
    sums = parts.groupBy("lang", "k", "key", "parent").agg(F.sum("n").alias("n"))
    nodes = sums.toPandas()
    langs = sorted(nodes["lang"].unique())
    nodes["l"] = nodes["lang"].map({x: i for i, x in enumerate(langs)}).astype("int64")
    keys, row = np.unique(nodes["key"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
    contexts = nodes.groupby(["l", "parent"], as_index=False)["n"].agg(total="sum", kinds="count")
    both = nodes.merge(contexts, on=["l", "parent"])
    row = Table(keys).find(both["key"].to_numpy(np.int64).view(np.uint64))
    seen = np.full((len(keys), len(langs)), np.nan, dtype=np.float32)
    seen[row, both["l"]] = np.log2(both["n"] / (both["total"] + both["kinds"]))
    escape = np.zeros((len(keys) + 1, len(langs)), dtype=np.float32)
    out = np.log2(contexts["kinds"] / (contexts["total"] + contexts["kinds"])).to_numpy()
    parent = contexts["parent"].to_numpy(np.int64).view(np.uint64)
    at = Table(keys).find(parent)
    inner = (at >= 0) & (parent > 1)
    escape[at[inner], contexts["l"].to_numpy()[inner]] = out[inner]
    root, start = np.zeros(len(langs), np.float32), np.zeros(len(langs), np.float32)
    root[contexts["l"].to_numpy()[parent == 0]] = out[parent == 0]
    start[contexts["l"].to_numpy()[parent == 1]] = out[parent == 1]
    return Model(langs, keys, seen, escape, root, start)


def code_lengths(w: Words, chosen: np.ndarray, model: Model, table: Table) -> np.ndarray:
    """Bits that each chosen word, with the space after it, takes in each language's tree."""
    word, _, keys, there = _nodes(w, chosen)
    found = [table.find(k) for k in keys]
    first = np.concatenate([[True], word[1:] != word[:-1]]) if len(word) else np.zeros(0, bool)
    bits = np.zeros((len(word), len(model.langs)), dtype=np.float32)
    open_ = np.ones_like(bits, dtype=bool)
    for k in range(ORDER, -1, -1):
        at = np.flatnonzero(there[k])
        if not len(at):
            continue
        value = np.where((found[k][at] >= 0)[:, None], model.seen[found[k][at]], np.nan)
        if k == 0:
            leave = np.broadcast_to(model.root, value.shape)
        else:
            context = np.concatenate([[-1], found[k - 1][:-1]])
            leave = model.escape[context[at]]
            leave[first[at]] = model.start if k == 1 else 0
        hit = ~np.isnan(value)
        live = open_[at]
        bits[at] -= np.where(live, np.where(hit, value, leave), 0)
        open_[at] = live & ~hit
    bits += 8 * open_  # a byte that was never seen: one of 256
    out = np.zeros((len(chosen), len(model.langs)))
    for j in range(len(model.langs)):
        out[:, j] = np.bincount(word, bits[:, j], len(chosen))
    return out


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row, ``lang_pred`` and ``score`` for its whole text.

    The predicted language is the one whose frozen tree codes the text (ASCII letters
    lower-cased, white space as single spaces) in the fewest bits; the score is its posterior
    under equal priors. Null texts and texts without a letter give ``und`` and 0; ties go to the
    first language by code point, and without any language learnt everything is ``und``. Rows repeated with
    one id or without an id are judged each for itself; columns of the two new names are replaced.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        table = Table(m.keys)
        names = np.array([*m.langs, "und"], dtype=object)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                n = part.num_rows
                letters = part.column("_letters").to_numpy(zero_copy_only=False).astype(bool)
                best, score = np.full(n, len(m.langs)), np.zeros(n)
                if m.langs and letters.any():
                    w = words(part.column("text"), lower=True)
                    first, number = distinct(w)
                    of_word, text = code_lengths(w, first, m, table), w.text
                    bits = np.stack([np.bincount(text, of_word[number, j], n) for j in range(len(m.langs))], axis=1)
                    choice = bits.argmin(axis=1)
                    less = np.exp2(-np.clip(bits - bits.min(axis=1, keepdims=True), 0, 1000)).sum(axis=1)
                    best[letters], score[letters] = choice[letters], (1 / less)[letters]
                out = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*out, pa.array(names[best], pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    types = dict(docs.dtypes)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters")
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"]), letters).mapInArrow(predicted, schema + ", lang_pred string, score double")


def op7_language(docs: DataFrame) -> DataFrame:
    """The contract's digest for all documents."""
    learn = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 3) != 1))
    out = identify(docs, train(learn.select("doc_id", "text", "lang")), ["doc_id"])
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
