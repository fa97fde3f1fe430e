"""Toxicity: a linear character n-gram classifier scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .training import fold, sample_per_class
from .words import Words, distinct, rolling, slices, words

SIZES = (3, 4, 5, 6)
#: The space that n-grams are hashed into, and row-feature pairs that a step of the fit expands.
SLOT_BITS = 21
SLOTS, _STEP = 1 << SLOT_BITS, 1 << 20
_BASE = 0xA0761D6478BD642F


def ngrams(w: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of the chosen words, lower-cased and with a mark at either
    end, and the number of the word that each comes from."""
    raw, _ = w.bytes_of(chosen)
    text = " " + raw.tobytes().decode("utf-8", errors="replace").lower()
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    edge = code == 32
    word = np.cumsum(edge) - 1  # an edge belongs to the word after it
    hashes, owners = [], []
    for n in SIZES:
        at = np.arange(max(0, len(code) - n + 1))
        inner = np.concatenate([[0], np.cumsum(edge)])
        at = at[inner[at + n - 1] == inner[at + 1]] if len(at) else at  # edges only at the ends
        hashes.append(rolling(code, _BASE, at, at + n))
        owners.append(word[at])
    return np.concatenate(hashes), np.concatenate(owners)


def _pairs(w: Words, number: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, word number) pairs."""
    both = np.unique(w.text * np.int64(max(1, n)) + number)
    return both // max(1, n), both % max(1, n)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of either class each word of a slice occurs."""
    for batch in batches:
        for part in slices(batch, "text"):
            w = words(part.column("text"))
            first, number = distinct(w)
            text, word = _pairs(w, number, len(first))
            toxic = part.column("toxic").to_numpy(zero_copy_only=False)[text] == 1
            raw, _ = w.bytes_of(first)
            names = pa.array(raw.tobytes().decode("utf-8", errors="replace").split(" ")[:-1], pa.string())
            counts = (np.bincount(word[x], minlength=len(first)).astype(np.int64) for x in (toxic, ~toxic))
            yield pa.RecordBatch.from_arrays([names, *map(pa.array, counts)], ["text", "p", "q"])


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words added up over their n-grams, by slot, as partial sums of a task."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            w = words(part.column("text"))
            h, owner = ngrams(w, np.arange(len(w.start)))
            if not len(h):
                continue
            slot, row = slot_of(h), w.text[owner]
            for name in ("p", "q"):
                more = np.bincount(slot, part.column(name).to_numpy()[row], SLOTS)
                held[name] = held[name] + more if name in held else more
    if held:
        some = np.flatnonzero(held["p"] + held["q"])
        for low in range(0, len(some), 100_000):
            cut = some[low : low + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(cut.astype(np.int32)), *(pa.array(held[c][cut].astype(np.int64)) for c in ("p", "q"))], ["slot", "p", "q"])


def slot_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


@dataclass
class Model:
    """``slots``: those of the features kept, ascending, ``weight``: classifier weight times ratio.
    Without features nothing is known about texts, and every score is that of the bias."""

    slots: np.ndarray
    weight: np.ndarray
    bias: float

    def numbers(self) -> np.ndarray:
        """Each slot's feature number, or -1."""
        return numbered_slots(self.slots)


def numbered_slots(slots: np.ndarray) -> np.ndarray:
    out = np.full(SLOTS, -1, dtype=np.int32)
    out[slots] = np.arange(len(slots))
    return out


def _features(batch: pa.RecordBatch, numbers: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature number) pairs of a slice."""
    w = words(batch.column("text"))
    first, number = distinct(w)
    h, owner = ngrams(w, first)
    feature = numbers[slot_of(h)].astype(np.int64)
    owner, feature = owner[feature >= 0], feature[feature >= 0]
    order = np.argsort(owner, kind="stable")
    owner, feature = owner[order], feature[order]
    size = np.bincount(owner, minlength=len(first))
    begin = np.concatenate([[0], np.cumsum(size)])
    useful = size[number] > 0
    row, word = w.text[useful], number[useful]
    if not len(row):
        return row, word
    both = np.unique(row * np.int64(len(first)) + word)
    row, word = both // len(first), both % len(first)
    n = size[word]
    at = np.repeat(begin[word] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    pairs = np.unique(np.repeat(row, n) * np.int64(features) + feature[at])
    return pairs // features, pairs % features


def _fit(ends: np.ndarray, feature: np.ndarray, label: np.ndarray, ratio: np.ndarray, steps: int = 200, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on 0/1 features times ``ratio`` (Adam, full batches). Row i has the
    features ``feature[ends[i] : ends[i + 1]]``; the gradient is summed over runs of rows."""
    theta = np.zeros(len(ratio) + 1)
    theta[-1] = np.log((label.sum() + 1) / (len(label) - label.sum() + 1))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, int(ends[-1]) + 1, _STEP)), [0, len(label)]))
    for t in range(1, steps + 1):
        scaled, grad = ratio * theta[:-1], np.append(l2 * theta[:-1], 0.0)
        for low, high in zip(cuts[:-1], cuts[1:]):
            f = feature[ends[low] : ends[high]]
            row = np.repeat(np.arange(high - low), np.diff(ends[low : high + 1]))
            z = np.bincount(row, scaled[f], high - low) + theta[-1]
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[low:high]) / len(label)
            grad[:-1] += ratio * np.bincount(f, error[row], len(ratio))
            grad[-1] += error.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta[:-1] * ratio, float(theta[-1])


def train(labelled: DataFrame, sample_rows: int = 12_000, texts: DataFrame | None = None) -> Model:
    """Fits the model on ``labelled`` (doc_id, text, toxic 0/1).

    Words are counted by class over all labelled rows (in texts), then added up over their n-grams,
    which are hashed into SLOTS slots: each distinct word is cut into n-grams once, and what a task
    hands on is bounded by the space. The log ratio of a slot's smoothed class frequencies scales it. Slots
    are features if their counts depart from the classes' shares (likelihood-ratio test over 12, ratio of
    e at least): a language's own common n-grams would outvote a single toxic word in a long text.

    The weights are fitted to about ``sample_rows`` rows of each class by a hash of the id (the
    documented bound), so a rare class is learnt from as many of its rows; the bias is then moved
    by the log ratio of the classes' sampling rates back to the shares of all rows. Where the texts
    of ``labelled`` come from a join with ``texts`` (doc_id, text), the sample is read from there by
    its ids, so that the texts of all rows are shuffled once only. If no n-gram tells the classes
    apart, as without labels, the model has no features; its score is then (p + 0.1) / (n + 1) with p
    of n labelled rows toxic: 0.1, below any usual threshold, if nothing is labelled.
    """
    spark = labelled.sparkSession
    known = labelled.filter("toxic in (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    in_words = known.select("text", "toxic").mapInArrow(_word_counts, "text string, p long, q long").groupBy("text").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    counts = in_words.mapInArrow(_slot_counts, "slot int, p long, q long").groupBy("slot").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    counts = materialize(counts)
    totals = counts.agg(F.sum("p").alias("p"), F.sum("q").alias("q")).first()
    toxic, clean = totals["p"] or 0, totals["q"] or 0
    share = toxic / max(1, toxic + clean)
    slots, r = np.zeros(0, np.int64), np.zeros(0)
    if 0 < share < 1:
        ratio = F.log((F.col("p") + 1) / (toxic + 2.0)) - F.log((F.col("q") + 1) / (clean + 2.0))
        part = lambda n, rate: F.when(n > 0, n * F.log(n / ((F.col("p") + F.col("q")) * rate))).otherwise(0.0)
        surprise = 2 * (part(F.col("p"), share) + part(F.col("q"), 1 - share))
        telling = counts.withColumn("r", ratio).filter((surprise > 12) & (F.abs("r") >= 1)).select("slot", "r").orderBy("slot").toPandas()  # at most SLOTS rows
        slots, r = telling["slot"].to_numpy(np.int64), telling["r"].to_numpy(np.float64)
    if not len(slots):
        prior = (pos + 0.1) / (pos + neg + 1)
        return Model(slots, r, float(np.log(prior / (1 - prior))))
    sent = spark.sparkContext.broadcast(slots)
    small = np.dtype(np.uint16 if len(slots) <= 1 << 16 else np.int32)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, features = numbered_slots(sent.value), len(sent.value)
        for batch in batches:
            for part in slices(batch, "text"):
                row, feature = _features(part, numbers, features)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32) * small.itemsize
                lists = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(feature.astype(small).tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("toxic"), lists], ["toxic", "f"])

    chosen = sample_per_class(known, "toxic", "doc_id", sample_rows, share=False)
    if texts is not None:
        ids = chosen.select("doc_id", "toxic").distinct()  # at most about twice ``sample_rows``
        chosen = texts.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    got = chosen.select("text", "toxic").mapInArrow(rows, "toxic int, f binary").toArrow()
    label = got.column("toxic").to_numpy().astype(float)
    lists = [x.as_py() for x in got.column("f")]
    del got
    ends = np.concatenate([[0], np.cumsum([len(x) // small.itemsize for x in lists])]).astype(np.int64)
    feature = np.frombuffer(b"".join(lists), small)
    del lists
    weight, bias = _fit(ends, feature, label, r)
    drawn = label.sum()
    if drawn and drawn < len(label):
        bias += float(np.log(pos / drawn) - np.log(neg / (len(label) - drawn)))
    return Model(slots, weight, bias)


def score_toxicity(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row and ``score``, the probability of label 1 for its whole
    text. Null and empty texts have no features, so their score is the model's prior. Rows repeated with
    one id or without an id are scored each for itself; a column ``score`` in ``keep`` is replaced."""
    keep = [c for c in keep if c != "score"]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        numbers = m.numbers()
        for batch in batches:
            for part in slices(batch, "text"):
                row, feature = _features(part, numbers, len(m.slots))
                z = m.bias + np.bincount(row, m.weight[feature] if len(row) else None, part.num_rows)
                out = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*out, pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], [*keep, "score"])

    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(scored, schema + ", score double")


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows to learn from: labelled, and outside the held-out fold (crc32 of the id mod 4 = 2).
    An id that is labelled more than once counts with its largest label."""
    known = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.hint("merge")  # the same plan at every size
    return docs.select("doc_id", "text").join(known, "doc_id").filter(fold("doc_id", 4) != 2)


def op9_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest for all documents."""
    model = train(labelled_rows(docs, labels), texts=docs)
    out = score_toxicity(docs, model, ["doc_id"])
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
