"""Lexical retrieval packing: BM25 neighbours fill the windows of seed documents."""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .words import distinct, member, mix, slices, words

#: BM25's usual constants.
K1, B = 1.2, 0.75


class WordTokens:
    """Token ids of words, kept across the batches of a Python worker.

    The tokenizer drops white space and splits there first, so a text's ids are those of its
    words in turn; each distinct word is tokenized once. At most ``most`` words are kept. Where the
    tokenizer drops the case of ASCII letters, words are told apart without it (``lower``).
    """

    _kept: dict[str, "WordTokens"] = {}

    def __init__(self, path: str, most: int = 3_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use every core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        ids = lambda texts: [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        letters = [*string.ascii_uppercase, string.ascii_uppercase, "The", "aBc"]
        self.lower = ids(letters) == ids([x.lower() for x in letters])
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.int32)
        self.old, self.new, self.ids = (np.zeros(0, np.uint64), none, none), (np.zeros(0, np.uint64), none, none), np.zeros(0, self.kind)

    @classmethod
    def of(cls, path: str) -> "WordTokens":
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def lookup(self, hashes: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids, in ``self.ids``, of distinct words by their ascending hashes;
        ``text_of`` gives the strings of chosen ones."""
        if len(self.old[0]) + len(self.new[0]) + len(hashes) > self.most:
            self.forget()
        missing = np.flatnonzero(~member(hashes, self.old[0]) & ~member(hashes, self.new[0]))
        if len(missing):
            sizes, parts = [], []
            for low in range(0, len(missing), 4096):  # a batch's encodings take a kilobyte a word
                got = [e.ids for e in self.tokenizer.encode_batch_fast(text_of(missing[low : low + 4096]), add_special_tokens=False)]
                sizes.append(np.fromiter(map(len, got), np.int32, len(got)))
                parts.append(np.fromiter(chain.from_iterable(got), self.kind, int(sizes[-1].sum())))
            size, ids = np.concatenate(sizes), np.concatenate(parts)
            begin = (np.cumsum(size, dtype=np.int64) - size + len(self.ids)).astype(np.int32)
            self.ids = np.concatenate([self.ids, ids])
            self.new = self._with(self.new, (hashes[missing], begin, size))
            if len(self.new[0]) > 65536:  # new words go into a small table first
                self.old, self.new = self._with(self.old, self.new), tuple(x[:0] for x in self.new)
        begin, size = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        for hash_, first, long in (self.old, self.new):
            here = np.flatnonzero(member(hashes, hash_))
            at = np.searchsorted(hash_, hashes[here])
            begin[here], size[here] = first[at], long[at]
        return begin, size

    @staticmethod
    def _with(table: tuple, more: tuple) -> tuple:
        at = np.searchsorted(table[0], more[0])
        return tuple(np.insert(old, at, x) for old, x in zip(table, more))


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0] .. begin[0]+size[0]-1, begin[1] .. and so on."""
    to = np.cumsum(size)
    return np.repeat(begin - (to - size), size) + np.arange(to[-1] if len(to) else 0)


def tokenize(column: pa.Array, cache: WordTokens, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each closed by ``end_id``, and the n+1 offsets of the texts."""
    w = words(column, lower=cache.lower)
    first, number = distinct(w)

    def text_of(new: np.ndarray) -> list[str]:
        raw, _ = w.bytes_of(first[new])
        return raw.tobytes().decode("utf-8", errors="replace").split(" ")[:-1]

    begin, size = cache.lookup(w.hash[first], text_of)
    n = np.concatenate([[0], np.cumsum(size[number])])[w.ptr]
    flat = cache.ids[_ranges(begin[number], size[number])]
    return np.insert(flat, n[1:], end_id), n + np.arange(len(n))


def token_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids): every row's token ids as little-endian numbers of two bytes (four for a large vocabulary)."""

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordTokens.of(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = tokenize(part.column("text"), cache, end_id)
                offsets = pa.py_buffer((at * ids.itemsize).astype(np.int32))
                body = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, offsets, pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), body], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(tokenized, "doc_id long, ids binary")


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a binary column's rows, and the n+1 offsets of the rows."""
    raw = [x.as_py() for x in column]
    return np.frombuffer(b"".join(raw), kind), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64) // np.dtype(kind).itemsize


def _terms(ids: np.ndarray, at: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, id) pairs and how often each occurs."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pair = np.sort(row * np.int64(kinds) + ids)
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    pair, tf = pair[first], np.diff(np.append(first, len(pair)))
    doc = pair // kinds
    return doc, pair - doc * kinds, tf


class Weights:
    """What BM25 knows of the whole corpus: each id's weight (0 for ids in one document only or in half
    of them or more), and the documents' mean length."""

    def __init__(self, df: np.ndarray, documents: int, mean: float):
        self.idf = np.where((df >= 2) & (2 * df < documents), np.log((documents - df + 0.5) / (df + 0.5)), 0.0)
        self.mean = mean


def corpus_weights(tokens: DataFrame, kinds: int, kind: type) -> Weights:
    """Document frequencies of all ids over all rows; as many numbers as the vocabulary reach the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(kinds, dtype=np.int64)
        for batch in batches:
            _, term, _ = _terms(*_flat(batch.column("ids"), kind), kinds)
            df += np.bincount(term, minlength=kinds)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["id", "df"])

    got = tokens.select("ids").mapInArrow(counted, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(kinds, dtype=np.int64)
    df[got["id"].to_numpy(np.int64)] = got["df"].to_numpy(np.int64)
    n = tokens.agg(F.count("*").alias("rows"), F.sum(F.octet_length("ids")).alias("bytes")).first()
    return Weights(df, n["rows"], (n["bytes"] or 0) / np.dtype(kind).itemsize / max(1, n["rows"]))


def route_ranks(weights: Weights, seeds: tuple[int, ...] = (1, 2)) -> np.ndarray:
    """For each seed the rank of every id in weighted min-hashing: the smallest of a row's ranks is its
    route, so two rows share a route with the share of weight that they have in common."""
    ids, out = np.arange(len(weights.idf), dtype=np.uint64), []
    for seed in seeds:
        u = (mix(ids + np.uint64(seed << 32)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
        out.append(np.where(weights.idf > 0, -np.log(u) / np.maximum(weights.idf, 1e-9), np.inf))
    return np.stack(out)


def routes(ids: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> list[np.ndarray]:
    """Each row's routes as numbers (one for all rows without terms of weight)."""
    smallest = (np.minimum.reduceat(r[ids], at[:-1]) if len(at) > 1 else np.zeros(0) for r in ranks)
    return [(mix(x.view(np.uint64)) >> np.uint64(1)).astype(np.int64) for x in smallest]


class Index:
    """BM25 postings of a shard, with the weights of the whole corpus; terms that only one of its
    documents has are left out, as they find nothing else here."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, weights: Weights):
        kinds, self.documents = len(weights.idf), len(at) - 1
        doc, term, tf = _terms(ids, at, kinds)
        use = (weights.idf[term] > 0) & (np.bincount(term, minlength=kinds)[term] >= 2)
        doc, term, tf = doc[use], term[use], tf[use]
        norm = K1 * (1 - B + B * np.diff(at) / max(1e-9, weights.mean))
        self.of_doc = np.searchsorted(doc, np.arange(self.documents + 1))
        self.term = term
        order = np.argsort(term.astype(np.uint16 if kinds <= 1 << 16 else np.int64), kind="stable")
        self.post_doc = doc[order]
        self.post = (weights.idf[term] * tf * (K1 + 1) / (tf + norm[doc]))[order]
        self.of_term = np.searchsorted(term[order], np.arange(kinds + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for the seed's terms."""
        asked = self.term[self.of_doc[seed] : self.of_doc[seed + 1]]
        at = _ranges(self.of_term[asked], self.of_term[asked + 1] - self.of_term[asked])
        return np.bincount(self.post_doc[at], self.post[at], self.documents)


def packing_order(index: Index, sizes: np.ndarray, same: np.ndarray, room: int, copies: np.ndarray | None = None) -> np.ndarray:
    """All entries of a shard's index in packing order, each as often as it has ``copies`` (None: one): a
    window's seed is the entry that the last window cut (or the first unused one); its best unused
    neighbours follow until it is full. An entry equal (``same``) to one that follows the seed
    waits until the others are used up, and then the first unused entry is the seed.

    A search ranks only what is unused and shares a term with the seed, and walks as many entries as it takes. Searches
    end with a full window or after a copy of every unused entry, so many equal texts cost no more than others.
    """
    left = np.ones(len(sizes), dtype=np.int64) if copies is None else copies.astype(np.int64)
    order, unused, filled, seed = [], np.arange(len(sizes)), 0, None
    total = int(left.sum())

    def use(entry: int) -> None:
        nonlocal filled
        order.append(entry)
        left[entry] -= 1
        filled += int(sizes[entry])

    while len(order) < total:
        unused = unused[left[unused] > 0]
        if seed is None:
            seed = int(unused[0])
            if len(unused) == 1:  # only copies of one entry are left
                order += [seed] * int(left[seed])
                break
            use(seed)
        free = -filled % room  # of the seed's window
        score = index.scores(seed)[unused]
        found, rest = np.flatnonzero(score > 0), np.flatnonzero(score <= 0)
        found = found[np.argsort(-score[found], kind="stable")]
        held, seed = {same[seed]}, None
        for entry in chain(unused[found], unused[rest]):
            if free <= 0:
                break
            if same[entry] in held:
                continue
            held.add(same[entry])
            use(int(entry))
            if sizes[entry] > free:
                seed = int(entry)  # cut by this window's end
            free -= min(free, int(sizes[entry]))
    return np.array(order)


def shard_order(ids: np.ndarray, at: np.ndarray, same: np.ndarray, weights: Weights, room: int) -> np.ndarray:
    """A shard's rows in packing order. Rows with equal ``same`` are copies of one entry of the index."""
    _, first, entry, copies = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
    by_place = np.argsort(first)  # entries in the order of their first rows
    first, copies = first[by_place], copies[by_place]
    number = np.empty(len(first), dtype=np.int64)
    number[by_place] = np.arange(len(first))
    size = np.diff(at)[first]
    index = Index(ids[_ranges(at[first], size)], np.concatenate([[0], np.cumsum(size)]), weights)
    order = packing_order(index, size, np.arange(len(first)), room, copies)
    rows = np.empty(len(order), dtype=np.int64)
    rows[np.argsort(order, kind="stable")] = np.argsort(number[entry], kind="stable")  # an entry's rows in turn
    return rows


def pack_shard(table: pa.Table, weights: Weights, kind: type, room: int, shard: int) -> dict[str, np.ndarray]:
    ids, at = _flat(table.column("ids"), kind)
    sizes = np.diff(at)
    order = shard_order(ids, at, table.column("same").to_numpy(), weights, room)
    ends = np.cumsum(sizes[order])
    total = int(ends[-1])
    # sequence bounds: full windows, then the rest in powers of two, so that nothing is padded
    full = total // room * room
    bounds, rest = list(range(0, full + 1, room)), total - full
    for bit in reversed(range(room.bit_length())):
        if rest >> bit & 1:
            bounds.append(bounds[-1] + (1 << bit))
    bounds = np.array(bounds)
    cuts = np.unique(np.concatenate([bounds, ends]))
    begin, length = cuts[:-1], np.diff(cuts)
    doc = np.searchsorted(ends, begin, side="right")
    sequence = np.searchsorted(bounds, begin, side="right") - 1
    start = begin - (ends - sizes[order])[doc]
    doc = order[doc]
    raw = ids.astype("<u4")
    crc = np.array([zlib.crc32(raw[a : a + n]) for a, n in zip(at[doc] + start, length)], dtype=np.int64)
    return {
        "row": doc, "start": start, "length": length, "ids_crc32": crc, "doc_tokens": sizes[doc],
        "sequence_id": sequence + np.int64(shard) * (1 << 20), "offset": begin - bounds[sequence],
        "ids": [raw[a : a + n] for a, n in zip(at[doc] + start, length)],
    }


def pack(docs: DataFrame, tokenizer: str, room: int = 2048, end_id: int = 1, shard_tokens: int = 1 << 20, with_ids: bool = False) -> DataFrame:
    """Packs every row of ``docs`` (doc_id, text) into sequences of ``room`` tokens.

    One row per piece of a document in a sequence: doc_id, start (the document's tokens before
    it), length, ids_crc32, doc_tokens (with the end token), sequence_id, offset, and with
    ``with_ids`` the piece's token ids. A null text is empty: one piece with the end token.

    Texts are tokenized once and written as ids. The index's terms are token ids, so document
    frequencies, number and mean length of all documents are one table of the vocabulary's size. Rows are
    routed to shards of about ``shard_tokens`` tokens by two of their own terms, drawn by weighted min-hashing:
    documents with much weight in common draw the same terms and lie side by side in the range
    partitioning (one shuffle; a frequent route is split by the second term, the text and the id). A
    shard has its own BM25 index with the corpus's weights, so no posting list outgrows a shard; a
    window's seed is followed by its best unused neighbours of the shard, in order of score,
    and the document that overflows the window is cut and seeds the next. Equal
    documents are one entry of the index with a number of copies, and aren't put into one window while there are others. Only a shard's last window can be
    short; it is cut into powers of two, which need no padding.

    Rows that repeat an id, and rows without one, are packed each for itself; an empty table gives none.
    """
    cache = WordTokens.of(tokenizer)
    kind, kinds = cache.kind, max(cache.tokenizer.get_vocab_size(), end_id + 1)
    tokens = materialize(token_ids(docs, tokenizer, end_id))
    weights = corpus_weights(tokens, kinds, kind)
    total = tokens.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # as long as the vocabulary
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = route_ranks(sent.value)
        for batch in batches:
            first, second = routes(*_flat(batch.column("ids"), kind), ranks)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first), pa.array(second)], ["doc_id", "ids", "same", "k1", "k2"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def emit(rows: list[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rows)
            got = pack_shard(table, sent.value, kind, room, shard)
            out = [table.column("doc_id").combine_chunks().take(pa.array(got["row"])), *(pa.array(got[c], pa.int64()) for c in names)]
            if with_ids:
                out.append(pa.array([x.astype(np.int32) for x in got["ids"]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", *names, *(["ids"] if with_ids else [])])

        held, size, shard = [], 0, TaskContext.get().partitionId() << 20
        for batch in batches:
            for part in slices(batch, "ids", shard_tokens * np.dtype(kind).itemsize // 4):
                held.append(part)
                size += part.column("ids").nbytes
                if size >= shard_tokens * np.dtype(kind).itemsize:
                    yield from emit(held, shard)
                    held, size, shard = [], 0, shard + 1
        if held:
            yield from emit(held, shard)

    order = ["k1", "k2", "same", "doc_id"]
    marked = tokens.withColumn("same", F.xxhash64("ids")).mapInArrow(routed, "doc_id long, ids binary, same long, k1 long, k2 long")
    shards = total // (shard_tokens * np.dtype(kind).itemsize) + 1
    dealt = marked.repartitionByRange(int(shards), *order).sortWithinPartitions(*order)
    schema = ", ".join(f"{c} long" for c in ["doc_id", *names]) + (", ids array<int>" if with_ids else "")
    return dealt.select("doc_id", "ids", "same").mapInArrow(packed, schema)


def op2_packing(docs: DataFrame) -> DataFrame:
    """The contract's digest for all documents."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
