"""Words of many texts at once: numpy arrays over the UTF-8 bytes of Arrow string columns.

All functions work on a slice of about a megabyte of text, so their memory is bounded by the
slice and the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd multipliers of the two rolling hashes
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, up to a slice's length, for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, dtype=np.uint64)
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 2**64))])
        if n <= 2 * SLICE:
            _POWERS[base] = have
    return have[:n]


def rolling(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for many ranges; equal contents have equal hashes."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=sums[1:])
    back = _powers(pow(base, -1, 2**64), len(values) + 1)
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none) and the n+1 offsets of the texts in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(table: pa.Table | pa.RecordBatch, text: str, limit: int = SLICE) -> Iterator[pa.Table | pa.RecordBatch]:
    """Parts of the rows with at most ``limit`` bytes of text (or of a binary column) each, one row at least."""
    column = table.column(text)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.cumsum(lengths + 16)
    low = 0
    while low < len(sizes):
        before = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield table.slice(low, high - low)
        low = high


@dataclass
class Words:
    """``start``/``end`` byte ranges of words, ``ptr``: each text's first word (n+1), ``hash``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    hash: np.ndarray

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    @property
    def place(self) -> np.ndarray:
        """A word's position in its text."""
        return np.arange(len(self.start)) - np.repeat(self.ptr[:-1], np.diff(self.ptr))

    def windows(self, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether its text has that many."""
        last = np.repeat(self.ptr[1:], np.diff(self.ptr))
        at = np.arange(len(self.start))
        inside = at + n <= last
        values = mix(self.hash ^ np.uint64(salt)) if salt else self.hash
        return rolling(values, _STEP, at, np.minimum(at + n, len(at))), inside

    def bytes_of(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen words, each followed by a space, and the n+1 offsets of these."""
        size = self.end[chosen] - self.start[chosen] + 1
        to = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(self.start[chosen] - to[:-1], size) + np.arange(to[-1])
        out = self.data[np.minimum(source, max(len(self.data) - 1, 0))] if len(self.data) else np.zeros(0, np.uint8)
        out[to[1:] - 1] = 32
        return out, to


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def words(column: pa.Array | pa.ChunkedArray, lower: bool = False, space: np.ndarray = SPACE) -> Words:
    """``space`` says of each byte whether it parts words."""
    data, offsets = text_bytes(column)
    if lower:
        data = lower_ascii(data)
    inside = ~space[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    start = np.flatnonzero(inside & (~before | first[:-1]))
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    ptr = np.searchsorted(start, offsets)
    return Words(data, start, end, ptr, rolling(data.astype(np.uint64) + np.uint64(1), _BASE, start, end))


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value occurs in the ascending array."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


class Table:
    """Positions of 64-bit keys in an array of distinct keys: open addressing with numpy."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = np.uint64((1 << max(4, int(2 * len(keys)).bit_length())) - 1)
        self.slot = np.full(int(self.mask) + 1, -1, dtype=np.int32)
        at, todo = (mix(keys) & self.mask).astype(np.int64), np.arange(len(keys))  # mixed: keys may be plain numbers
        while len(todo):
            free = todo[self.slot[at[todo]] < 0]
            self.slot[at[free]] = free
            todo = todo[self.slot[at[todo]] != todo]
            at[todo] = (at[todo] + 1) & int(self.mask)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value in the keys, or -1."""
        out = np.full(len(values), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        at, todo = (mix(values) & self.mask).astype(np.int64), np.arange(len(values))
        while len(todo):
            row = self.slot[at[todo]]
            todo, row = todo[row >= 0], row[row >= 0]
            same = self.keys[row] == values[todo]
            out[todo[same]] = row[same]
            todo = todo[~same]
            at[todo] = (at[todo] + 1) & int(self.mask)
        return out


def distinct(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """One occurrence of each distinct word, and each word's number among these."""
    _, first, number = np.unique(w.hash, return_index=True, return_inverse=True)
    return first, number
