"""Words and shingles of many texts at once, on Arrow's own buffers.

Hashes are 64 bits wide. A word's hash is a polynomial over random numbers for its bytes, mixed with its length; a
shingle's hash is one over its words' hashes. Texts are taken in chunks of about CHUNK bytes, a longer text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTES = _BYTE.copy()  # white space counted
_BYTE[_BLANK] = 0
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE, _STEP, _LENGTH = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        table = np.full(max(n, 256), _BASE, np.uint64)
        table[0] = 1
        _powers = np.multiply.accumulate(table)
    return _powers


def inverse_powers(n: int) -> np.ndarray:
    """Powers of the number that undoes _BASE, modulo 2^64."""
    global _inverses
    if len(_inverses) < n:
        table = np.full(max(n, 256), pow(int(_BASE), -1, 1 << 64), np.uint64)
        table[0] = 1
        _inverses = np.multiply.accumulate(table)
    return _inverses


@dataclass
class Words:
    """Words of several texts: bytes [start, end) of data, and the text that each is in (0, 1, ...)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    n_docs: int
    lower: bool

    @property
    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        first = self.starts[0]
        data = self.data[first:]
        starts = self.starts - first
        # position within the word, of each byte; what follows a word counts on, with value 0
        within = np.arange(len(data), dtype=np.int64)
        within -= np.repeat(starts, np.diff(np.append(starts, len(data))))
        longest = int((self.ends - self.starts).max())
        np.minimum(within, longest, out=within)
        values = (_LOWER if self.lower else _BYTE)[data] * _power_table(longest + 1)[within]
        return mix(np.add.reduceat(values, starts) + (self.ends - self.starts).astype(np.uint64) * _LENGTH)

    @property
    def ids(self) -> np.ndarray:
        """Equal numbers for equal words, which are told apart by their bytes."""
        lengths = self.ends - self.starts
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        at = np.zeros(len(self.data) + 1, np.int8)
        at[self.starts] = 1
        at[self.ends] -= 1
        packed = np.ascontiguousarray(self.data[np.cumsum(at[:-1], dtype=np.int8).view(bool)])
        made = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
        return made.dictionary_encode().indices.to_numpy().astype(np.int64)

    @property
    def bounds(self) -> np.ndarray:
        """Words of text i are [bounds[i], bounds[i + 1])."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool, blank: np.ndarray = _BLANK) -> Words:
    """Text i is data[offsets[i]:offsets[i + 1]]; words never reach from one text into the next. blank: bytes between words."""
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = len(offsets) - 1
    solid = ~blank[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    full = offsets[:-1] < offsets[1:]
    at = offsets[:-1][full]
    first[at] = solid[at]
    at = offsets[1:][full] - 1
    last[at] = solid[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    return Words(data, starts, ends, doc, n, lower)


def shingle(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of hashes[i:i + k] at each i; the last k - 1 positions have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += hashes[j : n + j]
    return mix(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, data, offsets) of consecutive rows with about `size` bytes of text."""
    if not batch.num_rows:
        return
    data, offsets = buffers(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield slice(start, end), data, offsets[start : end + 1]
        start = end


def parts_of(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys (0 to n - 1) together, and where each key begins in it."""
    order = np.argsort(keys, kind="stable")
    return order, np.searchsorted(keys[order], np.arange(n + 1))
