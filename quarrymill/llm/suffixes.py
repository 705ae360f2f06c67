"""Suffix arrays over several short strings side by side, their run-length compressed Burrows-Wheeler transforms, and
longest common extensions; all on whole arrays.

Strings stand one after the other, each followed by a stop. Stops are smaller than every symbol and smaller the earlier
they stand; no two of them are equal, so nothing that is found reaches from one string into the next.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64


def _bits(n: int) -> int:
    return max(int(n), 1).bit_length()


def _ordered(group: np.ndarray, key: np.ndarray, key_bits: int) -> np.ndarray:
    """Order by (group, key) of numbers of known widths; one sort of packed numbers where they fit into 64 bits."""
    at, wide = _bits(len(group)), _bits(int(group[-1]))
    if at + wide + key_bits > 64:
        return np.lexsort((key, group))
    packed = (group.astype(_U) << _U(at + key_bits)) | (key.astype(_U) << _U(at)) | np.arange(len(group), dtype=_U)
    packed.sort()
    return (packed & _U((1 << at) - 1)).astype(np.int64)


def suffix_array(symbols: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and each one's place in that order. symbols: numbers from 0 on; stops: where the stops are.

    Prefix doubling: suffixes are sorted by their first h symbols, then by those of the suffix h on. What is already told
    apart takes no further part, so the work follows the repeats. The first sort takes as many symbols as fit.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = _bits(int(symbols.max()) + 1)
    h = max(1, 63 // bits)
    bare = symbols.astype(_U) + _U(1)
    bare[stops] = 0
    left = np.repeat(stops, np.diff(np.concatenate([[-1], stops]))) - np.arange(n) + 1
    key = bare.copy()
    for j in range(1, h):  # a stop stays the last symbol: what follows it counts as zeros
        key <<= _U(bits)
        inside = np.flatnonzero(left > j)
        key[inside] |= bare[inside + j]
    order = np.argsort(key, kind="stable")
    found = key[order]
    first = np.ones(n, bool)
    first[1:] = (found[1:] != found[:-1]) | (left[order[1:]] <= h)  # suffixes that end are in order of their stops
    rank = np.empty(n, np.int64)
    slots, active = np.arange(n), order
    while True:
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(first)))
        place = np.repeat(slots[starts], sizes)
        rank[active] = place
        open_ = np.repeat(sizes > 1, sizes)
        if not open_.any():
            return order, rank
        slots, active, place = slots[open_], active[open_], place[open_]
        group = np.concatenate([[0], np.cumsum(place[1:] != place[:-1])])
        then = rank[active + h]
        by = _ordered(group, then, _bits(n))
        active, group, then = active[by], group[by], then[by]
        order[slots] = active
        first = np.ones(len(active), bool)
        first[1:] = (group[1:] != group[:-1]) | (then[1:] != then[:-1])
        h *= 2


def extension(symbols: np.ndarray, stops: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols agree from a[k] and from b[k] on; a stop agrees with nothing."""
    pad = 1 << 12
    one = np.full(len(symbols) + pad, -1, np.int64)
    one[: len(symbols)] = symbols
    one[stops] = -1
    other = one.copy()
    other[other < 0] = -2
    out = np.zeros(len(a), np.int64)
    at = np.arange(len(a))
    step = 8
    while len(at):
        ahead = np.arange(min(step, pad))
        still = []
        for some in np.array_split(at, max(1, len(at) * len(ahead) // 1_000_000)):
            differs = one[(a[some] + out[some])[:, None] + ahead] != other[(b[some] + out[some])[:, None] + ahead]
            n = np.where(differs.any(axis=1), differs.argmax(axis=1), len(ahead))
            out[some] += n
            still.append(some[n == len(ahead)])
        at = np.concatenate(still)
        step *= 2
    return out


@dataclass
class RunIndex:
    """A run-length compressed Burrows-Wheeler transform with its samples.

    chars and sizes are the runs of the transform. heads and tails are the text positions of each run's first and last
    suffix, before[k] how many symbols the head of run k has in common with the suffix above it, after[k] those of its
    tail with the suffix below.
    """

    n: int
    chars: np.ndarray
    sizes: np.ndarray
    heads: np.ndarray
    tails: np.ndarray
    before: np.ndarray
    after: np.ndarray

    @staticmethod
    def build(symbols: np.ndarray, stops: np.ndarray) -> tuple[RunIndex, np.ndarray, np.ndarray]:
        """The index, and the suffix array and its inverse that it was built from (drop them to keep the runs only)."""
        order, rank = suffix_array(symbols, stops)
        bare = symbols.astype(np.int64) + 1
        bare[stops] = -np.arange(len(stops))  # no two stops make a run
        bwt = bare[order - 1]
        starts = np.concatenate([[0], np.flatnonzero(bwt[1:] != bwt[:-1]) + 1]) if len(bwt) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(bwt)))
        heads, tails = order[starts], order[starts + sizes - 1] if len(starts) else order
        between = extension(symbols, stops, tails[:-1], heads[1:])
        zero = np.zeros(min(1, len(starts)), np.int64)
        return RunIndex(len(symbols), bwt[starts], sizes, heads, tails, np.concatenate([zero, between]), np.concatenate([between, zero])), order, rank

    @property
    def above(self) -> np.ndarray:
        """For each text position, what its suffix has in common with the one above. Within a run it is one symbol less
        than that of the position before it, so the samples at run heads tell all of it."""
        return self._stream(self.heads, self.before)

    @property
    def below(self) -> np.ndarray:
        return self._stream(self.tails, self.after)

    def _stream(self, samples: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        reach = np.full(self.n, -1, np.int64)
        reach[samples] = samples + lengths
        last = np.zeros(self.n, np.int64)
        last[samples] = samples
        return reach[np.maximum.accumulate(last)] - np.arange(self.n)

    def matching_statistics(self) -> np.ndarray:
        """For each text position, the longest string from there on that also starts at another position."""
        return np.maximum(self.above, self.below)


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place, the next one of a smaller value; the number of values where there is none."""
    out = [len(values)] * len(values)
    open_: list[int] = []
    of: list[int] = []
    for i, v in enumerate(values.tolist()):
        while of and of[-1] > v:
            of.pop()
            out[open_.pop()] = i
        of.append(v)
        open_.append(i)
    return np.array(out, np.int64)


class Minimum:
    """Range minima by a sparse table."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values.astype(np.int32)]
        while 2 << (len(self.levels) - 1) <= len(values):
            w = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-w], self.levels[-1][w:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of values[lo] to values[hi], both included."""
        out = np.empty(len(lo), np.int64)
        level = np.frexp((hi - lo + 1).astype(float))[1] - 1
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][lo[at]], self.levels[k][hi[at] - (1 << k) + 1])
        return out
