"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Spans of documents that can hold a window of `window` words which starts earlier meet in blocks (passages.py); copies of
one span are one, at the place where it starts first. A block is indexed by the suffix array of its spans' words, told
apart by their bytes, with longest common prefixes. Every span is parsed greedily from left to right against all that
stands earlier in its block: a factor is the longest string of words from a position on that also starts earlier (its
nearest earlier neighbours in suffix order tell which), or one word where there is none. Factors of `window` words or
more are duplicate spans. At factor boundaries the windows that lie across are looked up as well, and those that start
earlier, too, begin factors of their own, so what is cut is exact. Windows are judged on the input, not on what is left.

A window's span holds all of its words, and an earlier place of it is in a span of the same block, so nothing is asked of
other blocks. factors() joins factors of spans beside each other where they go on in the same source.

Defined results: null and blank texts have no words and lose none; texts shorter than a window lose none. Rows with equal
id and text are one document and lose the same words, none because of each other; other texts of the same id are
documents of their own, and null ids are no names (passages.py has their order). An empty table gives an empty result;
further columns pass through dedup() untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm import textkernel as tk
from quarrymill.llm.packing import release
from quarrymill.llm.passages import Plan, Words, gone, lists, with_marks
from quarrymill.llm.suffixes import Minimum, RunIndex, next_smaller

WINDOW = 20


def longest_earlier(symbols: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position, the length of the longest string from there on that starts earlier as well, and where.

    Of all earlier positions, the one above and the one below in suffix order have most in common with it.
    """
    index, order, rank = RunIndex.build(symbols, stops)
    n = len(order)
    common = Minimum(index.above[order])
    below = next_smaller(order)
    above = n - 1 - next_smaller(order[::-1])[::-1]
    length, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.arange(n)
    for other, there, low, high in ((above, above >= 0, above + 1, at), (below, below < n, at + 1, below)):
        k = np.flatnonzero(there)
        found = common.of(low[k], high[k])
        better = found > length[k]
        length[k[better]], source[k[better]] = found[better], order[other[k[better]]]
    return length[rank], source[rank]


def parse(length: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors of strings [starts[i], ends[i]): string and position of each, in no order; all strings a step at a time."""
    of, at = np.arange(len(starts)), starts.copy()
    found = []
    while len(of):
        inside = at < ends[of]
        of, at = of[inside], at[inside]
        found.append((of, at))
        at = at + np.maximum(length[at], 1)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (of, at)


def duplicate_factors(texts: list[bytes], n: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Factors of `width` words or more of spans in order of their documents: span, first word, word after the last, and
    span and word of the source."""
    sizes = np.array([len(x) for x in texts], np.int64)
    data = np.frombuffer(b" ".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    offsets[-1] -= 1
    w = tk.words(data, offsets, lower=False)
    count = np.diff(w.bounds)
    stops = np.cumsum(count + 1) - 1
    starts = stops - count
    symbols = np.zeros(int(stops[-1]) + 1, np.int64)
    is_word = np.ones(len(symbols), bool)
    is_word[stops] = False
    symbols[is_word] = w.ids
    length, source = longest_earlier(symbols, stops)
    span, at = parse(length, starts, stops)
    whole = length[at] >= width
    # windows that a boundary between factors cuts are looked up as well
    inner = at > starts[span]
    cut = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(cut, np.maximum(at[inner] - width + 1, starts[span[inner]]), 1)
    np.add.at(cut, at[inner], -1)
    across = np.flatnonzero((np.cumsum(cut[:-1]) > 0) & (length >= width))
    if len(across):  # of neighbours with neighbouring sources the first has all
        new = np.ones(len(across), bool)
        new[1:] = (across[1:] != across[:-1] + 1) | (source[across[1:]] != source[across[:-1]] + 1)
        across = across[new]
    at = np.concatenate([at[whole], across])
    span = np.searchsorted(stops, at)
    ref = np.searchsorted(stops, source[at])
    return span, at - starts[span], at - starts[span] + length[at], ref, source[at] - starts[ref]


def plan(window: int = WINDOW, **sizes: int) -> Plan:
    levels = (max(1, window * 2 // 5), max(1, window * 7 // 10), window)
    return Plan(Words, window, levels, duplicate_factors, earlier=True, **sizes)


def _kept(batch: pa.RecordBatch, ranges: str) -> Iterator[tuple[int, int, bytes]]:
    """Per row: words, removed words, and the kept words joined by one space."""
    cut, (a, b) = lists(batch.column(ranges), "a", "b")
    for i, text in enumerate(batch.column("text").cast(pa.binary())):
        words = (text.as_py() or b"").split()
        if cut[i] == cut[i + 1]:
            yield len(words), 0, b" ".join(words)
            continue
        s = slice(int(cut[i]), int(cut[i + 1]))
        out = gone((a[s], b[s]), len(words))
        yield len(words), int(out.sum()), b" ".join(compress(words, (~out).tolist()))


def dedup(docs: DataFrame, window: int = WINDOW, **sizes: int) -> DataFrame:
    """docs with text replaced by the kept words, joined by one space, and n_chars (if there) by its length."""
    out = docs.withColumn("n_chars", F.col("n_chars").cast("long")) if "n_chars" in docs.columns else docs
    found, ranges = with_marks(out, plan(window, **sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x[2].decode() for x in _kept(batch, ranges)]
            columns = {name: column for name, column in zip(batch.schema.names, batch.columns, strict=True) if name != ranges}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            release()

    return found.mapInArrow(run, out.schema)


def _joined(a: np.ndarray, b: np.ndarray, ref: np.ndarray, ref_start: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Factors (start, n_words, ref, ref_start), those that go on in the same source made one; longest of each first."""
    shift = ref_start - a
    order = np.lexsort((-b, a, shift, ref))
    a, b, ref, shift = a[order], b[order], ref[order], shift[order]
    k = 0
    while k < len(a):
        start, end, first = a[k], b[k], k
        while k + 1 < len(a) and ref[k + 1] == ref[first] and shift[k + 1] == shift[first] and a[k + 1] <= end:
            k += 1
            end = max(end, b[k])
        yield int(start), int(end - start), int(ref[first]), int(start + shift[first])
        k += 1


def factors(docs: DataFrame, window: int = WINDOW, **sizes: int) -> DataFrame:
    """The duplicate spans: doc_id, start and n_words of each factor, and where it starts earlier (ref_id, ref_start)."""
    found, ranges = with_marks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), plan(window, **sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, fields = lists(batch.column(ranges), "a", "b", "ref", "ref_start")
            rows = [(i, *x) for i in np.flatnonzero(np.diff(cut)).tolist() for x in _joined(*(f[cut[i] : cut[i + 1]] for f in fields))]
            at, start, n, ref, ref_start = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5
            columns = [batch.column("doc_id").take(pa.array(at)), pa.array(start), pa.array(n), pa.array(ref, mask=ref < -(1 << 62)), pa.array(ref_start)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_words", "ref_id", "ref_start"])

    return found.select("doc_id", ranges).mapInArrow(run, "doc_id long, start long, n_words long, ref_id long, ref_start long")


def digest(docs: DataFrame, window: int = WINDOW, **sizes: int) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""
    found, ranges = with_marks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), plan(window, **sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, out, hashlib.sha256(kept).hexdigest()) for n, out, kept in _kept(batch, ranges)]
            n, out, sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(out, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
            release()

    return found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
