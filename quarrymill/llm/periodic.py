"""Periodic runs: stretches of words that repeat with a period, found by the runs theorem.

Every run of smallest period q has, under one of the two orders of an alphabet, its Lyndon root as the longest Lyndon
word that starts somewhere in it. The longest Lyndon word at a position reaches to the next smaller value of the inverse
suffix array, so two suffix arrays give all roots. A root is extended to its run by longest common extensions: minima of
the LCP array between two suffixes, from a sparse table, forwards in the words and backwards in the reversed words.

Only runs of EXPONENT periods and LEAST words are wanted. A word of such a run occurs EXPONENT times in its document at
least, so words that are rarer in their document part it into stretches, and stretches below LEAST words have no run.
What is left of some texts is laid side by side and indexed at once. Words are told apart by their bytes.

Everything is row by row: no shuffle, one scan. A text is taken whole, a long one alone: it needs some 30 bytes of memory
a byte, and 250 for each word in stretches of frequent words.

Defined results: null and blank texts have no words and no runs. Repeated rows are found alike. An empty table gives an
empty result; further columns, of any name, pass through collapse(). A null id is no number: digest() leaves such a row's
words as they are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm import textkernel as tk
from quarrymill.llm.packing import release
from quarrymill.llm.suffixes import Minimum, RunIndex, next_smaller, suffix_array

EXPONENT = 4
LEAST = 6


class _Extensions:
    """Longest common extensions of pairs of positions: LCP array and sparse table."""

    def __init__(self, symbols: np.ndarray, stops: np.ndarray) -> None:
        index, order, self.rank = RunIndex.build(symbols, stops)
        self.lcp = Minimum(index.above[order])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.rank[a], self.rank[b]
        return self.lcp.of(np.minimum(x, y) + 1, np.maximum(x, y))


def runs_of(symbols: np.ndarray, stops: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs with `exponent` periods (2 or more) and `least` symbols, by start and period.

    symbols are strings side by side, each followed by a stop.
    """
    n = len(symbols)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    forward = _Extensions(symbols, stops)
    _, turned = suffix_array(symbols.max() - symbols, stops)
    at, period = [], []
    string = np.searchsorted(stops, np.arange(n))
    for rank in (forward.rank, turned):
        p = next_smaller(rank) - np.arange(n)
        i = np.arange(n)
        i, p = i[i + p < n], p[i + p < n]
        # a wanted run's root stands there once more
        good = (string[i] == string[i + p]) & (symbols[i] == symbols[i + p]) & (i != stops[string[i]]) & (i + p != stops[string[i]])
        at.append(i[good])
        period.append(p[good])
    at, period = np.concatenate(at), np.concatenate(period)
    ahead = forward.of(at, at + period)
    # what agrees backwards: the reversed strings, whose stops end them again
    back = _Extensions(np.concatenate([symbols[::-1][1:], symbols[-1:]]), np.sort(np.append(n - 2 - stops[:-1], n - 1)))
    before = np.zeros(len(at), np.int64)
    inner = np.flatnonzero(at > 0)
    before[inner] = back.of(n - 2 - (at[inner] - 1), n - 2 - (at[inner] + period[inner] - 1))
    start, length = at - before, before + period + ahead
    good = (length >= exponent * period) & (length >= least)
    found = np.unique(np.stack([start[good], period[good], length[good]]), axis=1)
    return found[0], found[2], found[1]


def _frequent(ids: np.ndarray, doc: np.ndarray, exponent: int) -> np.ndarray:
    """Words that occur `exponent` times in their text."""
    if not len(ids):
        return np.zeros(0, bool)
    key = doc * (int(ids.max()) + 1) + ids
    found = np.sort(key)
    at = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    n = np.diff(np.append(at, len(found)))
    often = found[at[n >= exponent]]
    return often[np.minimum(np.searchsorted(often, key), len(often) - 1)] == key if len(often) else np.zeros(len(ids), bool)


def find(ids: np.ndarray, doc: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of texts side by side: words' numbers, and the text that each word is in."""
    often = _frequent(ids, doc, exponent)
    edge = np.ones(len(ids), bool)
    edge[1:] = (doc[1:] != doc[:-1]) | (often[1:] != often[:-1])
    starts = np.flatnonzero(edge)
    sizes = np.diff(np.append(starts, len(ids)))
    fit = often[starts] & (sizes >= least) if len(starts) else np.zeros(0, bool)
    starts, sizes = starts[fit], sizes[fit]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    # stretches side by side, each followed by a stop
    ends = np.cumsum(sizes + 1)
    stops = ends - 1
    place = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes - 1), sizes + 1)
    symbols = ids[np.minimum(place, len(ids) - 1)]
    symbols = np.unique(symbols, return_inverse=True)[1]
    start, length, period = runs_of(symbols, stops, exponent, least)
    return place[start], length, period


def _planted(ids: np.ndarray, bounds: np.ndarray, doc_ids: list[int | None]) -> np.ndarray:
    """For each word, the word that takes its place: every tenth document (by CRC-32 of its id) gets a periodic end."""
    source = np.arange(len(ids))
    for i, name in enumerate(doc_ids):
        start, n = int(bounds[i]), int(bounds[i + 1] - bounds[i])
        h = zlib.crc32(str(name).encode()) if name is not None else 1
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[start + a : start + n] = start + a + np.arange(n - a) % p
    return source


def _texts(batch: pa.RecordBatch, exponent: int, least: int, plant: bool):
    """Per text of the batch: row, its words as a list, the words that stay, and its runs (start, length, period)."""
    ids_of = batch.column("doc_id").to_pylist() if plant else [None] * batch.num_rows
    for rows, data, offsets in tk.chunks(batch):
        w = tk.words(data, offsets, lower=False)
        ids, bounds = w.ids, w.bounds
        source = _planted(ids, bounds, ids_of[rows]) if plant else np.arange(len(ids))
        start, length, period = find(ids[source], w.doc, exponent, least)
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + length, -1)
        stays = np.cumsum(edge[:-1]) == 0
        cut = np.searchsorted(start, bounds)
        for i in range(w.n_docs):
            a, b = int(bounds[i]), int(bounds[i + 1])
            words = data[offsets[i] : offsets[i + 1]].tobytes().split()
            if plant and np.any(source[a:b] != np.arange(a, b)):
                words = [words[k] for k in (source[a:b] - a).tolist()]
            s = slice(int(cut[i]), int(cut[i + 1]))
            yield rows.start + i, words, stays[a:b], start[s] - a, length[s], period[s]
        release()


def digest(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the longest run, runs_sha256 and collapsed_sha256.

    Documents whose id has a CRC-32 divisible by ten get a periodic end first, so that there are runs to be found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, words, stays, start, length, period in _texts(batch, exponent, least, plant=True):
                kept = b" ".join(words) if not len(start) else b" ".join(compress(words, stays.tolist()))
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
                best = (None,) * 4
                if len(start):
                    k = int(np.lexsort((period, start, -length))[0])
                    best = (int(start[k]), int(length[k]), int(period[k]), 1000 * int(length[k]) // int(period[k]))
                out.append((len(start), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            arrays = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """doc_id, start, length and period, in words, of each run of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, _, start, length, period in _texts(batch, exponent, least, plant=False):
                if len(start):
                    ids = pa.array([batch.column("doc_id")[row].as_py()] * len(start), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (start, length, period))], ["doc_id", "start", "length", "period"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """docs with the words of each run after its first period left out; texts without runs stay as they are, others have
    their words joined by one space. n_chars, if there, follows."""
    count = "n_chars" in docs.columns
    docs = docs.withColumn("n_chars", F.col("n_chars").cast("long")) if count else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for row, words, stays, start, _, _ in _texts(batch, exponent, least, plant=False):
                if len(start):
                    texts[row] = b" ".join(compress(words, stays.tolist())).decode()
            names, columns = batch.schema.names, list(batch.columns)
            columns[names.index("text")] = pa.array(texts, pa.string())
            if count:
                columns[names.index("n_chars")] = pa.array([len(t or "") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
