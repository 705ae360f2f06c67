"""Suffix-array dedup by a run-length index: byte strings of `width` that start anywhere else are cut out.

Spans that can hold such strings meet in blocks (passages.py). A block's spans, often alike, are indexed by a
run-compressed Burrows-Wheeler transform with the positions of each run's ends and what these have in common with
their neighbours; the suffix array itself is dropped. Matching statistics are streamed over the spans from these samples:
within a run, a position's longest match is one byte shorter than that of the position before it. Windows whose longest
match at another place has `width` bytes or more repeat, and every byte that such a window covers goes. Windows are
judged on the input, not on what is left of it; overlapping occurrences count, matches never cross documents.

Defined results: null and blank texts: a null text is empty, white space is bytes as others are. Texts below `width` lose
nothing. Rows with equal id and text are one document and no matches of each other; all other equal texts are. An empty
table gives an empty result; further columns pass through dedup(), whatever their names. Cutting bytes can split a
character: dedup(), whose text is a string, leaves the rest of such a character out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.packing import release
from quarrymill.llm.passages import Bytes, Plan, gone, lists, with_marks
from quarrymill.llm.suffixes import RunIndex

WIDTH = 400


def repeated(texts: list[bytes], n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Span, first byte and byte after the last of what is covered by windows that start at another place of these texts too.

    Each of a text's first n[i] positions is asked about: those are the windows that are the span's own.
    """
    sizes = np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(sizes + 1)
    index = RunIndex.build(np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8), ends - 1)[0]
    n = n.astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(of)) - (np.cumsum(n) - n)[of]
    long = index.matching_statistics()[(ends - sizes - 1)[of] + within] >= width
    of, within = of[long], within[long]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (within[1:] != within[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(of))[: len(first)] - 1
    return of[first], within[first], within[last] + width


def plan(width: int = WIDTH, **sizes: int) -> Plan:
    levels = (max(1, width * 4 // 25), max(1, width * 16 // 25), width)
    return Plan(Bytes, width, levels, repeated, earlier=False, **sizes)


def _kept(batch: pa.RecordBatch, ranges: str) -> Iterator[tuple[int, int, int, bytes]]:
    """Per row: bytes, removed bytes, removed runs, and what is left."""
    cut, (a, b) = lists(batch.column(ranges), "a", "b")
    for i, text in enumerate(batch.column("text").cast(pa.binary())):
        data = text.as_py() or b""
        if cut[i] == cut[i + 1]:
            yield len(data), 0, 0, data
            continue
        s = slice(int(cut[i]), int(cut[i + 1]))
        out = gone((a[s], b[s]), len(data))
        yield len(data), int(out.sum()), int(out[0]) + int(np.count_nonzero(out[1:] & ~out[:-1])), np.frombuffer(data, np.uint8)[~out].tobytes()


def spans(docs: DataFrame, width: int = WIDTH, **sizes: int) -> DataFrame:
    """doc_id, start and n_bytes of each maximal run of bytes that goes."""
    found, ranges = with_marks(docs.select("doc_id", "text"), plan(width, **sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, (a, b) = lists(batch.column(ranges), "a", "b")
            rows = []
            for i in np.flatnonzero(np.diff(cut)).tolist():
                s = slice(int(cut[i]), int(cut[i + 1]))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone((a[s], b[s]), int(b[s].max())), [0]])))
                rows += [(i, x, y - x) for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            at, start, n = zip(*rows, strict=True) if rows else ((), (), ())
            arrays = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_bytes"])

    return found.select(F.col("doc_id").cast("long").alias("doc_id"), ranges).mapInArrow(run, "doc_id long, start long, n_bytes long")


def dedup(docs: DataFrame, width: int = WIDTH, **sizes: int) -> DataFrame:
    """docs with text replaced by what is left of it, and n_chars (if there) by its length."""
    out = docs.withColumn("n_chars", F.col("n_chars").cast("long")) if "n_chars" in docs.columns else docs
    found, ranges = with_marks(out, plan(width, **sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x[3].decode(errors="ignore") for x in _kept(batch, ranges)]
            columns = {name: column for name, column in zip(batch.schema.names, batch.columns, strict=True) if name != ranges}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return found.mapInArrow(run, out.schema)


def digest(docs: DataFrame, width: int = WIDTH, **sizes: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    found, ranges = with_marks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), plan(width, **sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*x[:3], hashlib.sha256(x[3]).hexdigest()) for x in _kept(batch, ranges)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            arrays = [pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            release()

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
