"""Messages of aligned arrays from tasks to many receivers, in one step or in two.

A task that holds n records for b receivers would send min(n, b) messages: with more receivers than records a message
holds one record, and its header is what is sent. Beyond ROUTES receivers records go in two steps: a task sends each of
ROUTES routes one message, which says whose each record is; at the route, the messages of many tasks are put together
and sent on, HELD records at a time. So a record is sent once or twice, however many receivers there are (up to about
ROUTES times HELD), and a task holds no more than HELD records at either step.

A row is (key, kind, data): key is the receiver, or -1 and below for a route.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrymill.llm import textkernel as tk
from quarrymill.llm.packing import pack, release, runs, unpack

ROWS = "key long, kind int, data binary"
ROUTES = 1024
#: Records held at a route before they are sent on.
HELD = 700_000

Codec = tuple[Callable[..., bytes], Callable[[bytes], list[np.ndarray]]]


def table(rows: list[tuple]) -> pa.Table:
    key, kind, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.Table.from_arrays([pa.array(key, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["key", "kind", "data"])


def row_batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), 128):
        yield from table(rows[k : k + 128]).combine_chunks().to_batches()


class Router:
    """Sends records of several kinds; codecs: by kind, aligned arrays to bytes and back."""

    def __init__(self, codecs: dict[int, Codec], receivers: int, routes: int = ROUTES) -> None:
        self.codecs, self.receivers, self.routes, self.two_steps = codecs, receivers, routes, receivers > routes

    def send(self, kind: int, to: np.ndarray, *arrays: np.ndarray) -> list[tuple]:
        """Rows for records that go to receivers `to` (one for each record)."""
        to = to.astype(np.int64)
        encode = self.codecs[kind][0]
        if not self.two_steps:
            return self._split(kind, to, arrays)
        route = (tk.mix(to.view(np.uint64)) % np.uint64(self.routes)).astype(np.int64)
        order = np.lexsort((to, route))
        route, to, arrays = route[order], to[order], [a[order] for a in arrays]
        out = []
        for at, n in zip(*runs(route), strict=True):
            s = slice(at, at + n)
            start, count = runs(to[s])
            head = pack(to[s][start], count.astype(np.uint32))
            out.append((-1 - int(route[at]), kind, len(head).to_bytes(4, "little") + head + encode(*(a[s] for a in arrays))))
        return out

    def _split(self, kind: int, to: np.ndarray, arrays) -> list[tuple]:
        order = np.argsort(to, kind="stable")
        to, arrays = to[order], [a[order] for a in arrays]
        encode = self.codecs[kind][0]
        return [(int(to[at]), kind, encode(*(a[at : at + n] for a in arrays))) for at, n in zip(*runs(to), strict=True)]

    def _read(self, kind: int, data: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
        size = 4 + int.from_bytes(data[:4], "little")
        to, n = unpack(data[4:size])
        return np.repeat(to, n), self.codecs[kind][1](data[size:])

    def _on(self, held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for kind, parts in held.items():
            to = np.concatenate([p[0] for p in parts])
            yield from row_batches(self._split(kind, to, [np.concatenate(x) for x in zip(*(p[1] for p in parts), strict=True)]))
        held.clear()
        release()

    def regroup(self, incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of key: those of a route become rows of receivers; others pass."""
        held: dict[int, list] = {}
        size, route = 0, None
        for batch in incoming:
            for key, kind, data in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "data")), strict=True):
                if key >= 0:
                    yield from row_batches([(key, kind, data)])
                    continue
                if size >= HELD or key != route:
                    yield from self._on(held)
                    size, route = 0, key
                to, arrays = self._read(kind, data)
                held.setdefault(kind, []).append((to, arrays))
                size += len(to)
        yield from self._on(held)

    def delivered(self, rows: DataFrame) -> DataFrame:
        """rows with all of them addressed to receivers."""
        if not self.two_steps:
            return rows
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(self.regroup, ROWS)
