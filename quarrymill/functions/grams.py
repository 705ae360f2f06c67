"""Keys by which texts that hold a string are found: least hashes of the grams in each of their windows of bytes.

Every window of `width` bytes picks the least hash of its grams, so a text that holds a string picks all that the
string's own windows pick, wherever it stands and whatever surrounds it. Widths below 16 have one gram a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTHS = (1, 2, 4, 8, 16, 32, 64)
#: Bytes of text that are hashed at a time, however long a text is.
CHUNK = 1 << 18
_U = np.uint64
_BYTES = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=_U)
_ODD = _U(0x9E3779B97F4A7C15)


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of data[i:i + n] at each i; n: a power of two."""
    out, k = _BYTES[data], 1
    while k < n:
        out = out[:-k] * _ODD + out[k:]
        out ^= out >> _U(29)
        k *= 2
    return out


def picked(data: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text and key of what the windows of texts side by side pick, each key once a text and chunk; bounds: where texts begin and end."""
    gram = width if width < 16 else width // 2
    size = width - gram + 1
    for low in range(int(bounds[0]), int(bounds[-1]), CHUNK):
        least, span = _grams(data[low : min(low + CHUNK + width - 1, int(bounds[-1]))], gram), 1
        while span < size:
            step = min(span, size - span)
            least, span = np.minimum(least[:-step], least[step:]), span + step
        if not len(least):
            continue
        new = np.ones(len(least), bool)
        np.not_equal(least[1:], least[:-1], out=new[1:])
        begin = bounds[np.searchsorted(bounds, low) : np.searchsorted(bounds, low + len(least))] - low
        new[begin] = True
        at = np.flatnonzero(new)
        of = np.searchsorted(bounds, at + low, "right") - 1
        inside = at + low + width <= bounds[of + 1]
        of, key = of[inside], least[at[inside]] ^ _U(width * int(_ODD) % (1 << 64))
        order = np.lexsort((key, of))
        of, key = of[order], key[order]
        first = np.ones(len(of), bool)
        first[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
        yield of[first], key[first].view(np.int64)


def keys(rows: DataFrame, id: str, text: str, widths: list[int] | tuple[int, ...] = WIDTHS, own: bool = False) -> DataFrame:
    """id, width and key of what texts pick by each width; own: by the largest one alone that is not above the text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text).cast(pa.large_string()).fill_null("")
            bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            most = np.array(widths)[np.maximum(np.searchsorted(widths, np.diff(bounds), "right") - 1, 0)]
            for width in widths:
                for of, key in picked(data, bounds, width):
                    if own:
                        of, key = of[most[of] == width], key[most[of] == width]
                    arrays = [batch.column(id).take(pa.array(of)), pa.array(np.full(len(of), width, np.int32)), pa.array(key)]
                    yield pa.RecordBatch.from_arrays(arrays, [id, "width", "key"])

    kind = rows.schema[id].dataType.simpleString()
    return rows.select(id, text).mapInArrow(run, f"{id} {kind}, width int, key long")
