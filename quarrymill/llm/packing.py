"""Arrays packed into one binary value, so that millions of small records shuffle as a few rows."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=1)
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray, raw: tuple[int, ...] = ()) -> bytes:
    """Arrays as bytes. Those whose position is in `raw` (hashes) are stored as they are, the others plane by plane and compressed."""
    head, body = [], []
    for i, a in enumerate(arrays):
        a = np.ascontiguousarray(a)
        data = a.tobytes() if i in raw else _zstd()[0].compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) if len(a) else b""
        head.append(struct.pack("<4sqq?", a.dtype.str.encode().ljust(4), len(a), len(data), i in raw))
        body.append(data)
    return struct.pack("<i", len(arrays)) + b"".join(head) + b"".join(body)


def unpack(blob: bytes) -> list[np.ndarray]:
    n = struct.unpack_from("<i", blob)[0]
    size = struct.calcsize("<4sqq?")
    at, out = 4 + n * size, []
    for i in range(n):
        kind, count, length, raw = struct.unpack_from("<4sqq?", blob, 4 + i * size)
        dtype = np.dtype(kind.decode().strip())
        data = blob[at : at + length]
        at += length
        if raw or not count:
            out.append(np.frombuffer(data, dtype, count))
        else:
            planes = np.frombuffer(_zstd()[1].decompress(data), np.uint8).reshape(dtype.itemsize, count)
            out.append(np.ascontiguousarray(planes.T).view(dtype).ravel())
    return out


@lru_cache(maxsize=1)
def _trim():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def release() -> None:
    """Give freed memory back to the system: a worker that is done with large arrays lives on beside others."""
    _trim()(0)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal neighbours begins, and how long it is."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return starts, np.diff(np.append(starts, len(keys)))
