"""Media columns: texts as 8-bit WAV sound, short-time Fourier transforms, spectral-peak pair fingerprints.

The transform is in fixed point: samples and windowed sines are small whole numbers whose sums 32-bit floats hold
exactly, so a sound has the same peaks wherever and beside whatever it is computed.

A sound is heard with HOP samples of silence before and after it, so that the shortest has three frames.

Defined results: a null text is empty, and an empty one is 192 spaces; equal texts give equal values; an empty table
gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

UNIT, RATE = 192, 8000
FRAME, HOP = 192, 96
#: Peaks per frame, and frames ahead that a peak is paired with.
PEAKS, AHEAD = 2, 3
#: Samples are transformed about so many at a time.
CHUNK = 1 << 18

_n = np.arange(FRAME)
_hann = 0.5 - 0.5 * np.cos(2 * np.pi * _n / FRAME)
_angles = 2 * np.pi * np.outer(_n, np.arange(FRAME // 2 + 1)) / FRAME
_COS, _SIN = (np.rint(127 * _hann[:, None] * f(_angles)).astype(np.float32) for f in (np.cos, np.sin))


def payload(text: bytes) -> bytes:
    """The text padded with spaces to a positive multiple of UNIT."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return r.readframes(r.getnframes())


def power(samples: np.ndarray) -> np.ndarray:
    """Power of each frame (HOP apart) in each of FRAME / 2 + 1 bands, exact whole numbers."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP].astype(np.float32) - np.float32(128)
    re, im = (frames @ _COS).astype(np.float64), (frames @ _SIN).astype(np.float64)
    return re * re + im * im


def peak_pairs(spectrum: np.ndarray, first_frame: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(frame, code) of pairs of peaks, in order of frame; code = band << 9 | later band << 2 | frames between.

    A peak is a band stronger than the one below and no weaker than the one above; a frame keeps its PEAKS strongest,
    of equal ones the lower, and silent frames have none.
    """
    inner = spectrum[:, 1:-1]
    strength = np.where((inner > spectrum[:, :-2]) & (inner >= spectrum[:, 2:]), inner, 0.0)
    bands, there = [], []
    rows = np.arange(len(spectrum))
    for _ in range(PEAKS):
        best = strength.argmax(axis=1)
        there.append(strength[rows, best] > 0)
        bands.append(best.astype(np.int64) + 1)
        strength[rows, best] = 0.0
    at, codes = [], []
    for gap in range(1, AHEAD + 1):
        if len(rows) <= gap:
            break
        for a in range(PEAKS):
            for b in range(PEAKS):
                ok = there[a][:-gap] & there[b][gap:]
                at.append(rows[:-gap][ok])
                codes.append((bands[a][:-gap] << 9 | bands[b][gap:] << 2 | gap)[ok])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, codes = np.concatenate(at), np.concatenate(codes)
    order = np.lexsort((codes, at))
    return at[order] + first_frame, codes[order]


def fingerprint(samples: bytes) -> np.ndarray:
    """Time-coded fingerprints of one sound: frame << 16 | code, ascending.

    Frame 0 begins HOP samples before the sound. Long sounds are transformed in overlapping parts: a part's last AHEAD
    frames only serve as partners.
    """
    data = np.pad(np.frombuffer(samples, np.uint8), HOP, constant_values=128)
    n_frames = (len(data) - FRAME) // HOP + 1
    step = max(1, CHUNK // HOP)
    found = []
    for start in range(0, n_frames, step):
        end = min(n_frames, start + step + AHEAD)
        at, codes = peak_pairs(power(data[start * HOP : (end - 1) * HOP + FRAME]), start)
        mine = at < start + step
        found.append((at[mine] << 16) | codes[mine])
    return np.concatenate(found)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bytes, bytes, bytes]]:
    for batch in batches:
        for doc, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary()), strict=True):
            raw = text.as_py() or b""
            stored = to_wav(payload(raw))
            yield doc.as_py(), raw, stored, from_wav(stored)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, media (WAV) and fingerprints (array<long>, time-coded) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, _, stored, back in _rows(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc], pa.int64()), pa.array([stored], pa.binary()), pa.array([fingerprint(back)], pa.list_(pa.int64()))],
                ["doc_id", "media", "fingerprints"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary, fingerprints array<long>")


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(docs: DataFrame) -> DataFrame:
    """Per row what was stored and read back; feature is the number of fingerprints and their array's SHA-256."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in _DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for doc, raw, stored, back in _rows(batches):
            marks = fingerprint(back)
            sha = lambda x: hashlib.sha256(x).hexdigest()
            rows.append((doc, len(raw), len(back), sha(back), zlib.crc32(back[-16:]), len(stored), sha(stored), f"{len(marks)}:{sha(marks.astype('<i8').tobytes())}"))
            if len(rows) >= 2048:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, _DIGEST)
