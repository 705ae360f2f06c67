"""Byte-level BPE with a local rank file: encoding, and decoding to raw bytes.

Long texts are cut before encoding, at places that no match of the pattern crosses: before white space that follows
other characters. (No alternative of the pattern holds a space after a non-space, and a run of white space stays
whole.) So pieces encode exactly as the whole text does, in bounded memory.

Defined results: a null text is empty and has no ids; empty texts give n_tokens 0 and the digests of empty input;
repeated rows give equal rows; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts longer than this many characters are encoded piece by piece.
PIECE_CHARS = 1 << 16
_CUT = re.compile(r"(?<=\S)(?=\s)")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    """One encoder a worker process; the file is read as bytes from where each node has it."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in parts of about `size` characters, cut at safe boundaries only; one part if there is none."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(enc, text: str) -> list[int]:
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for part in pieces(text):
        out += enc.encode_ordinary(part)
    return out


def encode_column(docs: DataFrame, ranks: str | None = None, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with the ids of a text column as array<int>."""
    path = ranks or default_ranks()

    @F.arrow_udf("array<int>")
    def ids(col: pa.Array) -> pa.Array:
        enc = encoder(path)
        return pa.array([encode(enc, t or "") for t in col.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(into, ids(F.col(text)))


def decode_column(docs: DataFrame, ranks: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """docs with the raw bytes that an array of ids stands for; they need not be valid UTF-8."""
    path = ranks or default_ranks()

    @F.arrow_udf("binary")
    def raw(col: pa.Array) -> pa.Array:
        enc = encoder(path)
        return pa.array([enc.decode_bytes(x or []) for x in col.to_pylist()], pa.binary())

    return docs.withColumn(into, raw(F.col(ids)))


def digest(docs: DataFrame, ranks: str | None = None, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """The `keep` columns, n_tokens, ids (if asked for), ids_sha256 and decoded_sha256 of each row.

    Texts are encoded and decoded in one visit to a Python worker.
    """
    path = ranks or default_ranks()
    made = [("n_tokens", "long", pa.int64()), *[("ids", "array<int>", pa.list_(pa.int32()))] * with_ids]
    made += [("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    names = [*keep, *(m[0] for m in made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        digits = [str(i) for i in range(enc.max_token_value + 1)]
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                rows = []
                for text in batch.column("text"):
                    ids = encode(enc, text.as_py() or "")
                    shas = [hashlib.sha256(x).hexdigest() for x in (" ".join([digits[i] for i in ids]).encode(), enc.decode_bytes(ids))]
                    rows.append((len(ids), *[ids] * with_ids, *shas))
                columns = [pa.array(c, m[2]) for c, m in zip(zip(*rows, strict=True), made, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names)

    kept = docs.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{m[0]} {m[1]}" for m in made)])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
