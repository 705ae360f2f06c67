"""Token-id files: documents encoded with a local tokenizer, each compressed alone against a shared zstandard dictionary.

A set of files is a folder with three Parquet tables, so that writing is committed task by task and a lost executor
costs only its own tasks: `dictionary` (hash, bytes), `blocks` (documents in ascending doc_id order: frames one after
another in payload, with doc_ids, offsets and counts as index, and the dictionary's hash) and `parts` (ids before each
part). One document is read by its block's range of ids and its offset, without touching its neighbours.

Defined results: a null or blank text has only the end id; null ids come first; repeated rows are documents of their
own, ordered by content; an empty table gives empty files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import partitions
from quarrymill.scratch import scratch_path

END_ID = 1
#: The dictionary is fitted on so many documents (those with the smallest hash of their id), at most so many bytes of each.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 1024, 16_384, 65_536
#: A block is closed beyond so many bytes of frames.
BLOCK_BYTES = 4 << 20
#: Encoded words kept by a worker, twice so many at most.
MEMO_WORDS, MEMO_WORD_BYTES = 300_000, 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The character that byte-level tokenizers write for each byte: itself if printable, else one from 256 onward."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


#: What a tokenizer file has to say of normalising and splitting for words to be encoded one by one (fixed values).
_WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


def _is_wordwise(path: str) -> bool:
    """Whether the file is of the kind that WordEncoder takes apart: a BPE model behind the steps above."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    return plain and all(spec.get(k) == v for k, v in _WORDWISE.items()) and all(t["content"].startswith("<|") and not t["normalized"] for t in spec["added_tokens"])


class WordEncoder:
    """Encodes texts with the tokenizers library, word by word, remembering words; whole texts if the file is of another kind.

    The tokenizer drops white space and no token of it crosses white space, so a text's ids are those of its words in
    turn. Only ASCII white space parts words here (a subset of what the tokenizer drops), the rest it handles itself.
    A new word of Latin letters with ASCII punctuation around it is what the tokenizer splits into these parts; they
    are remembered in lower case, and go to the library's model as it writes them. All other words go to it whole.
    """

    #: Letters whose lower case is one composed letter, in the first Latin blocks.
    _PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]*)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.wordwise = Tokenizer.from_file(path), _is_wordwise(path)
        if not self.wordwise:
            return
        self.model = self.tokenizer.model
        self.memo, self.old = _Memo(self), {}
        self.parts, self.old_parts = {"": b""}, {}
        self.letters = {i: c for i, c in enumerate(_byte_letters())}
        self.stops = {x: _packed(self.tokenizer.encode(x.decode(), add_special_tokens=False).ids) for x in (b",", b".")}

    def _part(self, part: str) -> bytes:
        """Ids of letters alone or of punctuation alone, in lower case."""
        got = self.old_parts.get(part)
        if got is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            got = _packed([t.id for t in self.model.tokenize(shown)])
        self.parts[part] = got
        return got

    def _word(self, word: bytes) -> bytes:
        memo, low = self.memo, word.lower()  # of ASCII letters; the tokenizer takes both cases alike
        if low[-1:] in (b",", b".") and low[-2:-1].isalnum():
            got, end = memo.get(low[:-1]), self.stops[low[-1:]]
            if got is not None and b"<|" not in word:
                return got + end
        elif low != word and (got := memo.get(low)) is not None and b"<|" not in word:
            return got
        text, parts = word.decode(), self.parts
        m = self._PLAIN.fullmatch(text)
        if m is None or "<|" in text:
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        letters, rest = m[1].lower(), m[2]
        if not rest:
            return self._part(letters)
        a = parts.get(letters)
        if a is None:
            a = self._part(letters)
        b = parts.get(rest)
        if b is None:
            b = self._part(rest)
        return a + b

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if not self.wordwise:
            for text in texts:
                yield _packed(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)
            return
        for text in texts:
            if len(self.memo) > MEMO_WORDS:  # the young become old, the old are forgotten unless asked for again
                self.memo, self.old = _Memo(self), self.memo
            if len(self.parts) > MEMO_WORDS:
                self.parts, self.old_parts = {"": b""}, self.parts
            yield b"".join(map(self.memo.__getitem__, text.split()))


class _Memo(dict):
    """Words to ids; a new word is encoded when it is first asked for."""

    def __init__(self, encoder: WordEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: bytes) -> bytes:
        got = self.encoder.old.get(word)
        if got is None:
            got = self.encoder._word(word)
        if len(word) <= MEMO_WORD_BYTES:
            self[word] = got
        return got


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[slice, list[bytes]]]:
    """Parts of a batch of about 4 MB of text."""
    column = batch.column("text").cast(pa.binary())
    start, size, part = 0, 0, []
    for i, x in enumerate(column):
        part.append(x.as_py() or b"")
        size += len(part[-1])
        if size >= 4 << 20:
            yield slice(start, i + 1), part
            start, size, part = i + 1, 0, []
    if part:
        yield slice(start, len(column)), part


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """A dictionary fitted on serialized ids of a bounded sample; empty if there is too little to learn from."""
    import zstandard

    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct()
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text").limit(SAMPLE_DOCS)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for _, part in _texts(batch):
                yield pa.RecordBatch.from_arrays([pa.array([x[:SAMPLE_BYTES] for x in encode(part)], pa.binary())], ["ids"])

    samples = [bytes(r.ids) for r in rows.mapInArrow(ids, "ids binary").collect() if r.ids]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def dict_hash(raw: bytes) -> str:
    import hashlib

    return hashlib.sha256(raw).hexdigest()


def _codec(raw: bytes):
    import zstandard

    data = zstandard.ZstdCompressionDict(raw) if raw else None
    if data is not None:
        data.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=data), zstandard.ZstdDecompressor(dict_data=data)


_BLOCK = (
    "part int, seq int, first_id long, last_id long, start_in_part long, n_tokens long, dict_hash string, "
    "doc_ids array<long>, offsets array<long>, counts array<long>, payload binary"
)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> str:
    """Encode docs (doc_id, text) into files below path; returns path.

    Frames, not texts, are shuffled: ranges of doc_id get the rows of a part, a sort within the part orders them.
    Range bounds come from doc_id alone, so texts are encoded once.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    raw = train_dictionary(docs, tokenizer)
    key = dict_hash(raw)
    spark.createDataFrame([(key, raw)], "hash string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    n = 2 * partitions(spark)
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(10 * n))).first()[0] if n > 1 else None
    bounds = np.unique(np.asarray(cuts or [], np.int64))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, (press, _), end = encoder(tokenizer), _codec(raw), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            where = np.searchsorted(bounds, ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right")
            for at, part in _texts(batch):
                coded = [x + end for x in encode(part)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(where[at], pa.int32()), ids[at], pa.array([len(x) // 4 for x in coded], pa.int64()),
                        pa.array([zlib.crc32(x) for x in coded], pa.int64()), pa.array([press.compress(x) for x in coded], pa.binary()),
                    ],
                    ["part", "doc_id", "n", "tie", "frame"],
                )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = None, 0, 0
        rows: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal rows, size, seq, before
            counts = [r[1] for r in rows]
            offsets = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])])
            out = [part, seq, rows[0][0], rows[-1][0], before, sum(counts), key, [r[0] for r in rows], offsets.tolist(), counts, b"".join(r[2] for r in rows)]
            rows, size, seq, before = [], 0, seq + 1, before + sum(counts)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, kinds, strict=True)], names)

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "frame")]
            for p, doc, count, frame in zip(*cols, strict=True):
                if rows and (p != part or size >= block_bytes):
                    yield close()
                if p != part:
                    part, seq, before = p, 0, 0
                rows.append((doc, count, frame))
                size += len(frame)
        if rows:
            yield close()

    i64 = pa.int64()
    kinds = [pa.int32(), pa.int32(), i64, i64, i64, i64, pa.string(), pa.list_(i64), pa.list_(i64), pa.list_(i64), pa.binary()]
    names = [x.split()[0] for x in _BLOCK.split(", ")]
    coded = docs.select("doc_id", "text").mapInArrow(frames, "part int, doc_id long, n long, tie long, frame binary")
    ordered = coded.repartition("part").sortWithinPartitions("part", "doc_id", "n", "tie")
    ordered.mapInArrow(blocks, _BLOCK).write.parquet(f"{path}/blocks")
    sums = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts = np.concatenate([[0], np.cumsum([r.n for r in sums])])[:-1] if sums else []
    rows = [(r.part, int(s)) for r, s in zip(sums, starts, strict=True)]  # a row for each part: as many as partitions
    spark.createDataFrame(rows, "part int, start long").coalesce(1).write.parquet(f"{path}/parts")
    return path


def read(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian unsigned 32-bit) of all documents, or of one."""
    found = spark.read.parquet(f"{path}/dictionary").first()
    raw, key = bytes(found.bytes), found.hash
    if dict_hash(raw) != key:
        raise ValueError("the dictionary does not match its hash")
    starts = {r.part: r.start for r in spark.read.parquet(f"{path}/parts").collect()}
    blocks = spark.read.parquet(f"{path}/blocks")
    if doc_id is not None:
        blocks = blocks.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, press = _codec(raw)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_hash"] != key:
                    raise ValueError("a block was written with another dictionary")
                offsets, payload = row["offsets"], memoryview(row["payload"])
                at = starts[row["part"]] + row["start_in_part"] + np.concatenate([[0], np.cumsum(row["counts"])])
                take = [i for i, d in enumerate(row["doc_ids"]) if doc_id is None or d == doc_id]
                for k in range(0, len(take), 1024):
                    some = take[k : k + 1024]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["doc_ids"][i] for i in some], pa.int64()), pa.array(at[some], pa.int64()),
                            pa.array([row["counts"][i] for i in some], pa.int64()),
                            pa.array([press.decompress(payload[offsets[i] : offsets[i + 1]]) for i in some], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return blocks.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


def digest(docs: DataFrame) -> DataFrame:
    path = write(docs, scratch_path(docs.sparkSession, "tokens"))
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
