"""Target-distribution importance resampling: draw documents whose hashed n-grams look like a target collection's.

Identical texts are collapsed by grouping on the full text: features and weight are computed once for each distinct text.
The counts that a text gives to its buckets are multiplied by its number of copies, so the corpus counts are those of all
documents. Weights go back to the documents by the text's SHA-256, and only then does each document get the noise of its
own id. Grouping combines in each task first, so a text in a third of all rows is one row a task, and the join back is
one by key, whose hot keys Spark splits.

A task sums its features to one count a bucket before anything is shuffled. The driver holds one number for each bucket
(`buckets`, a parameter) and counts, nothing that grows with documents.

Defined results: null and blank texts have no words, no features and weight 0, and are never drawn. Documents of equal
score stand in order of doc_id, null ids first; rows of one id have the same noise, and a null id draws as the id "null".
An empty collection draws nothing; an empty target has counts of 0. Further columns, of any name, pass through draw().
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.code_columns import number_rows
from quarrymill.llm import textkernel as tk
from quarrymill.llm.common import fresh
from quarrymill.scratch import materialize

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: bytes that are part of no word, after lower-casing: ASCII but digits and a-z
_BLANK = np.zeros(256, bool)
_BLANK[:128] = True
_BLANK[48:58] = _BLANK[97:123] = False
_CRC = np.array([zlib.crc32(bytes([b ^ 255])) ^ 0xFF000000 for b in range(256)], np.uint32)
#: longer slices are few, and are summed by the library one by one
_LOCKSTEP = 48


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of many slices of bytes, all slices' next byte at a time."""
    lengths = np.minimum(ends - starts, _LOCKSTEP + 1).astype(np.uint16)
    order = np.argsort(_LOCKSTEP + 1 - lengths, kind="stable")
    at, lengths = starts[order], lengths[order]
    active = len(at) - np.searchsorted(lengths[::-1], np.arange(_LOCKSTEP), "right")
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for j, m in enumerate(active.tolist()):
        if not m:
            break
        now = crc[:m]
        crc[:m] = _CRC[(now ^ data[at[:m] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out = np.empty(len(at), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(ends - starts > _LOCKSTEP):
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def features(data: np.ndarray, offsets: np.ndarray, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, features of each text, and all features' buckets in order of the texts."""
    low = _LOWER[data[offsets[0] : offsets[-1]]]
    w = tk.words(low, offsets - offsets[0], lower=False, blank=_BLANK)
    size = np.diff(w.bounds)
    # words side by side with one space between them: a run of words is one slice
    lengths = w.ends - w.starts
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    packed = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    take = ~_BLANK[low]
    place = np.ones(len(packed), bool)
    place[ends] = False
    packed[place] = low[take]
    found, of = [], []
    for k in range(1, most + 1):
        first = np.flatnonzero(w.doc[: len(starts) - k + 1] == w.doc[k - 1 :]) if len(starts) >= k else np.zeros(0, np.int64)
        found.append(crc32(packed, starts[first], ends[first + k - 1]) % np.uint32(buckets))
        of.append(w.doc[first])
    if most == 1:
        return size, size, found[0]
    found, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return size, np.bincount(of, minlength=len(size)), found[order]


def _featured(most: int, buckets: int):
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, copies = batch.column("key"), batch.column("copies")
            for rows, data, offsets in tk.chunks(batch):
                n_words, n, found = features(data, offsets, most, buckets)
                found = found.astype(kind)
                cut = np.concatenate([[0], np.cumsum(n)]).tolist()
                packed = pa.array([found[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())
                long = [pa.array(x, pa.int64()) for x in (n_words, n)]
                yield pa.RecordBatch.from_arrays([keys[rows], copies[rows], *long, packed], ["key", "copies", "n_words", "n_features", "found"])

    return run, kind


def _read(batch: pa.RecordBatch, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch's rows, and where each row's begin."""
    _, offs, data = batch.column("found").buffers()
    column = batch.column("found")
    offsets = np.frombuffer(offs, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    if data is None:
        return np.zeros(0, kind), offsets // size
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind), (offsets - offsets[0]) // size


def _sums(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[cut[1:]] - total[cut[:-1]]


def _count(kind: type, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            found, cut = _read(batch, kind)
            copies = np.repeat(batch.column("copies").to_numpy(), np.diff(cut))
            order = np.argsort(found, kind="stable")
            held += _sums(copies[order], np.searchsorted(found[order], np.arange(buckets + 1)))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["bucket", "n"])

    return run


def _distinct(texts: DataFrame, most: int, buckets: int, name: str) -> tuple[DataFrame, type]:
    """A row for each distinct text: key, copies, n_words, n_features and its features' buckets; written once."""
    run, kind = _featured(most, buckets)
    groups = texts.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    rows = groups.select(F.sha2("text", 256).alias("key"), "copies", "text")
    return materialize(rows.mapInArrow(run, "key string, copies long, n_words long, n_features long, found binary"), name), kind


def _bucket_counts(found: DataFrame, kind: type, buckets: int) -> np.ndarray:
    rows = found.select("copies", "found").mapInArrow(_count(kind, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.collect():  # a row a bucket
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of each bucket."""
    buckets = len(corpus)
    s, t, all_s, all_t = corpus.astype(float), target.astype(float), float(corpus.sum()), float(target.sum())
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def weights(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """key (SHA-256 of the text), copies, n_words, n_features and weight of each distinct text of docs."""
    found, kind = _distinct(docs, most, buckets, "features")
    aimed, _ = _distinct(target, most, buckets, "target")
    gain = gains(_bucket_counts(found, kind, buckets), _bucket_counts(aimed, kind, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets_of, cut = _read(batch, kind)
            weight = pa.array(_sums(gain[buckets_of], cut), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "copies", "n_words", "n_features")), weight], ["key", "copies", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "key string, copies long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel draw, rounded down, from the digest of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def rank(docs: DataFrame, target: DataFrame, carry: list[str], percent: int = PERCENT, most: int = 1, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row a document: the columns of `carry` in a struct _row, doc_id, n_features, weight, score and rank."""
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"), F.col("doc_id"), key.alias("key"))
    of = weights(docs.select("text"), target.select("text"), most, buckets).drop("copies")
    scored = rows.join(of, "key").select(
        "_row", "doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") < least_words).alias("_short")
    )
    scored = scored.withColumn("_down", -F.col("score"))
    numbered = number_rows(scored, ["_short", "_down", "doc_id"], "%d", "_place")
    fit = numbered.where("not _short").count() * percent // 100
    at = F.col("_place").cast("long")
    return numbered.select("_row", "doc_id", "n_features", "weight", "score", F.when(at <= fit, at).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """docs' own columns of the documents drawn, the best first in n-th place of the further column `rank`."""
    (name,) = fresh(docs, "rank")
    return rank(docs, target, docs.columns, **options).where("rank is not null").select("_row.*", F.col("rank").alias(name))


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document."""
    return rank(docs, target, ["doc_id"]).select(F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
), aimed AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), vocabulary AS (
  SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM words UNION SELECT w FROM aimed)
), bytes AS (
  SELECT w, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)) AS b FROM vocabulary
), bucketed AS (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc
), s AS (SELECT bucket, count(*) AS s FROM words JOIN bucketed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aimed JOIN bucketed USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM words) AS ss, (SELECT count(*) FROM aimed) AS tt),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST(ss AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(tt AS DOUBLE) + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), totals
), weighed AS (
  SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM words JOIN bucketed USING (w) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weighed USING (doc_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS fit FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM ranked
"""
