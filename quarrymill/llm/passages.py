"""Where strings of `width` units (bytes or words) that occur more than once can be: spans of texts, brought together.

No document meets every block of an index. Each window of `width` units picks the least hash of its grams (runs of
`levels[0]` units), so equal windows pick equal grams, wherever they stand; windows beside each other that pick one gram
make a span. Grams that only one place of all texts has are done with. The others' spans are cut out of the texts, equal
spans become one, and spans of one gram meet in one block, where an index over the units themselves decides. All
windows of a gram are in its spans and every window is in one span, so a block sees each place of its strings once.

A gram may be so common that its different spans exceed GROUP_BYTES (a short passage in a third of all documents). Its
windows pick again, by longer grams (levels[1], ...); at the last level a gram is a whole window and equal windows are one
span, so every group is bounded, and no pairs are made. Hashes of grams only say where windows meet; a collision makes a
block larger, not a result wrong. Equal spans are those of equal 128-bit digests.

What is shuffled: some 20 bytes a gram (one for each (width - gram) / 2 units), once; the spans of grams that repeat; and
the texts twice, to cut spans out and to apply marks. Everything is rows by key: messages do not grow with blocks.

Rows are told apart by id and text: rows with equal id and text are one document; other texts of the same id are
documents of their own, in order of their texts' xxhash64 (31 bits of it). A null id is no name: null ids come before all
ids above -2^62, in order of their texts' xxhash64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm import textkernel as tk
from quarrymill.llm.common import fresh, partitions
from quarrymill.llm.packing import release
from quarrymill.scratch import forget, materialize, settle

#: Bytes of different spans of one gram that meet in one task; beyond, the gram's windows pick longer grams.
GROUP_BYTES = 1 << 19
#: Bytes of spans in a block of the index.
BLOCK_BYTES = 1 << 20
#: Blocks that a task indexes one after another, where there are more blocks than Spark's shuffle partitions.
TASK_BLOCKS = 4
#: Digests that a task remembers, so as not to send a text twice.
TOLD = 300_000
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 18
_NULL_ID = -(1 << 63)
_U = np.uint64


class Bytes:
    """Texts side by side as bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.bounds = data[offsets[0] : offsets[-1]], offsets - offsets[0]

    def grams(self, k: int) -> np.ndarray:
        """Hash of data[i:i + k] at each i: differences of a polynomial's prefix sums, brought to one power whatever stands before."""
        n = len(self.data)
        if n < k:
            return np.zeros(0, _U)
        total = np.zeros(n + 1, _U)
        np.cumsum(tk._BYTES[self.data] * tk._power_table(n)[:n], out=total[1:])
        return tk.mix((total[k:] - total[: n - k + 1]) * tk.inverse_powers(n)[: n - k + 1])

    def pieces(self, starts: np.ndarray, stops: np.ndarray) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


class Words:
    """Texts side by side as words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.words = tk.words(data, offsets, lower=False)
        self.bounds = self.words.bounds

    def grams(self, k: int) -> np.ndarray:
        return tk.shingle(self.words.hashes, k)

    def pieces(self, starts: np.ndarray, stops: np.ndarray) -> list[bytes]:
        w = self.words
        return [b" ".join(w.data[a:b].tobytes().split()) for a, b in zip(w.starts[starts].tolist(), w.ends[stops - 1].tolist(), strict=True)]


@dataclass(frozen=True)
class Plan:
    """What is looked for: windows of `width` units; grams by level, the last as long as a window."""

    units: type
    width: int
    levels: tuple[int, ...]
    #: decides about a block: (spans' texts in order of documents, windows of each, width) -> ranges that repeat, as arrays
    #: span, first unit, unit after the last; and, if `earlier`, the span and unit where the same units start earlier
    decide: Callable
    #: a window repeats only if it starts earlier too, not if it starts anywhere else
    earlier: bool
    group_bytes: int = GROUP_BYTES
    block_bytes: int = BLOCK_BYTES


def _least_of_windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Position of the last least hash among each `size` neighbours."""
    n = len(hashes) - size + 1
    bits = _U(max(len(hashes), 2).bit_length())
    packed = ((hashes >> bits) << bits) | np.arange(len(hashes), 0, -1).astype(_U)
    whole = np.full(-(-len(packed) // size) * size, np.iinfo(_U).max, _U)
    whole[: len(packed)] = packed
    rows = whole.reshape(-1, size)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    on = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(on[:n], upto[size - 1 : size - 1 + n])
    return len(hashes) - (least & ((_U(1) << bits) - _U(1))).astype(np.int64)


def pick(hashes: np.ndarray, bounds: np.ndarray, gram: int, width: int) -> tuple[np.ndarray, ...]:
    """Spans of texts side by side: gram hash, text, first window (unit from the start of all texts), number of windows,
    and whether windows of the span may repeat within it.

    In a stretch that repeats within itself many places have the least hash; of those closer than half the grams of a
    window, one in half a window is kept, which leaves one at least in each window.
    """
    size = width - gram + 1
    doc = np.repeat(np.arange(len(bounds) - 1), np.maximum(np.diff(bounds) - width + 1, 0))
    if not len(doc):
        return np.zeros(0, _U), doc, doc, doc, doc
    at = np.arange(len(doc)) - np.searchsorted(doc, doc) + bounds[doc]  # where whole windows start
    least = _least_of_windows(hashes, size)[at]
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    last = np.append(first[1:], len(least)) - 1
    picked, of = least[first], doc[first]
    value = hashes[picked]
    half = max(1, size // 2)
    new = np.ones(len(picked), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1]) | (picked[1:] - picked[:-1] > size // 2)
    chain = np.maximum.accumulate(np.where(new, np.arange(len(picked)), 0))
    step = (picked - picked[chain]) // half
    keep = new.copy()
    keep[1:] |= step[1:] != step[:-1]
    keep[:-1] |= new[1:]
    keep[-1] = True
    # windows up to a kept place go to it, those after it to the next one kept
    place = np.cumsum(keep) - 1
    kept = np.flatnonzero(keep)
    here = picked[kept[place]]
    low, high = at[first], at[last]
    one, two = low <= here, high > here
    target = np.concatenate([place[one], place[two] + 1])
    begin = np.concatenate([low[one], np.maximum(low, here + 1)[two]])
    end = np.concatenate([np.minimum(high, here)[one], high[two]])
    order = np.argsort(target, kind="stable")
    target, begin, end = target[order], begin[order], end[order]
    cut = np.concatenate([[0], np.flatnonzero(target[1:] != target[:-1]) + 1])
    inner = np.diff(np.append(cut, len(target))) > 1
    begin, end, kept = np.minimum.reduceat(begin, cut), np.maximum.reduceat(end, cut), kept[target[cut]]
    return value[kept], of[kept], begin, end - begin + 1, inner


def named(docs: DataFrame, doc: str, tie: str) -> DataFrame:
    """docs with what tells its rows apart and orders them."""
    digest = F.xxhash64("text")
    docs = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID) + F.shiftrightunsigned(digest, 2)))
    return docs.withColumn(tie, F.when(F.col("doc_id").isNull(), 0).otherwise(1 + F.pmod(digest, F.lit((1 << 31) - 2))).cast("int"))


_GRAMS = "gram long, doc long, tie int, start int, n int, inner boolean"
_SENT = ["gram", "doc", "tie", "start", "n", "inner", "known", "salt"]
_SPANS = f"{_GRAMS}, many boolean, high long, low long, text binary"


def _long(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _grams(plan: Plan, held_rows: int = 500_000):
    """Spans of texts by gram, as they are found. A gram that a task has seen twice is known to repeat: one of its rows goes
    to where the gram's rows meet (salt 0), the others anywhere, so that a common gram makes one row a task there."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        gram, doc, tie, start, n, inner = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(gram)
        found = gram[order]
        same = found[1:] == found[:-1]
        known = np.zeros(len(gram), bool)
        known[order[1:]] = same
        known[order[:-1]] |= same
        later = np.zeros(len(gram), bool)
        later[order[1:]] = same
        salt = np.where(later, 1 + (tk.mix(doc.view(np.uint64)) & _U(0xFFFF)).astype(np.int32), 0).astype(np.int32)
        arrays = [gram.view(np.int64), doc, tie, start.astype(np.int32), n.astype(np.int32), inner, known | inner, salt]
        for k in range(0, len(gram), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]) for x in arrays], _SENT)
        release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            doc, tie = _long(batch.column("doc")), _long(batch.column("tie"))
            for rows, data, offsets in tk.chunks(batch, size=CHUNK):
                text = plan.units(data, offsets)
                gram, of, start, n, inner = pick(text.grams(plan.levels[0]), text.bounds, plan.levels[0], plan.width)
                if len(gram):
                    held.append((gram, doc[rows][of], tie[rows][of], start - text.bounds[of], n, inner))
                    size += len(gram)
                if size >= held_rows:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of gram: those known to repeat, and those beside another of the same gram."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        gram, keep = _long(batch.column("gram")), _long(batch.column("known")).copy()
        same = gram[1:] == gram[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        # the last row's next neighbour is still to come; what it knows of the one before it goes with it
        out = batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
        last = batch.slice(batch.num_rows - 1)
        last = last.set_column(_SENT.index("known"), "known", pa.array(keep[-1:]))
        yield out.select(_SENT[:6])
    if last is not None:
        yield last.filter(last.column("known")).select(_SENT[:6])


def _span_batch(gram, doc, tie, start, n, inner, many, texts: list[bytes], told: set[bytes] | None = None) -> pa.RecordBatch:
    """Spans with their digests; told: digests of texts that the task has sent, which are not sent again."""
    keys = [hashlib.blake2b(x, digest_size=16).digest() for x in texts]
    digests = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    if told is not None:
        if len(told) > TOLD:
            told.clear()
        for i, key in enumerate(keys):
            if key in told:
                texts[i] = None
            told.add(key)
    arrays = [pa.array(x) for x in (gram, doc, tie.astype(np.int32), start.astype(np.int32), n.astype(np.int32), inner, many, digests[:, 0], digests[:, 1])]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.binary())], ["gram", "doc", "tie", "start", "n", "inner", "many", "high", "low", "text"])


def lists(column: pa.Array, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets of an array column's rows (null: empty) and its elements' fields."""
    lengths = np.array(column.value_lengths().fill_null(0))
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(lengths)]), [_long(flat.field(f)) for f in fields]


def _cut_out(plan: Plan):
    """Spans of each document's grams that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for batch in batches:
            cut, (gram, start, n, inner) = lists(batch.column("found"), "gram", "start", "n", "inner")
            doc, tie = _long(batch.column("doc")), _long(batch.column("tie"))
            for rows, data, offsets in tk.chunks(batch, size=CHUNK):
                text = plan.units(data, offsets)
                s = slice(int(cut[rows.start]), int(cut[rows.stop]))
                of = np.repeat(np.arange(rows.stop - rows.start), np.diff(cut[rows.start : rows.stop + 1]))
                if len(of):
                    begin = text.bounds[of] + start[s]
                    texts = text.pieces(begin, begin + n[s] + plan.width - 1)
                    yield _span_batch(gram[s], doc[rows][of], tie[rows][of], start[s], n[s], inner[s], np.zeros(len(of), bool), texts, told)
            release()

    return run


def _pick_again(plan: Plan, level: int):
    """Spans of longer grams out of spans of a gram that is too common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie, at, many = (_long(batch.column(c)) for c in ("doc", "tie", "start", "many"))
            for rows, data, offsets in tk.chunks(batch, size=CHUNK):
                text = plan.units(data, offsets)
                gram, of, start, n, inner = pick(text.grams(plan.levels[level]), text.bounds, plan.levels[level], plan.width)
                if len(gram):
                    texts = text.pieces(start, start + n + plan.width - 1)
                    yield _span_batch(gram.view(np.int64), doc[rows][of], tie[rows][of], at[rows][of] + start - text.bounds[of], n, inner, many[rows][of], texts)
            release()

    return run


_RANGES = "doc long, tie int, a long, b long"
_SOURCE = ", ref long, ref_start long"


def _place() -> Column:
    return F.xxhash64("doc", "tie", "start")


def _marks_of(plan: Plan):
    """A block of the index: the windows that repeat, as ranges [a, b) of units of their documents."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        doc, tie, start, n, many = (table.column(c).to_numpy() for c in ("doc", "tie", "start", "n", "many"))
        order = np.lexsort((start, tie, doc))
        doc, tie, start, n, many = (x[order] for x in (doc, tie, start.astype(np.int64), n, many))
        texts = table.column("text").take(pa.array(order)).to_pylist()
        of, a, b, *source = plan.decide(texts, n, plan.width)
        if not plan.earlier:  # those that occur more than once are marked wherever they occur
            once = ~many[of]
            of, a, b = of[once], a[once], b[once]
        columns = [doc[of], tie[of], start[of] + a, start[of] + b]
        if plan.earlier:
            columns += [doc[source[0]], start[source[0]] + source[1]]
        release()
        return pa.Table.from_arrays([pa.array(x) for x in columns], ["doc", "tie", "a", "b", "ref", "ref_start"][: len(columns)])

    return run


def _settle(spans: DataFrame, plan: Plan, level: int) -> DataFrame:
    """Ranges of all windows that repeat among spans (a table, which is removed when it has been read)."""
    key = ["high", "low"]
    place = F.struct("doc", "tie", "start")
    different = spans.groupBy(*key).agg(
        F.first("gram").alias("gram"), F.min(place).alias("place"), F.first("n").alias("n"), ((F.min(place) != F.max(place)) | F.max("many")).alias("many"), F.max("inner").alias("inner"), F.first("text", ignorenulls=True).alias("text")
    )
    different = materialize(different.select(*key, "gram", "place.*", "n", "many", "inner", "text"), "different")
    # equal spans: all of their windows repeat
    again = different.where("many").select(*key, *[F.col(c).alias(f"first_{c}") for c in ("doc", "tie", "start")])
    full = spans.select(*key, "doc", "tie", "start", "n").join(again, key)
    if plan.earlier:
        full = full.where("not (doc = first_doc and tie = first_tie and start = first_start)")
    source = [F.col("first_doc").alias("ref"), F.col("first_start").cast("long").alias("ref_start")] if plan.earlier else []
    whole = full.select("doc", "tie", F.col("start").cast("long").alias("a"), (F.col("start").cast("long") + F.col("n") + plan.width - 1).alias("b"), *source)
    whole = materialize(whole, "whole")
    forget(spans)
    groups = different.groupBy("gram").agg(F.count("*").alias("spans"), F.sum(F.octet_length("text")).alias("bytes"), F.max("inner").alias("inner")).where("spans > 1 or inner")
    groups = materialize(groups, "groups")
    common = F.col("bytes") > plan.group_bytes
    sizes = groups.agg(F.sum(F.when(~common, F.col("bytes"))), F.count(F.when(common, 1))).first()
    blocks = max(1, -(-int(sizes[0] or 0) // plan.block_bytes))
    met = different.join(groups.where(~common).select("gram"), "gram").select(F.pmod(F.xxhash64("gram"), F.lit(blocks)).cast("int").alias("block"), "doc", "tie", "start", "n", "many", "text")
    # dealt by number: blocks are few bytes of much work, and by hash and bytes some tasks would get many of them
    met = met.repartitionById(max(min(blocks, partitions(spans.sparkSession)), -(-blocks // TASK_BLOCKS)), "block")
    out = whole.unionByName(met.groupBy("block").applyInArrow(_marks_of(plan), _RANGES + _SOURCE * plan.earlier))
    if sizes[1]:
        hot = different.join(groups.where(common).select("gram"), "gram").select("doc", "tie", "start", "many", "text")
        longer = materialize(hot.mapInArrow(_pick_again(plan, level + 1), _SPANS), "longer")
        repeated = longer.groupBy("gram").agg(F.min(_place()).alias("x"), F.max(_place()).alias("y"), F.max("many").alias("many"), F.max("inner").alias("inner")).where("x <> y or many or inner").select("gram")
        out = out.unionByName(_settle(materialize(longer.join(repeated, "gram"), "longer"), plan, level + 1))
    return out


def marks(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc, tie and the ranges (a, b; and their sources) of units that windows which repeat cover; docs: text, doc, tie."""
    found = docs.mapInArrow(_grams(plan), f"{_GRAMS}, known boolean, salt int")
    met = found.repartition("gram", "salt").sortWithinPartitions("gram")
    # rows of one place told twice count here; which spans repeat is found by place
    kept = materialize(met.mapInArrow(_repeated, _GRAMS), "kept")
    by_doc = kept.groupBy("doc", "tie").agg(F.collect_list(F.struct("gram", "start", "n", "inner")).alias("found"))
    spans = materialize(docs.join(by_doc, ["doc", "tie"]).mapInArrow(_cut_out(plan), _SPANS), "spans")
    forget(kept)
    ranges = F.collect_list(F.struct("a", "b", *(["ref", "ref_start"] if plan.earlier else []))).alias("ranges")
    return settle(lambda: _settle(spans, plan, 0).groupBy("doc", "tie").agg(ranges), "marks")


def with_marks(docs: DataFrame, plan: Plan) -> tuple[DataFrame, str]:
    """docs with an array of ranges [a, b) that are to go, and that column's name; null where nothing goes."""
    doc, tie, ranges = fresh(docs, "_doc", "_tie", "_ranges")
    docs = named(docs, doc, tie)
    found = marks(docs.select("text", F.col(doc).alias("doc"), F.col(tie).alias("tie")), plan)
    found = found.select(F.col("doc").alias(doc), F.col("tie").alias(tie), F.col("ranges").alias(ranges))
    return docs.join(found, [doc, tie], "left").drop(doc, tie), ranges


def gone(ranges: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Which of n units lie in a range."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, ranges[0], 1)
    np.add.at(edge, ranges[1], -1)
    return np.cumsum(edge[:-1]) > 0
