"""N-gram Jaccard join: sets of word n-grams in global order (of their hashes), joined through prefix trees.

Which sets must meet. Two sets of sizes a <= b that link at similarity t differ in at most H = (a + b)(1 - t)/(1 + t)
n-grams. Cut the range of hashes into P > H segments: at least one segment then has the same, non-empty content in
both. So each set signs the content of each segment, and only sets with a common signature meet. P depends on the
class of sizes; a set signs for its own class and for the one below. If more segments of a set are empty than P
allows for, it signs another cut as well, until one has few enough: no link is lost.

How they are joined. Sets with a common signature go to the family of the smallest of them. A family is one trie:
level by level the segments of the sorted n-grams, sets with equal segments sharing nodes and their partial overlap
with the sets that are looked up (several at once, as columns); subtrees are left when the overlap so far and the
n-grams that remain on either side cannot reach the threshold, when sizes cannot, or when all of a subtree is in the
looked-up set's component.

Skew. Equal sets are one set from the start. A signature that many sets of one task share makes a star there and then
and sends its centre only. Families beyond BLOCK_SETS sets or BLOCK_GRAMS n-grams are split into blocks that share
the centre. Such stars and blocks may miss links between their parts; where their members are not one component in
the end, the members outside the largest one are joined with all others, block by block.

n-grams are compared by 64-bit hash, equal sets by a 64-bit sum over them.

Defined results: null and blank texts have no n-grams and link with nothing; a text with fewer words than n has its
whole sequence as one n-gram; repeated rows link with each other; a null id is ignored as a component's name unless
there is no other; an empty table gives an empty result; further columns pass through drop_near_copies() untouched,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm import textkernel as tk
from quarrymill.llm.common import fresh, partitions
from quarrymill.llm.components import components
from quarrymill.llm.packing import pack, release, runs, unpack
from quarrymill.scratch import materialize, settle

#: Signatures held by a task before it sorts and sends them.
HELD = 600_000
#: A signature with more sets than this in one task makes a star there.
LOCAL_STAR = 64
#: Bytes of text whose sets one task brings together.
BUCKET_BYTES = 32 << 20
#: A family's blocks.
BLOCK_SETS, BLOCK_GRAMS = 2000, 1_500_000
#: Bits of the filter that tells which sets are in any family (8 MB, whatever the data; false positives do no harm).
FILTER_BITS = 26

_U = np.uint64
_DOC, _STAR, _GROUP = 0, 1, 2
_SEED = _U(0xC2B2AE3D27D4EB4F)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, n-grams, bounds): row i has the sorted distinct n-grams [bounds[i], bounds[i + 1])."""
    for rows, data, offsets in tk.chunks(batch):
        w = tk.words(data, offsets, lower=True)
        hashes, bounds = w.hashes, w.bounds
        grams = tk.shingle(hashes, k)
        whole = np.flatnonzero(w.doc[: len(grams)] == w.doc[k - 1 :]) if len(grams) else np.zeros(0, np.int64)
        count = np.diff(bounds)
        short = np.flatnonzero((count > 0) & (count < k))
        own = np.array([int(tk.shingle(hashes[bounds[i] : bounds[i + 1]], int(count[i]))[0]) for i in short], np.uint64)
        value = np.concatenate([grams[whole], own])
        doc = np.concatenate([w.doc[whole], short])
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        if len(value):
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
            value, doc = value[new], doc[new]
        yield rows, value, np.searchsorted(doc, np.arange(w.n_docs + 1))


def _sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _digests(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return tk.mix(_sum_by(tk.mix(grams ^ _SEED), bounds) + np.diff(bounds).astype(np.uint64) * _SEED)


@lru_cache(maxsize=8)
def _classes(num: int, den: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size of each class; and for sets of a class joined with those of it and the next: segments, spare empty ones.

    A class ends before the first size that cannot link with its first. 0 segments: only equal sets link.
    """
    first = [1]
    while first[-1] <= top:
        first.append(first[-1] * den // num + 1)
    first.append(first[-1] * den // num + 1)
    last = np.array(first[1:]) - 1
    differ = (last + last * den // num) * (den - num) // (den + num)
    # as many spare segments as the smallest set of a class leaves empty, with room for chance
    least, spare = np.array(first[:-1]), np.ones(len(last))
    for _ in range(100):
        empty = (differ + 1 + spare) * np.exp(-least / (differ + 1 + spare))
        spare = np.ceil(empty + 2 * np.sqrt(empty))
    spare = spare.astype(np.int64)
    return np.array(first), np.where(differ > 0, differ + 1 + spare, 0), spare


def _sign(grams: np.ndarray, bounds: np.ndarray, segments: np.ndarray, klass: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets (with segments > 0), the set of each, and how many segments of each set are not empty."""
    size = np.diff(bounds)
    of = np.repeat(np.arange(len(size)), size)
    if cut:
        grams = tk.mix(grams + _U(cut * int(_SEED) & (1 << 64) - 1))
        grams = grams[np.lexsort((grams, of))]
    part = ((grams >> _U(32)) * segments.astype(np.uint64)[of]) >> _U(32)
    key = (of.astype(np.uint64) << _U(32)) | part
    at, n = runs(key)
    ends = np.append(at, len(key))
    content = _sum_by(tk.mix(grams ^ _SEED), ends) + n.astype(np.uint64)
    place = part[at] | (klass.astype(np.uint64)[of[at]] << _U(32)) | (_U(cut) << _U(56))
    return tk.mix(content ^ tk.mix(place + _U(1))), of[at], np.bincount(of[at], minlength=len(size))


def _signatures(grams: np.ndarray, bounds: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, sets) of all sets."""
    size = np.diff(bounds)
    first, segments, spare = _classes(num, den, 1 << max(8, int(size.max(initial=1)).bit_length()))
    own = np.searchsorted(first, size, "right") - 1
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for klass in (own, own - 1):
        todo = np.flatnonzero((size > 0) & (klass >= 0) & (segments[klass] > 0))
        cut = 0
        while len(todo):
            pick = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in todo]) if len(todo) < len(size) else slice(bounds[0], bounds[-1])
            inner = np.concatenate([[0], np.cumsum(size[todo])])
            signs, of, filled = _sign(grams[pick], inner, segments[klass[todo]], klass[todo], cut)
            out.append((signs, todo[of]))
            todo = todo[segments[klass[todo]] - filled > spare[klass[todo]]]
            cut += 1
            if cut > 200:
                raise RuntimeError("no cut with few empty segments")
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    signs, of = (np.concatenate(x) for x in zip(*out, strict=True))
    return signs, of


_SENT = "bucket int, kind int, data binary"
_FOUND = "kind int, a long, b long, c long"


def _sent(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), 64):
        cols = list(zip(*rows[k : k + 64], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["bucket", "kind", "data"])


def _tasks(k: int, num: int, den: int, buckets: int, local_star: int):
    """Tasks' side: documents, signatures by bucket, local stars."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        signs, sets = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((sets, signs))
        signs, sets = signs[order], sets[order]
        new = np.ones(len(signs), bool)
        new[1:] = (signs[1:] != signs[:-1]) | (sets[1:] != sets[:-1])
        signs, sets = signs[new], sets[new]
        at, n = runs(signs)
        rows = []
        hot = n > local_star
        starred = np.zeros(len(signs), bool)
        if hot.any():
            member = np.repeat(hot, n)
            centre = sets[np.repeat(at, n)][member]
            star = np.unique(np.stack([sets[member], centre]), axis=1)
            rows.append((int(centre[0] % _U(buckets)), _STAR, pack(star[0], star[1])))
            rows.append((int(centre[0] % _U(buckets)), _GROUP, pack(signs[member], sets[member])))
            keep = ~member
            keep[at[hot]] = True
            starred[at[hot]] = True
            signs, sets, starred = signs[keep], sets[keep], starred[keep]
        order, cut = tk.parts_of((signs % _U(buckets)).astype(np.int64), buckets)
        for b in range(buckets):
            mine = order[cut[b] : cut[b + 1]]
            if len(mine):
                rows.append((b, -1, pack(signs[mine], sets[mine], starred[mine], raw=(0, 1))))
        yield from _sent(rows)
        release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [], 0, 0
        for batch in batches:
            column = batch.column("doc_id").cast(pa.int64())
            known, ids = column.is_valid().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy(zero_copy_only=False)
            docs = []
            for rows, grams, bounds in _sets(batch, k):
                digests = _digests(grams, bounds)
                docs.append(pack(ids[rows], known[rows], np.diff(bounds), digests))
                signs, of = _signatures(grams, bounds, num, den)
                held.append((signs, digests[of]))
                size += len(signs)
                if size >= HELD:
                    yield from flush(held)
                    held, size = [], 0
            turn += 1
            yield from _sent([((hash(len(d)) + turn + i) % buckets, _DOC, d) for i, d in enumerate(docs)])
        if held:
            yield from flush(held)

    return run


def _meet(table: pa.Table) -> pa.Table:
    """A bucket of signatures: documents pass, sets with a common signature get its smallest set as centre."""
    kinds, datas = table.column("kind").to_pylist(), table.column("data").to_pylist()
    out: list[tuple[np.ndarray, ...]] = []

    def add(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None, known: np.ndarray | None = None) -> None:
        c = np.zeros(len(a), np.int64) if c is None else c
        known = np.ones(len(a), bool) if known is None else known
        out.append((np.full(len(a), kind, np.int32), a.view(np.int64), b.view(np.int64), c.view(np.int64), known))

    held = []
    for kind, data in zip(kinds, datas, strict=True):
        got = unpack(data)
        if kind == _DOC:
            add(_DOC, got[0], got[2], got[3], got[1])
        elif kind >= 0:
            add(kind, *got)
        else:
            held.append(got)
    if held:
        signs, sets, starred = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(signs)
        _, n = runs(signs[order])
        order = order[np.repeat(n > 1, n)]
        signs, sets, starred = signs[order], sets[order], starred[order]
        order = np.lexsort((sets, signs))
        signs, sets, starred = signs[order], sets[order], starred[order]
        at, n = runs(signs)
        centre = sets[np.repeat(at, n)] if len(at) else sets
        if len(at):
            of = np.repeat(np.arange(len(at)), n)
            touched = np.bincount(of, starred, len(at)) > 0  # its other members are in stars of their tasks
            group = np.repeat(touched, n)
            if group.any():
                add(_GROUP, signs[group], sets[group])
        apart = sets != centre
        if apart.any():
            star = np.unique(np.stack([sets[apart], centre[apart]]), axis=1)
            add(_STAR, np.ascontiguousarray(star[0]), np.ascontiguousarray(star[1]))
    if not out:
        out = [(np.zeros(0, np.int32), *[np.zeros(0, np.int64)] * 3, np.zeros(0, bool))]
    kind, a, b, c, known = (np.concatenate(x) for x in zip(*out, strict=True))
    release()
    return pa.Table.from_arrays([pa.array(kind), pa.array(a, mask=~known), pa.array(b), pa.array(c)], ["kind", "a", "b", "c"])


class _Trie:
    """Sets as paths of segments of the hash range, level by level, sets with equal segments sharing nodes.

    n-grams that no other set of the family has cannot overlap: they count for sizes and are on no path. A level's
    nodes lie in order, each with the place of its parent, its segment, and the sizes and remaining n-grams of the
    sets below it.
    """

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den, n = num, den, len(sets)
        self.size = np.array([len(s) for s in sets], np.int64)
        grams, of = np.concatenate(sets), np.repeat(np.arange(n), self.size)
        order = np.argsort(grams)
        _, count = runs(grams[order])
        shared, ids = np.zeros(len(grams), bool), np.empty(len(grams), np.int64)
        shared[order] = np.repeat(count > 1, count)
        ids[order] = np.repeat(np.cumsum(count > 1) - 1, count)
        self.n_ids = int((count > 1).sum())
        grams, of, self.ids = grams[shared], of[shared], ids[shared]
        # a level for some n-grams, and no more levels than tell the sets apart
        log2 = max(0, min(int(self.size.max(initial=1)) // 8, n // 2, 256).bit_length() - 1)
        self.levels = levels = 1 << log2
        part = (grams >> _U(64 - log2)).astype(np.int64) if log2 else np.zeros(len(grams), np.int64)
        cells = np.searchsorted(of * levels + part, np.arange(n * levels + 1))
        content = (_sum_by(tk.mix(grams ^ _SEED), cells) + np.diff(cells).astype(np.uint64)).reshape(n, levels)
        filled = np.diff(cells).reshape(n, levels)
        self.of_set = np.searchsorted(of, np.arange(n + 1))
        self.rest = filled[:, ::-1].cumsum(axis=1)[:, ::-1] - filled  # n-grams after each level
        self.order = np.lexsort(content.T[::-1])  # sets as leaves, in order of their paths
        content, size, rest = content[self.order], self.size[self.order], self.rest[self.order]
        new = np.ones((n, levels), bool)
        new[1:] = np.logical_or.accumulate(content[1:] != content[:-1], axis=1)
        node = np.cumsum(new, axis=0) - 1
        self.leaf = node[:, -1]
        self.nodes = []
        for level in range(levels):
            at = np.flatnonzero(new[:, level])
            _, first, segment = np.unique(content[at, level], return_index=True, return_inverse=True)
            cell = self.order[at[first]] * levels + level
            parent = node[at, level - 1] if level else np.zeros(len(at), np.int64)
            low, high, left = np.minimum.reduceat(size, at), np.maximum.reduceat(size, at), np.maximum.reduceat(rest[:, level], at)
            self.nodes.append((at, parent, segment, cells[cell], cells[cell + 1], low, high, left))

    def find(self, queries: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, sets) that link, of different labels; some pairs of one label may be among them."""
        num, den, q = self.num, self.den, len(queries)
        mask = np.zeros((self.n_ids, q), np.int32)
        for j, s in enumerate(queries):
            mask[self.ids[self.of_set[s] : self.of_set[s + 1]], j] = 1
        size, own, leaves = self.size[queries], label[queries], label[self.order]
        alive, overlap = np.zeros(1, np.int64), np.zeros((1, q), np.int32)
        for level, (at, parent, segment, start, end, low, high, left) in enumerate(self.nodes):
            spot = np.full(int(parent[-1]) + 1, -1)
            spot[alive] = np.arange(len(alive))
            child = np.flatnonzero(spot[parent] >= 0)
            least, most = np.minimum.reduceat(leaves, at)[child], np.maximum.reduceat(leaves, at)[child]
            used, place = np.unique(segment[child], return_inverse=True)
            length = end[used] - start[used]
            more = np.zeros((len(used), q), np.int32)
            full = np.flatnonzero(length > 0)
            if len(full):
                ends = np.cumsum(length[full])
                pick = np.arange(ends[-1]) + np.repeat(start[used[full]] - ends + length[full], length[full])
                more[full] = np.add.reduceat(mask[self.ids[pick]], ends - length[full], axis=0)
            overlap = overlap[spot[parent[child]]] + more[place]
            # the least overlap that a set of this subtree needs, against the most that it can still have
            most_yet = overlap + np.minimum(self.rest[queries, level].astype(np.int32), left[child].astype(np.int32)[:, None])
            live = most_yet * np.int64(num + den) >= num * (size + low[child][:, None])
            live &= (high[child] * den)[:, None] >= size * num
            live &= (low[child] * num)[:, None] <= size * den
            live &= (least != most)[:, None] | (least[:, None] != own)
            keep = np.flatnonzero(live.any(axis=1))
            if not len(keep):
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            alive, overlap = child[keep], overlap[keep]
        spot = np.full(len(self.nodes[-1][0]), -1)
        spot[alive] = np.arange(len(alive))
        rows = np.flatnonzero(spot[self.leaf] >= 0)
        sets = self.order[rows]
        both = overlap[spot[self.leaf[rows]]]
        hit, j = np.nonzero(den * both.astype(np.int64) >= num * (self.size[sets][:, None] + size - both))
        return queries[j], sets[hit]


#: Sets looked up in a trie at a time, and cells of the table that tells which n-grams they have.
LOOK_UP, LOOK_UP_CELLS = 64, 8_000_000


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Labels once a's and b's are one, pair by pair; and which pairs joined two."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    joined = []
    for i, (x, y) in enumerate(zip(label[a].tolist(), label[b].tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            joined.append(i)
    if joined:
        new = np.arange(len(label))
        for x in parent:
            new[x] = top(x)
        label = new[label]
    return label, joined


def link_family(names: list[int], sets: list[np.ndarray], num: int, den: int, skip: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect all that are connected among a family's sets, one per pair of components joined.

    All sets are in one trie. Sets outside the largest component found so far are looked up in it, some at a time, until
    none is left that was not: of every pair one was looked up, or both are in the largest component. Subtrees whose
    sets are all in one's own component are left as well.

    skip: components known beforehand; members of one are not compared with each other.
    """
    n = len(names)
    label = np.arange(n) if skip is None else np.unique(np.array(skip), return_index=True, return_inverse=True)[1:]
    if skip is not None:
        label = label[0][label[1]]
    trie = _Trie(sets, num, den)
    most = int(max(1, min(LOOK_UP, LOOK_UP_CELLS // max(1, trie.n_ids))))
    done, links, some = np.zeros(n, bool), [], 1
    by_size = np.argsort(trie.size, kind="stable")
    while True:
        main = np.bincount(label).argmax()
        left = by_size[~done[by_size] & (label[by_size] != main)]
        if not len(left):
            return links
        if some < most:  # the middle ones of each part, so that the largest component is soon found
            take = left[(np.arange(some) * 2 + 1) * len(left) // (2 * some)] if len(left) > some else left
        else:
            take = left[:most]
        a, b = trie.find(np.unique(take), label)
        label, joined = _merged(label, a, b)
        links += [(names[a[i]], names[b[i]]) for i in joined]
        done[take] = True
        some = min(most, some * 4)


def _join_families(num: int, den: int, known: bool):
    """Rows sorted by family and block, to links. A family's block is what a task holds at a time."""

    def links(keys: list[tuple]) -> pa.RecordBatch:
        names, sets, skip = [], [], []
        seen = set()
        for name, grams, group in keys:
            if name not in seen:
                seen.add(name)
                names.append(name)
                sets.append(np.frombuffer(grams, np.uint64))
                skip.append(group)
        found = link_family(names, sets, num, den, skip if known else None)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("family", "block", "set", "grams", "known")]
            for family, block, name, grams, group in zip(*cols, strict=True):
                if (family, block) != now:
                    if len(held) > 1:
                        yield links(held)
                    now, held = (family, block), []
                held.append((name, grams, group))
            del cols
            release()
        if len(held) > 1:
            yield links(held)
        held = []
        release()

    return run


def _filter_of(sets: DataFrame) -> bytes:
    """A bitmap of FILTER_BITS bits of the sets' digests."""
    place = F.shiftrightunsigned(F.col("set"), 64 - FILTER_BITS)
    rows = sets.groupBy(F.shiftright(place, 15).alias("k")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(32768))).alias("bits")).collect()
    out = bytearray((1 << FILTER_BITS) // 8)
    for row in rows:
        out[row.k * 4096 : row.k * 4096 + len(row.bits)] = row.bits
    return bytes(out)


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(set, grams) of the wanted sets, and of a few others that the filter lets through."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            seen: set[int] = set()
            for _, grams, bounds in _sets(batch, k):
                digests = _digests(grams, bounds)
                place = digests >> _U(64 - FILTER_BITS)
                hit = (there[place >> _U(3)] >> (place & _U(7)).astype(np.uint8)) & 1
                names, values = [], []
                for i in np.flatnonzero((hit > 0) & (np.diff(bounds) > 0)):
                    if (name := int(digests[i])) not in seen:
                        seen.add(name)
                        names.append(name - (1 << 64) if name >> 63 else name)
                        values.append(grams[bounds[i] : bounds[i + 1]].tobytes())
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(values, pa.binary())], ["set", "grams"])
            release()

    found = docs.select("text").mapInArrow(run, "set long, grams binary")
    return found.groupBy("set").agg(F.first("grams").alias("grams"))


def _joined(rows: DataFrame, num: int, den: int, known: bool) -> DataFrame:
    n = 2 * partitions(rows.sparkSession)
    dealt = rows.repartition(n, "family", "block").sortWithinPartitions("family", "block", "set")
    return dealt.select("family", "block", "set", "grams", "known").mapInArrow(_join_families(num, den, known), "a long, b long")


def _complete(groups: DataFrame, links: DataFrame, sets: DataFrame, num: int, den: int, block_sets: int, block_grams: int) -> DataFrame | None:
    """Links that stars and blocks may have missed; None if there are none to look for.

    groups: (family, set), all members. Those whose members are one component are done. In the others, members outside
    the largest component are joined with all: every pair that could still matter has one of them. Groups with the
    same largest component are taken together, so that a set which shares many signatures with it comes once.
    """
    if not groups.limit(1).count():
        return None
    roots = components(links)
    placed = groups.join(roots, groups["set"] == roots["node"], "left").select("family", "set", F.coalesce("root", "set").alias("known"))
    sizes = placed.groupBy("family", "known").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("family").agg(F.max_by("known", F.struct("n", "known")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    open_ = placed.join(largest, "family").select(F.col("main").alias("family"), "set", "known").distinct()
    open_ = materialize(open_.withColumn("outside", F.col("known") != F.col("family")), "open")
    if not open_.limit(1).count():
        return None
    open_ = materialize(open_.join(sets, "set"), "open")
    cut = lambda w: F.greatest(
        F.lit(1), F.ceil(F.count_if(w) * 2 / block_sets), F.ceil(F.sum(F.when(w, F.length("grams") / 8).otherwise(0)) * 2 / block_grams)
    ).cast("int")
    rows = open_.join(open_.groupBy("family").agg(cut(F.lit(True)).alias("i_n"), cut(F.col("outside")).alias("l_n")), "family")
    spot = F.xxhash64("set")
    every = rows.withColumn("i", F.pmod(spot, F.col("i_n"))).withColumn("l", F.explode(F.sequence(F.lit(0), F.col("l_n") - 1)))
    outside = rows.where("outside").withColumn("l", F.pmod(spot, F.col("l_n"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("i_n") - 1)))
    cells = [x.select("family", F.concat_ws(":", F.col("i").cast("string"), F.col("l").cast("string")).alias("block"), "set", "grams", "known") for x in (every, outside)]
    return _joined(cells[0].unionByName(cells[1]), num, den, True)


def _buckets(docs: DataFrame, bucket_bytes: int) -> int:
    """Groups of about bucket_bytes of text each, and two for each task at least."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2 * partitions(docs.sparkSession), -(-int(size) // bucket_bytes))


def classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, block_sets: int = BLOCK_SETS, block_grams: int = BLOCK_GRAMS, local_star: int = LOCAL_STAR, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of each document.

    Two documents link when den * |intersection| >= num * |union| over their sets of word n-grams.
    """
    if not 0.7 * den <= num <= den:
        raise ValueError("the threshold must lie in [0.7, 1]: below, small sets may differ in as many n-grams as they have")
    buckets = _buckets(docs, bucket_bytes)
    sent = docs.select("doc_id", "text").mapInArrow(_tasks(n, num, den, buckets, local_star), _SENT)
    found = materialize(sent.groupBy("bucket").applyInArrow(_meet, _FOUND), "met")
    table = found.where(F.col("kind") == _DOC).select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.when(F.col("b") > 0, F.col("c")).alias("set"))
    stars = found.where((F.col("kind") == _STAR) & (F.col("a") != F.col("b"))).select(F.col("a").alias("set"), F.col("b").alias("family")).distinct()
    members = stars.unionByName(stars.select(F.col("family").alias("set"), "family").distinct())
    size = table.where("set IS NOT NULL").groupBy("set").agg(F.first("n_shingles").alias("n"))
    members = members.join(size, "set")
    need = members.groupBy("family").agg(F.count("*").alias("c"), F.sum("n").alias("g"))
    need = need.select("family", F.greatest(F.ceil(F.col("c") / block_sets), F.ceil(F.col("g") / block_grams)).cast("int").alias("blocks"))
    members = materialize(members.join(need, "family").select("family", "set", "blocks"), "families")
    sets = _sets_of(docs, members.select("set").distinct(), n)
    turn = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    dealt = F.when(F.col("set") == F.col("family"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(turn))
    split = members.withColumn("block", F.explode(dealt)).withColumn("block", F.col("block").cast("string")).join(sets, "set").withColumn("known", F.lit(0).cast("long"))
    links = materialize(_joined(split, num, den, False), "links")
    hot = found.where(F.col("kind") == _GROUP).select(F.col("a").alias("family"), F.col("b").alias("set")).distinct()
    large = members.where("blocks > 1").select("family", "set")
    more = _complete(materialize(hot.unionByName(large), "groups"), links, sets, num, den, block_sets, block_grams)
    if more is not None:
        links = links.unionByName(more)
    roots = components(links)
    # a component's name: the smallest id of its sets; a hot set's rows are reduced before they are shuffled
    named = table.where("set IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("least"))
    named = named.join(roots, named["set"] == roots["node"], "left").select("set", "least", F.coalesce("root", "set").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select(F.col("set").alias("_set"), "component_id")
    out = table.join(named, F.col("set") == F.col("_set"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """docs without those that link, directly or through others, with one of a smaller id; of an id's repeated rows one stays.

    Rows of null id stay.
    """
    gone_id, turn = fresh(docs, "_gone", "_turn")
    gone = settle(lambda: classes(docs, **options).where("component_id < doc_id").select(F.col("doc_id").alias(gone_id)).distinct(), "gone")
    left = docs.join(gone, docs["doc_id"] == gone[gone_id], "left_anti")
    order = Window.partitionBy("doc_id").orderBy(F.length("text").desc(), "text")
    if left.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        left = left.withColumn(turn, F.row_number().over(order)).where(F.col("doc_id").isNull() | (F.col(turn) == 1)).drop(turn)
    return left


def digest(docs: DataFrame) -> DataFrame:
    return classes(docs, n=4, num=85, den=100)
