"""Language-model scores from a hierarchical Pitman-Yor model of word pairs.

Each word is the context of the next: contexts are restaurants that share one parent, the root, whose base is uniform
over the vocabulary and one unknown word; tables of contexts are the root's customers. Seatings are sampled by Gibbs, in
ROUNDS that alternate: contexts given the root's probabilities, then the root given the contexts' tables. For each dish
of a restaurant the number of tables is drawn given all else, in steps of all scales, weighed by generalised Stirling
numbers (exact up to STIRLING customers, beyond by their saddle point), from likely numbers on. A pair's probability is
the average of its predictive probability over the last SAMPLES rounds; a text's score is the sum of their logarithms.

How it is spread. Counts of pairs go to buckets of contexts as packed arrays, summed by task before; beyond ROUTES
buckets all that is sent goes in two steps (routing.py), so a token costs the same however many buckets there are. In each round a
bucket seats its restaurants and sends each word's tables to the word's owner, who adds them up, seats the root's part
and answers the buckets that asked. Then tokens go to the buckets and sums of logarithms come back to documents. The
FREQUENT commonest words are broadcast with their counts (a bound that does not grow with the data), so that tokens
shrink to two bytes or so each; contexts of HOT_CUSTOMERS or more are dealt out pair by pair, not kept in one bucket, and
pairs that are a 2 ** -17th of all or more (so at most 2 ** 17) are scored in place. Words and pairs beyond these lists
take the way by buckets, exactly.

Draws are hashes of word, pair, round and sweep, so neither the number of buckets nor that of partitions changes a
score. The root and hot contexts, which are in many buckets, are sampled given their numbers of tables in the round
before, exact sums over all buckets; other restaurants given their present ones. Words and pairs are known by 64-bit
hashes; logarithms are summed as whole numbers of 1e-8, so sums do not depend on their order.

Defined results: null and blank texts consist of the end token; held-out texts teach nothing; without training texts
all counts are 0 and the model is uniform over one word; repeated rows get equal scores and each counts in training;
a null id counts as training; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm import textkernel as tk
from quarrymill.llm.common import partitions
from quarrymill.llm.langid import held_out
from quarrymill.llm.packing import pack, release, runs, unpack
from quarrymill.llm.routing import ROUTES, ROWS, Router, row_batches, table
from quarrymill.scratch import forget, materialize

#: Commonest words, which every task knows; a pair that is such a part of all tokens (2 to the minus) is known as well.
FREQUENT, HOT_PAIR_LOG2 = 262_143, 17
#: A context of so many customers is dealt out pair by pair.
HOT_CUSTOMERS = 200_000
#: Tokens held by a task before it sorts and sends them.
HELD = 700_000
#: Bytes of text whose words one task adds up.
WORD_BYTES = 64 << 20
#: Tokens of a bucket.
BUCKET_TOKENS = 600_000
#: Discount and strength of contexts and root.
DISCOUNT, STRENGTH, ROOT_DISCOUNT, ROOT_STRENGTH = 0.75, 1.0, 0.6, 1.0
#: Rounds of contexts and root, sweeps over a restaurant in each, and last rounds that are averaged.
ROUNDS, SWEEPS, SAMPLES = 3, 4, 2
STIRLING = 256

_U = np.uint64
_RARE = _U(1) << _U(63)
_END = int(tk.mix(np.array([0x5EED], np.uint64))[0])
_UNIT = 1e8

_PAIRS, _STATE, _ONCE, _SUMS, _CONTEXT, _HOT, _COMMON, _TOTAL, _TOKENS, _SCORES, _DOCS = range(11)
_ANSWER = 100  # and the round


def _of_kind(group: pa.Table) -> dict[int, list[list[np.ndarray]]]:
    """Arrays of each row, by kind: records of a kind that is sent, or what was packed."""
    out: dict[int, list[list[np.ndarray]]] = {}
    for kind, data in zip(group.column("kind").to_pylist(), group.column("data").to_pylist(), strict=True):
        out.setdefault(kind, []).append(_CODECS[kind][1](data) if kind in _CODECS else unpack(data))
    return out


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _short(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in a few bytes each, and the rare ones' in full."""
    rare = ids >= _RARE
    return np.where(rare, FREQUENT, ids).astype(np.uint32), ids[rare]


def _long(short: np.ndarray, rare: np.ndarray) -> np.ndarray:
    out = short.astype(np.uint64)
    out[short == FREQUENT] = rare
    return out


def _packed_pairs(u, w, c, also) -> bytes:
    return pack(*_short(u), *_short(w), c.astype(np.uint32), also, raw=(1, 3))


def _pairs_of(data: bytes) -> list[np.ndarray]:
    us, ur, ws, wr, c, also = unpack(data)
    return [_long(us, ur), _long(ws, wr), c, also]


def _packed_sums(source, word, customers, tables) -> bytes:
    return pack(source, *_short(word), customers, tables, raw=(2,))


def _sums_of(data: bytes) -> list[np.ndarray]:
    source, short, rare, *rest = unpack(data)
    return [source, _long(short, rare), *rest]


def _packed_answer(word, *facts) -> bytes:
    return pack(word, *facts, raw=(0,))


def _packed_tokens(part, doc, learn, u, w) -> bytes:
    at, n = _texts(part, doc)
    return pack(part[at], np.diff(doc[at], prepend=np.uint32(0)), learn[at], n.astype(np.uint32), *_short(u), *_short(w), raw=(5, 7))


def _tokens_of(data: bytes) -> list[np.ndarray]:
    part, steps, learn, n, us, ur, ws, wr = unpack(data)
    doc = np.cumsum(steps, dtype=np.uint32)
    return [np.repeat(part, n), np.repeat(doc, n), np.repeat(learn, n), _long(us, ur), _long(ws, wr)]


def _packed_scores(doc, *sums) -> bytes:
    return pack(np.diff(doc, prepend=np.uint32(0)), *sums)


def _scores_of(data: bytes) -> list[np.ndarray]:
    steps, *sums = unpack(data)
    return [np.cumsum(steps, dtype=np.uint32), *sums]


def _texts(part: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of one text's tokens begins, and how long it is."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.concatenate([[0], np.flatnonzero((part[1:] != part[:-1]) | (doc[1:] != doc[:-1])) + 1])
    return at, np.diff(np.append(at, len(doc)))


_CODECS = {
    _PAIRS: (_packed_pairs, _pairs_of), _SUMS: (_packed_sums, _sums_of), _CONTEXT: (pack, unpack), _TOKENS: (_packed_tokens, _tokens_of),
    _SCORES: (_packed_scores, _scores_of), **{_ANSWER + k: (_packed_answer, unpack) for k in range(ROUNDS)},
}


def _pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return tk.mix(tk.mix(u) + w * _U(0x9E3779B97F4A7C15))


@dataclass
class _Words:
    """The commonest words: their hashes in order, the rank of each, and training counts by rank."""

    hashes: np.ndarray
    ranks: np.ndarray
    counts: np.ndarray

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return hashes | _RARE
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ranks[at].astype(np.uint64), hashes | _RARE)


@dataclass
class _Tokens:
    """Tokens of several texts, each text's end included."""

    hashes: np.ndarray
    context: np.ndarray
    doc: np.ndarray
    n: np.ndarray


def _tokens(data: np.ndarray, offsets: np.ndarray) -> _Tokens:
    w = tk.words(data, offsets, lower=True)
    n = np.diff(w.bounds)
    doc = np.repeat(np.arange(w.n_docs), n + 1)
    ends = np.cumsum(n + 1) - 1
    hashes = np.empty(len(doc), np.uint64)
    inside = np.ones(len(doc), bool)
    inside[ends] = False
    hashes[inside] = w.hashes
    hashes[ends] = _END
    context = np.empty_like(hashes)
    context[1:] = hashes[:-1]
    context[0] = _END
    return _Tokens(hashes, context, doc, n + 1)


def _docs(batch: pa.RecordBatch) -> Iterator[tuple[slice, _Tokens]]:
    for rows, data, offsets in tk.chunks(batch):
        yield rows, _tokens(data, offsets)


def _flags(batch: pa.RecordBatch) -> np.ndarray:
    return ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)


@dataclass
class _Sizes:
    """Of the whole table: all tokens, those of training, and distinct ones in training."""

    tokens: int
    n_train: int
    vocabulary: int


def common_words(docs: DataFrame, most: int = FREQUENT) -> tuple[_Words, _Sizes]:
    """The commonest words of the training texts, and sizes. All texts are counted; `most` words reach the driver."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-int(size) // WORD_BYTES))
    router = Router(_CODECS, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, 0

        def send() -> Iterator[pa.RecordBatch]:
            words = np.sort(np.concatenate(held))
            at, n = runs(words)
            words = words[at]
            yield from row_batches(router.send(_ANSWER, (words % _U(buckets)).astype(np.int64), words, n.astype(np.uint32)))

        for batch in batches:
            learn = _flags(batch)
            for rows, tokens in _docs(batch):
                total += len(tokens.hashes)
                held.append(tokens.hashes[learn[rows][tokens.doc]])
                size += len(held[-1])
                if size >= HELD:
                    yield from send()
                    held, size = [], 0
        if size:
            yield from send()
        yield from row_batches([(TaskContext.get().partitionId() % buckets, _TOTAL, pack(np.array([total])))])

    def top(rows: pa.Table) -> pa.Table:
        found = _of_kind(rows)
        tokens = sum(int(x[0][0]) for x in found.get(_TOTAL, []))
        words, n = _joined(found[_ANSWER]) if _ANSWER in found else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        order = np.argsort(words)
        at, _ = runs(words[order])
        total = np.add.reduceat(n[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        words = words[order][at]
        best = np.lexsort((words, -total))[:most]
        word = np.concatenate([words[best].view(np.int64), np.zeros(3, np.int64)])
        count = np.concatenate([total[best], [tokens, total.sum(), len(total)]])
        kind = np.concatenate([np.zeros(len(best), np.int32), np.arange(1, 4, dtype=np.int32)])
        return pa.Table.from_arrays([pa.array(word), pa.array(count), pa.array(kind)], ["word", "n", "kind"])

    sent = docs.select("text", "held_out").mapInArrow(count, ROWS)
    found = materialize(router.delivered(sent).groupBy("key").applyInArrow(top, "word long, n long, kind int"), "common")
    sums = {r.kind: int(r.n) for r in found.where("kind > 0").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    rows = found.where("kind = 0").orderBy(F.desc("n"), "word").limit(most).toArrow()
    words = rows.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    return _Words(words[order], order, rows.column("n").to_numpy()), _Sizes(*(sums.get(k, 0) for k in (1, 2, 3)))


@lru_cache(maxsize=4)
def _stirling(discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers S(c, t), for c up to STIRLING; -inf where there are none."""
    s = np.full((STIRLING + 1, STIRLING + 2), -np.inf)
    s[1, 1] = 0.0
    for c in range(1, STIRLING):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            stay = np.where(c - t * discount > 0, np.log(np.maximum(c - t * discount, 1e-300)), -np.inf) + s[c, t]
        s[c + 1, t] = np.logaddexp(s[c, t - 1], stay)
    return s


@lru_cache(maxsize=4)
def _saddle(discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many customers: log(t / c), log f and log(a / c), all ascending but f, with S(c, t + 1) / S(c, t) = f / (t * discount).

    S(c, t) is c! / (t! discount ** t) times the coefficient of z ** c in f(z) ** t, f(z) = 1 - (1 - z) ** discount; the
    saddle point z of that coefficient depends on t / c alone. a = t * discount / f: tables open at odds a to f.
    """
    x = np.linspace(100.0, -12.0, 6001)  # logit of z; t / c ascends
    log_z, log_rest = -np.logaddexp(0, -x), -np.logaddexp(0, x)
    log_f = np.log(-np.expm1(discount * log_rest))
    at = log_f + (1 - discount) * log_rest - log_z - np.log(discount)
    return at, log_f, (1 - discount) * log_rest - log_z


@lru_cache(maxsize=4)
def _short_of(discount: float) -> np.ndarray:
    """What the saddle point lacks of log(S(STIRLING, t + 1) / S(STIRLING, t)), by t; of c customers it is less by c ** discount, as is t."""
    t = np.arange(1, STIRLING * 7 // 8)
    at, log_f, _ = _saddle(discount)
    return np.diff(_stirling(discount)[STIRLING, 1 : len(t) + 2]) - np.interp(np.log((t + 0.5) / STIRLING), at, log_f) + np.log(discount * t)


def _lack(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    lack, scale = _short_of(discount), (STIRLING / c) ** discount
    return scale * np.interp(t * scale, np.arange(1, len(lack) + 1), lack)


def _log_sum(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log(x) + log(x + 1) + ... of n terms, by their middle; exact for one term, good for n up to x."""
    middle = x + (n - 1) / 2
    square = (n * n - 1.0) / (12 * middle * middle)
    return n * (np.log(middle) - square / 2 - square * (3.0 * n * n - 7) / (80 * middle * middle))


def _log_ratio(c: np.ndarray, t: np.ndarray, step: np.ndarray, discount: float) -> np.ndarray:
    """log(S(c, t + step) / S(c, t))."""
    table = _stirling(discount)
    out = np.empty(len(c))
    small = c <= STIRLING
    k, n, s = c[small], t[small], step[small]
    out[small] = table[k, n + s] - table[k, n]
    k, n, s = c[~small], t[~small], step[~small]
    at, log_f, _ = _saddle(discount)
    out[~small] = s * (np.interp(np.log((n + s / 2) / k), at, log_f) - np.log(discount) + _lack(k, n + (s - 1) / 2, discount)) - _log_sum(n, s)
    return out


def _hash_draws(key: np.ndarray, salt: int) -> np.ndarray:
    """64 bits for each key; the same whenever key and salt are."""
    return tk.mix(key + tk.mix(np.array([salt + 1], np.uint64) * _U(0x9E3779B97F4A7C15)))


def _unit(bits: np.ndarray) -> np.ndarray:
    return (bits >> _U(11)) * 2.0**-53


def seated(c: np.ndarray, of: np.ndarray, parent: np.ndarray, discount: float, strength: float, more: np.ndarray, frozen: np.ndarray) -> np.ndarray:
    """Likely numbers of tables to start from: each dish's given its restaurant's tables, and these as their sum.

    c: customers of each dish, two or more; of: its restaurant; parent: the parent's probability of the dish; more: a
    restaurant's tables of dishes of one customer; frozen: a restaurant's tables in all where not all of it is here, nan
    where it is.
    """
    n = len(more)
    low = np.log(np.maximum(1, np.bincount(of, minlength=n) + more))
    high = np.log(np.maximum(1, np.bincount(of, c, n) + more))
    at, _, opening = _saddle(discount)
    share = np.log(parent / c)

    def tables(total: np.ndarray) -> np.ndarray:
        fit = c * np.exp(np.interp(np.log(strength + discount * np.exp(total))[of] + share, opening, at))
        return np.minimum(fit * (1 + _lack(c, fit, discount)) + 1, c)  # where odds are even, and one more: the mean of skew odds

    for _ in range(12):
        middle = (low + high) / 2
        above = np.bincount(of, tables(middle), n) + more > np.exp(middle)
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    total = np.where(np.isnan(frozen), (low + high) / 2, np.log(np.maximum(1, np.nan_to_num(frozen))))
    return np.rint(tables(total)).astype(np.int64)


def gibbs(
    c: np.ndarray, t: np.ndarray, of: np.ndarray, parent: np.ndarray, discount: float, strength: float, more: np.ndarray, frozen: np.ndarray,
    key: np.ndarray, salt: int, sweeps: int, reach: np.ndarray | None = None,
) -> np.ndarray:
    """Numbers of tables after so many sweeps; arguments as in seated(), and t: the numbers so far.

    key and salt: what draws are made from; reach: the longest step, 1 if not given. Steps are of all scales up to the
    reach, drawn whatever t is, and each is between two numbers by their odds. Halves of the dishes move at a time.
    """
    t, start, n = t.copy(), t, len(more)
    total = np.bincount(of, t, n) + more
    whole = np.isnan(frozen)[of]
    scale = np.zeros(len(c)) if reach is None else np.log(np.maximum(1, reach))
    for sweep in range(sweeps):
        first, second = (_hash_draws(key, (salt * 64 + sweep) * 2 + i) for i in range(2))
        for half in range(2):
            mine = np.flatnonzero((first & _U(1)) == half)
            step = np.exp(_unit(first[mine]) * scale[mine]).astype(np.int64)
            low = t[mine] - ((first[mine] >> _U(1)) & _U(1)).astype(np.int64) * step
            ok = (low >= 1) & (low + step <= c[mine])
            mine, low, step = mine[ok], low[ok], step[ok]
            others = np.where(whole[mine], total[of[mine]] - t[mine], frozen[of[mine]] - start[mine])
            rest = np.maximum(0, others) + low
            odds = step * np.log(discount * parent[mine]) + _log_sum(strength / discount + rest, step) + _log_ratio(c[mine], low, step, discount)
            new = low + step * (_unit(second[mine]) < 1 / (1 + np.exp(-np.clip(odds, -700, 700))))
            total += np.bincount(of[mine], new - t[mine], n)
            t[mine] = new
    return t


def _bucket(u: np.ndarray, pair: np.ndarray, buckets: int, n_hot: int) -> np.ndarray:
    """Of pairs: by context, those of hot contexts by pair."""
    return (np.where(u < n_hot, pair, tk.mix(u)) % _U(buckets)).astype(np.int64)


def _count_pairs(words: _Words, buckets: int, n_hot: int, router: Router):
    def send(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        u, w, learn = (np.concatenate(x) for x in zip(*held, strict=True))
        pair = _pair(u, w)
        order = np.argsort(pair)
        at, n = runs(pair[order])
        c = np.add.reduceat(learn[order].astype(np.int64), at)
        first = order[at]
        u, w, pair, also = u[first], w[first], pair[first], c < n
        yield from row_batches(router.send(_PAIRS, _bucket(u, pair, buckets, n_hot), u, w, c, also))
        del u, w, learn, pair, order
        release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            learn = _flags(batch)
            for rows, tokens in _docs(batch):
                ids = words.ids(tokens.hashes)
                before = np.empty_like(ids)
                before[1:], before[:1] = ids[:-1], words.ids(tokens.context[:1])
                held.append((before, ids, learn[rows][tokens.doc]))
                size += len(ids)
                if size >= HELD:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    return run


@dataclass
class _Bucket:
    """A bucket's restaurants. Dishes of one customer have one table; the others, `free`, are sampled."""

    words: np.ndarray  # all words of the bucket's pairs
    word_customers: np.ndarray
    word_single: np.ndarray  # of these the tables of dishes of one customer
    contexts: np.ndarray
    customers: np.ndarray
    single: np.ndarray
    n_free: np.ndarray
    word_of: np.ndarray  # of free dishes: place in words
    c: np.ndarray
    t: list[np.ndarray]  # by round, the present one last

    def pack(self) -> bytes:
        words, contexts = _short(self.words), _short(self.contexts)
        rest = (self.word_customers, self.word_single, self.customers, self.single, self.n_free, self.word_of.astype(np.uint32), self.c, *self.t)
        return pack(*words, *contexts, *rest, raw=(1, 3))

    @classmethod
    def unpack(cls, x: list[np.ndarray]) -> _Bucket:
        return cls(_long(x[0], x[1]), x[4], x[5], _long(x[2], x[3]), x[6], x[7], x[8], x[9].astype(np.int64), x[10], x[11:])

    @property
    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.contexts)), self.n_free)

    @property
    def pairs(self) -> np.ndarray:
        return _pair(np.repeat(self.contexts, self.n_free), self.words[self.word_of])

    def tables(self, t: np.ndarray) -> np.ndarray:
        """Tables of each context."""
        return self.single + np.bincount(self.of, t, len(self.contexts)).astype(np.int64)

    def frozen(self, hot_tables: np.ndarray) -> np.ndarray:
        out = np.full(len(self.contexts), np.nan)
        hot = self.contexts < len(hot_tables)
        out[hot] = hot_tables[self.contexts[hot].astype(np.int64)]
        return out

    def messages(self, key: int, buckets: int, n_hot: int, router: Router) -> list[tuple]:
        """Words' customers and tables for their owners, and hot contexts' tables for theirs."""
        owner = lambda ids: (tk.mix(ids) % _U(buckets)).astype(np.int64)
        tables = self.word_single + np.bincount(self.word_of, self.t[-1], len(self.words)).astype(np.int64)
        rows = router.send(_SUMS, owner(self.words), np.full(len(self.words), key), self.words, self.word_customers, tables)
        hot = np.flatnonzero(self.contexts < n_hot)
        return rows + router.send(_CONTEXT, owner(self.contexts[hot]), self.contexts[hot].astype(np.int64), self.tables(self.t[-1])[hot])


def _seat(words: _Words, sizes: _Sizes, buckets: int, n_hot: int, router: Router):
    """Round 0 of a bucket's restaurants, from pairs on."""
    share = words.counts / max(1, sizes.n_train)
    rare_share = float(share[-1]) / 2 if len(share) else 1.0
    hot_tables = words.counts[:n_hot] ** 0.8  # a guess for this round; the next has their sum

    def run(group: pa.Table) -> pa.Table:
        key = group.column("key")[0].as_py()
        u, w, c, also = _joined(_of_kind(group)[_PAIRS])
        pair = _pair(u, w)
        order = np.argsort(pair)
        pair = pair[order]
        at, _ = runs(pair)
        c = np.add.reduceat(c[order].astype(np.int64), at)
        also = np.maximum.reduceat(also[order], at)
        u, w, pair = u[order][at], w[order][at], pair[at]
        once = np.sort(pair[(c == 1) & also])
        del also, at
        order = np.argsort(u, kind="stable")
        u, w, pair, c = u[order], w[order], pair[order], c[order]
        del order
        at, n = runs(u)
        of = np.repeat(np.arange(len(at)), n)
        named, word_of = np.unique(w, return_inverse=True)
        count = lambda x, weight, size: np.bincount(x, weight, size).astype(np.int64)
        free = c > 1
        held = _Bucket(
            named, count(word_of, c, len(named)), count(word_of, c == 1, len(named)), u[at], count(of, c, len(at)),
            count(of, c == 1, len(at)), count(of, free, len(at)), word_of[free], c[free], [],
        )
        known = np.minimum(named, _U(max(0, len(share) - 1))).astype(np.int64)
        guess = np.where(named < _RARE, share[known] if len(share) else 1.0, rare_share)[held.word_of]
        frozen = held.frozen(hot_tables)
        where = (held.c, held.of, guess, DISCOUNT, STRENGTH, held.single.astype(float), frozen)
        t = seated(*where)
        held.t = [gibbs(held.c, t, *where[1:], pair[free], 0, SWEEPS, t)]
        rows = [(key, _STATE, held.pack()), (key, _ONCE, pack(once, raw=(0,))), *held.messages(key, buckets, n_hot, router)]
        release()
        return table(rows)

    return run


def _reseat(model, k: int, buckets: int, router: Router):
    """Round k of a bucket's restaurants, given the root of the round before."""
    last = k == ROUNDS - 1

    def run(group: pa.Table) -> pa.Table:
        m: Model = model.value
        found = _of_kind(group)
        if _STATE not in found:  # no pair of the bucket was ever seen in training
            return table([])
        key, held = group.column("key")[0].as_py(), _Bucket.unpack(found[_STATE][0])
        root = m.root_of_words(held.words, m.answered(found.get(_ANSWER + k - 1, []), k - 1), k - 1)
        t, pair = held.t[-1], held.pairs
        where = (held.of, root[held.word_of], DISCOUNT, STRENGTH, held.single.astype(float), held.frozen(m.context_tables[k - 1]))
        held.t = [*held.t[-SAMPLES + 1 :], gibbs(held.c, t, *where, pair, k, SWEEPS, t)]
        rows = [(key, _STATE, held.pack()), *held.messages(key, buckets, m.n_hot, router)]
        if last:
            u, w = np.repeat(held.contexts, held.n_free), held.words[held.word_of]
            hot = np.flatnonzero((u < _RARE) & (w < _RARE) & (held.c >= max(16, m.n_train >> HOT_PAIR_LOG2)))
            if len(hot):
                tables = [held.tables(t)[held.of[hot]] for t in held.t]
                rows.append((key, _HOT, pack(pair[hot], u[hot], w[hot], held.c[hot], *[t[hot] for t in held.t], *tables, raw=(0,))))
        release()
        return table(rows)

    return run


def root_tables(word: np.ndarray, customers: np.ndarray, k: int, total: float, vocabulary: int) -> np.ndarray:
    """The root's tables of words in round k, given its tables in the round before."""
    out = np.minimum(customers, 1)
    free = np.flatnonzero(customers > 1)
    c, base = customers[free], np.full(len(free), 1.0 / (vocabulary + 1))
    where = (np.zeros(len(free), np.int64), base, ROOT_DISCOUNT, ROOT_STRENGTH, np.zeros(1), np.array([total]))
    if len(free):
        t = seated(c, *where)
        out[free] = gibbs(c, t, *where, tk.mix(word[free]), ROUNDS + k, SWEEPS, t)
    return out


def _own(k: int, total: float, vocabulary: int, router: Router):
    """A word's owner: its customers at the root and its tables there, for the buckets that have the word."""

    def run(group: pa.Table) -> pa.Table:
        key, found = group.column("key")[0].as_py(), _of_kind(group)
        rows = []
        if _CONTEXT in found:
            context, tables = _joined(found[_CONTEXT])
            names, at = np.unique(context, return_inverse=True)
            rows.append((key, _CONTEXT, pack(names, np.bincount(at, tables).astype(np.int64))))
        if _SUMS in found:
            source, word, *sums = _joined(found[_SUMS])
            order = np.lexsort((source, word))
            source, word, sums = source[order], word[order], [x[order] for x in sums]
            at, n = runs(word)
            of = np.repeat(np.arange(len(at)), n)
            count, customers = (np.add.reduceat(x, at) for x in sums)
            word = word[at]
            tables = root_tables(word, customers, k, total, vocabulary)
            rows.append((key, _TOTAL, pack(np.array([customers.sum()], np.int64), np.array([tables.sum()], np.int64))))
            rare = word >= _RARE
            if not rare.all():
                rows.append((key, _COMMON, pack(*[x[~rare].astype(np.int64) for x in (word, count, customers, tables)])))
            asked = rare[of]
            of = of[asked]
            rows += router.send(_ANSWER + k, source[asked], word[of], count[of], customers[of], tables[of])
        return table(rows)

    return run


@dataclass
class Model:
    """What every task of sampling and scoring knows."""

    words: _Words
    n_train: int
    vocabulary: int
    n_hot: int
    root_customers: np.ndarray  # by round
    root_tables: np.ndarray
    counts: np.ndarray  # of common words by rank
    root: np.ndarray  # the root's probability of common words, by round and rank
    context_tables: np.ndarray  # of hot contexts, by round and rank
    hot_pairs: np.ndarray
    hot_logs: np.ndarray

    def root_of(self, customers: np.ndarray, tables: np.ndarray, k: int) -> np.ndarray:
        """The root's probability of words of so many customers and tables, in round k."""
        base = (ROOT_STRENGTH + ROOT_DISCOUNT * self.root_tables[k]) / (self.vocabulary + 1)
        return (np.maximum(0.0, customers - ROOT_DISCOUNT * tables) + base) / (ROOT_STRENGTH + self.root_customers[k])

    def answered(self, answers: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words that owners told of in round k, in order: their hashes, training counts, and the root's probabilities."""
        if not answers:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
        word, count, customers, tables = _joined(answers)
        order = np.argsort(word)
        return word[order], count[order], self.root_of(customers, tables, k)[order]

    def root_of_words(self, words: np.ndarray, answered: tuple, k: int) -> np.ndarray:
        """The root's probability: common words' as known, others' as answered, unknown ones' else."""
        out = np.full(len(words), self.root_of(np.zeros(1), np.zeros(1), k)[0])
        common = words < _RARE
        out[common] = self.root[k][words[common].astype(np.int64)]
        if len(answered[0]):
            at, there = _find(answered[0], words[~common])
            out[~common] = np.where(there, answered[2][at], out[~common])
        return out

    def log(self, c, seats: list, customers, tables: list, root: list) -> np.ndarray:
        """Logarithm of the average predictive probability, in units."""
        p = 0.0
        for s in range(SAMPLES):
            more = (STRENGTH + DISCOUNT * tables[s]) * root[s]
            p = p + (np.maximum(0.0, c - DISCOUNT * seats[s]) + more) / (STRENGTH + customers)
        return np.rint(_UNIT * np.log10(p / SAMPLES)).astype(np.int64)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.rint(_UNIT * np.log10((c + 1) / (self.n_train + self.vocabulary + 1))).astype(np.int64)


#: The rounds that are averaged.
SAMPLED = range(ROUNDS - SAMPLES, ROUNDS)


def _collected(found: DataFrame, kind: int) -> list[list[np.ndarray]]:
    """Rows of a kind whose content is bounded by a parameter, put together in tasks first: the driver gets 64 at most."""

    def merged(group: pa.Table) -> pa.Table:
        parts = _of_kind(group)[kind]
        joined = [x.sum(keepdims=True) for x in _joined(parts)] if kind == _TOTAL else _joined(parts)
        return table([(group.column("key")[0].as_py(), kind, pack(*joined))])

    rows = found.where(F.col("kind") == kind)
    for groups in (4096, 64):
        rows = rows.select((F.pmod("key", F.lit(groups))).alias("key"), "kind", "data").groupBy("key").applyInArrow(merged, ROWS)
    return [unpack(bytes(r.data)) for r in rows.select("data").collect()]


def train(docs: DataFrame, frequent: int = FREQUENT, bucket_tokens: int = BUCKET_TOKENS, hot_customers: int = HOT_CUSTOMERS, routes: int = ROUTES) -> tuple[Model, DataFrame, Router]:
    """The model from docs (text, held_out): what tasks know, rows for buckets, and what sends to them. frequent: words to broadcast, at most FREQUENT."""
    spark = docs.sparkSession
    words, sizes = common_words(docs, frequent)
    buckets = max(1, -(-sizes.tokens // bucket_tokens))
    router = Router(_CODECS, buckets, routes)
    n_hot = int((words.counts >= hot_customers).sum())
    n = len(words.counts)
    model = Model(
        words, sizes.n_train, sizes.vocabulary, n_hot, np.zeros(ROUNDS), np.zeros(ROUNDS), words.counts.astype(np.int64),
        np.zeros((ROUNDS, n)), np.zeros((ROUNDS, n_hot)), np.zeros(0, np.uint64), np.zeros(0, np.int64),
    )
    pairs = docs.select("text", "held_out").mapInArrow(_count_pairs(words, buckets, n_hot, router), ROWS)
    seats = router.delivered(pairs).groupBy("key").applyInArrow(_seat(words, sizes, buckets, n_hot, router), ROWS)
    total, answers, once, before = 1.3 * sizes.vocabulary, [], None, []
    for k in range(ROUNDS):
        seats = materialize(seats, "seated")
        for settled in before:  # of the round before
            forget(settled)
        if once is None:
            once = materialize(seats.where(F.col("kind") == _ONCE), "once")
        sums = seats.where(F.col("kind").isin(_SUMS, _CONTEXT))
        owned = materialize(router.delivered(sums).groupBy("key").applyInArrow(_own(k, total, sizes.vocabulary, router), ROWS), "owned")
        before = [seats] if k in SAMPLED else [seats, owned]
        model.root_customers[k], model.root_tables[k] = np.sum([[x[0][0], x[1][0]] for x in _collected(owned, _TOTAL)] or [np.zeros(2)], axis=0)
        total = float(model.root_tables[k])
        if common := _collected(owned, _COMMON):
            rank, _, customers, tables = _joined(common)
            model.root[k, rank] = model.root_of(customers, tables, k)
        for names, tables in _collected(owned, _CONTEXT):
            model.context_tables[k, names] = tables
        answers.append(owned.where(F.col("kind") == _ANSWER + k))
        state = seats.where(F.col("kind") == _STATE)
        if k + 1 < ROUNDS:
            shared = spark.sparkContext.broadcast(model)
            seats = state.unionByName(router.delivered(answers[-1])).groupBy("key").applyInArrow(_reseat(shared, k + 1, buckets, router), ROWS)
    if hot := _collected(seats, _HOT):
        pair, u, w, c, *rest = _joined(hot)
        order = np.argsort(pair)
        pair, u, w, c, rest = pair[order], u[order].astype(np.int64), w[order].astype(np.int64), c[order], [x[order] for x in rest]
        split = u < n_hot
        tables = [rest[SAMPLES + s].astype(float) for s in range(SAMPLES)]
        for s, k in enumerate(SAMPLED):
            tables[s][split] = model.context_tables[k][u[split]]
        model.hot_pairs, model.hot_logs = pair, model.log(c, rest[:SAMPLES], model.counts[u], tables, [model.root[k, w] for k in SAMPLED])
    rows = state.unionByName(once)
    for k in SAMPLED:
        rows = rows.unionByName(router.delivered(answers[k]))
    return model, rows, router


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each wanted key among sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _sums(part: np.ndarray, doc: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """part, doc and values summed by text, whose tokens stand together."""
    at, _ = _texts(part, doc)
    return [part[at], doc[at].astype(np.uint32), *(np.add.reduceat(v, at) if len(at) else v for v in values)]


#: Keys of parts (documents that a task sent together) lie beyond those of buckets.
_PART = 1 << 40


def _send_tokens(model, buckets: int, router: Router):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        task = TaskContext.get().partitionId()
        held: list[tuple] = []
        size = sent = 0

        def send() -> Iterator[pa.RecordBatch]:
            # a retried task reads the same rows and so makes the same parts
            part = _PART + (task << 20) + sent
            u, w, n, ids, known, learn = (np.concatenate(x) for x in zip(*held, strict=True))
            doc = np.repeat(np.arange(len(n), dtype=np.uint32), n)
            pair = _pair(u, w)
            common = w < _RARE
            c = m.counts[w[common].astype(np.int64)]
            seen, base = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
            seen[common], base[common] = c > 0, m.base(c)
            at, hot = _find(m.hot_pairs, pair)
            log = np.where(hot, m.hot_logs[at], 0) if len(m.hot_pairs) else np.zeros(len(w), np.int64)
            parts = np.full(len(w), part)
            rows = [(part, _DOCS, pack(ids, known, learn, n)), (part, _SCORES, _packed_scores(*_sums(parts, doc, [seen, base, log])[1:]))]
            rest = np.flatnonzero(~hot)
            rows += router.send(_TOKENS, _bucket(u[rest], pair[rest], buckets, m.n_hot), parts[rest], doc[rest], learn[doc[rest]], u[rest], w[rest])
            yield from row_batches(rows)
            del u, w, n, doc, pair, rest, parts
            release()

        for batch in batches:
            learn = _flags(batch)
            ids = batch.column("doc_id")
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            for rows, tokens in _docs(batch):
                words = m.words.ids(tokens.hashes)
                u = np.empty_like(words)
                u[1:], u[:1] = words[:-1], m.words.ids(tokens.context[:1])
                held.append((u, words, tokens.n, ids[rows], known[rows], learn[rows]))
                size += len(words)
                if size >= HELD:
                    yield from send()
                    held, size, sent = [], 0, sent + 1
        if held:
            yield from send()

    return run


def _score_bucket(model, router: Router):
    def run(group: pa.Table) -> pa.Table:
        m: Model = model.value
        if group.column("key")[0].as_py() >= _PART:  # a part's documents and sums wait for the rest
            return group.select(["key", "kind", "data"])
        found = _of_kind(group)
        rows = []
        empty = np.zeros(0, np.uint64)
        names, customers, tables = empty, empty, [empty] * SAMPLES
        pairs, pair_c, seats = [empty], [empty.astype(np.int64)], [[empty.astype(np.int64)] for _ in range(SAMPLES)]
        if _STATE in found:
            held = _Bucket.unpack(found[_STATE][0])
            cold = held.contexts >= m.n_hot
            names, customers, tables = held.contexts[cold], held.customers[cold], [held.tables(t)[cold] for t in held.t]
            pairs, pair_c, seats = [held.pairs], [held.c], [[t] for t in held.t]
        for (once,) in found.get(_ONCE, []):
            pairs.append(once)
            for x in (pair_c, *seats):
                x.append(np.ones(len(once), np.int64))
        pairs, pair_c, seats = np.concatenate(pairs), np.concatenate(pair_c), [np.concatenate(x) for x in seats]
        order = np.argsort(pairs)
        pairs, pair_c, seats = pairs[order], pair_c[order], [x[order] for x in seats]
        answered = [m.answered(found.get(_ANSWER + k, []), k) for k in SAMPLED]
        word, word_c, _ = answered[-1]
        for part, doc, learn, u, w in found.get(_TOKENS, []):
            at, there = _find(pairs, _pair(u, w))
            # a training text's pair that is not in the model occurs there and nowhere else
            alone = learn.astype(np.int64)
            c = np.where(there, pair_c[at], alone) if len(pairs) else alone
            t = [np.where(there, s[at], alone) if len(pairs) else alone for s in seats]
            at, there = _find(names, u)
            cu = np.where(there, customers[at], 0).astype(np.int64) if len(names) else np.zeros(len(u), np.int64)
            tu = [np.where(there, x[at], 0).astype(np.int64) if len(names) else np.zeros(len(u), np.int64) for x in tables]
            hot = np.flatnonzero(u < m.n_hot)
            hot_u = u[hot].astype(np.int64)
            cu[hot] = m.counts[hot_u]
            for s, k in enumerate(SAMPLED):
                tu[s][hot] = m.context_tables[k][hot_u]
            rare = w >= _RARE
            common = w[~rare].astype(np.int64)
            at, there = _find(word, w[rare])
            cw = np.where(there, word_c[at], 0).astype(np.int64) if len(word) else np.zeros(len(at), np.int64)
            root = [np.empty(len(w)) for _ in SAMPLED]
            for r, known_root, k in zip(root, answered, SAMPLED, strict=True):  # owners answer for the same words in all rounds
                unknown = m.root_of(np.zeros(1), np.zeros(1), k)[0]
                r[~rare] = m.root[k][common]
                r[rare] = np.where(there, known_root[2][at], unknown) if len(word) else unknown
            known, base = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
            known[rare], base[rare] = cw > 0, m.base(cw)
            part, *sums = _sums(part, doc, [known, base, m.log(c, t, cu, tu, root)])
            rows += router.send(_SCORES, part, *sums)
        release()
        return table(rows)

    return run


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _gather(n_train: int):
    """A part's documents, and what all buckets have of them."""

    def run(group: pa.Table) -> pa.Table:
        found = _of_kind(group)
        ids, known, learn, n = found[_DOCS][0]
        sums = [np.zeros(len(n), np.int64) for _ in range(3)]
        for where, *values in found[_SCORES]:
            for s, v in zip(sums, values, strict=True):
                np.add.at(s, where, v)
        columns = [
            pa.array(ids, mask=~known), pa.array(~learn), pa.array(n.astype(np.int64)), pa.array(sums[0]),
            pa.array(np.full(len(n), n_train, np.int64)), pa.array(sums[1] / _UNIT), pa.array(sums[2] / _UNIT),
        ]
        return pa.Table.from_arrays(columns, [x.split()[0] for x in _OUT.split(", ")])

    return run


def score(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of docs (doc_id, text, held_out)."""
    spark = docs.sparkSession
    model, rows, router = train(docs, **options)
    shared = spark.sparkContext.broadcast(model)
    sent = router.delivered(docs.select("doc_id", "text", "held_out").mapInArrow(_send_tokens(shared, router.receivers, router), ROWS))
    scored = router.delivered(sent.unionByName(rows).groupBy("key").applyInArrow(_score_bucket(shared, router), ROWS))
    return scored.groupBy("key").applyInArrow(_gather(model.n_train), _OUT)


def digest(docs: DataFrame) -> DataFrame:
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(7)))
