"""Records reach their receivers in one step and in two, at a cost that does not grow with the receivers."""

from __future__ import annotations

import time
from collections import defaultdict

import numpy as np
import pytest
from quarrymill.llm import lm, routing
from quarrymill.llm import textkernel as tk


def deliver(router, rows):
    """What delivered() does with rows of one task."""
    batch = routing.table(sorted(rows, key=lambda r: r[0])).combine_chunks()
    return [tuple(r.values()) for b in router.regroup(iter(batch.to_batches())) for r in b.to_pylist()] if router.two_steps else rows


def some_tokens(n, seed=0):
    rng = np.random.default_rng(seed)
    w = np.minimum(rng.zipf(1.2, n), 1 << 40).astype(np.uint64)
    return np.where(w < 1000, w, tk.mix(w) | lm._RARE), np.roll(w, 1) % np.uint64(1000)


@pytest.mark.parametrize("receivers", [3, 5000])
def test_records_arrive_once_and_whole(receivers):
    router = routing.Router(lm._CODECS, receivers, routes=16)
    w, u = some_tokens(20_000)
    to = (lm._pair(u, w) % np.uint64(receivers)).astype(np.int64)
    part, doc = np.repeat([1 << 40, 1 << 41], 10_000), (np.arange(20_000) // 37).astype(np.uint32)
    learn = doc % 3 == 0
    want = defaultdict(list)
    for record in zip(to.tolist(), part.tolist(), doc.tolist(), learn.tolist(), u.tolist(), w.tolist(), strict=True):
        want[record[0]].append(record[1:])
    got = defaultdict(list)
    for key, kind, data in deliver(router, [*router.send(lm._TOKENS, to, part, doc, learn, u, w), (7, lm._DOCS, b"as it is")]):
        if kind == lm._DOCS:
            assert (key, data) == (7, b"as it is")
        else:
            got[key] += zip(*(x.tolist() for x in lm._CODECS[kind][1](data)), strict=True)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_cost_of_a_token_does_not_grow_with_the_receivers():
    """One task's pairs, to 8,300 and to a hundred times as many buckets: bytes and seconds a pair, both steps counted."""
    w, u = some_tokens(lm.HELD)
    cost = {}
    for buckets in (8_300, 830_000):
        router = routing.Router(lm._CODECS, buckets)
        to = lm._bucket(u, lm._pair(u, w), buckets, 0)
        size = seconds = 0.0
        began = time.perf_counter()
        rows = router.send(lm._PAIRS, to, u, w, np.ones(len(u), np.int64), np.zeros(len(u), bool))
        seconds += time.perf_counter() - began
        assert len(rows) <= routing.ROUTES
        size += sum(len(r[2]) for r in rows)
        # a route gets such a message of each task: as many as make up what it holds at a time
        routes = sorted({r[0] for r in rows})[:2]
        for route in routes:
            data = next(r for r in rows if r[0] == route)
            n = len(router._read(lm._PAIRS, data[2])[0])
            many = [data] * (routing.HELD // n)
            began = time.perf_counter()
            out = list(router.regroup(iter(routing.table(many).combine_chunks().to_batches())))
            seconds += (time.perf_counter() - began) / len(routes)
            size += sum(len(x.as_py()) for b in out for x in b.column("data")) / len(routes)
        cost[buckets] = size, seconds
    assert cost[830_000][0] < 1.5 * cost[8_300][0]
    assert cost[830_000][1] < 2.5 * cost[8_300][1]


def test_scores_do_not_depend_on_the_steps(spark):
    texts = [" ".join(f"w{(i * j) % 23}" for j in range(40)) for i in range(30)] + [None, "", "one more"]
    docs = spark.createDataFrame([(i, t, i % 7 == 2) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean").repartition(3)
    found = [sorted(map(tuple, lm.score(docs, frequent=5, bucket_tokens=100, **x).collect())) for x in ({}, {"routes": 2})]
    assert found[0] == found[1]
