"""Spans, byte-span dedup and what they stand on, against brute force."""

from __future__ import annotations

import hashlib
import random
import uuid
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark import TaskContext
from quarrymill.llm import bytespans, passages, suffixes
from quarrymill.llm import textkernel as tk

SCHEMA = "doc_id long, text string, lang string, n_chars long, _doc int, _tie string, _ranges string, doc int, tie int, gram long"


def make_texts(seed):
    """Texts with copies, shared passages, periodic stretches and characters of several bytes."""
    rng = random.Random(seed)
    sentence = lambda n, letters="abcdé ": "".join(rng.choice(letters) for _ in range(n))
    passage, short = sentence(90), sentence(30)
    texts = [None, "", " \t\n ", "a", "x" * 300, "x" * (seed + 3), "ab" * 150, "\x00" * 80, "日本語のテキスト" * 9, sentence(400, "ab"), sentence(700)]
    texts += [f"{sentence(rng.randrange(60))}{passage}{sentence(rng.randrange(60))}" for _ in range(6)]
    texts += [f"{sentence(rng.randrange(20, 60))}{short}{sentence(rng.randrange(20, 60))}" for _ in range(60)]
    texts += [texts[10], texts[10], texts[10][:300] + "Z" + texts[10][300:], texts[12][20:], "é" + texts[11]]
    return texts


def rows_of(texts, rng):
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "en", len(t or ""), 1, "t", None, 5, 6, 7) for i, t in zip(ids, texts, strict=True)]
    return [*rows, rows[10], (rows[10][0], texts[14], *rows[10][2:]), (None, texts[13], *rows[10][2:]), (None, texts[13], *rows[10][2:])]


def brute_bytes(rows, width):
    """What each different (id, text) loses: [gone] by byte."""
    found = {(r[0], r[1]): (r[1] or "").encode() for r in rows}
    seen = Counter(t[i : i + width] for t in found.values() for i in range(len(t) - width + 1))
    out = {}
    for key, t in found.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        out[key] = gone
    return out


@pytest.mark.parametrize(("gram", "width"), [(8, 20), (1, 5), (20, 20), (19, 20)])
def test_equal_windows_pick_equal_grams_and_each_window_once(gram, width):
    rng = random.Random(gram)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 3, width, 50, 300)] + ["a" * 200, "ab" * 90, "aab" * 70]
    texts += [texts[4][7:200], "b" + texts[3]]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    cut = passages.Bytes(data, offsets)
    alone = passages.Bytes(data, offsets[-3:-1])
    at = cut.bounds[-3]
    assert (alone.grams(gram) == cut.grams(gram)[at : at + len(alone.data) - gram + 1]).all()
    value, doc, start, n, _ = passages.pick(cut.grams(gram), cut.bounds, gram, width)
    of = {}
    for v, d, s, k in zip(value.tolist(), doc.tolist(), start.tolist(), n.tolist(), strict=True):
        for w in range(s, s + k):
            assert w not in of
            of[w] = v
            assert cut.bounds[d] <= w and w + width <= cut.bounds[d + 1]
    assert len(of) == sum(max(0, len(t) - width + 1) for t in texts)
    by_text = defaultdict(set)
    for w, v in of.items():
        by_text[data[w : w + width].tobytes()].add(v)
    assert all(len(x) == 1 for x in by_text.values())
    if gram == 8:  # a stretch that repeats within itself does not pick every place
        assert np.count_nonzero(doc == 5) < 200 / 3


def test_suffix_arrays_and_run_index_against_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        parts = [[rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(12))] for _ in range(rng.randrange(1, 5))]
        symbols = np.array([x for p in parts for x in (*p, 0)]) * rng.choice([1, 100_000])
        stops = np.cumsum([len(p) + 1 for p in parts]) - 1
        code = [(1, x) for x in symbols.tolist()]
        for k, at in enumerate(stops.tolist()):
            code[at] = (0, k)
        order = sorted(range(len(code)), key=lambda i: code[i:])
        found, rank = suffixes.suffix_array(symbols, stops)
        assert found.tolist() == order
        assert rank[found].tolist() == list(range(len(code)))

        def common(i, j):
            n = 0
            while max(i, j) + n < len(code) and code[i + n] == code[j + n]:
                n += 1
            return n

        index, _, _ = suffixes.RunIndex.build(symbols, stops)
        assert int(index.sizes.sum()) == len(code)
        assert index.matching_statistics().tolist() == [max((common(i, j) for j in range(len(code)) if j != i), default=0) for i in range(len(code))]


def test_runs_of_a_repetitive_block_are_few():
    rng = random.Random(2)
    text = bytes(rng.randrange(97, 123) for _ in range(3000))
    block = (text + b"\x00") * 20
    index, _, _ = suffixes.RunIndex.build(np.frombuffer(block, np.uint8), np.arange(3000, len(block), 3001))
    assert len(index.chars) < len(block) / 15
    assert (index.matching_statistics()[:3000] == 3000 - np.arange(3000)).all()


def test_range_minima():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 50, 77)
    low = rng.integers(0, 77, 400)
    high = np.minimum(76, low + rng.integers(0, 77, 400))
    assert suffixes.Minimum(values).of(low, high).tolist() == [values[a : b + 1].min() for a, b in zip(low, high, strict=True)]


@pytest.mark.parametrize(("width", "sizes"), [(20, {}), (20, {"group_bytes": 100, "block_bytes": 300}), (45, {"group_bytes": 1}), (5, {"group_bytes": 1})])
def test_byte_spans(spark, width, sizes):
    rows = rows_of(make_texts(width), random.Random(4))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    gone = brute_bytes(rows, width)
    runs = lambda g: int(np.count_nonzero(np.diff(np.concatenate([[0], g.astype(int)])) == 1))

    def left(key):
        return np.frombuffer((key[1] or "").encode(), np.uint8)[~gone[key]].tobytes()

    want = sorted(((r[0], len(gone[r[:2]]), int(gone[r[:2]].sum()), runs(gone[r[:2]]), hashlib.sha256(left(r[:2])).hexdigest()) for r in rows), key=repr)
    assert sorted(map(tuple, bytespans.digest(docs, width, **sizes).collect()), key=repr) == want
    if sizes == {}:
        found = bytespans.dedup(docs, width, **sizes)
        assert found.columns == docs.columns
        texts = [left(r[:2]).decode(errors="ignore") for r in rows]
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(((r[0], t, r[2], len(t), *r[4:]) for r, t in zip(rows, texts, strict=True)), key=repr)
        spans = [tuple(x) for x in bytespans.spans(docs, width).collect()]
        assert sum(n for _, _, n in spans) == sum(int(gone[r[:2]].sum()) for r in rows)


def test_a_task_has_few_blocks(spark, tmp_path):
    folder = str(tmp_path)

    def noted(texts, n, width):
        at = TaskContext.get()
        open(f"{folder}/{at.stageId()}-{at.partitionId()}-{uuid.uuid4().hex}", "w").close()
        return bytespans.repeated(texts, n, width)

    docs = spark.createDataFrame(rows_of(make_texts(20), random.Random(4)), SCHEMA).select("doc_id", "text")
    passages.with_marks(docs, replace(bytespans.plan(20, block_bytes=300), decide=noted))[0].collect()
    tasks = Counter(x.name.rsplit("-", 1)[0] for x in tmp_path.iterdir())
    assert sum(tasks.values()) > 6 * passages.TASK_BLOCKS
    assert max(tasks.values()) <= passages.TASK_BLOCKS


def test_byte_spans_of_nothing_and_of_long_texts(spark, monkeypatch):
    empty = spark.createDataFrame([], SCHEMA)
    assert bytespans.digest(empty).collect() == []
    assert bytespans.dedup(empty).collect() == []
    assert bytespans.spans(empty).collect() == []
    monkeypatch.setattr(tk, "CHUNK", 1 << 16)
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(1200))
    long = "".join(rng.choice("abcdefghij ") for _ in range(300_000))
    texts = [long + passage, passage + long[::-1], long[1000:1399], long[5000:5400], "q" * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in bytespans.digest(docs).collect()}
    assert got == {0: (301_200, 1600, 2), 1: (301_200, 1200, 1), 2: (399, 0, 0), 3: (400, 400, 1), 4: (200_000, 200_000, 1)}
