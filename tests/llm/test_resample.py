"""Importance resampling against a plain account of the same arithmetic."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from quarrymill.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, rank string, _row int, key string, weight double"


def grams(text, most):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, most, buckets, percent, least):
    """(doc_id, n_features, weight, score, rank) of each row, by going through all texts."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    found = [grams(t, most) for _, t in docs]
    s = Counter(bucket(g) for _, x in found for g in x)
    t = Counter(bucket(g) for x in target for g in grams(x, most)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets))))
    rows = []
    for (i, _), (n, x) in zip(docs, found, strict=True):
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in x)
        rows.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {}
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        ranks.setdefault((r[0], r[3]), []).append(place)
    return [(*r[:4], ranks[r[0], r[3]].pop(0) if r[4] and ranks.get((r[0], r[3])) else None) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    vocabulary = ["the", "THE", "Ünïcode", "日本", "a1", "x" * 60, "b-c", "É"] + [f"w{i}" for i in range(80)]
    sentence = lambda n: rng.choice([" ", ", ", "\x00"]).join(rng.choice(vocabulary) for _ in range(n))
    texts = [None, "", " .,! ", "one", "y" * 50_000, sentence(9000), *[sentence(rng.randrange(1, 60)) for _ in range(60)]]
    texts += [texts[10]] * 9 + [texts[5]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [rows[3], rows[3], (None, texts[20]), (None, texts[20]), (7, texts[21]), (None, None)]
    target = [sentence(20), None, "the the a1", ""]
    frame = spark.createDataFrame([(i, t, "clash", 1, "k", 0.5) for i, t in rows], SCHEMA).repartition(4)
    return rows, target, frame, spark.createDataFrame([(t,) for t in target], "text string")


@pytest.mark.parametrize(("most", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (3, 70_000, 40, 2)])
def test_weights_scores_and_ranks(docs, most, buckets, percent, least):
    rows, target, frame, aimed = docs
    got = resample.rank(frame, aimed, ["doc_id"], percent=percent, most=most, buckets=buckets, least_words=least)
    want = brute(rows, target, most, buckets, percent, least)
    assert sorted(map(tuple, got.drop("_row").collect()), key=repr) == sorted(want, key=repr)
    assert any(r[4] for r in want)


def test_drawn_documents_keep_their_columns(docs, spark):
    rows, target, frame, aimed = docs
    drawn = resample.draw(frame, aimed, percent=30, least_words=5)
    assert drawn.columns == [*frame.columns, "rank_"]
    got = drawn.collect()
    assert sorted(r.rank_ for r in got) == list(range(1, len(got) + 1)) and all(r["rank"] == "clash" and r._row == 1 for r in got)
    want = {(r[0], r[4]) for r in brute(rows, target, 1, 10_000, 30, 5) if r[4]}
    assert {(r.doc_id, r.rank_) for r in got} == want
    texts = {(i, t) for i, t in rows}
    assert all((r.doc_id, r.text) in texts for r in got)


def test_nothing_to_draw_from(docs, spark):
    rows, _, frame, aimed = docs
    assert resample.digest(frame.limit(0), aimed).collect() == []
    assert resample.draw(frame.limit(0), aimed).collect() == []
    got = resample.digest(frame, aimed.limit(0))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows, [], 1, 10_000, 10, 20), key=repr)


def test_crc_of_slices():
    data = np.frombuffer(bytes(random.Random(1).randrange(256) for _ in range(3000)), np.uint8)
    starts = np.array([0, 5, 5, 100, 2999, 17], np.int64)
    ends = np.array([0, 6, 53, 2100, 3000, 66], np.int64)
    assert resample.crc32(data, starts, ends).tolist() == [zlib.crc32(data[a:b]) for a, b in zip(starts, ends, strict=True)]
