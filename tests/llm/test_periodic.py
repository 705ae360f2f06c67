"""Runs of words against a search over all periods and starts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from quarrymill.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n_chars int, start long, period string"


def brute_runs(w, exponent, least):
    out = set()
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(least, exponent * q) and not any(all(w[i + k] == w[i + k + r] for k in range(n - r)) for r in range(1, q)):
                out.add((i, n, q))
            i = j
    return sorted(out, key=lambda x: (x[0], x[2]))


def brute_digest(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w, 4, 6)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *facts, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def some_texts(seed=4):
    rng = random.Random(seed)
    some = lambda n: [rng.choice(["a", "b", "é", "日本", "a,", "B"]) for _ in range(n)]
    texts = [None, "", " \n\t ", "a", "a " * 6, "a " * 5, "a b " * 4 + "a", "\x85x  " * 9, "a\x00 a " * 4]
    for _ in range(90):
        w = []
        for _ in range(rng.randrange(1, 6)):
            w += some(rng.randrange(1, 6)) * rng.randrange(1, 8)
        texts.append(rng.choice([" ", "\n", " \t"]).join(w))
    return texts


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 5)])
def test_runs_of_texts_side_by_side(exponent, least):
    rng = random.Random(exponent)
    for _ in range(300):
        docs = [[x for _ in range(rng.randrange(5)) for x in [rng.randrange(4) for _ in range(rng.randrange(1, 5))] * rng.randrange(1, 7)] for _ in range(rng.randrange(1, 4))]
        ids = np.array([x for d in docs for x in d], np.int64)
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        got = list(zip(*(x.tolist() for x in periodic.find(ids, doc, exponent, least)), strict=True))
        want, at = [], 0
        for d in docs:
            want += [(s + at, n, q) for s, n, q in brute_runs(d, exponent, least)]
            at += len(d)
        assert got == want


def test_digest_of_planted_and_other_runs(spark):
    texts = some_texts()
    rows = [(i, t, "en", len(t or ""), 1, "p") for i, t in enumerate(texts)]
    rows += [(i + 1000, f"w{i} " * 3 + " ".join(f"u{j % 50}" for j in range(200)), None, 0, 1, "p") for i in range(60)]
    rows += [rows[4], rows[4], (None, texts[6], None, None, 1, "p"), (None, None, None, None, 1, "p")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = [brute_digest(r[0], r[1]) for r in rows]
    assert sorted(map(tuple, periodic.digest(docs).collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[1] > 0 for w in want) > 40 and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows)
    # what the operator itself gives: runs, and texts with their repeats left out
    found = [(r[0], *x) for r in rows for x in brute_runs(WORD.findall(r[1] or ""), 4, 6)]
    assert sorted(map(tuple, periodic.runs(docs).collect()), key=repr) == sorted(found, key=repr)
    short = periodic.collapse(docs)
    assert short.columns == docs.columns

    def collapsed(text):
        w = WORD.findall(text or "")
        runs = brute_runs(w, 4, 6)
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        return " ".join(x for i, x in enumerate(w) if i not in gone) if runs else text

    assert sorted(((r.doc_id, r.text, r.n_chars, r.period) for r in short.collect()), key=repr) == sorted(((r[0], t := collapsed(r[1]), len(t or ""), "p") for r in rows), key=repr)
    for table in (periodic.digest, periodic.runs, periodic.collapse):
        assert table(docs.limit(0)).collect() == []


def test_a_long_text_of_one_period(spark):
    docs = spark.createDataFrame([(3, "tick tock " * 60_000), (4, " ".join(f"v{i}" for i in range(80_000)))], "doc_id long, text string")
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in periodic.digest(docs).collect()}
    assert got == {3: (1, 0, 120_000, 2, 60_000_000), 4: (0, None, None, None, None)}
