"""The pipeline's stages in a row against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `_gone` int, copies string"


def make():
    """Prose with copies, near copies, shared passages, junk, repeated rows and ids, null ids and null columns."""
    from test_operators import make_rows

    rng = random.Random(11)
    prose = "the of and to in is that it was for on with as be at this".split() + [f"n{i}" for i in range(200)]
    rows = [(*r[:5], 1, "c") for r in make_rows()]
    rows += [(1000 + i, " ".join(rng.choice(prose) for _ in range(rng.randrange(12, 200))), "en", rng.choice("abc"), 0, 1, None) for i in range(60)]
    rows += [(2000 + i, rows[-1 - i][1], "en", "a", 0, 1, None) for i in range(10)]
    passage = " ".join(rng.choice(prose) for _ in range(60))
    rows += [(d, f"{passage} and {i} more of the words", None, None, None, None, None) for i, d in enumerate([3000, 3001, None, None, 3002, 3002])]
    return [*rows, rows[-1], rows[70], rows[70], (None, rows[75][1], None, "a", 1, 1, None)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(make(), COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def by_row(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_stages(spark, sf_dir):
    import corpus_pipeline
    from quarrymill.llm import bpe, mixing, quality
    from test_operators import brute_classes, brute_spans

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.text for r in quality.judge(docs.select("doc_id", "text")).where("kept").collect()}
    first = stages["quality_rules"](spark, docs, sf_dir)
    rows = list(first.toLocalIterator())
    assert by_row(first) == Counter(r for r in make() if r[1] in kept) and first.columns == docs.columns

    gone = {d for d, _, c in brute_classes(rows, 5, 80, 100) if d is not None and c < d}
    best = {}
    for r in map(tuple, rows):
        if r[0] is not None and r[0] not in gone:
            best[r[0]] = min(best.get(r[0], r), r, key=lambda x: (-len(x[1]), x[1]))
    second = stages["ngram_jaccard"](spark, first, sf_dir)
    stay = Counter(best.values()) + Counter(tuple(r) for r in rows if r[0] is None)
    assert by_row(second) == stay and second.columns == docs.columns

    spans = brute_spans(list(stay.elements()), 20)
    cut = Counter()
    for r, n in stay.items():
        text = spans[r[0], r[1]][2]
        cut[(r[0], text, *r[2:4], len(text) if r[1] is not None else 0, *r[5:])] += n
    third = stages["substring_dedup"](spark, second, sf_dir)
    assert by_row(third) == cut and third.columns == docs.columns

    size = len(docs.columns)
    taken = Counter()
    for r in mixing.mix(third).collect():
        taken[tuple(r)[:size]] += r["copies_"]
    fourth = stages["source_mixing"](spark, third, sf_dir)
    assert by_row(fourth) == +taken and fourth.columns == docs.columns

    enc = bpe.encoder(bpe.default_ranks())
    out = corpus_pipeline.run(spark, sf_dir).collect()
    want = Counter()
    for r, n in taken.items():
        want[r[0], tuple(enc.encode_ordinary(r[1]))] += n
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == +want and all(r.n_tokens == len(r.ids) for r in out)


def test_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and out.columns[:2] == ["doc_id", "source"]
