"""Containment, draws by counts, strict readers, whole runs and reports."""

from __future__ import annotations

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarrymill.functions import code
from quarrymill.functions import code_columns as C
from quarrymill.functions import text as X
from quarrymill.operators import relational, stats
from quarrymill.plans import builder, corpus, runs
from quarrymill.plans import templates as T
from quarrymill.sources import readers, reports, writers
from quarrymill.streaming import predict


def test_containment_is_that_of_text(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    blank = lambda: rng.choice([" ", " ", "  ", "\n", "\t"])
    text = lambda n: "".join(word() + blank() for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "é " * 20)]
    items = [(i, t[(a := rng.randrange(len(t))) : a + rng.randrange(1, 40)]) for i, (_, t) in enumerate(docs[:60]) if t]
    items += [(200, ""), (201, None), (202, " "), (203, "\n"), (204, "a"), (205, "é é"), (206, "zz"), (207, "a b"), (208, "b c a b c a b c")]
    want = sorted((d, i) for d, t in docs for i, x in items if t and x and x in t)
    got = corpus.contains_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == want and len(want) > 100
    # whole words of the middle are what items are met by, however many items there are
    many = spark.range(20_000).selectExpr("id AS item_id", "concat('w', id, ' x', id, ' y', id) AS item")
    texts = spark.createDataFrame([(1, "so w5 x5 y55 and w77 x77 y77"), (2, "none")], "doc_id long, text string")
    found = corpus.contains_pairs(texts, many)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(1, 5), (1, 77)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert corpus.contains_pairs(texts, many.limit(0)).count() == 0


def test_texts_make_few_keys_and_all_of_a_string_that_they_hold(spark, monkeypatch):
    from quarrymill.functions import grams

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é") for _ in range(rng.randrange(0, 400))) for _ in range(40)]
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    for chunk in (grams.CHUNK, 100):
        monkeypatch.setattr(grams, "CHUNK", chunk)
        for width in grams.WIDTHS:
            found = {}
            for of, key in grams.picked(data, bounds, width):
                for i, k in zip(of.tolist(), key.tolist(), strict=True):
                    found.setdefault(i, set()).add(k)
            for i, t in enumerate(raw):
                assert (i in found) == (len(t) >= width)
                if i in found:
                    part = t[(a := rng.randrange(len(t) - width + 1)) : a + rng.randrange(width, 200)]
                    own = np.frombuffer(part, np.uint8)
                    assert {k for _, key in grams.picked(own, np.array([0, len(own)]), width) for k in key.tolist()} <= found[i]
    long = np.frombuffer(rng.randbytes(200_000), np.uint8)
    assert sum(len(key) for _, key in grams.picked(long, np.array([0, len(long)]), 64)) < 200_000 / 12
    # a text makes keys in one Python pass, and no rows of its words
    got = corpus.contains_pairs(spark.createDataFrame([(1, "a text of some length, held " * 9)], "doc_id long, text string"), spark.createDataFrame([(1, "some length, held a text")], "item_id long, item string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and got.count() == 1


def test_binomial_draws(spark):
    rows = [(n, p, i / 500 + 0.001) for n, p in ((1, 0.5), (20, 0.3), (1000, 0.01), (10**9, 0.4), (7, 0.0), (7, 1.0), (0, 0.5)) for i in range(500)]
    got = stats.binomial_draws(spark.createDataFrame(rows, "n long, p double, u double"), "k").collect()
    assert len(got) == len(rows)
    exact = {}
    for n, p in ((1, 0.5), (20, 0.3), (1000, 0.01)):
        run = 0.0
        exact[n, p] = [run := run + math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
    for r in got:
        if (r.n, r.p) in exact:
            assert r.k == next(k for k, c in enumerate(exact[r.n, r.p]) if c >= r.u - 1e-12)
        elif r.n <= 7:
            assert r.k == (r.n if r.p == 1 else 0)
    big = [r.k for r in got if r.n == 10**9]
    assert sum(big) / len(big) == pytest.approx(4e8, rel=1e-5) and max(big) - min(big) < 10 * math.sqrt(2.4e8)


def test_replicates_by_types_and_counts(spark):
    types = spark.createDataFrame([(3, 5, 0), (4, 5, 2), (3, 5, 5)], "prompts int, n int, k int")
    rows = stats.typed_replicates(types, "prompts", ["n", "k"], 400, 3).collect()
    assert len(rows) == 400 and all(r.n == 50 for r in rows)
    assert sum(r.k for r in rows) / 400 == pytest.approx(23, abs=0.8)
    # any number of types, and of units
    many = spark.range(2000).selectExpr("50 AS prompts", "7 AS n", "id % 8 AS k")
    rows = stats.typed_replicates(many.groupBy("n", "k").agg(F.sum("prompts").alias("prompts")).unionByName(many.selectExpr("n", "8 + k AS k", "0 AS prompts")), "prompts", ["n", "k"], 30, 3).collect()
    assert len(rows) == 30 and all(r.n == 700_000 for r in rows)
    rows = stats.typed_replicates(spark.range(200).selectExpr("500 AS prompts", "id AS k"), "prompts", ["k"], 10, 3).collect()
    assert all(r.k == pytest.approx(100_000 * 99.5, rel=0.01) for r in rows) and len({r.k for r in rows}) == 10
    rows = stats.typed_replicates(spark.createDataFrame([(600_000_000, 1), (400_000_000, 0)], "prompts long, k long"), "prompts", ["k"], 20, 3).collect()
    assert all(abs(r.k - 6e8) < 10 * math.sqrt(2.4e8) for r in rows) and len({r.k for r in rows}) == 20
    counts = spark.createDataFrame([("a", 40, 10, 20), ("b", 9, 0, 9)], "g string, n long, x long, y long")
    drawn = stats.counted_replicates(counts, "n", ["x", "y"], 400, 3, ("g",)).collect()
    a = [r for r in drawn if r.g == "a"]
    assert len(drawn) == 800 and all(r.x + r.y <= r.n for r in drawn) and all(r.x == 0 and r.y == 9 for r in drawn if r.g == "b")
    assert sum(r.x for r in a) / 400 == pytest.approx(10, abs=0.6) and sum(r.y for r in a) / 400 == pytest.approx(20, abs=0.7)
    var = sum((r.x - 10) ** 2 for r in a) / 400
    assert var == pytest.approx(40 * 0.25 * 0.75, rel=0.25)


# Readers ------------------------------------------------------------------------------------------------------------------


def test_strict_and_numbered_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert sorted(r.x for r in readers.strict_json_lines(spark, str(tmp_path / "a.jsonl"), "x int").collect()) == [1, 2]
    assert readers.json_lines(spark, str(tmp_path / "b.jsonl"), "x int").count() == 2
    with pytest.raises(Exception, match="blank"):
        readers.strict_json_lines(spark, str(tmp_path / "b.jsonl"), "x int").collect()
    lines = [f"line {i}" for i in range(3000)]
    (tmp_path / "long.txt").write_text("\n".join(lines))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = readers.numbered_lines(spark, str(tmp_path / "long.txt")).orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [(r.line, r.value) for r in got] == list(enumerate(lines, 1))


@pytest.fixture(scope="module")
def records(spark):
    """All tasks and labels: ten occurrences of a few families."""
    idx = [(o * 750 + f,) for o in range(10) for f in (0, 17, 733, 749)]
    return builder.finish(builder.features(builder.build_from(spark.createDataFrame(idx, "idx long")))).cache()


def test_records_of_all_tasks(records):
    rows = records.collect()
    assert {(r.task, r.is_vulnerable) for r in rows} == {("repair", True), ("detect", True), ("detect", False), ("repo_patch", True)}
    assert builder.self_check(records).count() == 0
    for r in rows:
        target = json.loads(r.target)
        assert [m.role for m in r.messages] == ["system", "user", "assistant"] and r.messages[2].content == r.target and r.vulnerable_code in r.prompt
        if r.task == "repo_patch":
            assert sorted(target) == ["finding_id", "patch", "summary"] and code.apply_patch(r.vulnerable_code, target["patch"]).text == r.fixed_code
        else:
            assert tuple(target) == tuple(builder.ANALYSIS_FIELDS) and target["fixed_code"] == r.fixed_code
        assert bool(r.vulnerable_lines) == r.is_vulnerable == bool(r.patch) and (r.vulnerable_code == r.fixed_code) != r.is_vulnerable
        assert (r.forbidden_test_text is None or r.forbidden_test_text not in r.fixed_code) and r.required_test_text in r.fixed_code
        assert code.parses(r.safe_test) and r.required_test_text in "".join(eval(x.split(" in ")[0].removeprefix("    assert ")) for x in r.safe_test.splitlines() if x.endswith(" in shown") and " not in " not in x)


def test_every_template_in_every_form_parses_and_differs():
    specs = {s[1]: s for s in builder.SPECS}
    assert {t.slug for t in T.TEMPLATES} == set(specs) and [f.shape for f in T.FORMS] == [s for _, s in builder.SHAPES]
    for t in T.TEMPLATES:
        for f in T.FORMS:
            made = []
            for imports, body in ((t.imports_before, t.before), (t.imports_after, t.after)):
                text = (f"{imports}\n\n\n" if imports else "") + f.head + "\n".join(" " * f.indent + x if x else x for x in body.split("\n")) + "\n" + f.tail
                for mark, value in {"args": ", ".join("abc"[: t.args]), "def": "f", "class": "K", "a": "a", "b": "b", "c": "c", "n": "7"}.items():
                    text = text.replace(f"@{mark}@", value)
                assert code.parses(text), (t.slug, f.shape)
                made.append(text)
            forbidden, required = specs[t.slug][3:]
            assert made[0] != made[1] and required in made[1] and (forbidden is None or (forbidden in made[0] and forbidden not in made[1]))


def test_splits_are_read_strictly(spark, records, tmp_path):
    columns = [x.split()[0] for x in readers.RECORD_DDL.split(", ") if x.split()[0] in records.columns]
    held = records.where("split = 'train'").withColumn("target", F.col("target"))
    rows = held.select(*columns)
    path = str(tmp_path / "train")
    writers.write_json(rows, path)
    assert readers.read_split(spark, path, "train").count() == rows.count()
    assert {r.task for r in readers.read_split(spark, path, "train", ("detect", "repair")).select("task").distinct().collect()} == {"detect", "repair"}
    assert readers.patch_split(spark, path, "train", 3).count() == 3
    with pytest.raises(ValueError, match="split"):
        readers.read_split(spark, path, "val")
    lines = [r.value for r in spark.read.text(path).collect()]
    broken = {"json": "{", "license": lines[2].replace('"source_license":"Apache-2.0"', '"source_license":"MIT"'), "language": lines[2].replace('"language":"python"', '"language":"perl"')}
    for rule, line in broken.items():
        (tmp_path / f"{rule}.jsonl").write_text("\n".join([*lines[:2], line, *lines[3:5]]) + "\n")
        with pytest.raises(ValueError, match=f":3: {rule}"):
            readers.read_split(spark, str(tmp_path / f"{rule}.jsonl"), "train")
    (tmp_path / "none.jsonl").write_text("")
    with pytest.raises(ValueError, match="no records"):
        readers.read_split(spark, str(tmp_path / "none.jsonl"), "train")


# Digests, places ----------------------------------------------------------------------------------------------------------


def test_tree_digests_and_canonical_json(spark):
    files = [("t", "b.json", '{"b": 1.50, "a": [true, null, {"d": 1, "c": "é"}]}'), ("t", "a.json", "[ 1, 2 ]"), ("u", "x.json", '"s"')]
    frame = spark.createDataFrame(files, "tree string, path string, content string")
    raw = {r.tree: r.tree_sha256 for r in C.tree_digest_raw(frame, "tree").collect()}
    shaped = {r.tree: r.tree_sha256 for r in C.tree_digest_json(frame, "tree").collect()}
    for tree in "tu":
        mine = sorted((p, c) for t, p, c in files if t == tree)
        assert raw[tree] == hashlib.sha256(b"".join(p.encode() + b"\0" + c.encode() for p, c in mine)).hexdigest()
        canonical = "".join(p + json.dumps(json.loads(c), sort_keys=True, separators=(",", ":")) for p, c in mine)
        assert shaped[tree] == hashlib.sha256(canonical.encode()).hexdigest()
    assert code.canonical_json("{") is None and code.canonical_json(None) is None
    assert len(spark.range(1).select(X.utc_now()).first()[0]) == len("2020-01-01T00:00:00+00:00")


def test_shards_and_inventories(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    parts = [relational.shard(rows, "k", 3, i).count() for i in range(3)]
    assert parts == [4, 3, 3]
    with pytest.raises(ValueError, match="shard"):
        relational.shard(rows, "k", 3, 3)
    files = spark.createDataFrame([("a", "x.py", "1\n2\n"), ("a", "y.txt", "1\n2"), ("a", "z.py", ""), ("b", "x.py", None)], "c string, path string, content string")
    assert sorted(tuple(r) for r in relational.inventory(files, ["c"]).collect()) == [("a", 3, 2, 4), ("b", 1, 1, 0)]
    with pytest.raises(ValueError, match="none of"):
        relational.first_allowed(spark.createDataFrame([("m", False)], "model_id string, train_allowed boolean"), ["m"])


# Runs ---------------------------------------------------------------------------------------------------------------------


def test_evaluation_goes_on_where_it_ended(spark, records, tmp_path):
    detect = records.where("task = 'detect'")
    log = str(tmp_path / "log")
    rows, first = runs.evaluate(detect.where("idx % 2 = 0"), predict.KeepPredictor(), log, {"model": "keep"})
    assert rows.count() == detect.where("idx % 2 = 0").count()
    rows, report = runs.evaluate(detect, predict.KeepPredictor(), log, {"model": "keep"})
    got, want = rows.collect(), detect.orderBy("idx").collect()
    assert [r.id for r in got] == [r.id for r in want] and spark.read.parquet(log).count() == len(want)
    one = report.first()
    clean = sum(not r.is_vulnerable for r in want)
    assert (one.tn, one.fn, one.tp, one.fp) == (clean, len(want) - clean, 0, 0) and one.negative_preserved_rate == 1
    assert one.classification_correct_ci95[0] <= clean / len(want) <= one.classification_correct_ci95[1] and one.p95_latency >= 0
    with pytest.raises(ValueError, match="settings"):
        runs.evaluate(detect, predict.KeepPredictor(), log, {"model": "other"})
    again, _ = runs.evaluate(detect.limit(4), predict.KeepPredictor(), log, {"model": "other"}, force=True)
    assert again.count() == 4 and spark.read.parquet(log).count() == 4


def test_suites_from_cases_to_report(spark, records):
    cases = runs.build_cases(spark)
    made = runs.build_suite(cases, records).first()
    assert (made.records, made.pairs, made.vulnerable, made.clean) == (24, 12, 12, 12) and made.suite_sha256 == runs.manifest(cases.repartition(5)).first().suite_sha256
    leak = cases.limit(1).select(F.lit("f").alias("family"), F.element_at("files", F.col("target_file")).alias("vulnerable_code"), F.lit("x").alias("fixed_code"))
    with pytest.raises(ValueError, match="training"):
        runs.build_suite(cases, leak)
    with pytest.raises(ValueError, match="rule"):
        runs.build_suite(cases.withColumn("source_license", F.lit("none")), records)
    found = runs.run_suite(cases).collect()
    assert len(found) == 24 and all(r.expected_finding_detected == r.is_vulnerable for r in found)


def test_reports(spark):
    facts = spark.createDataFrame([("m|x", 3, 0.5, None, 0.25, 0.1, -0.2, 0.04)], "tag string, cases int, base_rate double, other_rate double, effect double, lower_95 double, upper_95 double, p double")
    text = reports.render(reports.COMPARISON, facts).first().markdown
    assert text.startswith("# Paired comparison m|x\n\n- Paired cases: 3\n- Base repair rate: 0.5000\n- Other repair rate: n/a\n- Effect: +0.2500\n") and text.endswith("interval holds zero.\n")
    files = spark.createDataFrame([("a.py", "eval('1')"), ("b.py", "x = 1")], "path string, content string")
    attempts = spark.createDataFrame([("AST-0001", 1, True, False, "first"), ("AST-0001", 2, False, True, "ok | fine")], "finding_id string, n int, invalid_json boolean, accepted boolean, reason string")
    head, found, tries = runs.agent_rows(files, attempts)
    text = reports.render(reports.AGENT, head.withColumn("target", F.lit("repo")), found, tries).first().markdown
    assert "- Findings: 1\n- Accepted patches: 1\n" in text and "| AST-0001 | dynamic-execution | HIGH | a.py | 1 |" in text and "| AST-0001 | true | true | ok \\| fine |" in text
    assert "No findings." in reports.render(reports.AGENT, head.withColumn("target", F.lit("r")), found.limit(0), tries).first().markdown


def test_repeated_rows_of_a_stored_run_are_those_stored(spark, tmp_path):
    from quarrymill.plans import flows

    # 1763 = 41 x 43 and 3182 = 2 x 37 x 43 stand twice: marked as preserved, and no longer as accepted, in both rows
    spark.createDataFrame([(1763, 0, 0), (3182, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(2002 * 43 * 37, 0, 0)], "doc_id long, quality int, toxic int").write.mode("append").parquet(f"{tmp_path}/labels.parquet")  # repaired, invalid, never accepted
    got = {r.rule: r.n for r in flows.suite_validation(spark, str(tmp_path)).collect()}
    assert got == {"unknown": 0, "missing": 0, "repeated": 3, "repair": 1, "preserved": 2, "invalid": 0, "lines": 0}


def test_whole_records_are_neither_written_nor_shuffled_to_be_told_apart(spark, monkeypatch):
    written, drawn = [], []
    keep = builder.materialize
    monkeypatch.setattr(builder, "materialize", lambda df, name="cut": (written.append(df.columns), keep(df, name))[1])
    # at first a family's records have one draw, so that some repeat a pair and are made again
    own = stats.hash_draw
    monkeypatch.setattr(builder, "hash_draw", lambda seed, family, n, attempt: (drawn.append(1), F.when(attempt == 0, own(seed, family)).otherwise(own(seed, family, n, attempt)))[1])
    idx = [(i + 750 * k,) for i in range(0, 60, 7) for k in range(4)]
    made = builder.build_from(spark.createDataFrame([*idx, idx[3]], "idx long"))
    assert {c for columns in written for c in columns} <= {"idx", "attempt", "pair_sha256", "_first"}
    exchanges = [x for x in made._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    assert exchanges and all("hashpartitioning(idx" in x for x in exchanges)
    got = made.collect()
    assert sorted(r.idx for r in got) == sorted(i for (i,) in idx) and len({r.pair_sha256 for r in got}) == len(got)
    assert {r.attempt for r in got} == {0, 1} and all(r.attempt == 0 for r in got if r.idx < 60)
