"""Operators outside the llm subpackage: published figures, small fixtures, and properties."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F
from quarrymill.functions import code
from quarrymill.functions import code_columns as C
from quarrymill.functions import text as X
from quarrymill.operators import metrics, relational, stats
from quarrymill.plans import builder, scoring, suites
from quarrymill.sources import readers, writers
from quarrymill.streaming import predict, resume

# Figures ----------------------------------------------------------------------------------------------------------------------


def test_confusion_figures(spark):
    rows = spark.createDataFrame([(1, 2103, 800, 0, 297), (2, 154, 0, 800, 2246), (3, 0, 0, 0, 0)], "k int, tp long, tn long, fp long, fn long")
    got = {r.k: r for r in metrics.confusion_rates(rows).collect()}
    assert got[1].accuracy == pytest.approx(0.9071875) and got[1].f1 == pytest.approx(0.9340439706862091)
    assert got[1].mcc == pytest.approx(0.7993844486912917) and got[1].balanced_accuracy == pytest.approx(0.938125)
    assert got[2].f1 == pytest.approx(0.09183064997018485) and got[2].mcc == pytest.approx(-0.8858701360659164)
    assert got[3].mcc == 0 and got[3].precision == 0


def test_invalid_answers_are_wrong_in_both_classes(spark):
    rows = spark.createDataFrame([(True, None), (False, None), (True, True)], "a boolean, p boolean")
    assert tuple(rows.agg(*metrics.confusion_counts(F.col("a"), F.col("p"))).first()) == (1, 0, 1, 1)


def test_trees_are_hashed_as_their_rows_pass():
    """A tree of 400 MB in batches of a piece each: memory stays at a few pieces."""
    import hashlib
    import tracemalloc

    import pyarrow as pa
    from quarrymill.functions import code_columns

    piece = bytes(range(256)) * 256
    batch = lambda tree: pa.RecordBatch.from_pydict({"tree": [tree] * 4, "piece": pa.array([piece] * 4, pa.binary())})
    tracemalloc.start()
    got = [tuple(r.values()) for b in code_columns._digest_in_order("tree")(batch(i // 1600) for i in range(1601)) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = hashlib.sha256()
    for _ in range(6400):
        whole.update(piece)
    assert got == [(0, whole.hexdigest()), (1, hashlib.sha256(piece * 4).hexdigest())] and peak < 64 << 20


def test_tree_digests_in_pieces(spark):
    import hashlib

    from quarrymill.functions import code_columns

    files = [(1, "b", b"x" * 1000), (1, "a", b""), (1, "c", None), (None, "z", "é".encode()), (2, "only", bytes(range(256)))]
    frame = spark.createDataFrame(files, "tree int, path string, content binary").repartition(3)
    want = {}
    for tree, path, content in sorted(files, key=lambda x: (str(x[0]), x[1])):
        want.setdefault(tree, hashlib.sha256()).update(path.encode() + b"\0" + (content or b""))
    for size in (7, 1000, 1 << 16):
        assert {r.tree: r.tree_sha256 for r in code_columns.tree_digest_raw(frame, "tree", size).collect()} == {k: v.hexdigest() for k, v in want.items()}


def test_patches_of_texts_without_a_last_line_end():
    from quarrymill.functions import code

    for before, after in (("a\nb", "a\nc"), ("a\nb\n", "a\nb"), ("a\nb", "a\nb\n"), ("a", ""), ("", "a"), ("x\ny\nz", "y\nz")):
        got = code.apply_patch(before, code.make_patch(before, after))
        assert got.ok and got.text == after, (before, after, code.make_patch(before, after))


def test_paired_test_figures(spark):
    rows = spark.createDataFrame([(21, 2770), (0, 0), (3, 5), (700, 700)], "l long, r long")
    got = {(r.l, r.r): r.log10_p for r in stats.mcnemar_log10(rows, "l", "r").collect()}
    assert got[21, 2770] == pytest.approx(-787.2505300492555, abs=1e-9) and got[0, 0] == 0
    assert 10 ** got[3, 5] == pytest.approx(2 * sum(math.comb(8, i) for i in range(4)) / 2**8)
    assert 10 ** got[700, 700] > 1  # not capped
    exact = lambda a, b: (math.log(sum(math.comb(a + b, i) for i in range(min(a, b) + 1))) - (a + b - 1) * math.log(2)) / math.log(10)
    cases = [(a, b) for a in (0, 1, 2, 7, 19, 20, 21, 60, 333) for b in (1, 3, 20, 25, 400)]
    found = stats.mcnemar_log10(spark.createDataFrame(cases, "l long, r long"), "l", "r").collect()
    assert all(r.log10_p == pytest.approx(exact(r.l, r.r), abs=1e-9, rel=1e-12) for r in found)
    large = stats.mcnemar_log10(spark.createDataFrame([(500_000_000, 500_000_000), (499_950_000, 500_050_000), (10**9, 0), (10**8, 9 * 10**8)], "l long, r long"), "l", "r")
    p = [r.log10_p for r in large.collect()]
    assert p[0] == pytest.approx(math.log10(1 + math.sqrt(2 / (math.pi * 1e9))), abs=1e-9)
    assert p[1] == pytest.approx(math.log10(math.erfc((100_000 - 1) / math.sqrt(2e9))), abs=1e-6)  # the normal tail, with its continuity
    assert p[2] == pytest.approx(-(10**9 - 1) * math.log10(2), rel=1e-12) and -2e8 < p[3] < -1e8
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Generate", "Join", "Exchange"))
    assert spark.createDataFrame([(got[700, 700],)], "p double").select(stats.mcnemar_p(F.col("p"))).first()[0] == 1


def test_interval_and_sampling_figures(spark):
    rows = spark.createDataFrame([(12, 12), (0, 12), (0, 0)], "k long, n long")
    got = [tuple(r) for r in rows.select(*stats.wilson(F.col("k"), F.col("n"))).collect()]
    assert got[0] == pytest.approx((0.7575059933447592, 1.0)) and got[1] == pytest.approx((0.0, 0.24249400665524085), abs=1e-12) and got[2] == (0, 0)
    k = spark.createDataFrame([(10, 3)], "n long, c long")
    assert k.select(stats.pass_at_k(F.col("n"), F.col("c"), 1)).first()[0] == pytest.approx(0.3)
    assert k.select(stats.pass_at_k(F.col("n"), F.lit(8), 5)).first()[0] == pytest.approx(1.0)
    with pytest.raises(Exception, match="fewer samples"):
        k.select(stats.pass_at_k(F.lit(2), F.lit(1), 3)).first()
    assert spark.range(1).select(stats.f_beta(F.lit(1.0), F.lit(0.5), 2.0)).first()[0] == pytest.approx(5 / 9)


def test_quantiles_and_medians_differ(spark):
    rows = spark.createDataFrame([(float(x),) for x in (1, 2, 10, 11)], "x double")
    got = rows.agg(stats.quantile_linear(F.col("x"), 0.95), stats.quantile_floor_last(F.col("x"), 0.95), stats.quantile_floor_count(F.col("x"), 0.95), stats.upper_median("x"), F.median("x")).first()
    assert tuple(got) == pytest.approx((10.85, 10, 11, 10, 6))
    assert rows.where("x < 0").agg(stats.upper_median("x")).first()[0] is None


def test_holm_runs_up(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "t string, p double").withColumn("g", F.lit(1))
    got = {r.t: r.p_holm for r in stats.holm(rows, "p", ["g"], ["t"]).collect()}
    assert got == pytest.approx({"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.5})


def test_replicates_draw_every_unit_alike(spark):
    units = spark.createDataFrame([(i, i) for i in range(10)], "k int, v int")
    drawn = stats.replicates(units.withColumn("n", F.lit(1)), ["k"], ["v", "n"], 300, 1)
    rows = drawn.collect()
    assert len(rows) == 300 and all(r.n == 10 for r in rows)
    assert sum(r.v for r in rows) / 300 == pytest.approx(45, abs=2)
    assert sorted(map(str, stats.replicates(units.repartition(3).withColumn("n", F.lit(1)), ["k"], ["v", "n"], 300, 1).collect())) == sorted(map(str, rows))


# Code -------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("source", "checks"),
    [
        ("import subprocess as s\ns.run('x', shell=True)", ["subprocess-shell-true"]),
        ("from subprocess import run as r\nr('x', shell=True)\nr('x', shell=False)", ["subprocess-shell-true"]),
        ("import os as o\no.system('x')\nfrom os import system as z\nz('y')\nfrom os import path\npath('z')", ["os-system", "os-system"]),
        ("eval('1')\nbuiltins.exec('1')\nx.eval('1')", ["dynamic-execution", "dynamic-execution"]),
        ("import yaml\nyaml.load(a)\nyaml.load(a, Loader=yaml.SafeLoader)\nyaml.load(a, Loader=SafeLoader)", ["unsafe-yaml-load"]),
        ("import cPickle\ncPickle.loads(a)\nfrom pickle import load\nload(a)", ["unsafe-pickle-load", "unsafe-pickle-load"]),
        ("x = input()\nc.execute(f'select {x}')\nc.execute('select 1')\nq = 'delete %s' % x\nc.executemany(q)", ["sql-string-format", "sql-string-format"]),
        ("c.execute(f'select {x}')\nx = input()", []),
        ("p = request.args['p']\nopen(p)\np.open()\nopen('a')", ["path-traversal-open", "path-traversal-open"]),
        ("a, b = sys.argv\nopen(b)", ["path-traversal-open"]),
        ("password = 'longenough1'\nAPI_KEY: str = 'longenough1'\nd['db_secret'] = 'longenough1'\ntoken = 'longenough1'\npwd = 'changeme'\npwd = 'short'", ["hardcoded-secret"] * 3),
        ("def broken(", None),
    ],
)
def test_findings(source, checks):
    got = code.findings(source)
    assert (got if got is None else [f["check"] for f in got]) == checks


def test_forms_ignore_what_they_should():
    a, b = "def f(x):\n    # note\n    return x + 1\n", "def g(yy):\n\n        return yy + 22\n"
    assert code.token_form(a) != code.token_form(b) and code.structure_form(a) == code.structure_form(b)
    assert code.token_form("x=1 # a\n") == code.token_form("x = 1\n")
    assert code.structure_form("async def f(): pass") != code.structure_form("async def g(): pass")
    assert code.structure_form("a.b") != code.structure_form("a.c") and code.structure_form("f(a=1)") != code.structure_form("f(b=1)")
    assert code.structure_form("x = True") != code.structure_form("x = 1")
    assert code.token_form("'''") is None and code.structure_form("def (") is None and not code.parses("a b")


def test_patches():
    before, after = "a\nb\nc\nd\ne\nf\ng\nh\n", "a\nB\nc\nd\ne\nf\ng\nnew\nh\n"
    patch = code.make_patch(before, after)
    assert code.apply_patch(before, patch).text == after
    assert code.edited_lines(before, after) == [2, 8] and code.changed_lines(before, after) == 2
    assert code.edited_lines("a\n", "a\nb\n") == [1] and code.edited_lines("", "b\n") == []
    broken = {"headers": "x", "hunk": "--- a/f\n+++ b/f\n x\n", "context": patch.replace(" a\n", " z\n"), "removal": patch.replace("-b\n", "-z\n"), "line": patch + "?\n"}
    for why, text in broken.items():
        assert code.apply_patch(before, text).error == why
    head, hunks = patch.split("\n", 2)[:2], patch.split("\n", 2)[2]
    assert code.apply_patch(before, "\n".join([*head, hunks + hunks])).error in ("overlap", "context")


def test_answers_to_code():
    assert code.extract_code("```python\nx = 1\n```").text == "x = 1"
    assert code.extract_code(json.dumps({"code": "y = 2", "output": "z"})).text == "y = 2"
    assert code.extract_code("python code: x = 1").text == "x = 1"
    assert code.extract_code("return 1", "def f():\n").text == "return 1"  # together they do not parse
    assert code.extract_code("y = x", "x = 1\n").text == "x = 1\ny = x"
    assert code.extract_code("x +").ok is False


def test_scan_numbers_findings_in_order(spark):
    files = spark.createDataFrame([("b.py", "eval('1')\nexec('1')"), ("a.py", "eval('1')"), ("bad.py", "def ("), ("none.py", None)], "path string, content string")
    found, errors = C.scan(files.repartition(3))
    assert [(r.id, r.file, r.line) for r in found.orderBy("id").collect()] == [("AST-0001", "a.py", 1), ("AST-0002", "b.py", 1), ("AST-0003", "b.py", 2)]
    assert sorted((r.file, r.error) for r in errors.collect()) == [("bad.py", "syntax error"), ("none.py", "not decodable")]


# Text -------------------------------------------------------------------------------------------------------------------------


def test_text_functions(spark):
    one = spark.createDataFrame([(1,)], "x int")
    value = lambda c: one.select(c).first()[0]
    L = F.lit
    assert value(X.tag_slug(L("--A b/C.d--"))) == "a-b-c.d" and value(X.safe_name(L("-.A b."))) == "a-b"
    assert value(X.cwe_from_id(L("author_CWE89_x.py"))) == "CWE-089" and value(X.cwe_from_id(L("none"))) is None
    assert value(X.cwe_normalised(L("cwe_0079"))) == "CWE-79" and value(X.file_of_id(L("a_b_c_d.py"))) == "c_d.py"
    assert value(X.uri_path(L("./../a%20b+c\\d"))) == "a b+c/d" and value(X.without_space(L("a  b\n"))) == "ab"
    assert value(X.markdown_cell(L("a|b\nc"))) == "a\\|b c" and value(X.markdown_cell(L(None).cast("string"))) == ""
    assert value(X.tag_cwes(F.array(L("external/cwe/cwe-79"), L("CWE/022"), L("x")))) == ["CWE-022", "CWE-079"]
    assert value(X.line_f1(F.array(L(1), L(2)), F.array(L(2), L(2)))) == pytest.approx(2 / 3)
    assert value(X.line_f1(F.array().cast("array<int>"), F.array().cast("array<int>"))) == 1 and value(X.line_f1(F.array(L(1)), L(None).cast("array<int>"))) == 0
    patch = "--- a/app.py\n+++ b/app.py\t2020\n@@ -1 +1 @@\n-x\n+eval(1)\n"
    why = lambda p, path="app.py", exists=True: value(X.preflight(L(p), L(path), L(exists), code.BANNED_ADDITIONS))
    assert why(patch) == "adds a banned pattern" and why(patch.replace("eval(1)", "y")) is None
    assert why(patch, "b.py") == "must change the finding's file and no other" and why(patch.replace("app.py", "../a.py"), "../a.py") == "path is unsafe or not a Python file"
    assert why("--- a/app.py\n+++ b/app.py\n") == "no change" and why(patch, exists=False) == "no such file"
    assert value(relational.context_lines(L("a\nb\nc\nd"), L(4), 1)) == "    3: c\n    4: d"


def test_strict_json(spark):
    texts = ['{"a": true, "n": [1]}', '{"a": "true", "n": [1]}', '{"a": true, "n": [true]}', '{"a": true}', '{"a": true, "n": [], "z": 1}', "[1]", "x", '{"a": true, "n": []}', None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select(X.has_schema(F.col("t"), {"a": "BOOLEAN", "n": "ARRAY<BIGINT>"}).alias("ok"), X.strict_object(F.col("t")).alias("object")).collect()
    assert [r.ok for r in got] == [True, False, False, False, False, False, False, True, False]
    assert [r.object for r in got] == [True, True, True, True, True, False, False, True, False]


# Relations ----------------------------------------------------------------------------------------------------------------------


def test_suffix_match_takes_the_first_path(spark):
    paths = spark.createDataFrame([("b/c.py", 1), ("c.py", 0), ("x.py", 2)], "path string, ord int")
    found = spark.createDataFrame([("/r/b/c.py",), ("c.py",), ("ac.py",), ("/x.py",), ("",)], "uri string")
    assert {r.uri: r.path for r in relational.suffix_match(found, "uri", paths, "path", "ord").collect()} == {"/r/b/c.py": "c.py", "c.py": "c.py", "ac.py": None, "/x.py": "x.py", "": None}


def test_overlaps_duplicates_and_completeness(spark):
    rows = spark.createDataFrame([("train", "a"), ("test", "a"), ("val", "b"), ("train", "a"), ("test", "b"), ("val", None), ("train", None)], "s string, v string")
    got = {(r.left_group, r.right_group): r.shared for r in relational.group_overlaps(rows, "s", "v", ["train", "val", "test"]).collect()}
    assert got == {("train", "val"): 0, ("train", "test"): 1, ("val", "test"): 1}
    a, b = (spark.createDataFrame([(x,) for x in xs], "id int") for xs in ((1, 2, 3), (2, 3, 4, 4)))
    assert {tuple(r) for r in relational.missing_and_extra(a, b, ["id"]).collect()} == {(1, "missing"), (4, "extra")}
    with pytest.raises(ValueError, match="repeated"):
        relational.require_none(relational.duplicates(b, ["id"]), "repeated")
    first = relational.keep_first(spark.createDataFrame([(1, "x", 3), (1, "y", 1), (2, "z", 9)], "k int, v string, o int"), ["k"], ["o"])
    assert {tuple(r) for r in first.collect()} == {(1, "y", 1), (2, "z", 9)}


def test_round_robin_takes_strata_in_turn(spark):
    rows = spark.createDataFrame([(i, "a" if i < 20 else "b" if i < 23 else "c") for i in range(24)], "id int, s string")
    got = relational.stratified_round_robin(rows, ["s"], F.col("id"), 9, 1).collect()
    assert [r.s for r in got] == ["a", "b", "c", "a", "b", "a", "b", "a", "a"]
    assert relational.stratified_round_robin(rows, ["s"], F.col("id"), 0, 1).count() == 24


# Corpus, scores, suites -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    return builder.finish(builder.features(builder.build(spark, 760, 7))).cache()


def test_corpus_is_sound_and_apart(spark, corpus):
    assert corpus.count() == 760 and corpus.select("id").distinct().count() == 760
    assert builder.self_check(corpus).count() == 0
    gate = builder.gate(corpus).first()
    assert gate.passed and corpus.select("family").distinct().count() == 750
    again = builder.build(spark, 760, 7)
    assert again.select("id").exceptAll(corpus.select("id")).count() == 0
    assert {r.task for r in corpus.select("task").distinct().collect()} == {"repair"}
    with pytest.raises(ValueError, match="families"):
        builder.build(spark, 10)
    assert builder.statistics(corpus).where("split IS NOT NULL AND cwe IS NULL AND task IS NULL").agg(F.sum("n")).first()[0] == 760


def test_oracle_answers_score_one(spark, corpus):
    refs = corpus.limit(60).cache()

    def answer(code):
        return F.to_json(F.struct("is_vulnerable", "cwe", F.lit("t").alias("vuln_type"), "vulnerable_lines", F.lit("e").alias("explanation"), code.alias("fixed_code"), F.lit("s").alias("patch_summary"), "safe_test"))

    said = refs.select("id", F.lit(False).alias("invalid_json"), answer(F.col("fixed_code")).alias("output"))
    scored = scoring.score_analysis(said, refs, builder.specs(spark)).cache()
    total = scoring.aggregate_analysis(scored).first()
    for c in ("json_valid", "schema_valid", "classification_correct", "cwe_correct", "fixed_code_parseable", "safe_test_parseable", "fixed_normalized_exact", "fixed_structural_exact", "security_control_pass", "no_dangerous_regression"):
        assert total[f"{c}_rate"] == 1.0, c
    assert total.rows == 60 and total.accuracy == 1.0 and total.line_f1_mean == 1.0 and total.overpatch_rate == 0
    unsafe = F.when(F.col("id") == refs.first().id, F.lit("[]")).otherwise(answer(F.concat(F.lit("import os\nos.system(1)\n"), "fixed_code")))
    worse = refs.select("id", F.lit(False).alias("invalid_json"), unsafe.alias("output"))
    low = scoring.aggregate_analysis(scoring.score_analysis(worse, refs, builder.specs(spark))).first()
    assert low.schema_valid_rate == pytest.approx(59 / 60) and low.no_dangerous_regression_rate == 0 and low.fn == 1
    paired = scoring.paired_compare(scoring.score_analysis(worse, refs, builder.specs(spark)), scored, refs, "no_dangerous_regression", F.col("is_vulnerable"), 50).first()
    assert paired.effect == 1.0 and paired.base_only == 0 and paired.final_only == 60 and paired.lower_95 == 1.0
    with pytest.raises(ValueError, match="differ"):
        scoring.paired_compare(scored.limit(3), scored, refs, "cwe_correct", F.lit(True), 5)


def test_patch_answers(spark, corpus):
    refs = corpus.limit(4).withColumn("finding_id", F.lit("F1"))
    r = F.row_number().over(__import__("pyspark").sql.Window.orderBy("id"))
    patch = F.when(r == 2, F.replace("patch", F.lit("a/app.py"), F.lit("a/b.py"))).when(r == 3, F.regexp_replace("patch", "\n-", "\n-nope ")).otherwise(F.col("patch"))
    said = refs.select("id", F.lit(False).alias("invalid_json"), F.to_json(F.struct("finding_id", F.when(r == 4, " ").otherwise("s").alias("summary"), patch.alias("patch"))).alias("output"))
    got = [x.scores for x in scoring.score_patch(said, refs, builder.specs(spark)).orderBy("id").collect()]
    assert all(v for k, v in got[0].asDict().items()), got[0]
    assert not got[1].relevant_file_only and not got[1].patch_applies and not got[1].no_dangerous_regression
    assert got[2].relevant_file_only and not got[2].patch_applies
    assert got[3].patched_code_exact and not got[3].summary_nonempty


def test_suite_summary_and_comparison(spark):
    ddl = "id string, is_vulnerable boolean, expected_finding_detected boolean, initial_finding_count int, invalid_json boolean, patch_accepted boolean, repair_success boolean, clean_preserved boolean, unrelated_file_rewrites array<string>, bandit_delta int, patch_changed_lines long, runtime_seconds double, peak_gpu_memory_bytes long"
    rows = [("a", True, True, 1, False, True, True, False, [], None, 1, 1.0, None), ("b", True, False, 0, True, False, False, False, ["x"], 2, 2, 1.0, 5), ("c", True, True, 1, False, True, True, False, [], 0, 3, 1.0, 7), ("d", True, True, 1, False, True, False, False, [], 0, 4, 1.0, None), ("e", False, False, 1, False, False, False, True, [], 0, None, 1.0, None)]
    runs = spark.createDataFrame(rows, ddl)
    got = suites.summarize(runs).first()
    assert (got.tp, got.fn, got.fp, got.tn, got.unrelated_rewrites, got.regressions, got.median_changed_lines, got.peak_memory_bytes) == (3, 1, 1, 0, 1, 1, 3, 7)
    assert got.repair_rate == 0.5 and got.detection_precision == 0.75 and got.preservation_rate == 1.0
    other = runs.withColumn("repair_success", F.lit(True))
    cmp = suites.compare_suites(runs, other, 40).first()
    assert (cmp.cases, cmp.base_only, cmp.other_only, cmp.effect) == (4, 0, 2, 0.5) and cmp.p == pytest.approx(0.5)
    with pytest.raises(ValueError, match="different"):
        suites.compare_suites(runs, other.where("id <> 'a'"))
    state = spark.createDataFrame([(True, True, True, False, True, ["f"], "f", True, 1), (False, None, None, False, True, [], "f", True, 0), (False, False, None, False, True, [], "f", True, 0)], "is_vulnerable boolean, initial_match boolean, accepted boolean, final_match boolean, tests_passed boolean, changed_paths array<string>, target_file string, protected_unchanged boolean, finding_count int")
    assert [(r.repair_success, r.clean_preserved) for r in suites.outcomes(state).collect()] == [(True, False), (False, False), (False, True)]


def test_samples(spark):
    ddl = "id string, sample_index int, status string, error string, compilable boolean, test_correctness string, test_vulnerability string, functional_pass boolean, security_test_pass boolean, secure_functional_pass boolean"
    rows = [("p", i, "complete", None, True, "ok", "failure" if i < 2 else "ok", i < 3, True, i == 0) for i in range(5)]
    rows += [("q", i, "failed", "docker build exited 1", True, None, None, None, None, None) for i in range(5)]
    rows += [("r", i, "failed", "A test result CSV was not produced.", i > 0, None, None, None, None, None) for i in range(5)]
    frame = spark.createDataFrame(rows, ddl)
    prompts = spark.createDataFrame([("p",), ("q",), ("r",)], "id string")
    suites.check_samples(frame, prompts, 5)
    with pytest.raises(ValueError, match="missing or unknown"):
        suites.check_samples(frame.where("sample_index < 4"), prompts, 5)
    norm = suites.normalise_status(frame, ["q"])
    assert {(r.id, r.status) for r in norm.select("id", "status").distinct().collect()} == {("p", "complete"), ("q", "upstream_fixture_missing"), ("r", "complete")}
    got = suites.sample_metrics(norm).first()
    assert got.scored == 10 and got.functional_pass == 3 and got.functional_pass_bounds == pytest.approx([3 / 15, 8 / 15])
    assert got.pass_at_1 == pytest.approx(0.3) and got.pass_at_1_bounds == pytest.approx([0.2, 0.2 + 1 / 3]) and got.vulnerable_at_5 == 0.5
    ci = suites.prompt_bootstrap(norm, "functional_pass", 60).first()
    assert ci.lower_95 == 0 and ci.upper_95 == pytest.approx(0.6)


def test_static_findings(spark, tmp_path):
    doc = {"runs": [{"tool": {"driver": {"rules": [{"id": "r1", "properties": {"tags": ["external/cwe/cwe-89"]}}]}, "extensions": [{"rules": [{"id": "r2", "properties": {"tags": []}}]}]},
           "results": [{"ruleId": "r1", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "./p000/s00%5Fcode.py"}}}]}, {"ruleId": "r2", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "/w/p000/s00_code.py"}}}]}, {"ruleId": "r9", "locations": []}]}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sarif").write_text(json.dumps(doc))
    found = readers.sarif(spark, str(tmp_path / "in"))
    prompts = spark.createDataFrame([("x", "CWE-089", 0, [("t", "code", True, 0), ("t", "more", False, 1)])], "id string, cwe string, prompt_index int, output array<struct<text:string,cleared_code:string,compilable:boolean,sample_index:int>>")
    files, source_map = writers.sample_files(prompts)
    assert {tuple(r) for r in files.collect()} == {("p000/s00_code.py", "code"), ("p000/s01_code.py", "more")}
    out, unmatched = suites.static_rollup(source_map.withColumn("ord", F.col("sample_index")), found)
    rows = {r.path: (r.findings, r.direct_findings, r.indirect_findings, r.finding_free, r.rules) for r in out.collect()}
    assert rows == {"p000/s00_code.py": (2, 1, 1, False, ["r1", "r2"]), "p000/s01_code.py": (0, 0, 0, True, [])} and unmatched.count() == 1


def test_exports_and_audits(spark):
    scanned = spark.createDataFrame([("os-system", "HIGH", "./a.py", 3, "m1"), ("unknown", "LOW", "a.py", 1, "m")], "check string, severity string, file string, line int, message string")
    other = spark.createDataFrame([("a.py", 3, "CWE-078", "B1", "m2", "LOW"), ("b.py", 1, None, "B2", "m", "LOW")], "path string, line int, cwe string, rule string, message string, severity string")
    got = suites.export_findings(scanned, other).collect()
    assert [(r.check_id, r.path, r.start.line, r.cwe, r.extra.message) for r in got] == [("B1", "a.py", 3, "CWE-78", "m2")]
    truth = spark.createDataFrame([("r1", True), ("r1", False), ("r2", True), ("r2", True), ("r2", False)], "repo string, is_vulnerable boolean")
    total = suites.strict_totals(truth, spark.createDataFrame([("r1", 1, 0, 0, 1)], "repo string, tp int, fp int, fn int, tn int")).first()
    assert (total.tp, total.fp, total.fn, total.tn) == (1, 0, 2, 2) and total.recall == pytest.approx(1 / 3) and total.f2_score == 38.5
    ddl = "model_id string, card_license string, license_name string, license_link string, tags array<string>, gated string, metadata_error string, card_text string"
    models = [("a", "apache-2.0", None, None, [], "false", None, ""), ("b", None, None, None, ["license:apache-2.0"], None, None, ""), ("c", "other", None, None, [], None, None, ""), ("d", "mit", None, None, [], None, None, ""), ("e", None, None, None, [], "auto", None, ""), ("f", None, None, None, None, None, "http_404", None), ("g", "apache-2.0", None, None, [], None, None, "Research use only")]
    audit = suites.classify_models(spark.createDataFrame(models, ddl), ["a", "g"])
    assert {r.model_id: r.status for r in audit.collect()} == {"a": "train_allowed", "b": "baseline_only", "c": "baseline_only", "d": "unknown", "e": "skipped", "f": "skipped", "g": "baseline_only"}
    suites.require_allowed(audit, ["a"])
    with pytest.raises(ValueError, match="not allowed"):
        suites.require_allowed(audit, ["a", "b"])
    train = spark.createDataFrame([("f1", "x = 1"), ("f2", "y = 2")], "family string, code string")
    cases = spark.createDataFrame([("c1", "f1", "q"), ("c2", "f9", "x=1"), ("c3", "f8", "z")], "id string, family string, code string")
    assert {tuple(r) for r in suites.contamination(cases, train).collect()} == {("c1", "family"), ("c2", "code")}


# Sources, sinks, runs -----------------------------------------------------------------------------------------------------------


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train", None), ("b", "val", "x|y")], "id string, split string, note string")
    writers.write_json(rows, str(tmp_path / "j"))
    back = readers.json_lines(spark, str(tmp_path / "j"), "id string, split string, note string")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert readers.json_lines_or_none(spark, str(tmp_path / "none"), "id string").count() == 0
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n{"id"\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl"), "id string").collect()
    for n in (0, 1):
        d = tmp_path / "s" / str(n)
        d.mkdir(parents=True)
        (d / f"shard-{n}.jsonl").write_text(f'{{"id": "{n}"}}\n')
    assert sorted(r.id for r in readers.shards(spark, str(tmp_path / "s"), "id string").collect()) == ["0", "1"]
    src = tmp_path / "src"
    (src / ".git").mkdir(parents=True)
    (src / "pkg").mkdir()
    (src / ".git" / "no.py").write_text("x")
    (src / "pkg" / "yes.py").write_text("eval('1')\n")
    (src / "latin.py").write_bytes(b"\xff\xfe")
    (tmp_path / "outside.py").write_text("x = 1\n")
    (src / "link.py").symlink_to(tmp_path / "outside.py")
    (src / "linked").symlink_to(src / "pkg", target_is_directory=True)
    files = {r.path: r.content for r in readers.python_files(spark, str(src)).collect()}
    assert files == {"pkg/yes.py": "eval('1')\n", "latin.py": None}
    (tmp_path / "t.csv").write_text("TestName,Result\na_Correctness_1,ok\nvulnerability,failure\ncorrectness_vulnerability,last\n")
    assert tuple(readers.test_results(spark, str(tmp_path / "t.csv")).first()) == ("last", "failure")
    writers.write_splits(rows, str(tmp_path / "splits"), 1)
    assert {r.split for r in spark.read.parquet(str(tmp_path / "splits")).collect()} == {"train", "val"}
    assert writers.manifest(spark.createDataFrame([("p", "c")], "path string, content string")).first()[0].endswith("  p")
    table = writers.markdown_table(rows, ["id", "note"], ["id"]).first()[0]
    assert table.splitlines() == ["| id | note |", "|---|---|", "| a |  |", "| b | x\\|y |"]
    report = writers.markdown_report("T", spark.createDataFrame([(0.5, 3)], "r double, n int"), {"r": "Rate", "n": "Count"}).first()[0]
    assert report == "# T\n\n- Rate: 0.5000\n- Count: 3"
    packed = relational.pack_samples(spark.createDataFrame([("i", 1, "b"), ("i", 0, "a")], "id string, sample_index int, text string"), ["id"], "sample_index", ["text"])
    assert [x.text for x in packed.first().output] == ["a", "b"]
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert readers.config(str(tmp_path / "c.json"), ("a",)) == {"a": 1}
    with pytest.raises(ValueError, match="lack"):
        readers.config(str(tmp_path / "c.json"), ("b",))


def test_python_files_leaves_links_out(spark, tmp_path):
    (tmp_path / "src" / "pkg").mkdir(parents=True)
    (tmp_path / "src" / "pkg" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "b.py").symlink_to(tmp_path / "src" / "pkg" / "a.py")
    assert [(r.path, r.content) for r in readers.python_files(spark, str(tmp_path / "src")).collect()] == [("pkg/a.py", "x = 1\n")]


def test_suite_rules(spark):
    ddl = "id string, pair_id string, language string, is_vulnerable boolean, source_license string"
    rows = [("1", "p", "python", True, "MIT"), ("2", "p", "python", False, "MIT"), ("3", "q", "python", True, "MIT"), ("4", "q", "python", True, "GPL"), ("1", "r", "ruby", None, "MIT")]
    bare = spark.createDataFrame(rows, ddl)
    rest = {c: F.lit("x") for c in ("family", "framework", "cwe", "expected_check", "target_file")} | {"files": F.create_map(F.lit("x"), F.lit("y"))}
    got = readers.suite_violations(bare.withColumns(rest), ("python",), ("MIT",))
    # a key that the whole suite lacks is broken by every case
    lacking = readers.suite_violations(bare, ("python",), ("MIT",))
    assert {r.rule for r in lacking.collect()} >= {f"no {c}" for c in rest}
    assert {tuple(r) for r in got.collect()} == {("4", "license"), ("1", "language"), ("1", "no is_vulnerable"), ("1", "repeated"), ("q", "pair"), ("r", "pair")}


class FailsOn:
    """A model that cannot take one prompt."""

    def __init__(self, prompt):
        self.prompt = prompt

    def infer_batch(self, prompts):
        if self.prompt in prompts:
            raise RuntimeError("no")
        return ["{}"] * len(prompts)


def test_resume_and_predict(spark, tmp_path):
    records = spark.range(10).select("id", F.concat(F.lit("p"), "id").alias("prompt"))
    predictor = predict.RulePredictor(5)
    log = str(tmp_path / "log")
    first = resume.append_missing(records.limit(4), log, ["id"], lambda r: predict.predictions(r, predictor))
    assert first.count() == 4
    assert resume.append_missing(records, log, ["id"], lambda r: predict.predictions(r, predictor)).count() == 10
    assert resume.append_missing(records, log, ["id"], lambda r: predict.predictions(r, predictor), force=True).count() == 10
    resume.frozen_settings(spark, str(tmp_path / "set"), {"a": 1})
    resume.frozen_settings(spark, str(tmp_path / "set"), {"a": 1})
    with pytest.raises(ValueError, match="other settings"):
        resume.frozen_settings(spark, str(tmp_path / "set"), {"a": 2})
    broken = predict.predictions(records, FailsOn("p3")).collect()
    assert [(r.id, r.error) for r in broken if r.invalid_json] == [(3, "RuntimeError: no")]


def test_driver_entry(spark):
    import __spark_entry__ as entry

    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 50
    assert entry.entry(spark).count() == 1


def test_batches_are_python_objects_a_few_rows_at_a_time():
    import tracemalloc

    import pyarrow as pa
    from quarrymill.functions import code_columns

    texts = pa.array(["line\n" * 4_000] * 1_000)  # 20 MB
    tracemalloc.start()
    got = code_columns._each(len, pa.int64())(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [20_000] * 1_000 and peak < 5_000_000
    assert code_columns._each(len, pa.int64())(texts.slice(0, 0)).to_pylist() == []


def test_a_tried_patch_is_what_its_parts_give():
    import random

    from quarrymill.functions import code

    rng = random.Random(3)
    ends = ["\n", "\n", "\r\n", "\r", "\x0b"]
    for n in range(3_000):
        text = lambda n=n: "".join(rng.choice("abcd") + (rng.choice(ends) if n % 2 else "\n") for _ in range(rng.randrange(0, 14))) + rng.choice(["", "x"])
        a, b = text(), text()
        got, patch = code.try_patch(a, b), code.make_patch(a, b)
        done = code.apply_patch(a, patch)
        assert (got.patch, got.ok, got.same, got.changed, got.lines) == (patch, done.ok, done.text == b, code.changed_lines(a, b), code.edited_lines(a, b))
    assert code.try_patch(None, "a") is None and code.try_patch("a", "a").patch == ""


def test_patch_queries_send_their_texts_to_python_once(spark):
    from quarrymill.plans import texts

    for query in (texts.patch_round_trip, texts.patch_edits):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_patch_queries_send_few_documents_at_once(spark, monkeypatch):
    from quarrymill.plans import texts

    monkeypatch.setattr(texts, "DOCS_A_TASK", 30)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for query in (texts.patch_round_trip, texts.patch_edits):
        rows = query(spark, "/root/testdata/sf0.001")
        assert rows._jdf.queryExecution().toRdd().getNumPartitions() == -(-docs // 30)


def test_facts_of_code_are_those_of_its_single_functions(monkeypatch):
    import hashlib

    from quarrymill.functions import code

    digest = lambda form: None if form is None else hashlib.sha256(form.encode()).hexdigest()
    for x in (None, "", "def (", "x = 'é'\neval(x)\nexec(x)\n", "async def f(a): return 1\n", "'unended"):
        got = code.facts(x)
        assert (got["parses"], got["tokens"], got["tree"], dict(got["found"])) == (code.parses(x), digest(code.token_form(x)), digest(code.structure_form(x)), code.finding_counts(x))
    parsed = []
    parse = code.ast.parse
    monkeypatch.setattr(code.ast, "parse", lambda text: (parsed.append(text), parse(text))[1])
    code.facts("eval('one text')\n")
    assert len(parsed) == 1
