"""Queries over whole runs and the operators that they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import code_columns as C
from quarrymill.functions import text as X
from quarrymill.operators import relational
from quarrymill.plans import builder, evaluation, labs, repair, runs, scoring, suites
from quarrymill.plans.evaluation import SAMPLES, binomial_sql, uniform_sql
from quarrymill.sources import reports
from quarrymill.streaming import predict, resume


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _reports(spark, sf_dir):
    """Three predictors' verdicts in long form: a stratum is a split, and the third has no verdict on some records."""
    f = evaluation.frame(spark, sf_dir)
    right = lambda c: F.coalesce(F.col(c) == F.col("is_vulnerable"), F.lit(False))
    third = f.where("id % 13 <> 0").select(F.col("stratum").alias("split"), F.lit("third").alias("tag"), "id", (F.col("is_vulnerable") == (F.col("id") % 3 == 0)).alias("ok"))
    sides = [f.select(F.col("stratum").alias("split"), F.lit(c).alias("tag"), "id", right(c).alias("ok")) for c in ("base", "final")]
    return sides[0].unionByName(sides[1]).unionByName(third).where("split IS NOT NULL")


def benchmark_pairs(spark, sf_dir):
    """All pairs of reports of a split, tested and adjusted."""
    got = runs.compare_reports(_reports(spark, sf_dir), SAMPLES)
    return got.select(
        "split", "left", "right", "shared", "left_only", "right_only", F.round("difference", 9).alias("difference"), F.round("lower_95", 9).alias("lower_95"), F.round("upper_95", 9).alias("upper_95"),
        F.round("p", 8).alias("p"), F.round("p_holm", 8).alias("p_holm"),
    )


def paired_compare(spark, sf_dir):
    """Two predictors on vulnerable records, families drawn with replacement."""
    f = evaluation.frame(spark, sf_dir)
    side = lambda c: f.select("id", F.struct(F.coalesce(F.col(c) == F.col("is_vulnerable"), F.lit(False)).alias("ok")).alias("scores"))
    got = scoring.paired_compare(side("base"), side("final"), f, "ok", runs.population("vulnerable"), SAMPLES)
    return got.select("records", "base_only", "final_only", *[F.round(c, 9).alias(c) for c in ("base_rate", "final_rate", "effect", "lower_95", "upper_95")], F.round("log10_p", 6).alias("log10_p"))


def preflight(spark, sf_dir):
    """Patches made of parts' keys against the rules that come before a patch is tried."""
    k = F.col("p_partkey")
    path = F.when(k % 11 == 0, F.lit("../app.py")).when(k % 13 == 0, F.lit("app.txt")).otherwise(F.lit("app.py"))
    other = F.when(k % 7 == 0, F.lit("other.py")).otherwise(path)
    added = F.when(k % 5 == 0, F.lit("+eval(x)\n")).otherwise(F.lit("+y = 1\n"))
    lines = F.when(k % 17 == 0, F.repeat(F.lit("+z\n"), 50)).when(k % 19 == 0, F.lit("")).otherwise(added)
    patch = F.concat(F.lit("--- a/"), path, F.lit("\n+++ b/"), other, F.lit("\n@@ -1 +1 @@\n"), lines)
    from quarrymill.functions.code import BANNED_ADDITIONS

    return _table(spark, sf_dir, "part").select("p_partkey", X.preflight(patch, path, k % 23 != 0, BANNED_ADDITIONS).alias("why"), X.patch_paths(patch)[0].alias("target"), F.size(X.patch_changes(patch)).cast("long").alias("changes"))


def repo_outcomes(spark, sf_dir):
    """Runs of labelled documents: repaired or preserved only if all that is needed is known and true."""
    i, v = F.col("doc_id"), F.col("quality") == 0
    some = lambda n: F.when(i % 29 != n, i % n != 0)
    rows = _table(spark, sf_dir, "labels").select(
        "doc_id", v.alias("is_vulnerable"), some(3).alias("initial_match"), (i % 2 == 0).alias("accepted"), (i % 7 == 0).alias("final_match"), some(5).alias("tests_passed"),
        F.when(i % 2 == 0, F.array(F.lit("a.py"))).otherwise(F.array().cast("array<string>")).alias("changed_paths"), F.lit("a.py").alias("target_file"), F.lit(True).alias("protected_unchanged"), (i % 4).alias("finding_count"),
    )
    return suites.outcomes(rows).select("doc_id", "repair_success", "clean_preserved")


def exported_findings(spark, sf_dir):
    """The scanner's findings and another tool's in one form: of equal places the last content at the first place."""
    k = F.col("p_partkey")
    scanned = _table(spark, sf_dir, "part").select(
        F.when(k % 3 == 0, "os-system").when(k % 3 == 1, "hardcoded-secret").otherwise("unmapped").alias("check"), F.lit("HIGH").alias("severity"), F.concat(F.lit("./m"), (k % 50).cast("string"), F.lit(".py")).alias("file"),
        (k % 20).alias("line"), F.lit("first").alias("message"),
    )
    other = _table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("m"), (F.col("s_suppkey") % 50).cast("string"), F.lit(".py")).alias("path"), (F.col("s_suppkey") % 20).alias("line"), F.when(F.col("s_suppkey") % 4 != 0, "CWE-078").alias("cwe"), F.lit("B1").alias("rule"),
        F.lit("second").alias("message"), F.lit("LOW").alias("severity"),
    )
    return suites.export_findings(scanned, other).select("path", F.col("start.line").alias("line"), "cwe", F.col("extra.message").alias("message"))


def repo_scan(spark, sf_dir):
    """Files of two kinds, one of which does not parse: findings with ids, and errors beside them."""
    rows = spark.createDataFrame([(0, "eval('1')\n"), (1, "import os\nos.system('x')\nexec('2')\n"), (2, "def (\n")], "k int, content string")
    files = _table(spark, sf_dir, "supplier").select(F.format_string("f%06d.py", "s_suppkey").alias("path"), F.pmod("s_suppkey", F.lit(3)).cast("int").alias("k")).join(F.broadcast(rows), "k")
    found, errors = C.scan(files.select("path", "content"))
    return found.select("id", "file", F.col("check").alias("what"), "line").unionByName(errors.select(F.lit(None).cast("string").alias("id"), "file", F.col("error").alias("what"), F.lit(None).cast("int").alias("line")))


def resume_samples(spark, sf_dir):
    """Samples that a log of (id, sample) lacks, and progress by shard."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("sample_index"))
    log = labels.where("(doc_id + sample_index) % 4 <> 0")
    return relational.pending(labels, log, ["doc_id", "sample_index"]).groupBy("sample_index").agg(F.count("*").alias("pending"))


def shard_progress(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return relational.shard_progress(docs, labels, "doc_id", "doc_id", 8)


def ordered_rows(spark, sf_dir):
    """Labels in the order of their documents' digests, as places."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("place"))
    rows = relational.in_order(_table(spark, sf_dir, "labels").select("doc_id", "quality"), docs, "doc_id", "place")
    return C.number_rows(rows.join(docs, "doc_id"), ["place"], "%06d", "at").select("doc_id", "quality", "at")


def base_selection(spark, sf_dir):
    """The first allowed model of three wanted ones, by an audit of nations."""
    audited = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("model_id"), (F.col("n_regionkey") == 1).alias("train_allowed"))
    return spark.createDataFrame([(relational.first_allowed(audited, ["NATION_7", "NATION_16", "NATION_11"]),)], "model_id string")


def inventory(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("source", F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(".txt")).alias("path"), F.col("text").alias("content"))
    return relational.inventory(docs, ["source"])


def canonical_form(spark, sf_dir):
    """Properties and their user in an object of objects, keys in order whatever order they were written in."""
    e = _table(spark, sf_dir, "events").select("event_id", F.format_string('{"z": {"b": %d, "a": "é"}, "a": [1, {"y": 2, "x": %d}]}', "user_id", "event_id").alias("j"))
    return e.select("event_id", C.canonical_json("j").alias("canonical"))


def tree_digests(spark, sf_dir):
    """A hundred documents are a tree: digests of paths with raw contents, and with canonical JSON."""
    docs = _table(spark, sf_dir, "documents").select(F.expr("doc_id div 100").alias("tree"), F.format_string("%012d", "doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content"), "n_chars")
    raw = C.tree_digest_raw(docs, "tree").withColumnRenamed("tree_sha256", "raw_sha256")
    shaped = docs.withColumn("content", F.format_string('{"n": %d, "d": "%s"}', F.coalesce("n_chars", F.lit(0)), "path"))
    return raw.join(C.tree_digest_json(shaped, "tree").withColumnRenamed("tree_sha256", "json_sha256"), "tree")


def evaluate_run(spark, sf_dir):
    """A predictor that changes nothing, run twice over half and over all records with one log: its report."""
    from quarrymill.scratch import scratch_path

    made = builder.converse(builder.features(labs._records(spark, sf_dir)))
    records = made.withColumn("task", F.lit("detect")).withColumn("prompt", F.lit(""))
    log = scratch_path(spark, "evaluation")
    runs.answer(records.where("idx % 2 = 0"), predict.KeepPredictor(), log, {"split": "all"})  # a run that ended before its report
    rows, report = runs.evaluate(records, predict.KeepPredictor(), log, {"split": "all"})
    asked = rows.agg(F.count("*").alias("answers"), F.countDistinct("id").alias("ids"))
    rates = ("schema_valid_rate", "classification_correct_rate", "fixed_code_parseable_rate", "negative_preserved_rate", "overpatch_rate")
    return report.join(F.broadcast(asked)).select("rows", "answers", "ids", "tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in rates])  # one row each


def code_of(docs):
    """A file of Python for each document: which weak lines it has follows from the document's text."""
    has = lambda pattern, line: F.when(F.coalesce(F.col("text").rlike(pattern), F.lit(False)), F.lit(line)).otherwise("")
    body = F.concat(
        F.lit("import ast\nimport os\nimport subprocess\n\n\ndef run_"), F.col("doc_id").cast("string"), F.lit("(value):\n    total = len(value)\n"),
        has("ing", "    total = eval(value)\n"), has("sch", "    os.system(value)\n"), F.lit("    one = 1\n    two = 2\n    three = 3\n    four = 4\n"),
        has("[0-9]", '    password = "never-to-be-told"\n'), F.lit("    return total, one, two, three, four\n"),
    )
    return docs.select(F.format_string("%09d.py", "doc_id").alias("path"), body.alias("content"))


def _repaired(spark, sf_dir):
    from quarrymill.scratch import scratch_path

    files = code_of(_table(spark, sf_dir, "documents"))
    return (files, *repair.repair(files, repair.RulePatcher(), scratch_path(spark, "repair")))


def repair_attempts(spark, sf_dir):
    """Every attempt at every finding of documents' files, by a predictor whose first answers fail for some."""
    _, found, attempts, _ = _repaired(spark, sf_dir)
    return attempts.join(found, "id").select("id", "file", F.col("check").alias("what"), "line", "attempt", "invalid_json", "accepted", F.substring_index("reason", ":", 1).alias("reason"))


def repair_outcome(spark, sf_dir):
    """What the loop leaves of all findings, and how many files it changed."""
    files, found, attempts, after = _repaired(spark, sf_dir)
    changed = after.join(files.withColumnRenamed("content", "was"), "path").agg(F.count_if(F.col("content") != F.col("was")).alias("changed_files"))
    return repair.summary(files, found, attempts, after).join(F.broadcast(changed))  # one row each


def sample_report(spark, sf_dir):
    """Samples from validation to static findings' rates."""
    rows = labs._samples(spark, sf_dir).drop("is_gap")
    prompts = rows.select("id").distinct()
    i = F.col("id").cast("long")
    n = (i + F.col("sample_index")) % 4
    static = rows.where(i % 3 != 0).select("id", "sample_index", n.alias("findings"), F.least(n, F.lit(1)).alias("direct_findings"), F.lit(0).alias("indirect_findings"), (n == 0).alias("finding_free"), F.array().cast("array<string>").alias("rules"))
    got = runs.sample_report(rows, prompts, 5, [], static)
    return got.select("prompts", "scored", F.round("functional_pass_rate", 9).alias("functional_rate"), *[F.round(c, 9).alias(c) for c in ("finding_free_rate", "direct_finding_rate", "any_finding_rate")], "static_findings")


def suite_manifest(spark, sf_dir):
    """Cases against records of all parts, frozen, and scanned."""
    cases = runs.build_cases(spark)
    made = runs.build_suite(cases, labs._records(spark, sf_dir))
    scan = runs.run_suite(cases).agg(F.count_if(F.col("is_vulnerable") & F.col("expected_finding_detected")).alias("tp"), F.count_if(~F.col("is_vulnerable") & (F.col("initial_finding_count") > 0)).alias("fp"))
    return made.join(F.broadcast(scan)).select("records", "pairs", "vulnerable", "clean", F.array_join("cwes", ",").alias("cwes"), F.array_join("frameworks", ",").alias("frameworks"), "tp", "fp")  # one row each


def suite_validation(spark, sf_dir):
    """A stored run in which some rows contradict themselves, are missing or stand twice."""
    i = F.col("id").cast("long")
    rows = labs._runs(spark, sf_dir)
    once = rows.where(i % 31 != 0).withColumns({"patch_accepted": F.col("patch_accepted") & (i % 37 != 0), "clean_preserved": F.col("clean_preserved") | (i % 41 == 0)})
    stored = once.unionByName(once.where(i % 43 == 0).withColumn("repair_success", F.lit(False)))
    return relational.dense_counts(runs.run_violations(stored, rows), "rule", list(runs.RUN_RULES))


def report_layouts(spark, sf_dir):
    """Two reports as text: a run of labelled documents, and reports with tables."""
    facts = suites.summarize(labs._runs(spark, sf_dir)).withColumn("tag", F.lit("labels"))
    suite = reports.render(reports.SUITE, facts).select(F.lit("suite").alias("kind"), "markdown")
    scored = _reports(spark, sf_dir)
    each = scored.groupBy("tag", "split").agg(F.count("*").alias("rows"), F.avg(F.col("ok").cast("double")).alias("accuracy"))
    pairs = runs.compare_reports(scored, 20)
    heads = each.agg(F.count("*").alias("reports")).join(F.broadcast(pairs.agg(F.count("*").alias("comparisons"))))  # one row each
    summary = reports.render(reports.SUMMARY, heads, each, pairs).select(F.lit("summary").alias("kind"), F.array_join(F.slice(F.split("markdown", "\n"), 1, 8), "\n").alias("markdown"))
    return suite.unionByName(summary)


def event_windows(spark, sf_dir):
    """Events by type and hour, as a stream's windows count them."""
    got = resume.event_windows(_table(spark, sf_dir, "events"))
    return got.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


def queries() -> dict:
    names = (
        benchmark_pairs, paired_compare, preflight, repo_outcomes, exported_findings, repo_scan, resume_samples, shard_progress, ordered_rows, base_selection, inventory, canonical_form, tree_digests,
        evaluate_run, repair_attempts, repair_outcome, sample_report, suite_manifest, suite_validation, report_layouts, event_windows,
    )
    return {f.__name__: f for f in names}


#: Findings of documents' files with the round that settles them, and their attempts.
_REPAIRS = """d AS (SELECT doc_id AS n, printf('%09d.py', doc_id) AS file, coalesce(text LIKE '%ing%', false) AS e, coalesce(text LIKE '%sch%', false) AS s, coalesce(regexp_matches(text, '[0-9]'), false) AS p FROM documents),
  w AS (SELECT n, file, 'dynamic-execution' AS what, 8 AS line, CASE WHEN n % 2 = 1 THEN 1 ELSE 2 END AS settled FROM d WHERE e
    UNION ALL SELECT n, file, 'os-system', 8 + e::INT, CASE WHEN n % 3 = 0 THEN 3 WHEN e AND n % 2 = 1 THEN 2 ELSE 1 END FROM d WHERE s
    UNION ALL SELECT n, file, 'hardcoded-secret', 12 + e::INT + s::INT, 4 FROM d WHERE p),
  i AS (SELECT *, row_number() OVER (ORDER BY file, line, what) AS k FROM w),
  f AS (SELECT *, 'AST-' || CASE WHEN k < 10000 THEN lpad(k::VARCHAR, 4, '0') ELSE k::VARCHAR END AS id FROM i),
  a AS (SELECT *, attempt = settled AS accepted, what = 'dynamic-execution' AND attempt < settled AS invalid_json,
    CASE WHEN attempt = settled THEN 'accepted' WHEN what = 'dynamic-execution' THEN 'no JSON object' WHEN what = 'os-system' THEN 'does not apply' ELSE 'no longer parses' END AS reason
    FROM f, (SELECT unnest([1, 2, 3]) AS attempt) WHERE attempt <= settled)"""


def oracle_sql() -> dict[str, str]:
    long = f"""{evaluation.FRAME}, long AS (SELECT stratum AS split, 'base' AS tag, id, coalesce(base = is_vulnerable, false) AS ok FROM frame UNION ALL
  SELECT stratum, 'final', id, coalesce(final = is_vulnerable, false) FROM frame UNION ALL SELECT stratum, 'third', id, is_vulnerable = (id % 3 = 0) FROM frame WHERE id % 13 <> 0)"""
    marked = f"{evaluation.FRAME}, marked AS (SELECT *, coalesce(base = is_vulnerable, false) AS base_ok, coalesce(final = is_vulnerable, false) AS final_ok FROM frame WHERE is_vulnerable)"
    draw = "CAST(('0x' || substr(md5('42:' || b || ':' || j), 1, 15)) AS BIGINT)"
    records = labs._RECORDS
    path = "CASE WHEN p_partkey % 11 = 0 THEN '../app.py' WHEN p_partkey % 13 = 0 THEN 'app.txt' ELSE 'app.py' END"
    samples = "s AS (SELECT doc_id, j, doc_id * 7 + j * 3 AS x FROM labels, range(5) r(j))"
    z = evaluation.stats.Z95
    return {
        "benchmark_pairs": f"""WITH {long}, c AS (SELECT a.split, a.tag AS l, b.tag AS r, count(*) AS shared, count(*) FILTER (a.ok AND NOT b.ok) AS left_only, count(*) FILTER (NOT a.ok AND b.ok) AS right_only
    FROM long a JOIN long b ON a.split = b.split AND a.id = b.id AND a.tag < b.tag GROUP BY 1, 2, 3),
  w1 AS (SELECT b, split, l, r, shared, left_only, right_only, shared AS n, left_only::DOUBLE / shared AS p, {uniform_sql(0)} AS u FROM c, range({SAMPLES}) x(b)), {binomial_sql("w1", "d1", "lost")},
  w2 AS (SELECT b, split, l, r, shared, lost, shared - lost AS n, least(1.0, coalesce(right_only::DOUBLE / nullif(shared - left_only, 0), 0.0)) AS p, {uniform_sql(1)} AS u FROM d1), {binomial_sql("w2", "d2", "won")},
  i AS (SELECT split, l, r, quantile_cont((won - lost)::DOUBLE / shared, 0.025) AS low, quantile_cont((won - lost)::DOUBLE / shared, 0.975) AS high FROM d2 GROUP BY 1, 2, 3),
  x AS (SELECT *, unnest(range(0, least(left_only, right_only) + 1)) AS k, left_only + right_only AS m FROM c),
  t AS (SELECT split, l, r, CASE WHEN any_value(m) = 0 THEN 1.0 ELSE least(1.0, sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) - (m - 1) * ln(2.0::DOUBLE)))) END AS p FROM x GROUP BY 1, 2, 3),
  h AS (SELECT *, row_number() OVER (ORDER BY p, split, l, r) AS rank, count(*) OVER () AS tests FROM t)
SELECT c.split, c.l AS "left", c.r AS "right", shared, left_only, right_only, round((right_only - left_only)::DOUBLE / shared, 9) AS difference, round(low, 9) AS lower_95, round(high, 9) AS upper_95, round(p, 8) AS p,
  round(max(least(1.0, p * (tests - rank + 1))) OVER (ORDER BY p, c.split, c.l, c.r ROWS UNBOUNDED PRECEDING), 8) AS p_holm FROM c JOIN i USING (split, l, r) JOIN h USING (split, l, r)""",
        "paired_compare": f"""WITH {marked}, t AS (SELECT family, count(*) AS n, sum(base_ok::INT) AS base, sum(final_ok::INT) AS final FROM marked GROUP BY family),
  k AS (SELECT *, row_number() OVER (ORDER BY family) - 1 AS i FROM t),
  d AS (SELECT b, {draw} % (SELECT count(*) FROM t) AS i FROM range({SAMPLES}) x(b), range((SELECT count(*) FROM t)) y(j)),
  r AS (SELECT b, sum(n) AS n, sum(base) AS base, sum(final) AS final FROM d JOIN k USING (i) GROUP BY b),
  c AS (SELECT count(*) AS records, count(*) FILTER (base_ok AND NOT final_ok) AS base_only, count(*) FILTER (NOT base_ok AND final_ok) AS final_only, avg(base_ok::INT) AS base_rate, avg(final_ok::INT) AS final_rate FROM marked),
  x AS (SELECT *, base_only + final_only AS m, unnest(range(0, least(base_only, final_only) + 1)) AS q FROM c), y AS (SELECT any_value(m) AS m, sum(exp(lgamma(m + 1) - lgamma(q + 1) - lgamma(m - q + 1) - m * ln(2.0::DOUBLE))) AS s FROM x)
SELECT records, base_only, final_only, round(base_rate, 9) AS base_rate, round(final_rate, 9) AS final_rate, round(final_rate - base_rate, 9) AS effect,
  (SELECT round(quantile_cont((final - base)::DOUBLE / n, 0.025), 9) FROM r) AS lower_95, (SELECT round(quantile_cont((final - base)::DOUBLE / n, 0.975), 9) FROM r) AS upper_95,
  (SELECT round(CASE WHEN m = 0 THEN 0.0 ELSE log10(2 * s) END, 6) FROM y) AS log10_p FROM c""",
        "preflight": f"""WITH p AS (SELECT p_partkey, p_partkey AS k, {path} AS path FROM part), o AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'other.py' ELSE path END AS target, CASE WHEN k % 17 = 0 THEN 50 WHEN k % 19 = 0 THEN 0 ELSE 1 END AS n FROM p)
SELECT p_partkey, CASE WHEN target <> path THEN 'must change the finding''s file and no other' WHEN path <> 'app.py' THEN 'path is unsafe or not a Python file' WHEN k % 23 = 0 THEN 'no such file' WHEN n = 0 THEN 'no change'
  WHEN n > 40 THEN 'more than 40 lines change' WHEN k % 5 = 0 AND n = 1 THEN 'adds a banned pattern' END AS why, target, n AS changes FROM o""",
        "repo_outcomes": """WITH r AS (SELECT doc_id, doc_id AS i, quality = 0 AS v FROM labels)
SELECT doc_id, v AND i % 29 <> 3 AND i % 3 <> 0 AND i % 2 = 0 AND i % 7 <> 0 AND i % 29 <> 5 AND i % 5 <> 0 AS repair_success,
  NOT v AND i % 29 <> 3 AND i % 3 = 0 AND i % 4 = 0 AND i % 2 <> 0 AND i % 29 <> 5 AND i % 5 <> 0 AS clean_preserved FROM r""",
        "exported_findings": """WITH a AS (SELECT 'm' || p_partkey % 50 || '.py' AS path, p_partkey % 20 AS line, CASE p_partkey % 3 WHEN 0 THEN 'CWE-78' WHEN 1 THEN 'CWE-798' END AS cwe, 'first' AS message FROM part
  UNION ALL SELECT 'm' || s_suppkey % 50 || '.py', s_suppkey % 20, CASE WHEN s_suppkey % 4 <> 0 THEN 'CWE-78' END, 'second' FROM supplier)
SELECT path, line, cwe, max(message) AS message FROM a WHERE cwe IS NOT NULL GROUP BY 1, 2, 3""",
        "repo_scan": """WITH f AS (SELECT printf('f%06d.py', s_suppkey) AS file, s_suppkey % 3 AS k FROM supplier), r AS (SELECT file, what, line FROM f JOIN (VALUES (0, 'dynamic-execution', 1), (1, 'os-system', 2), (1, 'dynamic-execution', 3)) t(k, what, line) USING (k))
SELECT 'AST-' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS id, file, what, line FROM (SELECT *, row_number() OVER (ORDER BY file, line, what) AS n FROM r)
UNION ALL SELECT NULL, file, 'syntax error', NULL FROM f WHERE k = 2""",
        "resume_samples": "SELECT j::INT AS sample_index, count(*) AS pending FROM labels, range(3) r(j) WHERE (doc_id + j) % 4 = 0 GROUP BY 1",
        "shard_progress": """WITH d AS (SELECT doc_id % 8 AS shard, doc_id IN (SELECT doc_id FROM labels) AS done FROM documents)
SELECT r.s::INT AS shard, count(d.shard) AS expected, count(*) FILTER (done) AS done FROM range(8) r(s) LEFT JOIN d ON d.shard = r.s GROUP BY 1""",
        "ordered_rows": """SELECT doc_id, quality, lpad((row_number() OVER (ORDER BY md5(doc_id::VARCHAR)))::VARCHAR, 6, '0') AS at FROM labels JOIN documents USING (doc_id)""",
        "base_selection": "SELECT n_name AS model_id FROM nation WHERE n_regionkey = 1 AND n_name IN ('NATION_7', 'NATION_16', 'NATION_11') ORDER BY CASE n_name WHEN 'NATION_7' THEN 0 WHEN 'NATION_16' THEN 1 ELSE 2 END LIMIT 1",
        "inventory": """SELECT source, count(*) AS files, count(*) FILTER (doc_id % 2 = 0) AS python_files,
  CAST(coalesce(sum(len(text) - len(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END), 0) AS BIGINT) AS lines FROM documents GROUP BY 1""",
        "canonical_form": r"""SELECT event_id, '{"a":[1,{"x":' || event_id || ',"y":2}],"z":{"a":"\u00e9","b":' || user_id || '}}' AS canonical FROM events""",
        "tree_digests": r"""WITH d AS (SELECT doc_id // 100 AS tree, printf('%012d', doc_id) AS path, coalesce(text, '') AS content, coalesce(n_chars, 0) AS n FROM documents)
SELECT tree, sha256(string_agg(path || chr(0) || content, '' ORDER BY path)) AS raw_sha256, sha256(string_agg(path || '{"d":"' || path || '","n":' || n || '}', '' ORDER BY path)) AS json_sha256 FROM d GROUP BY 1""",
        "evaluate_run": f"""WITH {records} SELECT count(*) AS rows, count(*) AS answers, count(*) AS ids, 0 AS tp, count(*) FILTER (NOT v) AS tn, 0 AS fp, count(*) FILTER (v) AS fn, 1.0::DOUBLE AS schema_valid_rate,
  round(coalesce(avg((NOT v)::INT), 0), 6) AS classification_correct_rate, 1.0::DOUBLE AS fixed_code_parseable_rate, CASE WHEN count(*) FILTER (NOT v) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS negative_preserved_rate, 0.0::DOUBLE AS overpatch_rate FROM r""",
        "repair_attempts": f"""WITH {_REPAIRS} SELECT id, file, what, line, attempt, invalid_json, accepted, reason FROM a""",
        "repair_outcome": f"""WITH {_REPAIRS} SELECT (SELECT count(*) FROM documents) AS python_files, (SELECT count(*) FROM f) AS ast_findings, (SELECT count(*) FROM f WHERE settled > 3) AS final_ast_findings,
  (SELECT count(*) FROM f WHERE settled <= 3) AS accepted_patches, (SELECT count(*) FROM f WHERE settled > 3) AS rejected_patches, (SELECT count(*) FROM a) AS attempts,
  (SELECT count(DISTINCT n) FROM f WHERE settled <= 3) AS changed_files""",
        "sample_report": f"""WITH {samples}, c AS (SELECT count(DISTINCT doc_id) AS prompts, count(*) AS scored, avg((doc_id % 20 <> 10 AND x % 3 = 0)::INT) AS f FROM s),
  t AS (SELECT (doc_id + j) % 4 AS n FROM s WHERE doc_id % 3 <> 0)
SELECT prompts, scored, round(f, 9) AS functional_rate, (SELECT round(avg((n = 0)::INT), 9) FROM t) AS finding_free_rate, (SELECT round(avg((n > 0)::INT), 9) FROM t) AS direct_finding_rate,
  (SELECT round(avg((n > 0)::INT), 9) FROM t) AS any_finding_rate, (SELECT sum(n)::BIGINT FROM t) AS static_findings FROM c""",
        "suite_manifest": "SELECT 24 AS records, 12 AS pairs, 12 AS vulnerable, 12 AS clean, 'CWE-078,CWE-094,CWE-502' AS cwes, 'plain,web,worker' AS frameworks, 12 AS tp, 0 AS fp",
        "suite_validation": """WITH r AS (SELECT doc_id AS i, quality = 0 AS v FROM labels), a AS (SELECT i, v, i % 13 = 0 AS invalid, v AND i % 2 = 0 AND i % 37 <> 0 AS accepted, v AND i % 7 = 0 AS repaired, (NOT v AND i % 5 <> 0) OR i % 41 = 0 AS kept FROM r WHERE i % 31 <> 0),
  s AS (SELECT * FROM a UNION ALL SELECT i, v, invalid, accepted, false, kept FROM a WHERE i % 43 = 0)
SELECT 0 AS ord, 'unknown' AS rule, 0 AS n UNION ALL SELECT 1, 'missing', count(*) FROM r WHERE i % 31 = 0 UNION ALL SELECT 2, 'repeated', count(*) FROM a WHERE i % 43 = 0
UNION ALL SELECT 3, 'repair', count(*) FROM s WHERE repaired AND NOT (v AND accepted) UNION ALL SELECT 4, 'preserved', count(*) FROM s WHERE kept AND v UNION ALL SELECT 5, 'invalid', count(*) FROM s WHERE invalid AND accepted UNION ALL SELECT 6, 'lines', 0""",
        "report_layouts": f"""WITH runs AS (SELECT doc_id AS i, quality = 0 AS v FROM labels), c AS (SELECT count(*) AS n, count(*) FILTER (v) AS vn, count(*) FILTER (NOT v) AS cn, count(*) FILTER (v AND i % 3 <> 0) AS tp, count(*) FILTER (NOT v AND i % 11 = 0) AS fp,
  count(*) FILTER (v AND i % 13 <> 0) AS js, count(*) FILTER (v AND i % 2 = 0) AS ac, count(*) FILTER (v AND i % 7 = 0) AS re, count(*) FILTER (NOT v AND i % 5 <> 0) AS pr FROM runs), {long},
  e AS (SELECT tag, split, count(*) AS n, avg(ok::INT) AS a FROM long GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (ORDER BY split, tag) AS o FROM e), g AS (SELECT split, count(*) AS t FROM e GROUP BY 1)
SELECT 'suite' AS kind, '# Repository repair of labels' || chr(10) || chr(10) || printf('- Records: %d\\n- Vulnerable: %d\\n- Clean: %d\\n- Detection recall: %.4f\\n- Detection precision: %.4f\\n- Strict JSON: %.4f\\n- Patches accepted: %.4f\\n- Repaired end to end: %.4f\\n- Clean code preserved: %.4f\\n- Unrelated rewrites: 0\\n- Regressions: 0',
  n, vn, cn, tp::DOUBLE / vn, tp::DOUBLE / (tp + fp), js::DOUBLE / vn, ac::DOUBLE / vn, re::DOUBLE / vn, pr::DOUBLE / cn).replace('\\n', chr(10)) || chr(10) || chr(10) || 'A controlled suite of pairs, the same for all models.' || chr(10) AS markdown FROM c
UNION ALL SELECT 'summary', '# Benchmark summary' || chr(10) || chr(10) || '- Reports: ' || (SELECT count(*) FROM e) || chr(10) || '- Comparisons: ' || (SELECT sum(t * (t - 1) // 2)::BIGINT FROM g) || chr(10) || chr(10) || '## Reports' || chr(10) || chr(10) || '| Tag | Split | Records | Accuracy |'""",
        "event_windows": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""",
    }
