"""Queries that run the composite plans on rows made from the tables: corpus building, rubrics, suites, samples, static findings, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import text as X
from quarrymill.operators import relational, stats
from quarrymill.plans import builder, scoring, suites
from quarrymill.plans.evaluation import uniform_sql, binomial_sql


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark, sf_dir):
    """A record for each part: its key says which family and occurrence."""
    return builder.build_from(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx")), 42)


def corpus_build(spark, sf_dir):
    """Records by split and task."""
    return _records(spark, sf_dir).groupBy("split", "task").agg(F.count("*").alias("n"), F.count_if("is_vulnerable").alias("n_vulnerable"), F.countDistinct("id").alias("ids"))


def corpus_statistics(spark, sf_dir):
    """Counts by split, weakness, both, task, both, and ecosystem, with what each level leaves out as null."""
    return builder.statistics(_records(spark, sf_dir))


def corpus_gate(spark, sf_dir):
    return builder.gate(builder.features(_records(spark, sf_dir)))


def corpus_gate_planted(spark, sf_dir):
    """The gate over records of which some were put into the holdout split as well."""
    made = builder.features(_records(spark, sf_dir))
    return builder.gate(made.unionByName(made.where("idx % 40 = 3").withColumn("split", F.lit("holdout"))))


def corpus_records(spark, sf_dir):
    """Whole records by task and label: how many have what a record must have."""
    made = builder.finish(builder.features(_records(spark, sf_dir)))
    v, answer = F.col("verification"), F.get("messages", F.lit(2))["content"]
    checks = {
        "parsed": v["vulnerable_ast_parse"] & v["fixed_ast_parse"] & v["safe_test_ast_parse"], "controlled": v["security_oracle_pass"], "round_trips": v["patch_round_trip"],
        "answered": answer == F.col("target"), "asked": F.contains("prompt", "vulnerable_code") & (builder.prompt_of(F.lit("")) == F.col("prompt")),
        "analysis": X.has_schema(F.col("target"), scoring.ANALYSIS_FIELDS), "patching": X.has_schema(F.col("target"), scoring.PATCH_FIELDS),
    }
    return made.groupBy("task", "is_vulnerable").agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in checks.items()])


def corpus_self_check(spark, sf_dir):
    """Records broken on purpose, in one way by each of several divisors of their index: how many break which rule."""
    i = F.col("idx")
    made = _records(spark, sf_dir).withColumns(
        {"vulnerable_code": F.when(i % 7 == 0, F.concat("vulnerable_code", F.lit("def (\n"))).otherwise(F.col("vulnerable_code")), "fixed_code": F.when(i % 19 == 0, "x = 1\n").otherwise(F.col("fixed_code"))}
    )
    made = builder.finish(builder.features(made).withColumn("patch", F.when(i % 11 == 0, "").otherwise(F.col("patch"))))
    made = made.withColumns({"target": F.when(i % 13 == 0, "{}").otherwise(F.col("target")), "messages": F.when(i % 17 == 0, F.slice("messages", 1, 2)).otherwise(F.col("messages"))})
    return relational.dense_counts(builder.self_check(made), "rule", list(builder.RULES))


def analysis_rubric(spark, sf_dir):
    """References as answers, every tenth broken and every tenth with two hundred lines more: rates over all records."""
    refs = builder.features(_records(spark, sf_dir))
    longer = F.concat("fixed_code", F.lit("\n"), F.repeat(F.lit("# and more\n"), 200))
    answers = refs.withColumn("fixed_code", F.when(F.col("idx") % 10 == 1, longer).otherwise(F.col("fixed_code")))
    said = answers.select("id", F.lit(False).alias("invalid_json"), F.when(F.col("idx") % 10 == 0, F.lit("{}")).otherwise(builder.analysis_target()).alias("output"))
    got = scoring.aggregate_analysis(scoring.score_analysis(said, refs, builder.specs(spark)))
    rates = {"schema_valid_rate": "valid_rate", "fixed_structural_exact_rate": "exact_rate", "security_control_pass_rate": "control_rate", "safe_test_parseable_rate": "test_rate", "no_dangerous_regression_rate": "safe_rate", "overpatch_rate": "overpatch_rate", "negative_preserved_rate": "preserved_rate", "line_f1_mean": "line_f1"}
    return got.select("rows", "tp", "tn", "fp", "fn", *[F.round(c, 6).alias(name) for c, name in rates.items()])


def patch_rubric(spark, sf_dir):
    """Patches of vulnerable records as answers, every tenth for another file."""
    refs = builder.features(_records(spark, sf_dir)).where("is_vulnerable").withColumn("finding_id", builder.finding_id())
    patch = F.when(F.col("idx") % 10 == 0, F.replace("patch", F.lit("b/app.py"), F.lit("b/x.py"))).otherwise(F.col("patch"))
    said = refs.select("id", F.lit(False).alias("invalid_json"), F.to_json(F.struct("finding_id", F.col("patch_summary").alias("summary"), patch.alias("patch"))).alias("output"))
    scored = scoring.score_patch(said, refs, builder.specs(spark))
    flags = ("schema_valid", "finding_id_exact", "relevant_file_only", "patch_applies", "patched_code_exact", "security_control_pass", "no_dangerous_regression")
    return scored.agg(*[F.count_if(F.col(f"scores.{f}")).alias(f) for f in flags])


def suite_summary(spark, sf_dir):
    """Labelled documents as a suite's cases: id parity decides what was detected and repaired."""
    return suites.summarize(_runs(spark, sf_dir)).select(
        "records", "vulnerable", "clean", "tp", "fn", "fp", "tn", "repaired", "preserved", "median_changed_lines",
        F.round("detection_f1", 9).alias("detection_f1"), F.round(F.get("repair_ci95", F.lit(0)), 9).alias("repair_low"), F.round(F.get("repair_ci95", F.lit(1)), 9).alias("repair_high"),
    )


def _runs(spark, sf_dir, repaired=7):
    i, v = F.col("doc_id"), F.col("quality") == 0
    return _table(spark, sf_dir, "labels").select(
        i.cast("string").alias("id"), v.alias("is_vulnerable"), (v & (i % 3 != 0)).alias("expected_finding_detected"), F.when(v, i % 3).otherwise((i % 11 == 0).cast("int")).cast("int").alias("initial_finding_count"),
        (i % 13 == 0).alias("invalid_json"), (v & (i % 2 == 0)).alias("patch_accepted"), (v & (i % repaired == 0)).alias("repair_success"), (~v & (i % 5 != 0)).alias("clean_preserved"),
        F.array().cast("array<string>").alias("unrelated_file_rewrites"), F.lit(None).cast("int").alias("bandit_delta"), F.when(v & (i % 2 == 0), i % 23).alias("patch_changed_lines"), F.lit(1.0).alias("runtime_seconds"), F.lit(None).cast("long").alias("peak_gpu_memory_bytes"),
    )


def suite_compare(spark, sf_dir):
    got = suites.compare_suites(_runs(spark, sf_dir), _runs(spark, sf_dir, 3), 200, 42)
    return got.select("cases", "base_only", "other_only", F.round("effect", 9).alias("effect"), F.round("lower_95", 9).alias("lower_95"), F.round("upper_95", 9).alias("upper_95"), F.round("p", 8).alias("p"))


def _samples(spark, sf_dir):
    """Five samples of each of the documents' first rows: users' events by number."""
    made = _table(spark, sf_dir, "labels").select(F.col("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("sample_index"))
    x = F.col("doc_id") * 7 + F.col("sample_index") * 3
    state = F.when(F.col("doc_id") % 10 == 0, "failed").otherwise("complete")
    return made.select(
        F.col("doc_id").cast("string").alias("id"), "sample_index", state.alias("status"), F.when(state == "failed", F.when(F.col("doc_id") % 20 == 0, "docker build exited 1").otherwise("The test result CSV was not produced.")).alias("error"),
        (x % 4 != 0).alias("compilable"), F.lit("ok").alias("test_correctness"), F.when(x % 6 == 0, "failure").otherwise("ok").alias("test_vulnerability"),
        (x % 3 == 0).alias("functional_pass"), (x % 2 == 0).alias("security_test_pass"), (x % 6 == 0).alias("secure_functional_pass"), (F.col("doc_id") % 20 == 0).alias("is_gap"),
    )


def sample_scores(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    norm = suites.normalise_status(rows, F.col("is_gap"))
    got = suites.sample_metrics(norm)
    return got.select(
        "prompts", "scored_prompts", "scored", "samples", F.round("functional_pass_rate", 9).alias("functional_rate"), F.round("compilable_rate", 9).alias("compilable_rate"),
        *[F.round(c, 9).alias(c) for c in ("pass_at_1", "pass_at_3", "pass_at_5", "secure_pass_at_1", "vulnerable_at_3")],
        F.round(F.get("pass_at_3_bounds", F.lit(0)), 9).alias("pass_at_3_low"), F.round(F.get("pass_at_3_bounds", F.lit(1)), 9).alias("pass_at_3_high"),
    )


def sample_bootstrap(spark, sf_dir):
    norm = suites.normalise_status(_samples(spark, sf_dir).where("NOT is_gap"), [])
    got = suites.prompt_bootstrap(norm, "functional_pass", 100, 42)
    return got.select(F.round("lower_95", 9).alias("lower_95"), F.round("upper_95", 9).alias("upper_95"))


def static_rollup(spark, sf_dir):
    """Parts as mapped files, lines of orders as findings at them: findings, direct ones and rules per file."""
    at = lambda key: ((F.col(key) % 25).cast("int"), F.expr(f"cast({key} div 25 as int)"))
    files = _table(spark, sf_dir, "part").select(F.format_string("p%03d/s%02d_code.py", *at("p_partkey")).alias("path"), F.format_string("CWE-%03d", "p_size").alias("cwe"), F.col("p_partkey").alias("ord"))
    line = _table(spark, sf_dir, "lineitem")
    uri = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "/w/").otherwise("./"), F.format_string("p%03d/s%02d%%5Fcode.py", *at("l_partkey")))
    found = line.select(F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("rule"), uri.alias("uri"), F.array(F.format_string("CWE-%03d", (F.col("l_quantity")).cast("int"))).alias("cwes"))
    out, _ = suites.static_rollup(files, found)
    return out.select("path", "findings", "direct_findings", "indirect_findings", "finding_free", F.array_join("rules", ",").alias("rules"))


def changed_files(spark, sf_dir):
    """Documents as files of cases of a hundred, before and after an edit of some."""
    case = F.concat_ws("/", "source", F.expr("doc_id div 100"))
    docs = _table(spark, sf_dir, "documents").select(case.alias("case"), F.col("doc_id").cast("string").alias("path"), F.md5(F.coalesce("text", F.lit(""))).alias("sha256"), "doc_id")
    after = docs.where("doc_id % 9 <> 4").withColumn("sha256", F.when(F.col("doc_id") % 8 == 1, "edited").otherwise(F.col("sha256")))
    return suites.changed_files(docs, after).select("case", F.array_join("changed_paths", ",").alias("changed_paths"))


def suite_contamination(spark, sf_dir):
    """Every tenth document as a case, all others as training records."""
    family = F.concat("source", F.lit("/"), (F.col("doc_id") % 331).cast("string"))
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), family.alias("family"), F.col("text").alias("code"), (F.col("doc_id") % 10 == 0).alias("is_case"))
    return suites.contamination(docs.where("is_case"), docs.where("NOT is_case"))


def strict_totals(spark, sf_dir):
    """Sources as repositories, labels as truth; some repositories were not scanned."""
    truth = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo")), "doc_id").select("repo", (F.col("quality") == 0).alias("is_vulnerable"), "doc_id")
    seen = truth.where("repo NOT LIKE '%7'").withColumn("said", F.col("doc_id") % 2 == 0)
    v, s = F.col("is_vulnerable"), F.col("said")
    results = seen.groupBy("repo").agg(F.count_if(v & s).alias("tp"), F.count_if(~v & s).alias("fp"), F.count_if(v & ~s).alias("fn"), F.count_if(~v & ~s).alias("tn"))
    got = suites.strict_totals(truth, results)
    return got.select("tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "f2", "f3")])


def model_audit(spark, sf_dir):
    """Nations as models with made-up cards, by status."""
    n = F.col("n_nationkey")
    models = _table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("model_id"), F.when(n % 4 == 0, "apache-2.0").when(n % 4 == 1, "other").alias("card_license"), F.lit(None).cast("string").alias("license_name"), F.lit(None).cast("string").alias("license_link"),
        F.when(n % 4 == 2, F.array(F.lit("x"), F.lit("license:Apache-2.0"))).alias("tags"), F.when(n % 7 == 0, "auto").alias("gated"), F.when(n == 5, "http_404").alias("metadata_error"), F.when(n % 3 == 0, "Research use only").alias("card_text"),
    )
    audit = suites.classify_models(models, ["NATION_4", "NATION_8", "NATION_12"])
    return relational.dense_counts(audit, "status", ["train_allowed", "baseline_only", "skipped", "unknown"])


def draws(spark, sf_dir):
    """Portable draws: one for each part."""
    return _table(spark, sf_dir, "part").select("p_partkey", stats.hash_draw(F.lit(9), F.col("p_partkey")).alias("draw"))


def queries() -> dict:
    names = (
        corpus_build, corpus_statistics, corpus_gate, corpus_gate_planted, corpus_records, corpus_self_check, analysis_rubric, patch_rubric, suite_summary, suite_compare, sample_scores, sample_bootstrap,
        static_rollup, changed_files, suite_contamination, strict_totals, model_audit, draws,
    )
    return {f.__name__: f for f in names}


#: What a part's key says of its record: spec, shape, split, task and whether it is vulnerable.
_RECORDS = """r AS (SELECT *, CASE WHEN shape < 12 THEN 'train' WHEN shape = 12 THEN 'val' WHEN shape = 13 THEN 'test' ELSE 'holdout' END AS split,
    CASE WHEN turn < 4 THEN 'repair' WHEN turn < 8 THEN 'detect' ELSE 'repo_patch' END AS task, turn < 6 OR turn > 7 AS v
  FROM (SELECT p_partkey AS idx, p_partkey % 15 AS shape, p_partkey % 750 // 15 AS spec, p_partkey // 750 % 10 AS turn FROM part))"""
#: Specs whose repair changes constants only, so that clean and vulnerable code have one structure.
_CONSTANTS_ONLY = ", ".join(str(i) for i, s in enumerate(builder.SPECS) if s[1] in ("cleartext_http_transport", "insecure_file_permissions", "celery_pickle_serializer"))
_SPEC_ROWS = "spec AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s[0]}', '{s[2]}')" for i, s in enumerate(builder.SPECS)) + ") t(spec, cwe, ecosystem))"


def _tree_sql(levels: int) -> str:
    """SQL of stats.typed_replicates: draws of s0 (b, node, n) down a tree over o (i, c), level by level."""
    steps = []
    for level in range(levels):
        down = levels - level - 1
        heap = f"({1 << level} + s.node)"
        steps.append(
            f"""h{level} AS (SELECT i >> {down + 1} AS node, sum(CASE WHEN (i >> {down}) % 2 = 0 THEN c ELSE 0 END)::DOUBLE / sum(c) AS p FROM o GROUP BY 1),
  w{level} AS (SELECT s.b, s.node, s.n, h.p, {uniform_sql(heap).replace("|| b ||", "|| s.b ||")} AS u FROM s{level} s JOIN h{level} h USING (node)), {binomial_sql(f"w{level}", f"d{level}", "got")},
  s{level + 1} AS (SELECT b, node * 2 AS node, got AS n FROM d{level} WHERE got > 0 UNION ALL SELECT b, node * 2 + 1, n - got FROM d{level} WHERE n > got)"""
        )
    return ", ".join(steps)


def oracle_sql() -> dict[str, str]:
    runs = "runs AS (SELECT doc_id AS i, quality = 0 AS v FROM labels)"
    z = stats.Z95
    samples = """s AS (SELECT doc_id, j, doc_id * 7 + j * 3 AS x FROM labels, range(5) r(j)),
  n AS (SELECT doc_id, doc_id % 20 = 0 AS gap, x % 4 <> 0 AS comp, doc_id % 10 <> 0 AND x % 3 = 0 AS f, doc_id % 10 <> 0 AND x % 6 = 0 AS sf,
    CASE WHEN doc_id % 10 = 0 THEN false ELSE x % 6 = 0 END AS vul FROM s)"""
    p = lambda c, k: "1 - " + " * ".join(f"((n - {c} - {i})::DOUBLE / (n - {i}))" for i in range(k))
    return {
        "corpus_build": f"WITH {_RECORDS} SELECT split, task, count(*) AS n, count(*) FILTER (v) AS n_vulnerable, count(*) AS ids FROM r GROUP BY 1, 2",
        "corpus_statistics": f"""WITH {_RECORDS}, {_SPEC_ROWS}, j AS (SELECT * FROM r JOIN spec USING (spec))
SELECT split, cwe, task, ecosystem, count(*) AS n, count(*) FILTER (v) AS n_vulnerable, count(DISTINCT idx % 750) AS families FROM j
GROUP BY GROUPING SETS ((split), (cwe), (split, cwe), (task), (split, task), (ecosystem))""",
        "corpus_gate": f"""WITH {_RECORDS}, f AS (SELECT idx % 750 AS family, count(DISTINCT split) AS splits FROM r GROUP BY 1)
SELECT count(*) FILTER (splits > 1) AS shared_family, count(*) FILTER (splits > 1) AS shared_pair, count(*) FILTER (splits > 1) AS shared_structure, count(*) FILTER (splits > 1) = 0 AS passed FROM f""",
        "corpus_gate_planted": f"""WITH {_RECORDS}, p AS (SELECT * FROM r WHERE idx % 40 = 3 AND split <> 'holdout')
SELECT count(DISTINCT idx % 750) AS shared_family, count(*) AS shared_pair, count(DISTINCT (spec, CASE WHEN shape = 4 THEN 2 ELSE shape END, v OR spec IN ({_CONSTANTS_ONLY}))) AS shared_structure, count(*) = 0 AS passed FROM p""",
        "corpus_records": f"""WITH {_RECORDS} SELECT task, v AS is_vulnerable, count(*) AS n, count(*) AS parsed, count(*) AS controlled, count(*) FILTER (v) AS round_trips, count(*) AS answered, count(*) AS asked,
  count(*) FILTER (task <> 'repo_patch') AS analysis, count(*) FILTER (task = 'repo_patch') AS patching FROM r GROUP BY 1, 2""",
        "corpus_self_check": f"""WITH {_RECORDS}, n AS (SELECT count(*) FILTER (idx % 7 = 0) AS a, count(*) FILTER (idx % 19 = 0) AS b, count(*) FILTER (v AND idx % 11 = 0) AS c,
  count(*) FILTER (NOT v AND (idx % 7 = 0 OR idx % 19 = 0)) AS d, count(*) FILTER (idx % 13 = 0) AS e, count(*) FILTER (idx % 17 = 0) AS f FROM r)
SELECT 0 AS ord, 'parses' AS rule, a AS n FROM n UNION ALL SELECT 1, 'control', b FROM n UNION ALL SELECT 2, 'round_trip', c FROM n UNION ALL SELECT 3, 'lines', d FROM n
UNION ALL SELECT 4, 'target', e FROM n UNION ALL SELECT 5, 'roles', f FROM n""",
        "analysis_rubric": f"""WITH {_RECORDS}, k AS (SELECT v, idx % 10 <> 0 AS ok, v AND idx % 10 = 1 AS long FROM r)
SELECT count(*) AS rows, count(*) FILTER (v AND ok) AS tp, count(*) FILTER (NOT v AND ok) AS tn, count(*) FILTER (NOT v AND NOT ok) AS fp, count(*) FILTER (v AND NOT ok) AS fn,
  round(avg(ok::INT), 6) AS valid_rate, round(avg(ok::INT) FILTER (v), 6) AS exact_rate, round(avg(ok::INT) FILTER (v), 6) AS control_rate, round(avg(ok::INT) FILTER (v), 6) AS test_rate,
  round(avg(ok::INT), 6) AS safe_rate, round(avg(long::INT), 6) AS overpatch_rate, round(coalesce(avg(ok::INT) FILTER (NOT v), 0.0), 6) AS preserved_rate, round(avg(ok::INT) FILTER (v), 6) AS line_f1 FROM k""",
        "patch_rubric": f"""WITH {_RECORDS}, n AS (SELECT count(*) AS a, count(*) FILTER (idx % 10 <> 0) AS b FROM r WHERE v)
SELECT a AS schema_valid, a AS finding_id_exact, b AS relevant_file_only, b AS patch_applies, b AS patched_code_exact, b AS security_control_pass, b AS no_dangerous_regression FROM n""",
        "suite_summary": f"""WITH {runs}, c AS (SELECT count(*) AS records, count(*) FILTER (v) AS vulnerable, count(*) FILTER (NOT v) AS clean, count(*) FILTER (v AND i % 3 <> 0) AS tp, count(*) FILTER (v AND i % 3 = 0) AS fn,
  count(*) FILTER (NOT v AND i % 11 = 0) AS fp, count(*) FILTER (NOT v AND i % 11 <> 0) AS tn, count(*) FILTER (v AND i % 7 = 0) AS repaired, count(*) FILTER (NOT v AND i % 5 <> 0) AS preserved,
  list_sort(list(i % 23) FILTER (v AND i % 2 = 0)) AS l FROM runs), p AS (SELECT *, repaired::DOUBLE / vulnerable AS p FROM c)
SELECT records, vulnerable, clean, tp, fn, fp, tn, repaired, preserved, l[1 + len(l) // 2] AS median_changed_lines, round(2.0 * tp / (2 * tp + fp + fn), 9) AS detection_f1,
  round((p + {z * z} / (2 * vulnerable) - {z} * sqrt(p * (1 - p) / vulnerable + {z * z} / (4.0 * vulnerable * vulnerable))) / (1 + {z * z} / vulnerable), 9) AS repair_low,
  round((p + {z * z} / (2 * vulnerable) + {z} * sqrt(p * (1 - p) / vulnerable + {z * z} / (4.0 * vulnerable * vulnerable))) / (1 + {z * z} / vulnerable), 9) AS repair_high FROM p""",
        "suite_compare": f"""WITH {runs}, m AS (SELECT (i % 3 = 0)::INT - (i % 7 = 0)::INT AS d FROM runs WHERE v),
  c AS (SELECT count(*) AS cases, count(*) FILTER (d < 0) AS base_only, count(*) FILTER (d > 0) AS other_only, avg(d) AS effect FROM m),
  w1 AS (SELECT b, cases, base_only AS all_base, other_only, cases AS n, base_only::DOUBLE / cases AS p, {uniform_sql(0)} AS u FROM c, range(200) x(b)), {binomial_sql("w1", "d1", "lost")},
  w2 AS (SELECT b, cases, lost, cases - lost AS n, least(1.0, coalesce(other_only::DOUBLE / nullif(cases - all_base, 0), 0.0)) AS p, {uniform_sql(1)} AS u FROM d1), {binomial_sql("w2", "d2", "won")},
  l AS (SELECT list_sort(list((won - lost)::DOUBLE / cases)) AS e FROM d2),
  q AS (SELECT exp(lgamma(base_only + other_only + 1) - lgamma(i + 1) - lgamma(base_only + other_only - i + 1) - (base_only + other_only - 1) * ln(2.0::DOUBLE)) AS x FROM c, range((SELECT least(base_only, other_only) + 1 FROM c)) r(i))
SELECT cases, base_only, other_only, round(effect, 9) AS effect, round(e[1 + floor(0.025 * 199)::INT], 9) AS lower_95, round(e[1 + floor(0.975 * 199)::INT], 9) AS upper_95, round(least(1.0, (SELECT sum(x) FROM q)), 8) AS p FROM c, l""",
        "sample_scores": f"""WITH {samples}, g AS (SELECT doc_id, count(*) FILTER (NOT gap) AS n, count(*) AS a, count(*) FILTER (NOT gap AND comp) AS comp, count(*) FILTER (NOT gap AND f) AS f, count(*) FILTER (NOT gap AND sf) AS sf,
  count(*) FILTER (NOT gap AND vul) AS vul FROM n GROUP BY 1), m AS (SELECT count(*) AS prompts, count(*) FILTER (n > 0) AS scored_prompts, sum(n)::BIGINT AS scored, sum(a)::BIGINT AS samples, sum(comp) AS comp, sum(f) AS fs,
  avg({p('f', 1)}) FILTER (n > 0) AS p1, avg({p('f', 3)}) FILTER (n > 0) AS p3, avg({p('f', 5)}) FILTER (n > 0) AS p5, avg({p('sf', 1)}) FILTER (n > 0) AS s1, avg({p('vul', 3)}) FILTER (n > 0) AS v3 FROM g)
SELECT prompts, scored_prompts, scored, samples, round(fs / scored, 9) AS functional_rate, round(comp / scored, 9) AS compilable_rate, round(p1, 9) AS pass_at_1, round(p3, 9) AS pass_at_3, round(p5, 9) AS pass_at_5,
  round(s1, 9) AS secure_pass_at_1, round(v3, 9) AS vulnerable_at_3, round(p3 * scored_prompts / prompts, 9) AS pass_at_3_low, round((p3 * scored_prompts + prompts - scored_prompts) / prompts, 9) AS pass_at_3_high FROM m""",
        "sample_bootstrap": f"""WITH {samples}, g AS (SELECT doc_id AS id, count(*) AS n, count(*) FILTER (f) AS k FROM n WHERE NOT gap GROUP BY 1),
  o AS (SELECT *, row_number() OVER (ORDER BY n, k) - 1 AS i FROM (SELECT n, k, count(*) AS c FROM g GROUP BY 1, 2)),
  s0 AS (SELECT b, 0 AS node, (SELECT sum(c)::BIGINT FROM o) AS n FROM range(100) x(b)), {_tree_sql(stats.LEVELS)},
  l AS (SELECT list_sort(list(r)) AS r FROM (SELECT b, sum(d.n * o.k) / sum(d.n * o.n) AS r FROM s{stats.LEVELS} d JOIN o ON d.node = o.i GROUP BY b))
SELECT round(r[1 + floor(0.025 * 99)::INT], 9) AS lower_95, round(r[1 + floor(0.975 * 99)::INT], 9) AS upper_95 FROM l""",
        "static_rollup": """WITH f AS (SELECT printf('p%03d/s%02d_code.py', p_partkey % 25, p_partkey // 25) AS path, printf('CWE-%03d', p_size) AS cwe, p_partkey FROM part),
  x AS (SELECT l_partkey, 'r' || l_linenumber AS rule, printf('CWE-%03d', l_quantity::INT) AS cwe FROM lineitem)
SELECT path, count(rule) AS findings, count(*) FILTER (x.cwe = f.cwe) AS direct_findings, count(rule) - count(*) FILTER (x.cwe = f.cwe) AS indirect_findings, count(rule) = 0 AS finding_free,
  coalesce(array_to_string(list_sort(list(DISTINCT rule) FILTER (rule IS NOT NULL)), ','), '') AS rules FROM f LEFT JOIN x ON l_partkey = p_partkey GROUP BY path""",
        "changed_files": """SELECT concat_ws('/', source, doc_id // 100) AS case, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS changed_paths FROM documents WHERE doc_id % 9 = 4 OR doc_id % 8 = 1 GROUP BY 1""",
        "suite_contamination": r"""WITH d AS (SELECT doc_id AS id, source || '/' || doc_id % 331 AS family, regexp_replace(text, '\s+', '', 'g') AS h, doc_id % 10 = 0 AS c FROM documents WHERE text IS NOT NULL), t AS (SELECT * FROM d WHERE NOT c)
SELECT id, 'code' AS by FROM d WHERE c AND h IN (SELECT h FROM t) UNION ALL SELECT id, 'family' FROM d WHERE c AND family IN (SELECT family FROM t)""",
        "strict_totals": """WITH t AS (SELECT source AS repo, quality = 0 AS v, doc_id % 2 = 0 AS s FROM labels JOIN documents USING (doc_id)), m AS (SELECT *, repo NOT LIKE '%7' AS seen FROM t),
  c AS (SELECT count(*) FILTER (seen AND v AND s) AS tp, count(*) FILTER (seen AND NOT v AND s) AS fp, count(*) FILTER (v AND NOT (seen AND s)) AS fn, count(*) FILTER (NOT v AND NOT (seen AND s)) AS tn FROM m),
  p AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r FROM c)
SELECT tp, fp, fn, tn, round(p, 9) AS precision, round(r, 9) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1, round(coalesce(5 * p * r / nullif(4 * p + r, 0), 0), 9) AS f2, round(coalesce(10 * p * r / nullif(9 * p + r, 0), 0), 9) AS f3 FROM p""",
        "model_audit": """WITH m AS (SELECT n_name, n_nationkey AS n, n_nationkey % 4 IN (0, 2) AS apache, n_nationkey % 3 = 0 AS hit FROM nation),
  s AS (SELECT CASE WHEN n = 5 OR n % 7 = 0 THEN 'skipped' WHEN apache AND NOT hit AND n_name IN ('NATION_4', 'NATION_8', 'NATION_12') THEN 'train_allowed' WHEN NOT apache AND (hit OR n % 4 = 1) THEN 'baseline_only' WHEN apache THEN 'baseline_only' ELSE 'unknown' END AS status FROM m)
SELECT ord, v.status, count(s.status) AS n FROM (VALUES (0, 'train_allowed'), (1, 'baseline_only'), (2, 'skipped'), (3, 'unknown')) v(ord, status) LEFT JOIN s USING (status) GROUP BY 1, 2""",
        "draws": "SELECT p_partkey, CAST(('0x' || substr(md5('9:' || p_partkey), 1, 15)) AS BIGINT) AS draw FROM part",
    }
