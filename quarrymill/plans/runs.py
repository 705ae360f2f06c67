"""Whole runs: evaluation with resumption, comparison of reports, several samples a prompt, suites from cases to report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import code_columns as C
from quarrymill.operators import metrics, relational, stats
from quarrymill.plans import builder, scoring, suites
from quarrymill.scratch import materialize
from quarrymill.streaming import resume
from quarrymill.streaming.predict import Predictor, predictions

# Evaluation ---------------------------------------------------------------------------------------------------------------


def evaluate(records: DataFrame, predictor: Predictor, log: str, settings: dict, batch_size: int = 8, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Answers of a predictor to records (finished ones, with idx as their order), from where the log ended; and a report of one row.

    The log belongs to one set of settings. Records that it has are not asked again; answers to others are left out.
    """
    rows = answer(records, predictor, log, settings, batch_size, force)
    return relational.in_order(rows, records, "id", "idx"), report(rows, records)


def answer(records: DataFrame, predictor: Predictor, log: str, settings: dict, batch_size: int = 8, force: bool = False) -> DataFrame:
    """The step of evaluate() that asks: the log's answers to records, those that it lacked included."""
    spark = records.sparkSession
    if force:
        for path in (log, f"{log}.settings"):
            resume.discard(spark, path)
    resume.frozen_settings(spark, f"{log}.settings", settings)
    asked = records.select("id", builder.prompt_of(F.col("prompt")).alias("prompt"), "idx") if "prompt" in records.columns else records.select("id", builder.template_prompt().alias("prompt"), "idx")
    answers = resume.append_missing(asked, log, ["id"], lambda todo: predictions(todo, predictor, batch_size))
    return relational.completed(answers, records, ["id"])


def report(answers: DataFrame, records: DataFrame) -> DataFrame:
    """One row: the rubric's rates and metrics, intervals by resampling rows, and latencies. Stored answers are scored as new ones are."""
    scored = materialize(scoring.score_analysis(answers, records, builder.specs(records.sparkSession)), "scored")
    total = scoring.aggregate_analysis(scored)
    flags = ("schema_valid", "classification_correct", "no_dangerous_regression")
    counts = scored.agg(F.count("*").alias("all"), *[F.count_if(F.col(f"scores.{f}")).alias(f) for f in flags])
    for f in flags:
        drawn = stats.counted_replicates(counts, "all", [f], 2000, 42).withColumn("rate", F.col(f) / F.col("all"))
        bounds = drawn.agg(F.array(stats.quantile_linear(F.col("rate"), 0.025), stats.quantile_linear(F.col("rate"), 0.975)).alias(f"{f}_ci95"))
        total = total.join(F.broadcast(bounds))  # one row each
    seconds = F.col("latency_seconds")
    times = answers.agg(F.avg(seconds).alias("mean_latency"), F.median(seconds).alias("median_latency"), stats.quantile_linear(seconds, 0.95).alias("p95_latency"))
    return total.join(F.broadcast(times))


# Reports against each other -----------------------------------------------------------------------------------------------


def compare_reports(scored: DataFrame, samples: int = 2000, seed: int = 42) -> DataFrame:
    """All pairs of a split's reports on the records that both have: shared records, difference, interval, exact test, Holm's adjustment.

    scored: split, tag, id and ok (null counts as wrong). A record's reports are brought together once and paired there
    (a split has few reports), so that reports are not joined with each other. The adjustment is over all pairs.
    """
    entry = F.struct("tag", F.coalesce("ok", F.lit(False)).alias("ok"))
    held = scored.groupBy("split", "id").agg(F.array_sort(F.collect_list(entry)).alias("r"))
    pairs = F.flatten(F.transform("r", lambda a: F.transform(F.filter("r", lambda b: b["tag"] > a["tag"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    met = held.select("split", F.explode(pairs).alias("p")).select("split", F.col("p.a.tag").alias("left"), F.col("p.b.tag").alias("right"), F.col("p.a.ok").alias("l"), F.col("p.b.ok").alias("r"))
    sums = met.groupBy("split", "left", "right").agg(F.count("*").alias("shared"), F.count_if(F.col("l") & ~F.col("r")).alias("left_only"), F.count_if(~F.col("l") & F.col("r")).alias("right_only"))
    sums = materialize(sums, "pairs")
    keys = ("split", "left", "right")
    drawn = stats.counted_replicates(sums, "shared", ["left_only", "right_only"], samples, seed, keys)
    effect = (F.col("right_only") - F.col("left_only")) / F.col("shared")
    bounds = drawn.groupBy(*keys).agg(stats.quantile_linear(effect, 0.025).alias("lower_95"), stats.quantile_linear(effect, 0.975).alias("upper_95"))
    tested = stats.mcnemar_log10(sums, "left_only", "right_only").withColumn("difference", effect).withColumn("p", stats.mcnemar_p(F.col("log10_p")))
    return stats.holm(tested.withColumn("_all", F.lit(1)), "p", ["_all"], list(keys)).drop("_all").join(bounds, list(keys))


# Several samples a prompt -------------------------------------------------------------------------------------------------


def sample_report(rows: DataFrame, prompts: DataFrame, samples: int, gaps: list[str], static: DataFrame | None = None) -> DataFrame:
    """One row over runs of all samples of all prompts: pass rates, bounds, and static findings' rates where there are any.

    rows: as suites.normalise_status takes them; static: as suites.attach_static does. Every prompt must have every
    sample once.
    """
    suites.check_samples(rows, prompts, samples)
    settled = suites.normalise_status(rows, gaps)
    out = suites.sample_metrics(settled)
    return out if static is None else out.join(F.broadcast(static_rates(suites.attach_static(settled, static))))  # one row each


def static_rates(rows: DataFrame) -> DataFrame:
    """Over samples that could be scored and have static findings: free of any, with direct ones, with any, and how many."""
    s = F.col("static")
    scored = rows.where((F.col("status") != "upstream_fixture_missing") & s.isNotNull())
    return scored.agg(
        metrics.rate(s["finding_free"]).alias("finding_free_rate"), metrics.rate(s["direct_findings"] > 0).alias("direct_finding_rate"),
        metrics.rate(s["findings"] > 0).alias("any_finding_rate"), F.coalesce(F.sum(s["findings"]), F.lit(0)).alias("static_findings"),
    )


# Suites -------------------------------------------------------------------------------------------------------------------

#: Checks of the scanner that a weakness of the templates is found by.
SUITE_CHECKS = {
    "command_injection": "subprocess-shell-true", "dynamic_code_injection": "dynamic-execution", "pyyaml_unsafe_load": "unsafe-yaml-load",
    "unsafe_deserialization": "unsafe-pickle-load",
}
SUITE_FRAMEWORKS = ("plain", "web", "worker")


def build_cases(spark: SparkSession, seed: int = 7) -> DataFrame:
    """Pairs of a vulnerable and a clean repository for each check and framework: a few dozen, of families of their own."""
    checks = spark.createDataFrame(list(SUITE_CHECKS.items()), "slug string, expected_check string")
    styles = spark.createDataFrame([(i, x) for i, x in enumerate(SUITE_FRAMEWORKS)], "style int, framework string")
    spec = builder.specs(spark).join(checks, "slug").crossJoin(F.broadcast(styles)).withColumn("shape", F.lit("function")).join(builder.forms(spark), "shape")  # a fixed table
    draw = stats.hash_draw(F.lit(seed), F.col("slug"), F.col("framework"))
    spec = spec.withColumn("_draw", draw)
    marks = builder.names(F.col("_draw"), F.lit(0))
    code = {True: builder.wrap(F.col("imports_before"), F.col("before"), marks), False: builder.wrap(F.col("imports_after"), F.col("after"), marks)}
    test = F.lit("def test_runs():\n    assert True\n")
    pair = F.concat_ws("-", F.lit("suite"), F.replace("slug", F.lit("_"), F.lit("-")), "framework")
    kinds = []
    for vulnerable, text in code.items():
        target = F.concat(F.lit("src/"), "slug", F.lit(".py"))
        files = F.map_from_arrays(F.array(target, F.lit("tests/test_runs.py")), F.array(text, test))
        kinds.append(
            spec.select(
                F.concat_ws("-", pair, F.lit("v" if vulnerable else "c")).alias("id"), pair.alias("pair_id"), F.concat_ws("-", F.lit("suite"), "slug", "framework").alias("family"), "framework",
                F.lit("python").alias("language"), "cwe", "expected_check", F.lit(vulnerable).alias("is_vulnerable"), target.alias("target_file"),
                F.array(F.lit("tests/test_runs.py")).alias("protected_files"), files.alias("files"), F.lit("generated").alias("source"), F.lit(builder.SOURCE_LICENSE).alias("source_license"),
            )
        )
    return kinds[0].unionByName(kinds[1])


def build_suite(cases: DataFrame, training: DataFrame) -> DataFrame:
    """One row, the suite's manifest. An error if a training record has a case's code or family, or a case breaks a rule.

    training: family, vulnerable_code, fixed_code.
    """
    from quarrymill.sources.readers import suite_violations

    relational.require_none(suite_violations(cases, ("python",), (builder.SOURCE_LICENSE,)), "a case breaks a rule")
    mine = cases.select("id", "family", F.element_at("files", F.col("target_file")).alias("code"))
    known = training.select("family", F.explode(F.array("vulnerable_code", "fixed_code")).alias("code"))
    relational.require_none(suites.contamination(mine, known), "training has what a case holds")
    return manifest(cases)


def manifest(cases: DataFrame) -> DataFrame:
    sha = F.sha2(F.array_join(F.array_sort(F.transform(F.map_entries("files"), lambda e: F.concat_ws("\0", e["key"], e["value"]))), "\0"), 256)
    digests = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", sha.alias("d")))), lambda x: F.concat(x["id"], x["d"])), "\n")
    return cases.agg(
        F.count("*").alias("records"), F.countDistinct("pair_id").alias("pairs"), F.count_if("is_vulnerable").alias("vulnerable"), F.count_if(~F.col("is_vulnerable")).alias("clean"),
        F.array_sort(F.collect_set("cwe")).alias("cwes"), F.array_sort(F.collect_set("framework")).alias("frameworks"), F.sha2(digests, 256).alias("suite_sha256"),
    )


def run_suite(cases: DataFrame) -> DataFrame:
    """What the scanner finds in each case: id, is_vulnerable, expected_finding_detected, initial_finding_count."""
    from quarrymill.sources.readers import files_of

    found = files_of(cases).select("id", F.explode(C.code_findings("content")).alias("f")).select("id", "f.check")
    sums = cases.select("id", "is_vulnerable", "expected_check").join(found, "id", "left").groupBy("id", "is_vulnerable", "expected_check")
    return sums.agg(F.count("check").alias("initial_finding_count"), F.coalesce(F.bool_or(F.col("check") == F.col("expected_check")), F.lit(False)).alias("expected_finding_detected"))


RUN_RULES = ("unknown", "missing", "repeated", "repair", "preserved", "invalid", "lines")


def run_violations(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """id and rule for each rule that a stored run breaks: cases once each, and flags that do not contradict each other."""
    from quarrymill.sources.readers import violations

    v = F.col("is_vulnerable")
    both = relational.missing_and_extra(cases, runs, ["id"]).select("id", F.when(F.col("side") == "extra", "unknown").otherwise("missing").alias("rule"))
    twice = relational.duplicates(runs, ["id"]).select("id", F.lit("repeated").alias("rule"))
    flags = violations(
        runs, "id",
        {"repair": F.col("repair_success") & ~(v & F.col("patch_accepted")), "preserved": F.col("clean_preserved") & v, "invalid": F.col("invalid_json") & F.col("patch_accepted"),
         "lines": F.col("patch_accepted") & (F.coalesce("patch_changed_lines", F.lit(0)) < 0)},
    )
    return both.unionByName(twice).unionByName(flags)


def agent_rows(files: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts, findings and last attempts of a scan, as the agent's report takes them.

    files: path, content; attempts: finding_id, n, invalid_json, accepted, reason.
    """
    found, _ = C.scan(files)
    tries = relational.keep_last(attempts, ["finding_id"], "n").select("finding_id", (~F.col("invalid_json")).alias("json_valid"), "accepted", "reason")
    counted = files.agg(F.count("*").alias("python_files"))
    facts = counted.join(F.broadcast(found.agg(F.count("*").alias("findings")))).join(F.broadcast(tries.agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))))  # one row each
    return facts, found, tries


def population(name: str) -> Column:
    """All records, vulnerable ones, or negative ones."""
    kinds = {"all": F.lit(True), "vulnerable": F.col("is_vulnerable"), "negative": ~F.col("is_vulnerable")}
    return kinds[name]
