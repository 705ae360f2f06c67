"""Suites of paired repository cases, runs of several samples a prompt, static findings, and audits of sources and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import text as X
from quarrymill.operators import metrics, relational, stats
from quarrymill.scratch import materialize

# What checks are instances of, and terms that restrict a license.
CHECK_CWE = {
    "subprocess-shell-true": "CWE-78", "os-system": "CWE-78", "dynamic-execution": "CWE-94", "unsafe-yaml-load": "CWE-502",
    "unsafe-pickle-load": "CWE-502", "sql-string-format": "CWE-89", "path-traversal-open": "CWE-22", "hardcoded-secret": "CWE-798",
}
RESTRICTIONS = (
    "non-commercial", "noncommercial", "research use only", "acceptable use policy", "additional restrictions", "custom license", "responsible ai license",
)

# Repository suites ------------------------------------------------------------------------------------------------------------


def outcomes(runs: DataFrame) -> DataFrame:
    """runs with repair_success and clean_preserved: conjunctions in which anything unknown is false.

    runs: is_vulnerable, initial_match, accepted, final_match, tests_passed, changed_paths, target_file, protected_unchanged, finding_count.
    """
    c = F.col
    only = c("changed_paths").eqNullSafe(F.array(c("target_file")))
    repaired = relational.conjunction(c("is_vulnerable"), c("initial_match"), c("accepted"), ~c("final_match"), c("tests_passed"), only, c("protected_unchanged"))
    kept = relational.conjunction(~c("is_vulnerable"), ~c("initial_match"), c("finding_count") == 0, F.size("changed_paths") == 0, c("tests_passed"), c("protected_unchanged"))
    return runs.withColumn("repair_success", repaired).withColumn("clean_preserved", kept)


def summarize(runs: DataFrame) -> DataFrame:
    """One row for a suite's run. runs: F7's columns as they are stored."""
    v = F.col("is_vulnerable")
    part = lambda flag: metrics.rate(F.when(v, flag))
    counted = runs.withColumn("_changed", F.when(v, F.col("patch_changed_lines"))).agg(
        F.count("*").alias("records"), F.count_if(v).alias("vulnerable"), F.count_if(~v).alias("clean"),
        F.count_if(v & F.col("expected_finding_detected")).alias("tp"), F.count_if(v & ~F.col("expected_finding_detected")).alias("fn"),
        F.count_if(~v & (F.col("initial_finding_count") > 0)).alias("fp"), F.count_if(~v & (F.coalesce("initial_finding_count", F.lit(0)) == 0)).alias("tn"),
        part(~F.col("invalid_json")).alias("strict_json_rate"), part(F.col("patch_accepted")).alias("patch_acceptance_rate"), part(F.col("repair_success")).alias("repair_rate"),
        F.count_if(v & F.col("repair_success")).alias("repaired"), F.count_if(~v & F.col("clean_preserved")).alias("preserved"),
        metrics.rate(F.when(~v, F.col("clean_preserved"))).alias("preservation_rate"), F.coalesce(F.sum(F.size("unrelated_file_rewrites")), F.lit(0)).alias("unrelated_rewrites"),
        F.count_if(F.coalesce("bandit_delta", F.lit(0)) > 0).alias("regressions"), stats.upper_median("_changed").alias("median_changed_lines"),
        F.sum("runtime_seconds").alias("runtime_seconds"), F.max("peak_gpu_memory_bytes").alias("peak_memory_bytes"),
    )
    p, r = metrics.ratio(F.col("tp"), F.col("tp") + F.col("fp")), metrics.ratio(F.col("tp"), F.col("vulnerable"))
    interval = lambda k, n: F.array(*stats.wilson(F.col(k), F.col(n)))
    return counted.withColumns(
        {"detection_precision": p, "detection_recall": r, "detection_f1": stats.f_beta(p, r, 1.0), "false_positive_rate": metrics.ratio(F.col("fp"), F.col("clean")),
         "recall_ci95": interval("tp", "vulnerable"), "repair_ci95": interval("repaired", "vulnerable"), "preservation_ci95": interval("preserved", "clean")}
    )


def compare_suites(base: DataFrame, other: DataFrame, samples: int = 10_000, seed: int = 42) -> DataFrame:
    """Paired vulnerable cases of two runs: rates, effect, its interval (elements at int(q (n - 1))), and the exact test.

    A case's difference is -1, 0 or 1, so cases are resampled by how many there are of each.
    """
    relational.require_none(relational.missing_and_extra(base, other, ["id"]), "runs have different cases")
    side = lambda runs, name: runs.where("is_vulnerable").select("id", F.col("repair_success").cast("int").alias(name))
    met = side(base, "b").join(side(other, "o"), "id").withColumn("d", F.col("o") - F.col("b"))
    sums = met.agg(F.count("*").alias("cases"), F.avg("b").alias("base_rate"), F.avg("o").alias("other_rate"), F.avg("d").alias("effect"), F.count_if(F.col("d") < 0).alias("base_only"), F.count_if(F.col("d") > 0).alias("other_only"))
    sums = materialize(sums, "paired")
    drawn = stats.counted_replicates(sums, "cases", ["base_only", "other_only"], samples, seed)
    effect = (F.col("other_only") - F.col("base_only")) / F.col("cases")
    interval = drawn.agg(stats.quantile_floor_last(effect, 0.025).alias("lower_95"), stats.quantile_floor_last(effect, 0.975).alias("upper_95"))
    tested = stats.mcnemar_log10(sums, "base_only", "other_only")
    return tested.withColumn("p", stats.mcnemar_p(F.col("log10_p"))).join(F.broadcast(interval))  # one row each


def contamination(cases: DataFrame, training: DataFrame) -> DataFrame:
    """Cases whose code (without white space) or family a training record has. cases: id, family, code; training: family, code."""
    digest = lambda c: F.sha2(X.without_space(c), 256)
    same_code = cases.withColumn("h", digest(F.col("code"))).join(training.select(digest(F.col("code")).alias("h")), "h", "left_semi").select("id", F.lit("code").alias("by"))
    same_family = cases.join(training.select("family"), "family", "left_semi").select("id", F.lit("family").alias("by"))
    return same_code.unionByName(same_family)


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """case and paths that changed, from two inventories (case, path, sha256)."""
    key = lambda d: d.select(F.struct("case", "path").alias("key"), "sha256")
    return relational.changed(key(before), key(after), "key", "sha256").select("key.case", "key.path").groupBy("case").agg(F.array_sort(F.collect_list("path")).alias("changed_paths"))


# Several samples a prompt -----------------------------------------------------------------------------------------------------


def normalise_status(rows: DataFrame, gaps: list[str] | Column) -> DataFrame:
    """Rows whose run was not completed, by cause: the benchmark's own gap, an answer that broke before a result, or infrastructure.

    gaps: ids of prompts that the benchmark cannot build, or a condition that tells them.
    """
    error, done = F.coalesce("error", F.lit("")), F.col("status") == "complete"
    listed = gaps if isinstance(gaps, Column) else F.col("id").isin(*gaps) if gaps else F.lit(False)
    gap = ~done & listed & error.startswith("docker build exited")
    broke = ~done & ~gap & error.endswith("test result CSV was not produced.")
    status = F.when(done | broke, "complete").when(gap, "upstream_fixture_missing").otherwise("infrastructure")
    result = F.when(broke, F.when(F.col("compilable"), "error").otherwise("SyntaxError"))
    # what rests on the old status is settled before the new one takes its place
    out = rows.withColumns({"_broke": broke, "_result": result, "_status": status}).withColumn("status", F.col("_status"))
    broke, result = F.col("_broke"), F.col("_result")
    for c in ("test_correctness", "test_vulnerability"):
        out = out.withColumn(c, F.coalesce(result, F.col(c)))
    for c in ("functional_pass", "security_test_pass", "secure_functional_pass"):
        out = out.withColumn(c, F.when(broke, F.lit(False)).otherwise(F.coalesce(c, F.lit(False))))
    return out.drop("_broke", "_result", "_status")


def check_samples(rows: DataFrame, prompts: DataFrame, samples: int) -> None:
    """Every prompt has every sample once, and there is no other."""
    relational.require_none(relational.duplicates(rows, ["id", "sample_index"]), "repeated samples")
    wanted = prompts.select("id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample_index"))
    relational.require_none(relational.missing_and_extra(wanted, rows, ["id", "sample_index"]), "samples are missing or unknown")


def sample_metrics(rows: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row of rates, pass@k and bounds over rows with normalised status; gaps count in bounds only.

    Prompts are summed up first; bounds take missing samples as all failed and as all passed.
    """
    scored = F.col("status") != "upstream_fixture_missing"
    flags = ("functional_pass", "security_test_pass", "secure_functional_pass")
    prompt = rows.groupBy("id").agg(
        F.count_if(scored).alias("n"), F.count("*").alias("all"), F.count_if(scored & F.col("compilable")).alias("compiled"),
        *[F.count_if(scored & F.col(f)).alias(f"{f}_n") for f in flags], F.count_if(scored & (F.col("test_vulnerability") == "failure")).alias("vulnerable"),
    )
    at = lambda c, k: F.avg(F.when(F.col("n") > 0, stats.pass_at_k(F.greatest(F.col("n"), F.lit(k)), F.col(c), k)))
    got = prompt.agg(
        F.count("*").alias("prompts"), F.count_if(F.col("n") > 0).alias("scored_prompts"), F.sum("n").alias("scored"), F.sum("all").alias("samples"), F.sum("compiled").alias("n_compiled"),
        *[F.sum(f"{f}_n").alias(f) for f in flags],
        *[at(c, k).alias(f"{name}_{k}") for c, name in (("functional_pass_n", "pass_at"), ("secure_functional_pass_n", "secure_pass_at"), ("vulnerable", "vulnerable_at")) for k in ks],
    )
    rates = {f"{f}_rate": metrics.ratio(F.col(f), F.col("scored")) for f in flags} | {"compilable_rate": metrics.ratio(F.col("n_compiled"), F.col("scored"))}
    bounds = {f"{f}_bounds": F.array(F.col(f) / F.col("samples"), (F.col(f) + F.col("samples") - F.col("scored")) / F.col("samples")) for f in flags}
    missing = F.col("prompts") - F.col("scored_prompts")
    for name in ("pass_at", "secure_pass_at"):
        for k in ks:
            mean = F.coalesce(F.col(f"{name}_{k}"), F.lit(0.0)) * F.col("scored_prompts")
            bounds[f"{name}_{k}_bounds"] = F.array(mean / F.col("prompts"), (mean + missing) / F.col("prompts"))
    return got.withColumns(rates | bounds)


def prompt_bootstrap(rows: DataFrame, flag: str, samples: int = 10_000, seed: int = 42) -> DataFrame:
    """An interval for a rate, prompts drawn with replacement: elements at int(q (B - 1)) of ratios of sums."""
    totals = rows.where("status <> 'upstream_fixture_missing'").groupBy("id").agg(F.count("*").alias("n"), F.count_if(flag).alias("k"))
    ratio = F.col("k") / F.col("n")
    drawn = stats.typed_replicates(totals.groupBy("n", "k").agg(F.count("*").alias("prompts")), "prompts", ["n", "k"], samples, seed)
    return drawn.agg(stats.quantile_floor_last(ratio, 0.025).alias("lower_95"), stats.quantile_floor_last(ratio, 0.975).alias("upper_95"))


def static_rollup(source_map: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per mapped path its findings, direct ones (the rule names the path's own weakness) and rules; and findings that no path has.

    source_map: path, cwe, ord and more; findings: rule, uri, cwes.
    """
    named = findings.withColumn("norm", X.uri_path(F.coalesce("uri", F.lit(""))))
    met = relational.suffix_match(named, "norm", source_map, "path", "ord")
    direct = F.array_contains("cwes", F.col("cwe"))
    known = met.where("path IS NOT NULL").join(source_map.select("path", "cwe"), "path")
    sums = known.groupBy("path").agg(F.count("*").alias("findings"), F.count_if(direct).alias("direct_findings"), F.array_sort(F.collect_set("rule")).alias("rules"))
    out = source_map.join(sums, "path", "left").withColumns({"findings": F.coalesce("findings", F.lit(0)), "direct_findings": F.coalesce("direct_findings", F.lit(0)), "rules": F.coalesce("rules", F.array().cast("array<string>"))})
    out = out.withColumn("indirect_findings", F.col("findings") - F.col("direct_findings")).withColumn("finding_free", F.col("findings") == 0)
    return out, met.where("path IS NULL").drop("path", "norm")


def attach_static(rows: DataFrame, static: DataFrame) -> DataFrame:
    """rows with a nullable struct of their static findings."""
    side = static.select("id", "sample_index", F.struct("findings", "direct_findings", "indirect_findings", "finding_free", "rules").alias("static"))
    return rows.join(side, ["id", "sample_index"], "left")


# Exports and audits -----------------------------------------------------------------------------------------------------------


def export_findings(scanned: DataFrame, other: DataFrame) -> DataFrame:
    """Findings of two scanners in one form; of equal (path, line, cwe) the last one's content at the first one's place.

    scanned: check, severity, file, line, message; other: path, line, cwe, rule, message, severity. Checks without a known weakness are left out.
    """
    spark = scanned.sparkSession
    cwes = F.broadcast(spark.createDataFrame(list(CHECK_CWE.items()), "check string, cwe string"))  # a fixed table
    form = lambda rule: F.struct(F.col("message"), F.col("severity"), F.struct(F.array("cwe").alias("cwe")).alias("metadata")).alias("extra")
    a = scanned.join(cwes, "check").select(F.lit(0).alias("src"), F.col("check").alias("check_id"), X.uri_path(F.col("file"), decode=False).alias("path"), "line", "cwe", form("check"))
    b = other.withColumn("cwe", X.cwe_normalised(F.col("cwe"))).where("cwe IS NOT NULL").select(F.lit(1).alias("src"), F.col("rule").alias("check_id"), X.uri_path(F.col("path"), decode=False).alias("path"), "line", "cwe", form("rule"))
    rows = a.unionByName(b).withColumn("at", F.struct("src", "path", "line", "check_id"))
    return relational.keep_last(rows, ["path", "line", "cwe"], "at").select("check_id", "path", F.struct("line").alias("start"), "cwe", "extra", "first_at").orderBy("first_at").drop("first_at")


def strict_totals(truth: DataFrame, results: DataFrame) -> DataFrame:
    """Totals over repositories; one without results misses all its weaknesses and passes all its traps.

    truth: repo, is_vulnerable; results: repo, tp, fp, fn, tn.
    """
    wanted = truth.groupBy("repo").agg(F.count_if("is_vulnerable").alias("v"), F.count_if(~F.col("is_vulnerable")).alias("t"))
    met = wanted.join(results, "repo", "left")
    none = F.col("tp").isNull()
    sums = met.agg(F.sum(F.coalesce("tp", F.lit(0))).alias("tp"), F.sum(F.coalesce("fp", F.lit(0))).alias("fp"), F.sum(F.when(none, F.col("v")).otherwise(F.col("fn"))).alias("fn"), F.sum(F.when(none, F.col("t")).otherwise(F.col("tn"))).alias("tn"))
    p, r = metrics.ratio(F.col("tp"), F.col("tp") + F.col("fp")), metrics.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    scores = {f"f{b}": stats.f_beta(p, r, float(b)) for b in (1, 2, 3)}
    return sums.withColumns({"precision": p, "recall": r, **scores, "f2_score": F.bround(scores["f2"] * 100, 1), "f3_score": F.bround(scores["f3"] * 100, 1)})


def license_value(card_license: Column, tags: Column) -> Column:
    """The card's license, else the first license: tag."""
    tag = F.get(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.startswith("license:")), F.lit(0))
    return F.coalesce(F.nullif(card_license, F.lit("")), F.substring_index(tag, ":", -1))


def classify_models(models: DataFrame, candidates: list[str]) -> DataFrame:
    """models (model_id, card_license, license_name, license_link, tags, gated, metadata_error, card_text) with status and what led to it."""
    found = models.withColumn("license", license_value(F.col("card_license"), F.col("tags")))
    card = F.coalesce("card_text", F.lit(""))
    apache = F.coalesce(F.col("license").rlike(X.APACHE), card.rlike(X.APACHE))
    hits = X.terms_found(F.concat_ws(" ", "license", card), list(RESTRICTIONS))
    found = found.withColumn("apache", apache).withColumn("restrictions", hits)
    limited = F.size("restrictions") > 0
    custom = ~F.col("apache") & (limited | F.coalesce(F.lower("license").isin("other", "custom"), F.lit(False)) | (F.coalesce("license_name", F.lit("")) != "") | (F.coalesce("license_link", F.lit("")) != ""))
    missing = F.coalesce(F.col("metadata_error") == "http_404", F.lit(False))
    gated = F.coalesce(~F.lower(F.col("gated").cast("string")).isin("false", ""), F.lit(False))
    status = (
        F.when(missing | gated, "skipped").when(F.col("apache") & ~limited & F.col("model_id").isin(*candidates), "train_allowed")
        .when(custom, "baseline_only").when(F.col("apache"), "baseline_only").otherwise("unknown")
    )
    return found.withColumn("status", status).withColumn("train_allowed", status == "train_allowed")


def require_allowed(audited: DataFrame, wanted: list[str]) -> None:
    asked = audited.sparkSession.createDataFrame([(w,) for w in wanted], "model_id string")
    relational.require_none(asked.join(audited.where("train_allowed"), "model_id", "left_anti"), "model is not allowed for training")
