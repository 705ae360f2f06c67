"""Scoring of stored predictions against references: the analysis rubric and the patch rubric, and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import code_columns as C
from quarrymill.functions import text as X
from quarrymill.operators import metrics, stats

# The answers' fields and types.
ANALYSIS_FIELDS = {
    "is_vulnerable": "BOOLEAN", "cwe": "STRING", "vuln_type": "STRING", "vulnerable_lines": "ARRAY<BIGINT>", "explanation": "STRING",
    "fixed_code": "STRING", "patch_summary": "STRING", "safe_test": "STRING",
}
PATCH_FIELDS = {"finding_id": "STRING", "summary": "STRING", "patch": "STRING"}
PATCH_HEADERS = ("--- a/app.py", "+++ b/app.py")


def with_spec(references: DataFrame, specs: DataFrame) -> DataFrame:
    """references with the first spec (by ord) whose slug stands in their family between hyphens.

    A family is cut at its hyphens and met by slug, so that no pair of a family and a spec is tried in vain.
    """
    families = references.select("family").distinct()
    parts = F.array_distinct(F.split("family", "-"))
    inner = F.slice(parts, 1, F.size(parts))
    met = families.select("family", F.explode(inner).alias("slug")).where(F.contains("family", F.concat(F.lit("-"), "slug", F.lit("-")))).join(specs, "slug")
    first = met.groupBy("family").agg(F.min_by(F.struct("forbidden_test_text", "required_test_text"), "ord").alias("spec"))
    return references.join(first, "family", "left")


def control_passes(code: Column, spec: Column) -> Column:
    """Forbidden text absent and required text present, each if the spec names one; false without a spec."""
    absent = F.coalesce(~F.contains(code, spec["forbidden_test_text"]), F.lit(True))
    present = F.coalesce(F.contains(code, spec["required_test_text"]), F.lit(True))
    return spec.isNotNull() & absent & present


def score_analysis(predictions: DataFrame, references: DataFrame, specs: DataFrame) -> DataFrame:
    """id, family, cwe, is_vulnerable, said (null without a valid answer) and scores, of predictions that have a reference.

    Reference-side code features are made once a row; an answer that breaks the schema keeps every default.
    """
    refs = with_spec(references, specs).select(
        "id", "family", "cwe", "is_vulnerable", "vulnerable_code", "fixed_code", "vulnerable_lines", "spec", C.changed_lines("vulnerable_code", "fixed_code").alias("ref_changed"),
        C.code_facts("vulnerable_code").alias("old"), C.code_facts(F.nullif("fixed_code", "vulnerable_code")).alias("_fixed"),
    ).withColumn("fixed", F.when(F.col("fixed_code").eqNullSafe(F.col("vulnerable_code")), F.col("old")).otherwise(F.col("_fixed")))
    value = F.try_parse_json("output")
    get = lambda k, t="string": F.try_variant_get(value, f"$.{k}", t)
    valid = X.has_schema(F.col("output"), ANALYSIS_FIELDS)
    rows = predictions.select("id", "invalid_json", "output").join(refs, "id").withColumns(
        {"valid": valid, "new": F.when(valid, get("fixed_code")), "test": F.when(valid, get("safe_test")), "said": F.when(valid, get("is_vulnerable", "boolean")), "said_cwe": F.when(valid, get("cwe")), "lines": F.when(valid, get("vulnerable_lines", "array<bigint>"))}
    )
    # an answer that is one of the reference's codes has that one's facts
    as_old, as_fixed = F.col("new").eqNullSafe(F.col("vulnerable_code")), F.col("new").eqNullSafe(F.col("fixed_code"))
    other = F.when(~as_old & ~as_fixed, F.col("new"))
    rows = rows.withColumns({"_own": C.code_facts(other), "_lines": C.changed_lines("vulnerable_code", other), "test_parses": C.py_parses("test")})
    facts = F.when(as_old, F.col("old")).when(as_fixed, F.col("fixed")).otherwise(F.col("_own"))
    rows = rows.withColumns({"facts": facts, "changed": F.when(as_old & F.col("new").isNotNull(), F.lit(0)).when(as_fixed, F.col("ref_changed")).otherwise(F.col("_lines"))})
    new = F.col("facts")
    if_valid = lambda c: F.when(F.col("valid"), F.coalesce(c, F.lit(False))).otherwise(F.lit(False))
    kept = new["tokens"].eqNullSafe(F.col("old.tokens"))
    least = F.greatest(F.lit(1), F.col("ref_changed"))
    too_much = F.when(F.col("is_vulnerable"), F.col("changed") > F.greatest(2 * least, least + 5)).otherwise(~kept)
    scores = F.struct(
        (~F.coalesce("invalid_json", F.lit(True))).alias("json_valid"), F.col("valid").alias("schema_valid"),
        if_valid(F.col("said") == F.col("is_vulnerable")).alias("classification_correct"),
        if_valid(F.upper(F.trim("said_cwe")) == F.upper("cwe")).alias("cwe_correct"),
        if_valid(new["parses"]).alias("fixed_code_parseable"), if_valid(F.col("test_parses")).alias("safe_test_parseable"),
        if_valid(new["tokens"] == F.col("fixed.tokens")).alias("fixed_normalized_exact"), if_valid(new["tree"] == F.col("fixed.tree")).alias("fixed_structural_exact"),
        if_valid(new["parses"] & control_passes(F.col("new"), F.col("spec"))).alias("security_control_pass"),
        if_valid(C.no_more_findings(F.col("old.found"), new["found"])).alias("no_dangerous_regression"),
        if_valid(~F.col("is_vulnerable") & kept).alias("negative_preserved"),
        F.when(F.col("valid"), X.line_f1(F.col("vulnerable_lines"), F.col("lines"))).otherwise(F.lit(0.0)).alias("line_f1"),
        F.when(F.col("valid"), F.col("changed")).alias("predicted_changed_lines"), F.col("ref_changed").alias("reference_changed_lines"),
        if_valid(too_much).alias("overpatch"),
    )
    return rows.select("id", "family", "cwe", "is_vulnerable", "said", scores.alias("scores"))


def score_patch(predictions: DataFrame, records: DataFrame, specs: DataFrame) -> DataFrame:
    """id, cwe, family and scores of patch answers. records: id, family, cwe, finding_id, vulnerable_code, fixed_code.

    Each score after the first that fails stays false: a patch for other files is not applied, one that does not apply has no code.
    """
    refs = with_spec(records, specs)
    value = F.try_parse_json("output")
    get = lambda k: F.try_variant_get(value, f"$.{k}", "string")
    valid = X.has_schema(F.col("output"), PATCH_FIELDS)
    rows = predictions.select("id", "invalid_json", "output").join(refs, "id").withColumns({"valid": valid, "said_id": get("finding_id"), "summary": get("summary"), "patch": F.when(valid, get("patch"))})
    heads = F.filter(F.split("patch", r"\r?\n"), lambda x: x.startswith("--- ") | x.startswith("+++ "))
    rows = rows.withColumn("file_ok", F.coalesce(heads == F.array(*map(F.lit, PATCH_HEADERS)), F.lit(False)))
    rows = rows.withColumn("r", C.apply_patch("vulnerable_code", F.when(F.col("file_ok"), F.col("patch")))).withColumn("new", F.when(F.col("r.ok"), F.col("r.text")))
    rows = rows.withColumn("parses", C.py_parses("new")).withColumn("old_found", C.finding_counts("vulnerable_code")).withColumn("new_found", C.finding_counts("new"))
    flag = lambda c, *needs: F.coalesce(c, F.lit(False)) if not needs else F.coalesce(needs[0] & c, F.lit(False))
    parsed = F.col("new").isNotNull() & F.col("parses")
    scores = F.struct(
        (~F.coalesce("invalid_json", F.lit(True))).alias("json_valid"), F.col("valid").alias("schema_valid"),
        flag(F.col("said_id") == F.col("finding_id"), F.col("valid")).alias("finding_id_exact"), flag(F.trim("summary") != "", F.col("valid")).alias("summary_nonempty"),
        F.col("file_ok").alias("relevant_file_only"), F.col("new").isNotNull().alias("patch_applies"), flag(parsed).alias("patched_code_parseable"),
        flag(F.col("new") == F.col("fixed_code"), parsed).alias("patched_code_exact"), flag(control_passes(F.col("new"), F.col("spec")), parsed).alias("security_control_pass"),
        flag(C.no_more_findings(F.col("old_found"), F.col("new_found")), parsed).alias("no_dangerous_regression"),
    )
    return rows.select("id", "family", "cwe", scores.alias("scores"))


def aggregate_analysis(scored: DataFrame) -> DataFrame:
    """All rates and the confusion metrics in one pass: repair rates over vulnerable rows, preservation over clean ones."""
    v = F.col("is_vulnerable")
    every = ("json_valid", "schema_valid", "classification_correct", "cwe_correct", "no_dangerous_regression", "overpatch")
    repair = ("fixed_code_parseable", "safe_test_parseable", "fixed_normalized_exact", "fixed_structural_exact", "security_control_pass")
    counted = scored.agg(
        F.count("*").alias("rows"), *metrics.confusion_counts(v, F.col("said")),
        *[metrics.rate(F.col(f"scores.{c}")).alias(f"{c}_rate") for c in every],
        *[metrics.rate(F.when(v, F.col(f"scores.{c}"))).alias(f"{c}_rate") for c in repair],
        metrics.rate(F.when(~v, F.col("scores.negative_preserved"))).alias("negative_preserved_rate"),
        F.coalesce(F.avg(F.when(v, F.col("scores.line_f1"))), F.lit(0.0)).alias("line_f1_mean"),
    )
    return metrics.confusion_rates(counted)


def per_cwe(scored: DataFrame) -> DataFrame:
    v = F.col("is_vulnerable")
    return scored.groupBy("cwe").agg(
        F.count("*").alias("rows"), metrics.rate(F.col("scores.classification_correct")).alias("classification_rate"),
        metrics.rate(F.when(v, F.col("scores.security_control_pass"))).alias("control_rate"), metrics.rate(F.when(v, F.col("scores.fixed_structural_exact"))).alias("exact_rate"),
    )


def paired_compare(base: DataFrame, final: DataFrame, records: DataFrame, metric: str, population: Column, samples: int = 10_000, seed: int = 42) -> DataFrame:
    """One row: rates of both sides, their difference with a family-cluster interval, and the exact paired test.

    base, final: id and scores; both must have every record of the population and no other.
    """
    wanted = records.where(population).select("id", "family")
    take = lambda side, name: side.select("id", F.col(f"scores.{metric}").cast("double").alias(name))
    met = wanted.join(take(base, "b"), "id", "left").join(take(final, "f"), "id", "left")
    totals = met.groupBy("family").agg(
        F.count("*").alias("n"), F.sum("b").alias("b"), F.sum("f").alias("f"), F.count_if(F.col("b").isNull() | F.col("f").isNull()).alias("missing"),
        F.count_if(F.col("b") > F.col("f")).alias("base_only"), F.count_if(F.col("f") > F.col("b")).alias("final_only"),
    )
    if totals.agg(F.sum("missing")).first()[0]:
        raise ValueError("predictions and records differ")
    drawn = stats.replicates(totals.select("family", "n", "b", "f"), ["family"], ["n", "b", "f"], samples, seed).where("n > 0")
    diff = (F.col("f") - F.col("b")) / F.col("n")
    interval = drawn.agg(stats.quantile_linear(diff, 0.025).alias("lower_95"), stats.quantile_linear(diff, 0.975).alias("upper_95"))
    sums = totals.agg(*[F.sum(c).alias(c) for c in ("n", "b", "f", "base_only", "final_only")])
    sums = stats.mcnemar_log10(sums, "base_only", "final_only")
    return sums.join(F.broadcast(interval)).select(  # one row each
        F.col("n").alias("records"), (F.col("b") / F.col("n")).alias("base_rate"), (F.col("f") / F.col("n")).alias("final_rate"), ((F.col("f") - F.col("b")) / F.col("n")).alias("effect"),
        "lower_95", "upper_95", "base_only", "final_only", "log10_p",
    )
