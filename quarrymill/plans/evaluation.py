"""Evaluation queries over labels and documents: the reference side, two predictors, and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import text
from quarrymill.operators import metrics, relational, stats


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per labelled document: id, family, stratum, is_vulnerable, base, final (null where the output is invalid)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    valid = F.col("doc_id") % 17 != 0
    short = F.col("n_chars") < 500
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("source").alias("family"), F.col("lang").alias("stratum"),
        (F.col("quality") == 0).alias("is_vulnerable"),
        F.when(valid, short).alias("base"), F.when(valid, short | (F.col("toxic") == 1)).alias("final"),
    )


FRAME = """frame AS (
  SELECT d.doc_id AS id, d.source AS family, d.lang AS stratum, l.quality = 0 AS is_vulnerable,
         CASE WHEN d.doc_id % 17 <> 0 THEN d.n_chars < 500 END AS base,
         CASE WHEN d.doc_id % 17 <> 0 THEN d.n_chars < 500 OR l.toxic = 1 END AS final
  FROM labels l JOIN documents d USING (doc_id))"""


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = frame(spark, sf_dir).agg(*metrics.confusion_counts(F.col("is_vulnerable"), F.col("final")))
    rated = metrics.confusion_rates(counted)
    return rated.select(*[F.round(c, 9).alias(c) if c not in ("tp", "tn", "fp", "fn") else F.col(c) for c in rated.columns])


_OK = "coalesce({0} = is_vulnerable, false)"
SAMPLES, SEED = 200, 42


def _correct(side: str):
    """Whether a prediction is right; none is wrong."""
    return F.coalesce(F.col(side) == F.col("is_vulnerable"), F.lit(False))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir).withColumn("base_ok", _correct("base")).withColumn("final_ok", _correct("final"))


_MARKED = f"""{FRAME}, marked AS (SELECT *, {_OK.format('base')} AS base_ok, {_OK.format('final')} AS final_ok FROM frame)"""


def per_stratum_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over all rows of a stratum, repair rates over its vulnerable rows only."""
    rate = lambda c: F.coalesce(F.round(F.avg(c.cast("double")), 9), F.lit(0.0))
    return _marked(spark, sf_dir).groupBy("stratum").agg(
        F.count("*").alias("n"), F.count_if("is_vulnerable").alias("n_vulnerable"), rate(F.col("final_ok")).alias("accuracy"),
        rate(F.when(F.col("is_vulnerable"), F.col("final_ok"))).alias("recall"),
        rate(F.when(~F.col("is_vulnerable"), F.col("final_ok"))).alias("specificity"),
    )


def paired_discordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs right on one side only, and the exact paired test, per stratum."""
    counts = _marked(spark, sf_dir).groupBy("stratum").agg(
        F.count_if(F.col("base_ok") & ~F.col("final_ok")).alias("base_only"), F.count_if(~F.col("base_ok") & F.col("final_ok")).alias("final_only")
    )
    return stats.mcnemar_log10(counts, "base_only", "final_only").withColumn("log10_p", F.round("log10_p", 6))


def holm_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    tested = paired_discordance(spark, sf_dir).select("stratum", F.round(stats.mcnemar_p(F.col("log10_p")), 8).alias("p"))
    adjusted = stats.holm(tested.withColumn("one", F.lit(1)), "p", ["one"], ["stratum"])
    return adjusted.select("stratum", "p", F.col("rank").cast("long").alias("rank"), F.round("p_holm", 8).alias("p_holm"))


_PAIRED = f"""WITH {_MARKED}, c AS (
  SELECT stratum, count(*) FILTER (base_ok AND NOT final_ok) AS base_only, count(*) FILTER (NOT base_ok AND final_ok) AS final_only
  FROM marked GROUP BY stratum
), x AS (SELECT *, unnest(range(0, least(base_only, final_only) + 1)) AS i, base_only + final_only AS n FROM c
), t AS (SELECT *, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) AS l FROM x
), m AS (SELECT *, max(l) OVER (PARTITION BY stratum) AS top FROM t
), paired AS (SELECT stratum, any_value(base_only) AS base_only, any_value(final_only) AS final_only,
  round(CASE WHEN any_value(n) = 0 THEN 0.0 ELSE (max(top) + ln(sum(exp(l - top))) - (any_value(n) - 1) * ln(2.0::DOUBLE)) / ln(10.0::DOUBLE) END, 6) AS log10_p
  FROM m GROUP BY stratum)"""


def wilson_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _marked(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n"), F.count_if("final_ok").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return counts.select("family", "n", "k", F.round(low, 9).alias("lower"), F.round(high, 9).alias("upper"))


def f_beta_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = frame(spark, sf_dir).groupBy("stratum").agg(*metrics.confusion_counts(F.col("is_vulnerable"), F.col("final")))
    p, r = metrics.ratio(F.col("tp"), F.col("tp") + F.col("fp")), metrics.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counted.select("stratum", *[F.round(stats.f_beta(p, r, float(b)), 9).alias(f"f{b}") for b in (1, 2, 3)])


def cluster_bootstrap(spark: SparkSession, sf_dir: str, samples: int = SAMPLES) -> DataFrame:
    """Difference of rates, families drawn with replacement: totals first, then draws."""
    totals = _marked(spark, sf_dir).groupBy("family").agg(
        F.count("*").alias("n"), F.sum(F.col("base_ok").cast("long")).alias("base"), F.sum(F.col("final_ok").cast("long")).alias("final")
    )
    drawn = stats.replicates(totals, ["family"], ["n", "base", "final"], samples, SEED).where("n > 0")
    diff = (F.col("final") - F.col("base")) / F.col("n")
    return drawn.agg(F.round(stats.quantile_linear(diff, 0.025), 9).alias("lower_95"), F.round(stats.quantile_linear(diff, 0.975), 9).alias("upper_95"))


def row_bootstrap(spark: SparkSession, sf_dir: str, samples: int = SAMPLES) -> DataFrame:
    """Rows drawn with replacement; one set of replicates under the three quantile rules."""
    counts = _marked(spark, sf_dir).agg(F.count("*").alias("rows"), F.count_if("final_ok").alias("hits"))
    drawn = stats.counted_replicates(counts, "rows", ["hits"], samples, SEED).withColumn("mean", F.col("hits") / F.col("rows"))
    rules = {"linear": stats.quantile_linear, "floor_last": stats.quantile_floor_last, "floor_count": stats.quantile_floor_count}
    return drawn.agg(*[F.round(f(F.col("mean"), q), 9).alias(f"{name}_{side}") for name, f in rules.items() for side, q in (("low", 0.025), ("high", 0.975))])


def paired_row_bootstrap(spark: SparkSession, sf_dir: str, samples: int = SAMPLES) -> DataFrame:
    """Mean paired difference, rows drawn: rows with equal differences are alike, so counts of -1, 0, 1 are drawn from."""
    counts = _marked(spark, sf_dir).agg(
        F.count("*").alias("rows"), F.count_if(F.col("base_ok") & ~F.col("final_ok")).alias("worse"), F.count_if(~F.col("base_ok") & F.col("final_ok")).alias("better")
    )
    drawn = stats.counted_replicates(counts, "rows", ["worse", "better"], samples, SEED)
    means = drawn.withColumn("mean", (F.col("better") - F.col("worse")) / F.col("rows"))
    return means.agg(F.round(stats.quantile_linear(F.col("mean"), 0.025), 9).alias("lower_95"), F.round(stats.quantile_linear(F.col("mean"), 0.975), 9).alias("upper_95"))


_DRAW = "CAST(('0x' || substr(md5('42:' || b || ':' || j), 1, 15)) AS BIGINT)"


def binomial_sql(wanted: str, into: str, name: str) -> str:
    """SQL of stats.binomial_draws: tables `{into}_c` of chances and `{into}` of draws, from `wanted` (n, p, u and more)."""
    return f"""{into}_k AS (SELECT n, p, unnest(range(greatest(0, floor(n * p - 12 * sqrt(n * p * (1 - p)) - 24))::BIGINT, least(n, ceil(n * p + 12 * sqrt(n * p * (1 - p)) + 24))::BIGINT + 1)) AS k
    FROM (SELECT DISTINCT n, p FROM {wanted})),
  {into}_x AS (SELECT n, p, k, CASE WHEN (p <= 0 AND k > 0) OR (p >= 1 AND k < n) THEN 0.0 ELSE exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    + CASE WHEN k = 0 THEN 0.0 ELSE k * ln(p) END + CASE WHEN n = k THEN 0.0 ELSE (n - k) * ln(1 - p) END) END AS c FROM {into}_k),
  {into}_y AS (SELECT n, p, k, CASE WHEN k = max(k) OVER (PARTITION BY n, p) THEN 2.0 ELSE sum(c) OVER (PARTITION BY n, p ORDER BY k) END AS v FROM {into}_x),
  {into}_c AS (SELECT n, p, v, min(k) AS k FROM {into}_y GROUP BY 1, 2, 3),
  {into} AS (SELECT w.*, c.k AS {name} FROM {wanted} w ASOF JOIN {into}_c c ON w.n = c.n AND w.p = c.p AND w.u <= c.v)"""


def uniform_sql(i: int) -> str:
    return f"CAST(('0x' || substr(md5('42:' || b || ':' || {i}), 1, 15)) AS BIGINT) / CAST(1152921504606846976 AS DOUBLE)"


def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table row of text for each stratum."""
    rates = per_stratum_rates(spark, sf_dir)
    cells = [text.markdown_cell(F.col("stratum")), F.col("n").cast("string"), F.format_string("%.4f", "accuracy"), F.format_string("%.4f", "recall")]
    return rates.select("stratum", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are prompts, their events samples, purchases passes: pass@k and bounds that count prompts too small as all fail or all pass."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    groups = events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("c"))
    big = groups.withColumn("scored", F.col("n") >= 5)
    scored = [F.avg(F.when(F.col("scored"), stats.pass_at_k(F.greatest(F.col("n"), F.lit(k)), F.col("c"), k))) for k in (1, 3, 5)]
    out = big.agg(F.count("*").alias("prompts"), F.count_if("scored").alias("scored_prompts"), *[s.alias(f"p{k}") for s, k in zip(scored, (1, 3, 5), strict=True)])
    bounds = []
    for k in (1, 3, 5):
        mean = F.coalesce(F.col(f"p{k}"), F.lit(0.0))
        bounds += [F.round(mean, 9).alias(f"pass_at_{k}"), F.round(mean * F.col("scored_prompts") / F.col("prompts"), 9).alias(f"lower_{k}"),
                   F.round((mean * F.col("scored_prompts") + F.col("prompts") - F.col("scored_prompts")) / F.col("prompts"), 9).alias(f"upper_{k}")]
    return out.select("prompts", "scored_prompts", *bounds)


def _pass_sql() -> str:
    terms = {k: "1 - " + " * ".join(f"((n - c - {i})::DOUBLE / (n - {i}))" for i in range(k)) for k in (1, 3, 5)}
    means = ", ".join(f"coalesce(avg({t}) FILTER (n >= 5), 0.0) AS p{k}" for k, t in terms.items())
    bounds = ", ".join(f"round(p{k}, 9) AS pass_at_{k}, round(p{k} * scored_prompts / prompts, 9) AS lower_{k}, round((p{k} * scored_prompts + prompts - scored_prompts) / prompts, 9) AS upper_{k}" for k in terms)
    return f"""WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS c FROM events GROUP BY user_id),
    s AS (SELECT count(*) AS prompts, count(*) FILTER (n >= 5) AS scored_prompts, {means} FROM g)
    SELECT prompts, scored_prompts, {bounds} FROM s"""


def report_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families as reports of a split (their stratum of most rows): accuracy differences of all pairs within a split, i < j."""
    rows = _marked(spark, sf_dir).groupBy("family").agg(F.round(F.avg(F.col("final_ok").cast("double")), 9).alias("accuracy"), F.count_if("is_vulnerable").alias("v"))
    reports = rows.withColumn("split", (F.col("v") % 3).cast("int"))
    a, b = (reports.select(F.col("split").alias(f"{s}_split"), F.col("family").alias(s), F.col("accuracy").alias(f"{s}_accuracy")) for s in ("first", "second"))
    met = a.join(b, (F.col("first_split") == F.col("second_split")) & (F.col("first") < F.col("second")))
    return met.select(F.col("first_split").alias("split"), "first", "second", F.round(F.col("first_accuracy") - F.col("second_accuracy"), 9).alias("difference"))


def detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases as a repository suite's: confusion over findings, changed lines' upper median over vulnerable ones, nulls left out."""
    f = frame(spark, sf_dir).withColumn("changed", F.when(F.col("id") % 5 != 0, F.col("id") % 37))
    v = F.col("is_vulnerable")
    f = f.withColumn("changed_vulnerable", F.when(v, F.col("changed")))
    return f.agg(
        F.count_if(v & F.coalesce("final", F.lit(False))).alias("tp"), F.count_if(~v & F.coalesce("final", F.lit(False))).alias("fp"),
        F.count_if(v & ~F.coalesce("final", F.lit(False))).alias("fn"), F.count_if(~v & ~F.coalesce("final", F.lit(False))).alias("tn"),
        stats.upper_median("changed_vulnerable").alias("upper_median"), F.max("changed").alias("most"),
        F.round(F.median(F.when(v, F.col("changed"))), 6).alias("median"), F.count_if(F.coalesce("changed", F.lit(0)) > 30).alias("n_large"),
    )


def stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored predictions joined to references: those without a reference are left out, missing ones listed as pending."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    log = docs.where("doc_id % 3 <> 0").select("doc_id", (F.col("n_chars") < 500).alias("said"))
    semi = relational.completed(log, labels, ["doc_id"])
    scored = semi.join(labels, "doc_id").select("doc_id", F.lit("scored").alias("state"), (F.col("said") == (F.col("quality") == 0)).alias("right"))
    return scored.unionByName(relational.pending(labels, log, ["doc_id"]).select("doc_id", F.lit("pending").alias("state"), F.lit(None).cast("boolean").alias("right")))


def queries() -> dict:
    return {
        "confusion_metrics": confusion, "per_stratum_rates": per_stratum_rates, "paired_discordance": paired_discordance,
        "holm_by_stratum": holm_by_stratum, "wilson_by_family": wilson_by_family, "f_beta_by_stratum": f_beta_by_stratum,
        "cluster_bootstrap": cluster_bootstrap, "row_bootstrap": row_bootstrap, "paired_row_bootstrap": paired_row_bootstrap,
        "report_markdown": report_markdown, "pass_at_k": pass_at_k, "report_pairs": report_pairs,
        "detection_summary": detection_summary, "stored_scores": stored_scores,
    }


_STRATA = f"""WITH {_MARKED}, rates AS (SELECT stratum, count(*) AS n, count(*) FILTER (is_vulnerable) AS n_vulnerable,
  coalesce(round(avg(final_ok::INT), 9), 0.0) AS accuracy, coalesce(round(avg(final_ok::INT) FILTER (is_vulnerable), 9), 0.0) AS recall,
  coalesce(round(avg(final_ok::INT) FILTER (NOT is_vulnerable), 9), 0.0) AS specificity FROM marked GROUP BY stratum)"""


def oracle_sql() -> dict[str, str]:
    z = stats.Z95
    return {
        "confusion_metrics": f"""WITH {FRAME}, c AS (
  SELECT count(*) FILTER (is_vulnerable AND coalesce(final, NOT is_vulnerable)) AS tp,
         count(*) FILTER (NOT is_vulnerable AND NOT coalesce(final, NOT is_vulnerable)) AS tn,
         count(*) FILTER (NOT is_vulnerable AND coalesce(final, NOT is_vulnerable)) AS fp,
         count(*) FILTER (is_vulnerable AND NOT coalesce(final, NOT is_vulnerable)) AS fn FROM frame)
SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0.0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 9) AS recall,
  round(coalesce(tn / nullif(tn + fp, 0), 0.0), 9) AS specificity,
  round((coalesce(tp / nullif(tp + fn, 0), 0.0) + coalesce(tn / nullif(tn + fp, 0), 0.0)) / 2, 9) AS balanced_accuracy,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 9) AS f1,
  round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0.0), 9) AS mcc
FROM c""",
        "per_stratum_rates": f"{_STRATA} SELECT * FROM rates",
        "paired_discordance": f"{_PAIRED} SELECT * FROM paired",
        "holm_by_stratum": f"""{_PAIRED}, p AS (SELECT stratum, round(least(1.0, pow(10.0::DOUBLE, log10_p)), 8) AS p FROM paired),
  r AS (SELECT *, row_number() OVER (ORDER BY p, stratum) AS rank, count(*) OVER () AS m FROM p)
SELECT stratum, p, rank, round(max(least(1.0, p * (m - rank + 1))) OVER (ORDER BY p, stratum ROWS UNBOUNDED PRECEDING), 8) AS p_holm FROM r""",
        "wilson_by_family": f"""WITH {_MARKED}, c AS (SELECT family, count(*) AS n, count(*) FILTER (final_ok) AS k FROM marked GROUP BY family),
  p AS (SELECT *, k::DOUBLE / n AS p FROM c)
SELECT family, n, k, round((p + {z * z} / (2 * n) - {z} * sqrt(p * (1 - p) / n + {z * z} / (4.0 * n * n))) / (1 + {z * z} / n), 9) AS lower,
  round((p + {z * z} / (2 * n) + {z} * sqrt(p * (1 - p) / n + {z * z} / (4.0 * n * n))) / (1 + {z * z} / n), 9) AS upper FROM p""",
        "f_beta_by_stratum": f"""WITH {FRAME}, c AS (SELECT stratum, count(*) FILTER (is_vulnerable AND coalesce(final, NOT is_vulnerable)) AS tp,
  count(*) FILTER (NOT is_vulnerable AND coalesce(final, NOT is_vulnerable)) AS fp, count(*) FILTER (is_vulnerable AND NOT coalesce(final, NOT is_vulnerable)) AS fn
  FROM frame GROUP BY stratum), p AS (SELECT stratum, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r FROM c)
SELECT stratum, {", ".join(f"round(coalesce({1 + b * b} * p * r / nullif({b * b} * p + r, 0), 0), 9) AS f{b}" for b in (1, 2, 3))} FROM p""",
        "cluster_bootstrap": f"""WITH {_MARKED}, t AS (SELECT family, count(*) AS n, sum(base_ok::INT) AS base, sum(final_ok::INT) AS final FROM marked GROUP BY family),
  k AS (SELECT *, row_number() OVER (ORDER BY family) - 1 AS i, count(*) OVER () AS c FROM t),
  d AS (SELECT b, {_DRAW} % (SELECT count(*) FROM t) AS i FROM range({SAMPLES}) x(b), range((SELECT count(*) FROM t)) y(j)),
  r AS (SELECT b, sum(n) AS n, sum(base) AS base, sum(final) AS final FROM d JOIN k USING (i) GROUP BY b)
SELECT round(quantile_cont((final - base)::DOUBLE / n, 0.025), 9) AS lower_95, round(quantile_cont((final - base)::DOUBLE / n, 0.975), 9) AS upper_95 FROM r""",
        "row_bootstrap": f"""WITH {_MARKED}, t AS (SELECT count(*) AS n, count(*) FILTER (final_ok) AS k FROM marked),
  w AS (SELECT b, n, k::DOUBLE / n AS p, {uniform_sql(0)} AS u FROM t, range({SAMPLES}) x(b)), {binomial_sql("w", "d", "hits")},
  r AS (SELECT hits::DOUBLE / n AS mean FROM d),
  l AS (SELECT list_sort(list(mean)) AS m, quantile_cont(mean, 0.025) AS a, quantile_cont(mean, 0.975) AS z FROM r)
SELECT round(a, 9) AS linear_low, round(z, 9) AS linear_high, round(m[1 + floor(0.025 * {SAMPLES - 1})::INT], 9) AS floor_last_low,
  round(m[1 + floor(0.975 * {SAMPLES - 1})::INT], 9) AS floor_last_high, round(m[1 + floor(0.025 * {SAMPLES})::INT], 9) AS floor_count_low,
  round(m[1 + least({SAMPLES - 1}, floor(0.975 * {SAMPLES})::INT)], 9) AS floor_count_high FROM l""",
        "paired_row_bootstrap": f"""WITH {_MARKED}, t AS (SELECT count(*) AS m, count(*) FILTER (base_ok AND NOT final_ok) AS worse, count(*) FILTER (NOT base_ok AND final_ok) AS better FROM marked),
  w1 AS (SELECT b, m, worse AS all_worse, better, m AS n, worse::DOUBLE / m AS p, {uniform_sql(0)} AS u FROM t, range({SAMPLES}) x(b)), {binomial_sql("w1", "d1", "hits")},
  w2 AS (SELECT b, m, hits AS worse, m - hits AS n, least(1.0, coalesce(better::DOUBLE / nullif(m - all_worse, 0), 0.0)) AS p, {uniform_sql(1)} AS u FROM d1), {binomial_sql("w2", "d2", "gains")},
  r AS (SELECT (gains - worse)::DOUBLE / m AS mean FROM d2)
SELECT round(quantile_cont(mean, 0.025), 9) AS lower_95, round(quantile_cont(mean, 0.975), 9) AS upper_95 FROM r""",
        "report_markdown": f"""{_STRATA} SELECT stratum, '| ' || replace(replace(coalesce(stratum, ''), '|', '\\|'), chr(10), ' ') || ' | ' || n || ' | '
  || format('{{:.4f}}', accuracy) || ' | ' || format('{{:.4f}}', recall) || ' |' AS line FROM rates""",
        "pass_at_k": _pass_sql(),
        "report_pairs": f"""WITH {_MARKED}, r AS (SELECT family, round(avg(final_ok::INT), 9) AS accuracy, (count(*) FILTER (is_vulnerable) % 3)::INT AS split FROM marked GROUP BY family)
SELECT a.split, a.family AS first, b.family AS second, round(a.accuracy - b.accuracy, 9) AS difference FROM r a JOIN r b ON a.split = b.split AND a.family < b.family""",
        "detection_summary": f"""WITH {FRAME}, f AS (SELECT *, CASE WHEN id % 5 <> 0 THEN id % 37 END AS changed, coalesce(final, false) AS said FROM frame)
SELECT count(*) FILTER (is_vulnerable AND said) AS tp, count(*) FILTER (NOT is_vulnerable AND said) AS fp, count(*) FILTER (is_vulnerable AND NOT said) AS fn,
  count(*) FILTER (NOT is_vulnerable AND NOT said) AS tn, list_sort(list(changed) FILTER (is_vulnerable AND changed IS NOT NULL))[
  1 + (count(changed) FILTER (is_vulnerable) // 2)] AS upper_median, max(changed) AS most,
  round(median(changed) FILTER (is_vulnerable), 6) AS median, count(*) FILTER (changed > 30) AS n_large FROM f""",
        "stored_scores": """SELECT d.doc_id, 'scored' AS state, (d.n_chars < 500) = (l.quality = 0) AS "right" FROM documents d JOIN labels l USING (doc_id) WHERE d.doc_id % 3 <> 0
UNION ALL SELECT l.doc_id, 'pending', NULL FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.doc_id % 3 <> 0)""",
    }
