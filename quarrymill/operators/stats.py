"""Statistics in closed form or by seeded hash draws, so that another engine can repeat them digit by digit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.code_columns import number_rows
from quarrymill.operators.metrics import ratio
from quarrymill.scratch import forget, materialize

Z95 = 1.959963984540054
#: Levels of a tree of types at least.
LEVELS = 3


def hash_draw(*parts: Column) -> Column:
    """60 bits of the MD5 of parts joined by ':', as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


# Quantiles: three rules that must not be mixed up -----------------------------------------------------------------------


def quantile_linear(values: Column, q: float) -> Column:
    """Between the neighbours of q (n - 1), in proportion."""
    return F.percentile(values, F.lit(q))


def quantile_floor_last(values: Column, q: float) -> Column:
    """The element at int(q (n - 1))."""
    ordered = F.sort_array(F.collect_list(values))
    return F.get(ordered, F.floor(F.lit(q) * (F.size(ordered) - 1)).cast("int"))


def quantile_floor_count(values: Column, q: float) -> Column:
    """The element at int(q n), the last at most."""
    ordered = F.sort_array(F.collect_list(values))
    return F.get(ordered, F.least(F.size(ordered) - 1, F.floor(F.lit(q) * F.size(ordered)).cast("int")))


def upper_median(column: str) -> Column:
    """The element at n // 2 of a column of whole numbers; null over no values.

    Twice the median less the lower of the two middle elements: both keep a count for each distinct value, not a list.
    """
    lower = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}`)")
    return (2 * F.median(column) - lower).cast("long")


# Resampling -------------------------------------------------------------------------------------------------------------


def replicates(clusters: DataFrame, by: list[str], sums: list[str], samples: int, seed: int) -> DataFrame:
    """replicate and resampled sums. clusters: one row per unit to draw (a family, of which there are few), in the order `by`.

    Units are aggregated before they are drawn, so the work is samples x units whatever the rows behind them. The
    units' ordinals are drawn by hash, spread over tasks, and joined; replicates are summed where they are made.
    """
    spark = clusters.sparkSession
    numbered = clusters.withColumn("_i", F.row_number().over(Window.orderBy(*by)) - 1)
    n = clusters.count()
    draws = spark.range(samples * n).select(F.expr(f"id div {max(1, n)}").alias("replicate"), F.pmod("id", F.lit(max(1, n))).alias("_k"))
    drawn = draws.select("replicate", (hash_draw(F.lit(seed), F.col("replicate"), F.col("_k")) % max(1, n)).cast("int").alias("_i"))
    return drawn.join(numbered, "_i").groupBy("replicate").agg(*[F.sum(c).alias(c) for c in sums])


def typed_replicates(types: DataFrame, count: str, sums: list[str], samples: int, seed: int) -> DataFrame:
    """As replicates(), of units that fall into types: a type's units are alike, so their number is all that matters.

    types: a row for each type, its number of units in `count` and a unit's values in `sums`. Types in order of these values
    are the leaves of a tree; from the root down, the units drawn in a node are split between its halves by a binomial draw
    from their shares. So the work grows with types and with the root of units, no unit is drawn, and there may be any number
    of types. Trees have LEVELS at least; halves without units cost nothing.
    """
    spark = types.sparkSession
    leaves = number_rows(types.where(F.col(count) > 0).select(F.col(count).cast("long").alias("_c"), *sums), [*sums, "_c"], "%d", "_i").withColumn("_i", F.col("_i").cast("long") - 1)
    n_types, units = leaves.agg(F.count("*"), F.sum("_c")).first()
    levels = max(LEVELS, (max(1, n_types) - 1).bit_length())
    state = spark.range(samples).select(F.col("id").alias("replicate"), F.lit(0).cast("long").alias("_node"), F.lit(int(units or 0)).alias("_n")).where("_n > 0")
    for level in range(levels):
        down = levels - level - 1  # leaves below a child: 2 ** down
        half = F.shiftright("_i", down)
        shares = leaves.groupBy(F.shiftright(half, 1).alias("_node")).agg((F.sum(F.when(half % 2 == 0, F.col("_c")).otherwise(0)) / F.sum("_c")).alias("p"))
        drawn = state.join(shares, "_node").withColumnsRenamed({"_n": "n"})
        drawn = binomial_draws(drawn.withColumn("u", uniform(F.lit(seed), F.col("replicate"), F.lit(1 << level) + F.col("_node"))), "_left")
        halves = F.array(F.struct((F.col("_node") * 2).alias("_node"), F.col("_left").alias("_n")), F.struct((F.col("_node") * 2 + 1).alias("_node"), (F.col("n") - F.col("_left")).alias("_n")))
        before, state = state, materialize(drawn.select("replicate", F.inline(halves)).where("_n > 0"), "halves")
        if level:
            forget(before)
    met = state.join(leaves, state["_node"] == leaves["_i"])
    return met.groupBy("replicate").agg(*[F.sum(F.col("_n") * F.col(c)).alias(c) for c in sums])


def binomial_draws(wanted: DataFrame, into: str) -> DataFrame:
    """wanted (n, p, u and more) with a number of hits out of n of probability p: the least whose chance to be reached is u or more.

    Chances are summed up once for each (n, p), from 12 deviations below the mean to 12 above (what lies beyond is less
    than 1e-30), so the work grows with the root of n, not with n, and no row is drawn.
    """
    mean, spread = F.col("n") * F.col("p"), 12 * F.sqrt(F.col("n") * F.col("p") * (1 - F.col("p"))) + 24
    lowest = F.greatest(F.lit(0), F.floor(mean - spread)).cast("long")
    highest = F.least(F.col("n"), F.ceil(mean + spread)).cast("long")
    cells = wanted.select("n", "p").distinct().withColumn("_k", F.explode(F.sequence(lowest, highest)))
    n, k, p = F.col("n"), F.col("_k"), F.col("p")
    times = lambda count, chance: F.when(count == 0, F.lit(0.0)).otherwise(count * F.log(chance))
    log = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + times(k, p) + times(n - k, 1 - p)
    chance = F.when((p <= 0) & (k > 0), F.lit(0.0)).when((p >= 1) & (k < n), F.lit(0.0)).otherwise(F.exp(log))
    run = Window.partitionBy("n", "p").orderBy("_k")
    table = cells.withColumn("_c", chance).withColumn("_v", F.sum("_c").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    # rounding must not leave the last chance below 1
    table = table.withColumn("_v", F.when(k == highest, F.lit(2.0)).otherwise(F.col("_v"))).select("n", "p", "_v", "_k", F.lit(1).alias("_side"))
    rest = [c for c in wanted.columns if c not in ("n", "p")]
    both = table.withColumn("_w", F.lit(None).cast(wanted.select(F.struct(*rest).alias("w")).schema["w"].dataType)).unionByName(
        wanted.select("n", "p", F.col("u").alias("_v"), F.lit(None).cast("long").alias("_k"), F.lit(0).alias("_side"), F.struct(*rest).alias("_w"))
    )
    # from the highest chance down: the last number passed is the least that reaches u
    down = Window.partitionBy("n", "p").orderBy(F.desc("_v"), F.desc("_side"), F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn(into, F.last_value("_k", F.lit(True)).over(down)).where("_side = 0")
    return met.select("n", "p", "_w.*", into)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of the hash of parts."""
    return hash_draw(*parts).cast("double") / float(1 << 60)


def counted_replicates(counts: DataFrame, total: str, classes: list[str], samples: int, seed: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, replicate, total and resampled counts of classes, of `total` rows drawn with replacement: only counts matter.

    counts: one row (one for each of a few keys) with the number of rows in all and in each class. Classes are drawn one
    after another, each out of what the earlier ones left.
    """
    spark = counts.sparkSession
    kept = counts.select(*keys, F.col(total).alias("_total"), *[F.col(c).alias(f"_all_{c}") for c in classes])
    rows = spark.range(samples).select(F.col("id").alias("replicate")).join(F.broadcast(kept)).where("_total > 0")  # a few rows
    rows = rows.withColumn("_rows", F.col("_total")).withColumn("_left", F.col("_total"))
    for i, c in enumerate(classes):
        share = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(f"_all_{c}").cast("double"), F.col("_rows").cast("double")), F.lit(0.0)))
        asked = rows.withColumns({"n": F.col("_left"), "p": share, "u": uniform(F.lit(seed), F.col("replicate"), F.lit(i))})
        rows = binomial_draws(asked, c).drop("n", "p", "u")
        rows = rows.withColumns({"_left": F.col("_left") - F.col(c), "_rows": F.col("_rows") - F.col(f"_all_{c}")})
    return rows.select(*keys, "replicate", F.col("_total").alias(total), *classes)


# Tests ------------------------------------------------------------------------------------------------------------------


def log_factorial(n: Column) -> Column:
    """ln n!: exact below 20, Stirling's series above (error under 1e-15)."""
    x = n.cast("double")
    series = x * F.log(x) - x + F.log(2 * F.pi() * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5))
    return F.when(n < 20, F.log(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def _log_halves(n: Column, k: Column) -> Column:
    """ln of C(n, k) / 2^n, without the difference of large logarithms where k is not small."""
    x = lambda c: c.cast("double")
    d = (x(n) - 2 * x(k)) / x(n)
    rest = lambda c: 1 / (12 * x(c)) - 1 / (360 * F.pow(x(c), 3)) + 1 / (1260 * F.pow(x(c), 5))
    large = -x(n) * ((1 - d) / 2 * F.log1p(-d) + (1 + d) / 2 * F.log1p(d)) + F.log(x(n) / (2 * F.pi() * x(k) * (x(n) - x(k)))) / 2 + rest(n) - rest(k) - rest(n - k)
    small = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - x(n) * F.log(F.lit(2.0))
    return F.when(k < 20, small).otherwise(large)


def mcnemar_log10(pairs: DataFrame, left_only: str, right_only: str) -> DataFrame:
    """pairs with log10_p: the exact two-sided test in logarithms. 0 without discordant pairs; not capped at 0.

    The tail of the binomial is the regularised incomplete beta function at 1/2, by its continued fraction from the
    innermost term out: a row's work grows with the root of its discordant pairs, and no row is made or joined.
    """
    n, k = (F.col(left_only) + F.col(right_only)).cast("long"), F.least(left_only, right_only).cast("long")
    a, b = (n - k).cast("double"), (k + 1).cast("double")
    terms = F.least(2 * (k + 1), 100 + F.ceil(2 * F.sqrt(n.cast("double")))).cast("int")

    def term(j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        odd = -(a + m) * (a + b + m) / (2 * (a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) / (2 * (a + 2 * m - 1) * (a + 2 * m))
        return F.when(j % 2 == 1, odd).otherwise(even)

    fraction = F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), F.lit(1.0), lambda h, j: 1 + term(j) / h)
    log10_p = (_log_halves(n, k) - F.log(fraction)) / F.log(F.lit(10.0))
    return pairs.withColumn("log10_p", F.when(n == 0, F.lit(0.0)).otherwise(log10_p))


def mcnemar_p(log10_p: Column) -> Column:
    return F.least(F.lit(1.0), F.pow(F.lit(10.0), log10_p))


def holm(tests: DataFrame, p: str, family: list[str], order: list[str]) -> DataFrame:
    """tests with rank and p_holm, adjusted within a family of tests by stepping down; ties in the given order."""
    w = Window.partitionBy(*family).orderBy(p, *order)
    m = F.count("*").over(Window.partitionBy(*family))
    ranked = tests.withColumn("rank", F.row_number().over(w)).withColumn("_a", F.least(F.lit(1.0), F.col(p) * (m - F.col("rank") + 1)))
    return ranked.withColumn("p_holm", F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_a")


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; 0, 0 over nothing."""
    n, p = total.cast("double"), ratio(successes, total)
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    bound = lambda sign: F.when(total > 0, (centre + sign * half) / (1 + z * z / n)).otherwise(F.lit(0.0))
    return bound(-1), bound(1)


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    return ratio((1 + beta * beta) * precision * recall, beta * beta * precision + recall)


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased chance that one of k samples passes, of n with c passing; an error if n < k."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * (n - c - i) / (n - i))
    return F.when(n < k, F.raise_error(F.lit("fewer samples than k")).cast("double")).otherwise(1 - miss)
