"""Mixing sources to target weights, with DataFrame functions only.

Sizes (words) are aggregated per source, targets are water-filled, repetition rates follow, and each document is
taken floor(rate) times plus one more time if its hash-seeded draw falls below the fraction.

Defined results: a null or blank text has size 0 and takes 0 words; a null source is a source of its own, last in
order; an empty table gives an empty result; repeated rows are rows of their own but share a draw with their id, rows of
null id with their text; a source without words has target 0. Columns that the caller adds pass through untouched,
whatever their names: mix() adds underscores to its own where they clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import fresh, n_words
from quarrymill.scratch import materialize

#: The table of sources is broadcast up to so many rows (under 1 MB); beyond, Spark joins it by key.
BROADCAST_SOURCES = 10_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share_pct: int = 150, cap: int = 2) -> DataFrame:
    """Columns source, source_size to source, source_size, target.

    Sources by code point, null last, weigh as in `weights`, repeating. They share share_pct % of all words; no
    target exceeds cap times its source's size, and what is above is shared again by weight. The water level is
    found in one pass over sources in order of cap/weight: a source is capped if its cap lies below the level that
    the sources from it onward would have. One row per source is all that these windows see.
    """
    if not 0 < share_pct <= 100 * cap:
        raise ValueError("share_pct must lie in (0, 100 * cap]")
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")).cast("long"))
    weighed = weighed.withColumn("_cap", F.col("source_size") * cap)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = weighed.select(
        "source", "source_size", "_w", "_cap",
        # hundredths of words, so that all sums are whole numbers
        (F.sum("source_size").over(everything) * share_pct - F.coalesce(F.sum("_cap").over(before), F.lit(0)) * 100).alias("_left"),
        F.sum("_w").over(onward).alias("_w_left"),
    )
    # these products can pass the range of long at very many words and sources
    exact = lambda c, digits: c.cast(f"decimal({digits},0)")
    capped = exact(F.col("_cap"), 19) * exact(F.col("_w_left") * 100, 14) <= exact(F.col("_left"), 19) * exact(F.col("_w"), 9)
    level = F.col("_left").cast("double") / (F.col("_w_left") * 100).cast("double")
    leveled = filled.withColumn("_capped", capped).withColumn("_level", F.max(F.when(~F.col("_capped"), level)).over(everything))
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.col("_w").cast("double") * F.col("_level"))
    return leveled.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the id alone (from the text where there is none): 52 bits of a digest."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce(text, F.lit("")))))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (3, 1, 2), share_pct: int = 150, cap: int = 2) -> DataFrame:
    """docs with columns size, source_size, target and copies added; needs doc_id, text and source.

    One pass aggregates sizes per source (combined before the shuffle, so a hot source costs one row a task), a
    second attaches them.
    """
    size, total, target, copies, source = fresh(docs, "size", "source_size", "target", "copies", "_source")
    sized = docs.withColumn(size, n_words(F.col("text")))
    by_source = sized.select("source", F.col(size).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    sums = materialize(targets(by_source, weights, share_pct, cap), "mix")
    small = sums.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    sums = sums.select(F.col("source").alias(source), F.col("source_size").alias(total), F.col("target").alias(target))
    joined = sized.join(F.broadcast(sums) if small else sums, sized["source"].eqNullSafe(sums[source])).drop(source)
    rate = F.when(F.col(total) > 0, F.col(target) / F.col(total)).otherwise(F.lit(0.0))
    extra = (draw(F.col("doc_id"), F.col("text"), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn(copies, F.when(F.col(total) > 0, F.floor(rate) + extra).otherwise(F.lit(0)).cast("long"))


def expand(docs: DataFrame, **options) -> DataFrame:
    """Each document as often as the mix takes it, with docs' own columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", "source")
    taken = mix(whole, **options).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
         2 * source_size AS cap FROM s
), f AS (
  SELECT *, CAST(sum(source_size) OVER () * 150 AS BIGINT) - 100 * CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w,
         source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS room,
         CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source IS NULL, source
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_left FROM w
), l AS (
  SELECT *, max(CASE WHEN NOT cap * 100 * w_left <= room * w THEN CAST(room AS DOUBLE) / CAST(w_left * 100 AS DOUBLE) END) OVER () AS level,
         cap * 100 * w_left <= room * w AS capped FROM f
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(w AS DOUBLE) * level END AS target FROM l
), r AS (
  SELECT d.doc_id, d.text, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size > 0 THEN size * (floor(rate) + CAST(
  CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '-' || md5(coalesce(text, '')))), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) < rate - floor(rate)
  AS BIGINT)) ELSE 0 END AS BIGINT) AS taken FROM r
"""
