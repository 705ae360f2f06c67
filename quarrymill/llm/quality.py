"""Quality rules: a table of thresholds compiled into one projection, with DataFrame functions only.

Defined results: a null or blank text has no words, fails the base rule and is not kept; repeated rows are judged
alike; an empty table gives an empty result; any other columns pass through filter_clean() untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import BLANKS, words

#: The commonest function words of four languages; prose has some of them, lists of junk have none.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "with", "as", "be", "at", "this", "are", "a",
    "de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "sur", "pas", "au",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf", "ist", "ein", "eine", "nicht", "dem", "es",
    "el", "los", "las", "y", "por", "con", "para", "una", "su", "se", "no", "al", "lo", "del",
)


@dataclass(frozen=True)
class Rule:
    """Documents outside [low, high] of a measure are rejected; None leaves that end open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Production thresholds. They reject markup dumps, symbol soup, repeated lines and word lists, not plain prose.
RULES = (
    Rule("n_words", 10, None),
    Rule("mean_word_chars", 1.5, 20.0),
    Rule("symbol_ratio", None, 0.25),
    Rule("stop_word_ratio", 0.03, None),
    Rule("dup_line_ratio", None, 0.5),
)


def _repeat_count(words_col: str) -> Column:
    """Words that lie in a 5-word window found twice or more.

    Equal windows stand side by side once (hash, position) pairs are sorted; the positions with an equal neighbour,
    in order, cover min(5, gap to the next) words each and the last covers 5. Texts whose windows all differ (most)
    skip the sort: a hash set of plain longs tells. Everything stays within the row, so nothing is shuffled.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words_col) - 5),
        lambda i: F.xxhash64(*[F.get(F.col(words_col), i + k) for k in range(5)]),
    )

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def runs(s: Column) -> Column:
            near = lambda x, j: x["h"] == F.get(s, j)["h"]
            same = F.filter(s, lambda x, i: F.coalesce(near(x, i - 1), F.lit(False)) | F.coalesce(near(x, i + 1), F.lit(False)))
            at = F.array_sort(F.transform(same, lambda x: x["p"]))
            # the sum over positions carries (last position, total)
            start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("total"))
            step = lambda acc, x: F.struct(x.alias("last"), (acc["total"] + F.least(F.lit(5), x - acc["last"])).alias("total"))
            return F.aggregate(at, start, step, lambda acc: acc["total"])

        return F.get(F.transform(F.array(pairs), runs), F.lit(0))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    bound = F.get(F.transform(F.array(hashes), count), F.lit(0))
    return F.when(F.size(words_col) >= 6, bound).otherwise(F.lit(0)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """docs with counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the ratios that rules use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.withColumn("_w", words(F.col("text"))).withColumn(
        "_lines", F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    )
    length = F.length(text)
    # A filter on a measure must not be pushed below this projection: it would carry the expressions along, and the split
    # into words would run once for every word. Spark leaves projections alone that are not deterministic.
    fence = F.monotonically_increasing_id() * 0
    counted = held.withColumns(
        {
            "n_words": F.size("_w").cast("long") + fence,
            "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
            "n_symbols": (length - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _repeat_count("_w"),
            "n_stop_words": F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        }
    ).drop("_w", "_lines")
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counted.withColumns(
        {
            "mean_word_chars": part("word_chars", "n_words"),
            "symbol_ratio": part("n_symbols", "word_chars"),
            # one more stop word than there is, so that short texts are not judged by a few words
            "stop_word_ratio": F.when(F.col("n_words") > 0, (F.col("n_stop_words") + 1) / F.col("n_words")).otherwise(F.lit(0.0)),
            "dup_line_ratio": part("n_dup_lines", "n_lines"),
        }
    )


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression."""
    verdict = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            verdict = verdict & (F.col(rule.measure) >= rule.low)
        if rule.high is not None:
            verdict = verdict & (F.col(rule.measure) <= rule.high)
    return verdict


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with measures, base_failed and kept."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & passes(rules))


def filter_clean(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with docs' own columns."""
    bare = judge(docs.select(F.struct(*docs.columns).alias("_row"), F.col("text")), rules)
    return bare.where("kept").select("_row.*")


def digest(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    rules = " AND ".join(
        f"{r.measure} {op} {v!r}" for r in RULES for op, v in ((">=", r.low), ("<=", r.high)) if v is not None
    )
    ratio = "CASE WHEN {1} > 0 THEN CAST({0} AS DOUBLE) / {1} ELSE 0.0 END".format
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS n FROM p),
r AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM g WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop_words
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id
), q AS (
  SELECT *, {ratio('word_chars', 'n_words')} AS mean_word_chars, {ratio('n_symbols', 'word_chars')} AS symbol_ratio,
    {ratio('(n_stop_words + 1)', 'n_words')} AS stop_word_ratio, {ratio('n_dup_lines', 'n_lines')} AS dup_line_ratio,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept FROM q
"""


ORACLE = _oracle()
