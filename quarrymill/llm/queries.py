"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm import bpe, bytespans, htmltext, jaccard, langid, lm, media, mixing, periodic, quality, resample, substrings, tokenfiles
from quarrymill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(table(spark, sf_dir, name))


def queries() -> dict[str, Query]:
    return {
        "op1_html_text": _over("pages", htmltext.extract),
        "op2_ngram_jaccard": _over("documents", jaccard.digest),
        "op3_media_fingerprints": _over("documents", media.digest),
        "op4_quality_rules": _over("documents", quality.digest),
        "op5_token_files": _over("documents", tokenfiles.digest),
        "op6_source_mixing": _over("documents", mixing.digest),
        "op7_language_id": _over("documents", langid.digest),
        "op8_byte_bpe": _over("documents", bpe.digest),
        "op9_substring_dedup": _over("documents", substrings.digest),
        "op10_lm_scoring": _over("documents", lm.digest),
        "op11_suffix_array_dedup": _over("documents", bytespans.digest),
        "op13_periodic_runs": _over("documents", periodic.digest),
        "op12_importance_resampling": lambda spark, sf_dir: resample.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality.ORACLE, "op6_source_mixing": mixing.ORACLE, "op12_importance_resampling": resample.ORACLE}
