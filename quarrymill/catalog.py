"""All registered queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrymill.plans import corpus, evaluation, flows, labs, texts

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (evaluation, corpus, texts, labs, flows)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in _MODULES:
        found |= module.queries()
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _MODULES:
        found |= module.oracle_sql()
    return found
