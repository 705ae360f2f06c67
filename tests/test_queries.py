"""Registered queries against their SQL on the smallest tables, where these are at hand."""

from __future__ import annotations

import math
import os

import pytest
from quarrymill import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return None if value is None else str(value)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    frame = catalog.queries()[name](spark, SF_DIR)
    got = [[plain(r[c]) for c in sorted(frame.columns)] for r in frame.collect()]
    rows = duck.sql(catalog.oracle_sql()[name])
    order = sorted(range(len(rows.columns)), key=lambda i: rows.columns[i])
    want = [[plain(r[i]) for i in order] for r in rows.fetchall()]
    assert sorted(frame.columns) == sorted(rows.columns)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_scans_are_pruned_and_filters_pushed(spark):
    plan = catalog.queries()["resume_pending"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema", 1)[1].split("\n", 1)[0]
    plan = catalog.queries()["pass_at_k"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan


def test_joins_of_tables_are_by_key(spark):
    for name in ("star_join", "split_overlap", "suffix_join", "completeness_gate", "static_rollup", "contamination_contains", "contamination_exact", "dedup_normalised", "changed_files", "tree_digests"):
        plan = catalog.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
