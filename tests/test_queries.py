"""Every query of the engine against its SQL, over the smallest tables."""

from __future__ import annotations

import os

import pytest

from gridloom.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == names
    cells = lambda rows, order: sorted((tuple(repr(r[order.index(c)]) for c in names) for r in rows))
    assert cells([tuple(r) for r in df.collect()], df.columns) == cells(want.fetchall(), want.columns)


def test_plans_prune_and_push_down(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan(QUERIES["row_count_all"](spark, DATA))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in plan(QUERIES["column_subset"](spark, DATA))
    assert "TakeOrderedAndProject" in plan(QUERIES["sort_string_top"](spark, DATA))
    assert "Exchange" not in plan(QUERIES["row_numbers"](spark, DATA)) and "Exchange" not in plan(QUERIES["search_anywhere"](spark, DATA))
    assert "BroadcastHashJoin" in plan(QUERIES["edit_overlay"](spark, DATA))
