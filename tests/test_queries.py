"""Registered queries against their SQL checks on the smallest tables.

The default run takes the headline queries and the streaming twins; TRACEWELL_ALL_QUERIES=1 takes all.
"""

import os

import duckdb
import pytest
from compare import TABLES, rows_of

from bench import HEADLINE
from tracewell import plans

ALL = os.environ.get("TRACEWELL_ALL_QUERIES") == "1"
CHECKED = sorted(n for n in plans.ORACLES if ALL or n in HEADLINE or n.startswith(("n2", "n3", "n4", "n5")))
UNCHECKED = sorted(n for n in set(plans.QUERIES) - set(plans.ORACLES) if ALL or n in ("l8_covariance_family", "l33_validation_tuning"))


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, duck, name, capsys):
    df = plans.QUERIES[name](spark, sf)
    capsys.readouterr()
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(plans.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, found.fetchall())


@pytest.mark.parametrize("name", UNCHECKED)
def test_rows_only_query_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, sf, capsys):
    plans.QUERIES["b6_time_slice"](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in plan


def test_windows_and_blocks_share_one_shuffle(spark, sf, capsys):
    plans.QUERIES["e20_resample_bins"](spark, sf).explain("formatted")
    assert capsys.readouterr().out.count("hashpartitioning") == 1
