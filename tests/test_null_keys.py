"""Null keys give the same rows below and above the row limit."""

import pytest
from pyspark.sql import functions as F

from tracewell import session
from tracewell.operators import conformal, scaling
from tracewell.operators.ordered import running


@pytest.fixture
def rows(spark):
    made = [(None if i % 2 else "a", i, float(i % 7), i % 3 == 0) for i in range(40)]
    yield spark.createDataFrame(made, "k string, i long, x double, cal boolean")
    spark.conf.unset(session.ROWS_PER_CHUNK)


def both(spark, build):
    found = []
    for limit in ("2000000", "8"):
        spark.conf.set(session.ROWS_PER_CHUNK, limit)
        found.append(sorted((tuple(r) for r in build().collect()), key=repr))
    return found


def test_running_sums_and_totals(spark, rows):
    small, large = both(spark, lambda: running(rows, ["k"], ["i"], sums={"s": F.col("x")}, totals={"t": F.col("x")}, rows=40).select("k", "i", "s", "t"))
    assert small == large and len(small) == 40


def test_conformal_p_values(spark, rows):
    small, large = both(spark, lambda: conformal.p_values(rows, ["k"], "x", F.col("cal"), rows=40).select("k", "i", "p_value"))
    assert small == large and len(small) == 40


def test_scales_and_standard_scores_keep_the_null_feature(spark, rows):
    def build():
        p = scaling.robust_parameters(rows, ["k"], "x", rule="relative", rows=40)
        return scaling.standardize(rows, p, ["k"], "x").select("k", "i", "z")

    small, large = both(spark, build)
    assert small == large and len(small) == 40 and all(r[2] is not None for r in small)
