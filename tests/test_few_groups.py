"""Quantiles of few large groups: bins first, then only the values next to the ranks."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import ranks, scaling

NAN, INF = float("nan"), float("inf")


@pytest.fixture
def small_chunks(spark):
    spark.conf.set("spark.tracewell.rowsPerChunk", "40")
    yield
    spark.conf.unset("spark.tracewell.rowsPerChunk")


def groups():
    draw = random.Random(3)
    rows = [("a", round(draw.uniform(0, 50), 2)) for _ in range(400)]
    rows += [("b", 7.0)] * 90 + [("c", None)] * 5 + [("d", 1.5)]
    rows += [("e", v) for v in (-INF, -1e308, 1e308, INF, NAN, 0.0)] + [(None, round(draw.gauss(0, 1), 3)) for _ in range(201)]
    return rows + [("f", 1e-9 * i if i else 1e9) for i in range(300)]  # all but one value in one bin


def test_medians_of_large_inputs_have_the_bits_of_the_percentile_aggregate(spark, small_chunks):
    draw = random.Random(1)
    rows = [(i, round(draw.uniform(0, 50), 2)) for i in range(150) for _ in range(2)]
    df = spark.createDataFrame(rows, "k int, x double")
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.percentile("x", F.lit(0.5)).alias("m")).collect()}
    got = {r["k"]: r["m"] for r in ranks.quantiles(df, ["k"], "x", {"m": 0.5}, rows=len(rows)).collect()}
    assert got == want


@pytest.mark.parametrize("higher", [False, True])
def test_few_groups_give_the_quantiles_of_the_ordered_pass(spark, small_chunks, higher):
    df, wanted = spark.createDataFrame(groups(), "k string, x double"), {"low": 0.0, "q": 0.17, "m": 0.5, "high": 1.0}
    found = [{r["k"]: [repr(r[n]) for n in wanted] for r in ranks.quantiles(df, ["k"], "x", wanted, higher=higher, few=few).collect()} for few in (False, True)]
    assert found[0] == found[1] and set(found[1]) == {"a", "b", "d", "e", "f", None}


def test_few_groups_order_only_the_bins_of_the_ranks(spark, small_chunks, monkeypatch):
    ordered, running = [], ranks.running
    monkeypatch.setattr(ranks, "running", lambda df, *args, **more: ordered.append(df.count()) or running(df, *args, **more))
    df = spark.range(20_000).select(F.lit(0).alias("k"), (F.col("id") * 1.0).alias("x"))
    assert ranks.quantiles(df, ["k"], "x", {"m": 0.5}, few=True).first()["m"] == 9999.5
    assert scaling.fit_one(df, "x", rule="relative")[0] == 9999.5
    assert max(ordered) <= 20
