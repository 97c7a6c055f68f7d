"""Many small groups need no ranges, however many rows there are: nothing is written between the source and the result."""

import pytest
from pyspark.sql import functions as F
from test_ordered import as_set

from tracewell import plans
from tracewell.operators import ordered, ranks


def test_small_groups_are_not_split(spark):
    df = spark.range(3000).select((F.col("id") % 100).alias("k"), "id", (F.col("id") * 7 % 13).cast("double").alias("v"))
    kept = {"sums": {"s": F.col("v")}, "lags": {"p": "v"}, "totals": {"t": F.col("v")}}
    few = ordered.running(df, ["k"], ["id"], **kept, rows=3000, limit=100, largest=30)
    assert not few.inputFiles() and as_set(few) == as_set(ordered.running(df, ["k"], ["id"], **kept, rows=3000, limit=5000))
    split = ordered.running(df, ["k"], ["id"], **kept, rows=3000, limit=20, largest=30)
    assert split.inputFiles() and as_set(few) == as_set(split)


@pytest.mark.parametrize("name", ["f7_transition_design", "l30_normal_equations"])
def test_events_are_read_straight(spark, sf, name):
    spark.conf.set("spark.tracewell.rowsPerChunk", "500")
    try:
        seen = plans.QUERIES[name](spark, sf).inputFiles()
    finally:
        spark.conf.unset("spark.tracewell.rowsPerChunk")
    assert seen and all("events.parquet" in f for f in seen)


def test_quantiles_of_small_groups(spark):
    df = spark.range(3000).select((F.col("id") % 100).alias("k"), (F.col("id") * 7 % 13).cast("double").alias("v"))
    spark.conf.set("spark.tracewell.rowsPerChunk", "100")
    try:
        few, many = (ranks.quantiles(df, ["k"], "v", {"m": 0.5}, rows=3000, largest=n) for n in (30, None))
        assert not few.inputFiles() and many.inputFiles() and as_set(few) == as_set(many)
    finally:
        spark.conf.unset("spark.tracewell.rowsPerChunk")
