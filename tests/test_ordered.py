"""Ordered primitives: the chunked plan must equal a plain window, with hot keys and heavy ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.operators import conformal, ordered, ranks


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    n = 3000
    key = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 20, n))
    score = np.where(rng.random(n) < 0.4, 2.0, np.round(rng.normal(size=n), 2))
    pdf = pd.DataFrame({"k": key, "s": score, "i": np.arange(n), "v": rng.integers(0, 9, n).astype(float)})
    return spark.createDataFrame(pdf).cache()


def as_set(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("limit", [100, 10_000])
def test_running_equals_window(skewed, limit):
    w = Window.partitionBy("k").orderBy("s", "i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select("k", "s", "i", "v", (F.row_number().over(w) - 1).alias("pos"),
                         F.sum("v").over(upto).alias("cs"), F.max("v").over(upto).alias("cm"),
                         F.lag("v").over(w).alias("pv"), F.sum("v").over(Window.partitionBy("k")).alias("t"))
    got = ordered.running(skewed, ["k"], ["s", "i"], position="pos", sums={"cs": F.col("v")},
                          maxima={"cm": F.col("v")}, lags={"pv": "v"}, totals={"t": F.col("v")}, limit=limit)
    assert as_set(got.select("k", "s", "i", "v", "pos", "cs", "cm", "pv", "t")) == as_set(want)


@pytest.mark.parametrize("limit", [100, 10_000])
def test_running_takes_text_order_and_ties(skewed, limit):
    """Two order columns of other types, one of them the same in half of the rows."""
    text = skewed.withColumn("o", F.when(F.col("i") % 2 == 0, F.lit("same")).otherwise(F.concat(F.lit("t"), F.col("i"))))
    w = Window.partitionBy("k").orderBy("o", "i")
    want = text.select("k", "i", (F.row_number().over(w) - 1).alias("pos"), F.lag("v").over(w).alias("pv"))
    got = ordered.running(text, ["k"], ["o", "i"], position="pos", lags={"pv": "v"}, limit=limit)
    assert as_set(got.select("k", "i", "pos", "pv")) == as_set(want)


def test_a_split_scan_reads_its_source_twice(spark, skewed, tmp_path):
    """Once for the range bounds and once for the rows; the rest reads the written windows."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    source = skewed.mapInPandas(count, skewed.schema)
    rows = skewed.count()
    out = ordered.running(source, ["k"], ["s", "i"], position="pos", sums={"cs": F.col("v")}, totals={"t": F.col("v")}, rows=rows, limit=100)
    assert out.count() == rows and out.agg(F.max("pos")).first()[0] > 0
    assert seen.value <= 2 * rows


@pytest.mark.parametrize("limit", ["100", "1000000"])
def test_quantiles_match_numpy(spark, skewed, limit):
    spark.conf.set("spark.tracewell.rowsPerChunk", limit)
    try:
        pdf = skewed.toPandas()
        lin = {r[0]: r[1:] for r in ranks.quantiles(skewed, ["k"], "s", {"m": .5, "h": .9}).collect()}
        high = {r[0]: r[1] for r in ranks.quantiles(skewed, ["k"], "s", {"h": .9}, higher=True).collect()}
        for k, g in pdf.groupby("k"):
            assert np.allclose(lin[k], np.quantile(g.s, [.5, .9]))
            assert high[k] == np.quantile(g.s, .9, method="higher")
    finally:
        spark.conf.unset("spark.tracewell.rowsPerChunk")


@pytest.mark.parametrize("limit", ["100", "1000000"])
def test_p_values_match_counting(spark, skewed, limit):
    spark.conf.set("spark.tracewell.rowsPerChunk", limit)
    try:
        got = conformal.p_values(skewed, ["k"], "s", F.col("i") % 2 == 0).toPandas()
        for k, g in got.groupby("k"):
            cal = g.s[g.i % 2 == 0].to_numpy()
            want = (1 + (cal[None, :] >= g.s.to_numpy()[:, None]).sum(1)) / (len(cal) + 1)
            assert np.allclose(g.p_value, want)
        assert len(got) == 3000
    finally:
        spark.conf.unset("spark.tracewell.rowsPerChunk")


def test_threshold_rules(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "k string, s double")
    assert conformal.threshold(df, ["k"], "s", 0.2).first()["threshold"] == 9.0
    assert conformal.threshold(df, ["k"], "s", 0.05).first()["threshold"] == float("inf")
    assert conformal.threshold(df, ["k"], "s", 0.05, overflow="clamp").first()["threshold"] == 10.0


def test_sustained_run_and_trailing_mean(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=400)
    pdf = pd.DataFrame({"k": 1, "i": np.arange(400), "v": v})
    df = spark.createDataFrame(pdf)
    got = ordered.trailing_mean(df, ["k"], "i", F.col("v"), 7, "m", block=50).orderBy("i").toPandas()
    want = pd.Series(v).rolling(7).mean()
    assert np.allclose(got.m.fillna(-9), want.fillna(-9))
    flags = v > -0.5
    best = next(i for i in range(400) if flags[i:i + 6].all() and len(flags[i:i + 6]) == 6)
    assert ordered.first_sustained(df, ["k"], "i", F.col("v") > -0.5, 6).first()["start_index"] == best


def test_asof_both_directions(spark):
    rng = np.random.default_rng(3)
    q = pd.DataFrame({"k": 1, "id": np.arange(200), "t": np.round(rng.random(200), 2)})
    p = pd.DataFrame({"k": 1, "t": np.round(rng.random(60), 2), "v": rng.random(60)}).drop_duplicates("t")
    for direction in ("backward", "forward"):
        got = ordered.asof(spark.createDataFrame(q), spark.createDataFrame(p), ["k"], at="t", value="v",
                           direction=direction, id_cols=["id"]).toPandas().sort_values("id")
        want = pd.merge_asof(q.sort_values("t"), p.sort_values("t"), on="t", by="k", direction=direction)
        want = want.sort_values("id")
        assert np.allclose(got.matched.fillna(-1).astype(float), want.v.fillna(-1))


def test_weighted_quantiles_match_search(spark):
    rng = np.random.default_rng(4)
    s, w, tw = np.round(rng.random(80), 1), rng.random(80), np.append(rng.random(30) * 3, 500.0)
    cal = spark.createDataFrame(pd.DataFrame({"k": 1, "s": s, "w": w}))
    tests = spark.createDataFrame(pd.DataFrame({"k": 1, "id": np.arange(31), "tw": tw}))
    got = conformal.weighted_quantiles(cal, tests, ["k"], score="s", weight="w", test_weight="tw",
                                       id_cols=["id"], alpha=0.1).toPandas().sort_values("id")
    order = np.argsort(s, kind="stable")
    cum = np.cumsum(w[order])
    idx = np.searchsorted(cum, 0.9 * (cum[-1] + tw))
    want = np.where(idx < 80, s[order][np.minimum(idx, 79)], np.inf)
    assert np.array_equal(got.half_width.to_numpy(), want)


def test_auroc_and_average_precision(spark, skewed):
    pdf = skewed.toPandas()
    pos = pdf.v > 5
    p, q = pdf.s[pos].to_numpy(), pdf.s[~pos].to_numpy()
    want = ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))
    one = skewed.withColumn("g", F.lit(1))
    assert abs(ranks.auroc(one, ["g"], "s", F.col("v") > 5).first()["auroc"] - want) < 1e-12
    ap, tp, seen = 0.0, 0, 0
    for value in sorted(pdf.s.unique(), reverse=True):
        hit = pdf.s == value
        tp, seen = tp + (hit & pos).sum(), seen + hit.sum()
        ap += (hit & pos).sum() / pos.sum() * tp / seen
    assert abs(ranks.average_precision(one, ["g"], "s", F.col("v") > 5).first()["auprc"] - ap) < 1e-12
