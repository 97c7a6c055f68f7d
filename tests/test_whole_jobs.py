"""Forecasts to the end of every profile, fits that read rows of equal features once, and boosting of all rounds."""

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from tracewell import plans
from tracewell.operators import models, thermal


def profile(spark, lengths):
    rng = np.random.default_rng(3)
    rows = [(p, i, *rng.normal(20, 3, 2).tolist(), *rng.random(5).tolist(), *rng.normal(40, 2, 3).tolist()) for p, n in enumerate(lengths) for i in range(n)]
    names = ["profile_id", "idx", "coolant", "ambient", *thermal.LOSSES, *thermal.NODES]
    return spark.createDataFrame(pd.DataFrame(rows, columns=names)), pd.DataFrame(rows, columns=names)


def test_horizons_reach_the_end_of_each_profile(spark):
    df, pdf = profile(spark, [4, 5, 9, 30])
    h = thermal.horizon_rows(df, "profile_id", "idx", start=4)
    coef = np.full((3, 9), 0.03)
    shift = np.array([0.1, 0.0, -0.1])
    c, i = thermal.constant_model(coef, shift)
    found = {r["profile_id"]: r for r in thermal.rollout(h.withColumn("coef", c).withColumn("intercept", i)).collect()}
    assert sorted(found) == [1, 2, 3]
    for p, r in found.items():
        own = pdf[pdf.profile_id == p].sort_values("idx")
        t, u = own[list(thermal.NODES)].to_numpy(), own[["coolant", "ambient", *thermal.LOSSES]].to_numpy()
        s, want = t[3].copy(), []
        for step in range(4, len(own)):
            moved = [s[n] + coef[n] @ np.array([*[s[o] - s[n] for o in range(3) if o != n], u[step, 0] - s[n], u[step, 1] - s[n], *u[step, 2:]]) + shift[n] for n in range(3)]
            s = np.array(moved)
            want.append(s)
        assert np.allclose(np.array(r["prediction"]).reshape(-1, 3), want) and np.allclose(np.array(r["truth"]).reshape(-1, 3), t[4:])


def test_cells_fit_what_all_rows_fit(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 9, 3000), rng.integers(0, 5, 3000)
    pdf = pd.DataFrame({"a": a.astype(float), "b": b.astype(float), "y": a * b + rng.normal(0, 4, 3000)})
    df = spark.createDataFrame(pdf)
    read = []
    for kind in (GBTRegressor, LinearRegression):
        fit = kind.fit
        monkeypatch.setattr(kind, "fit", lambda self, d, *more, fit=fit: read.append(d.count()) or fit(self, d, *more))
    z = [((F.col(c) - F.lit(pdf[c].mean())) / F.lit(pdf[c].std())).alias(f"z{c}") for c in "ab"]
    ready = VectorAssembler(inputCols=["za", "zb"], outputCol="_features").transform(df.select("*", *z))
    plain = {"ridge": LinearRegression(featuresCol="_features", labelCol="y", regParam=1 / 3000, elasticNetParam=0.0, standardization=False),
             "boosted": GBTRegressor(featuresCol="_features", labelCol="y", maxIter=5, maxDepth=5, stepSize=0.08, seed=42)}
    for kind, est in plain.items():
        want = [r["prediction"] for r in est.fit(ready).transform(ready).orderBy("a", "b", "y").collect()]
        read.clear()
        got = [r["p_y"] for r in models.multi_target(kind, df, ["a", "b"], ["y"], size=5)(df).orderBy("a", "b", "y").collect()]
        assert np.allclose(got, want, rtol=0, atol=1e-9)
        assert read == [45]


def test_residual_boosting_runs_all_rounds(spark, sf, monkeypatch):
    """The query asks for as many rounds as the operator's default, of which the test lets two run."""
    asked = []

    class Short(GBTRegressor):
        def _fit(self, dataset):
            asked.append(self.getMaxIter())
            return super()._fit(dataset) if self.getMaxIter() <= 2 else self.copy({self.maxIter: 2})._fit(dataset)

    monkeypatch.setattr(models, "GBTRegressor", Short)
    rows = plans.QUERIES["l31_residual_boosting"](spark, sf).collect()
    assert [n for n in asked if n != 2] == [200] * 3 and {r["node"] for r in rows} == set(thermal.NODES)
