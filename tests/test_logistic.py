"""Newton fits of all folds and strengths against a plain numpy fit, and the density ratio they select."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.operators import logistic, models


def plain(x, y, w, c):
    """Newton to the end on standardised columns; returns coefficients in raw units."""
    mean, spread = x.mean(0), x.std(0)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / spread])
    ridge, b = np.diag([0.0] + [1.0] * x.shape[1]), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve(c * (z * (w * p * (1 - p))[:, None]).T @ z + ridge, c * z.T @ (w * (y - p)) - ridge @ b)
    return b[1:] / spread, b[0] - (b[1:] / spread) @ mean


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3)) * [1, 5, 0.1] + [3, 0, -2]
    y = (rng.uniform(size=600) < 1 / (1 + np.exp(-(x[:, 0] - 3 + 0.3 * x[:, 1])))).astype(float)
    w = np.where(y == 1, 2.0, 0.5)
    pdf = pd.DataFrame(x, columns=list("abc")).assign(y=y, w=w, f=np.arange(600) % 3)
    df = spark.createDataFrame(pdf).repartition(4)
    gap = df.limit(2).withColumn("b", F.lit(None).cast("double"))
    return df.unionByName(gap), x, y, w


def test_all_folds_and_strengths_equal_numpy(rows):
    df, x, y, w = rows
    data = logistic.stage(df, [F.col(c) for c in "abc"], "y", "w", F.col("f"))
    strengths = [1e-4, 1e-2, 1.0]
    found = logistic.fit_path(data, strengths, [0, 1, 2, logistic.ALL])
    fold = np.arange(600) % 3
    for (f, c), m in found.items():
        use = fold != f
        coef, intercept = plain(x[use], y[use], w[use], c)
        assert m.converged and np.allclose(m.coef, coef, atol=1e-6) and abs(m.intercept - intercept) < 1e-5
    losses = logistic.held_out_losses(data, {k: m for k, m in found.items() if k[0] != logistic.ALL})
    for c in strengths:
        want = []
        for f in range(3):
            margin = x[fold == f] @ found[f, c].coef + found[f, c].intercept
            wf = w[fold == f]
            want.append((wf * (np.logaddexp(0, margin) - y[fold == f] * margin)).sum() / wf.sum())
        assert abs(losses[c] - np.mean(want)) < 1e-9


def test_separable_rows_still_settle(spark):
    df = spark.createDataFrame([(float(i), float(i > 4)) for i in range(10)], "x double, y double")
    model = logistic.fit_path(logistic.stage(df, [F.col("x")], "y"), [1e6])[logistic.ALL, 1e6]
    assert model.converged and model.coef[0] > 0 and -5.2 < model.intercept / model.coef[0] < -3.8


def test_density_ratio_follows_the_true_one(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=4000), rng.normal(size=4000) * 0.7 + 0.5
    source = spark.createDataFrame(pd.DataFrame({"x": a, "id": np.arange(4000)}))
    target = spark.createDataFrame(pd.DataFrame({"x": b, "id": np.arange(4000)}))
    model = models.DensityRatio.fit(source, target, ["x"], "id")
    assert set(model.losses) == {1e-4, 1e-3, 1e-2, 1e-1, 1.0} and model.losses[model.strength] == min(model.losses.values())
    got = model.transform(source.filter("abs(x) < 1.5")).toPandas()
    true = -np.log(0.7) - (got.x - 0.5) ** 2 / (2 * 0.49) + got.x ** 2 / 2
    assert np.abs(got.log_ratio - true).mean() < 0.15
