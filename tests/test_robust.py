"""Minimum-determinant covariance against concentration steps in numpy."""

import numpy as np
import pandas as pd
import pytest

from tracewell.operators.oneclass import RobustCovariance

NAMES = [f"x{i}" for i in range(5)]


def steps(x, moments, h):
    """Concentration to the end, all rows in memory."""
    size = np.inf
    while True:
        away = np.einsum("ij,jk,ik->i", x, np.linalg.inv(moments), x)
        kept = x[np.argsort(away, kind="stable")[:h]]
        moments = kept.T @ kept / h
        det = np.linalg.slogdet(moments)[1]
        if not size - det > 1e-9:
            return moments, det
        size = det


@pytest.mark.parametrize("nest", [1500, 200])
def test_several_starts_find_the_planted_half(spark, monkeypatch, nest):
    """Outliers have the spread of the clean rows in every column, only not their strong ties, so norms tell nothing."""
    from tracewell.operators import oneclass

    monkeypatch.setattr(oneclass, "NEST", nest)
    rng = np.random.default_rng(4)
    a = np.hstack([rng.normal(size=(2, 3)), np.eye(2)]) * 3
    clean = rng.normal(size=(620, 2)) @ a + rng.normal(size=(620, 5)) * 0.1
    far = rng.normal(size=(380, 5)) * clean.std(axis=0)
    x = np.vstack([clean, far])
    df = spark.createDataFrame(pd.DataFrame(x, columns=NAMES)).repartition(6)
    df = df.unionByName(df.limit(3).withColumn("x2", df["x2"] * float("nan")))
    model = RobustCovariance.fit(df, NAMES, starts=20)
    want, det = steps(x, clean.T @ clean / len(clean), (1000 + 6) // 2)
    assert model.support == 503 and model.converged and model.starts == 11
    assert model.log_det <= det + 1e-6
    again, _ = steps(x, model.raw, model.support)
    assert np.allclose(model.raw, again, atol=1e-9)  # nothing left to concentrate
    assert np.allclose(model.raw, want, atol=0.05 * np.abs(want).max())
    half = np.argsort(np.einsum("ij,jk,ik->i", x, np.linalg.inv(model.raw), x))[:model.support]
    assert (half < 620).mean() > 0.98
    scores = model.score(spark.createDataFrame(pd.DataFrame(x, columns=NAMES).assign(id=np.arange(1000)))).toPandas().sort_values("id")["score"].to_numpy()
    assert np.quantile(scores[620:], 0.05) > np.quantile(scores[:620], 0.99)


def test_every_row_counts_in_few_rows(spark):
    x = np.random.default_rng(1).normal(size=(7, 5))
    model = RobustCovariance.fit(spark.createDataFrame(pd.DataFrame(x, columns=NAMES)), NAMES)
    assert model.support == 6 and np.isfinite(model.matrix).all()
