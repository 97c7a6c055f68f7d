"""Bootstrap by hashed Poisson weights: the law of the weights, the strata and the interval."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tracewell.operators import compare


def test_weights_follow_the_poisson_law():
    w = compare.poisson_weights(np.arange(2000), np.arange(500), 711)
    n = w.size
    for k in range(5):
        p = math.exp(-1) / math.factorial(k)
        assert abs((w == k).mean() - p) < 5 * math.sqrt(p / n)
    assert abs(w.mean() - 1) < 5 / math.sqrt(n) and abs(w.var() - 1) < 0.02
    rows = np.corrcoef(w[:60])
    columns = np.corrcoef(w[:, :60].T)
    assert np.abs(rows - np.eye(60)).max() < 0.2 and np.abs(columns - np.eye(60)).max() < 0.11


def test_means_equal_numpy_in_every_iteration(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 300), "s": rng.integers(0, 4, 300), "id": np.arange(300), "v": rng.normal(size=300)})
    pdf.loc[(pdf.g == 1) & (pdf.s == 3), "s"] = 2
    df = spark.createDataFrame(pdf).withColumn("s", F.when(F.col("s") > 0, F.col("s")))  # a null stratum
    df = df.unionByName(df.limit(4).withColumn("v", F.lit(None).cast("double")))
    got = compare.bootstrap_means(df.repartition(5), ["s"], "v", "id", iterations=200, seed=3, by=["g"]).toPandas()
    for g, part in pdf.groupby("g"):
        want = np.zeros(200)
        for _, stratum in part.groupby("s"):
            w = compare.poisson_weights(np.arange(200), stratum.id.to_numpy(), 3)
            v = stratum.v.to_numpy()
            mean = np.where(w.sum(1) > 0, (w @ v) / np.maximum(w.sum(1), 1), v.mean())
            want += len(v) / len(part) * mean
        assert np.allclose(got[got.g == g].sort_values("iteration")["mean"], want)


def test_interval_agrees_with_resampling(spark):
    """Ten thousand draws against numpy's own resampling with replacement inside strata."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"s": np.repeat([0, 1, 2], 120), "id": np.arange(360)})
    pdf["v"] = pdf.s * 0.5 + rng.normal(size=360) + 0.02
    row = compare.bootstrap_interval(spark.createDataFrame(pdf), ["s"], "v", "id", seed=711).first()
    means = np.mean([rng.choice(part.v.to_numpy(), (10_000, len(part))) for _, part in pdf.groupby("s")], axis=2).mean(axis=0)
    low, high = np.quantile(means, [0.025, 0.975])
    assert abs(row["observed"] - pdf.v.mean()) < 1e-12 and row["n"] == 360
    assert abs(row["ci_low"] - low) < 0.015 and abs(row["ci_high"] - high) < 0.015
    assert row["p_value"] < 0.01
