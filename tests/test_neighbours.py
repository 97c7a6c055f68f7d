"""Nearest neighbours against numpy, by one matrix and by the pivot table."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell import session
from tracewell.operators import neighbours

NAMES = [f"x{i}" for i in range(8)]


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 10
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 8))
    x[:300] = x[0]  # copies
    pdf = pd.DataFrame(x, columns=NAMES).assign(id=[f"r{i:05d}" for i in range(3000)])
    return spark.createDataFrame(pdf).cache(), pdf


@pytest.fixture(params=["400", "100000"])
def limit(spark, request):
    spark.conf.set(session.BROADCAST_ROWS, request.param)
    yield int(request.param)
    spark.conf.unset(session.BROADCAST_ROWS)


def test_several_k_and_text_ids_in_one_search(spark, clusters, limit):
    df, pdf = clusters
    x = pdf[NAMES].to_numpy()
    away = np.sqrt(((x[2700:, None, :] - x[None, :2700, :]) ** 2).sum(-1))
    want, first = np.sort(away, axis=1), away.argmin(axis=1)
    got = neighbours.nearest(df.filter("id >= 'r02700'"), df.filter("id < 'r02700'"), NAMES, k=[1, 5], reference_id="id",
                             distance=["d1", "d5"], neighbour="near").toPandas().sort_values("id")
    assert np.allclose(got["d1"], want[:, 0]) and np.allclose(got["d5"], want[:, 4])
    assert list(got["near"]) == [f"r{i:05d}" for i in first]


def test_incomplete_rows_stay_with_a_flag(spark, clusters, limit):
    df, _ = clusters
    gaps = df.limit(6).withColumn("x3", F.when(F.col("id") < "r00003", F.lit(None)).when(F.col("id") < "r00005", F.lit(float("nan"))).otherwise(F.col("x3")))
    got = neighbours.nearest(gaps, df.unionByName(gaps), NAMES, k=2, distance="d", searched="searched").collect()
    assert len(got) == 6 and sum(r["searched"] for r in got) == 1
    assert all((r["d"] is None) == (not r["searched"]) for r in got)


def test_too_few_and_no_reference_rows(spark, clusters, limit):
    df, _ = clusters
    few = df.filter("id in ('r00400', 'r00500')")
    assert all(np.isinf(r["d"]) for r in neighbours.nearest(df.limit(5), few, NAMES, k=3, distance="d").collect())
    none = neighbours.nearest(df.limit(5), df.filter("false"), NAMES, distance="d", reference_id="id", neighbour="n").collect()
    assert len(none) == 5 and all(np.isinf(r["d"]) and r["n"] is None for r in none)


def test_pivots_spare_most_pairs(spark, clusters):
    df, pdf = clusters
    distinct = neighbours._distinct(df, NAMES, "id")
    points = df.select(*NAMES).distinct()
    n = distinct.count()
    pairs = neighbours.pivot_pairs(points, distinct, NAMES, [1, 5], n, 400, "string")
    assert pairs.count() < 0.1 * n * n


def test_an_equal_distance_shell_is_searched_whole(spark, limit):
    """All reference rows at one distance of the pivot, and every query equally far from all of them."""
    rows = [tuple(float(v) for v in 5 * np.eye(8)[i % 8] * (-1) ** (i // 8)) + (i,) for i in range(16)]
    df = spark.createDataFrame(rows, [*NAMES, "id"])
    many = df
    for i in range(40):
        many = many.unionByName(df.withColumns({f: F.col(f) * (1 + i) for f in NAMES}).withColumn("id", F.col("id") + 16 * (i + 1)))
    zero = spark.createDataFrame([tuple([0.0] * 8)], NAMES)
    got = neighbours.nearest(zero, many, NAMES, k=[1, 33], reference_id="id", distance=["a", "b"], neighbour="n").first()
    assert (got["a"], got["b"], got["n"]) == (5.0, 10.0, 0)


def test_many_dimensions_by_blocks(spark, monkeypatch):
    """Noise in 24 dimensions: no pairs are joined row by row, ties take the smallest id, copies count."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(900, 24)), 1) + 1000.0
    x[:50] = x[0]
    names = [f"x{i}" for i in range(24)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=[f"r{i:05d}" for i in range(900)]))
    monkeypatch.setattr(neighbours, "_pivot_search", None)
    spark.conf.set(session.BROADCAST_ROWS, "100")
    try:
        got = neighbours.nearest(df, df, names, k=[1, 4], reference_id="id", distance=["d1", "d4"], neighbour="near").toPandas().sort_values("id")
    finally:
        spark.conf.unset(session.BROADCAST_ROWS)
    away = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    assert np.allclose(got["d1"], 0) and np.allclose(got["d4"], np.sort(away, axis=1)[:, 3])
    assert list(got["near"]) == [f"r{i:05d}" for i in away.argmin(axis=1)]
