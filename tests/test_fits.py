"""Fits and detectors against numpy references and invariants."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.functions import basis, spectral
from tracewell.operators import compare, covariance, signal, thermal
from tracewell.operators.conditional import ConditionalResidual
from tracewell.operators.oneclass import IsolationForest, RobustCovariance, _chi2_quantile, path_constant


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 4)) @ np.array([[2, 0, 0, 0], [.5, 1, 0, 0], [0, .3, .7, 0], [.1, 0, 0, 1.5]])
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(id=np.arange(400), e=np.arange(400) % 3)
    return spark.createDataFrame(pdf), pdf


def test_covariance_paths_agree(cloud, monkeypatch):
    df, pdf = cloud
    want = np.cov(pdf[list("abcd")].to_numpy(), rowvar=False)
    for narrow in (16, 2):
        monkeypatch.setattr(covariance, "NARROW", narrow)
        got = covariance.matrices(covariance.sample_covariance(df, [], list("abcd")), [], 4)[()]
        assert np.allclose(got, want)


def test_log_euclidean_mean_of_commuting_matrices():
    a, b = np.diag([1.0, 4.0]), np.diag([4.0, 1.0])
    got = covariance.log_euclidean_mean([a, b], 1e-9)
    assert np.allclose(got, 2 * np.eye(2), atol=1e-6)


def test_shrinkage_matches_published_formula(cloud):
    df, pdf = cloud
    x = pdf[list("abcd")].to_numpy()
    c = x - x.mean(0)
    n, d = x.shape
    s = c.T @ c / n
    mu = np.trace(s) / d
    spread = ((s - mu * np.eye(d)) ** 2).sum() / d
    noise = sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / n / n / d
    w = min(noise, spread) / spread
    _, cov, weight = covariance.shrunk_covariance(df, list("abcd"))
    assert abs(weight - w) < 1e-10
    assert np.allclose(cov, (1 - w) * s + w * mu * np.eye(d))


def test_contributions_sum_to_the_score(cloud):
    df, pdf = cloud
    p = covariance.precision_of(np.cov(pdf[list("abcd")].to_numpy(), rowvar=False))
    row = df.select(covariance.distance(list("abcd"), p).alias("s"), covariance.contributions(list("abcd"), p).alias("parts"), *"abcd").first()
    x = np.array([row[k] for k in "abcd"])
    assert abs(row["s"] - x @ p @ x) < 1e-9
    assert abs(sum(c["contribution"] for c in row["parts"]) - row["s"]) < 1e-9


def test_independent_columns_drop_relations(cloud):
    df, _ = cloud
    wide = df.withColumn("r", F.col("a") + F.col("b")).withColumn("one", F.lit(3.0))
    kept = covariance.independent_columns(wide, ["a", "b", "c", "d", "r", "one"])
    assert len(kept) == 4 and "one" not in kept


def test_nonnegative_solution_is_the_best_subset():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, y = rng.normal(size=(30, 5)), rng.normal(size=30)
        g, b = a.T @ a, a.T @ y
        got = thermal.nonnegative_solution(g, b)
        best = np.inf
        for r in range(6):
            for s in itertools.combinations(range(5), r):
                x = np.zeros(5)
                if s:
                    x[list(s)] = np.linalg.lstsq(a[:, s], y, rcond=None)[0]
                if (x >= 0).all():
                    best = min(best, ((a @ x - y) ** 2).sum())
        assert (got >= 0).all() and abs(((a @ got - y) ** 2).sum() - best) < 1e-8


def test_ridge_from_sums_matches_weighted_ridge(spark):
    rng = np.random.default_rng(4)
    rows = []
    for p, n in ((1, 12), (2, 40)):
        for _ in range(n):
            for node in thermal.NODES:
                rows.append((p, node, [float(v) for v in rng.normal(size=9)], float(rng.normal())))
    df = spark.createDataFrame(rows, "p int, node string, x array<double>, y double")
    coef, intercept = thermal.ridge_from(thermal.pooled(thermal.normal_equations(df, ["p", "node"])), 0.7)
    for i, node in enumerate(thermal.NODES):
        part = [r for r in rows if r[1] == node]
        x, y = np.array([r[2] for r in part]), np.array([r[3] for r in part])
        w = np.array([1 / 12 if r[0] == 1 else 1 / 40 for r in part])
        xm, ym = (w @ x) / w.sum(), (w @ y) / w.sum()
        beta = np.linalg.solve((x - xm).T @ ((x - xm) * w[:, None]) + 0.7 * np.eye(9), (x - xm).T @ ((y - ym) * w))
        assert np.allclose(coef[i], beta) and abs(intercept[i] - (ym - xm @ beta)) < 1e-9


def test_spline_basis_is_a_partition_and_continues_linearly():
    x = np.linspace(-1, 1, 41)
    cols = basis.spline_columns(x, -1.0, 1.0, knots=4, degree=2)
    assert cols.shape == (41, 4)
    assert (cols >= -1e-9).all() and (cols.sum(axis=1) <= 1 + 1e-9).all()
    out = basis.spline_columns(np.array([1.5, 2.0, 2.5]), -1.0, 1.0, knots=4, degree=2)
    assert np.allclose(out[2] - out[1], out[1] - out[0], atol=1e-6)


def test_linear_mean_model_matches_numpy(spark):
    rng = np.random.default_rng(5)
    n = 300
    pdf = pd.DataFrame({"g": np.arange(n) % 10, "u": rng.normal(size=n), "v": rng.normal(size=n) * 3 + 1})
    pdf["y"] = 2 * pdf.u - pdf.v + rng.normal(size=n) * .1
    pdf["w"] = pdf.u + rng.normal(size=n)
    df = spark.createDataFrame(pdf)
    model = ConditionalResidual.fit(df, ["u", "v"], ["y", "w"], "g", mean_model="linear", local_scale=False)
    x = pdf[["u", "v"]].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    y = pdf[["y", "w"]].to_numpy()
    beta = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean(0)))
    assert np.allclose(model.coefs[-1], np.vstack([y.mean(0), beta]))
    scores = model.score(df.withColumn("y", F.col("y") + F.when(F.col("g") == 3, 5.0).otherwise(0.0))).toPandas()
    assert scores.score[scores.g == 3].min() > scores.score[scores.g != 3].median() * 5


@pytest.mark.parametrize("kind,local", [("constant", False), ("quadratic", False), ("spline", True)])
def test_mean_models_find_a_shift(spark, kind, local):
    rng = np.random.default_rng(6)
    n = 400
    pdf = pd.DataFrame({"g": np.arange(n) % 8, "u": rng.uniform(-1, 1, n)})
    pdf["y"] = rng.normal(size=n) * .2 + (pdf.u ** 2 if kind != "constant" else 0)
    df = spark.createDataFrame(pdf)
    model = ConditionalResidual.fit(df, ["u"], ["y"], "g", mean_model=kind, local_scale=local)
    base = model.score(df).agg(F.avg("score")).first()[0]
    moved = model.score(df.withColumn("y", F.col("y") + 2)).agg(F.avg("score")).first()[0]
    assert 0.3 < base < 3 and moved > 20 * base


def test_isolation_forest_ranks_outliers_first(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(500, 3)), rng.normal(size=(10, 3)) + 8])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=np.arange(510)))
    forest = IsolationForest.fit(df.filter("id < 500"), list("abc"), "id", trees=40)
    s = forest.score(df).toPandas().sort_values("id").score.to_numpy()
    assert s[500:].min() > np.quantile(s[:500], .98)
    assert ((s > 0) & (s < 1)).all()
    assert abs(float(path_constant(256)) - 10.2448) < 1e-3


def test_robust_covariance_ignores_outliers(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(800, 2)), rng.normal(size=(150, 2)) * .1 + 12])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("ab")))
    m = RobustCovariance.fit(df, ["a", "b"])
    assert np.allclose(m.matrix, np.eye(2), atol=.25)
    assert abs(_chi2_quantile(0.95, 1) - 3.841459) < 1e-5 and abs(_chi2_quantile(0.5, 4) - 3.356694) < 1e-5


def test_signed_rank_p_exact_and_normal(spark):
    d = [1.5, -0.2, 2.3, 0.7, -1.1, 3.0, 0.4]
    df = spark.createDataFrame([(1, v) for v in d], "k int, d double")
    row = compare.signed_ranks(df, ["k"], "d").withColumn(
        "p", compare.wilcoxon_p("ranked", "statistic", "z", F.col("largest_tie") > 1)).first()
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    totals = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=7)]
    w = min(sum(r for r, v in zip(ranks, d) if v > 0), sum(r for r, v in zip(ranks, d) if v < 0))
    assert row["statistic"] == w
    assert abs(row["p"] - min(1.0, 2 * sum(t <= w for t in totals) / 128)) < 1e-12


def test_holm_by_hand(spark):
    df = spark.createDataFrame([(0, i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.9])], "f int, t int, p double")
    got = {r["t"]: r["holm_p"] for r in compare.holm(df, ["f"], "p", "t").collect()}
    assert np.allclose([got[i] for i in range(4)], [0.04, 0.09, 0.09, 0.9])


def test_balanced_sinusoid_features(spark):
    n, rate, f = 200, 2000.0, 100.0
    rows = [(0, i, *(10 * math.sin(2 * math.pi * f * i / rate - p * 2 * math.pi / 3) for p in range(3))) for i in range(n)]
    row = signal.window_features(spark.createDataFrame(rows, "w int, i int, ia double, ib double, ic double"), ["w"], index="i",
                                 size=n, rate=rate).first()
    assert abs(row["fundamental_hz"] - f) < 1e-9
    assert row["sequence_unbalance"] < 1e-3 and row["zero_sequence_rms"] < 1e-9 and row["thd_2_to_5_mean"] < 1e-2
    assert abs(row["rms_a"] - 10 / math.sqrt(2)) < 1e-9 and abs(row["kurtosis_a"] - 1.5) < 1e-9


def test_decimation_removes_an_alias_and_ignores_block_size(spark):
    n, down = 2000, 5
    t = np.arange(n)
    slow, alias = np.sin(2 * np.pi * t / 400), np.sin(2 * np.pi * t * 0.45)
    df = spark.createDataFrame(pd.DataFrame({"r": 1, "i": t, "x": slow + alias + 0.01 * t}))
    out = {b: signal.decimate(df, ["r"], "i", "x", down, block=b).toPandas().sort_values("step") for b in (40, 100_000)}
    assert len(out[40]) == n // down and np.allclose(out[40]["value"], out[100_000]["value"])
    inner = out[40]["value"].to_numpy()[20:-20]
    assert np.abs(inner - (slow + 0.01 * t)[::down][20:-20]).max() < 0.02
    taps = np.array(spectral.lowpass_taps(down))
    assert abs(taps.sum() - 1) < 1e-12 and np.allclose(taps, taps[::-1])


def test_surrogate_selection_matches_refits(spark):
    from tracewell.operators import models

    rng = np.random.default_rng(10)
    n, pos = 240, 24
    x = rng.uniform(-2, 3, size=(n, 3))
    grid = np.arange(pos) * 2 * np.pi / pos
    y = 5 + x[:, [0]] * np.cos(grid) + (x[:, [1]] * x[:, [2]]) * np.sin(2 * grid) + rng.normal(size=(n, pos)) * .01
    df = spark.createDataFrame([(i, *map(float, x[i]), [float(v) for v in y[i]]) for i in range(n)], "id int, a double, b double, c double, y array<double>")
    alphas = [1e-3, 1e3]
    got = models.select_surrogate(df, ["a", "b", "c"], "y", "id", alphas=alphas, retained=5, positions=pos).toPandas().sort_values("candidate")
    folds = df.select("id", (models.hash_draw(F.lit(711), "id") % 3).alias("f")).toPandas().sort_values("id").f.to_numpy()
    for c, alpha in enumerate(alphas):
        maes = []
        for f in range(3):
            tr, te = folds != f, folds == f
            z = (x - x[tr].mean(0)) / x[tr].std(0)
            i, j = np.triu_indices(3)
            b = np.hstack([z, z[:, i] * z[:, j]])
            spec = np.fft.rfft(y, axis=1)[:, :5]
            code = np.hstack([spec.real, spec[:, 1:].imag])
            bm, cm = b[tr].mean(0), code[tr].mean(0)
            beta = np.linalg.solve((b[tr] - bm).T @ (b[tr] - bm) + alpha * np.eye(9), (b[tr] - bm).T @ (code[tr] - cm))
            p = cm + (b[te] - bm) @ beta
            s = np.zeros((te.sum(), pos // 2 + 1), dtype=complex)
            s[:, :5] = p[:, :5]
            s[:, 1:5] += 1j * p[:, 5:]
            maes.append(np.abs(np.fft.irfft(s, n=pos, axis=1) - y[te]).mean())
        assert abs(got.cv_mae.iloc[c] - np.mean(maes)) < 1e-9
    assert got.selected.tolist() == [True, False]


def test_every_tree_has_its_sample_at_every_size(spark):
    for n in (100, 293, 10_000, 200_000):
        df = spark.range(n).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"))
        forest = IsolationForest.fit(df, ["a", "b"], "id", trees=20)
        roots = forest.nodes[forest.nodes["depth"] == 0]
        assert len(roots) == 20 and set(roots["size"]) == {min(256, n)} == {forest.sample}


def test_prior_grid_equals_projected_descent(spark):
    """Every (ridge, penalty) cell against a slow solver; warm starts must not change a solution."""
    rng = np.random.default_rng(12)
    d = len(thermal.FEATURES)
    prior = np.abs(rng.normal(size=(len(thermal.NODES), d)))
    rows, made = [], {}
    for p in range(3):
        for n in thermal.NODES:
            x = rng.normal(size=(40, d))
            y = x @ rng.normal(size=d) + rng.normal(size=40)
            made[p, n] = x, y
            rows.append((p, n, 40, (x.T @ x)[np.triu_indices(d)].tolist(), (x.T @ y).tolist()))
    df = spark.createDataFrame(rows, "profile_id int, node string, n long, g array<double>, b array<double>")
    ridges, penalties = (0.0, 0.1), (0.0, 0.01, 1.0)
    got = thermal.nonnegative_grid(df, prior, ridges, penalties).collect()
    assert len(got) == 3 * len(thermal.NODES) * 6
    for r in got:
        x, y = made[r["profile_id"], r["node"]]
        a = x.T @ x / 40 + (r["ridge"] + r["penalty"]) * np.eye(d)
        b = x.T @ y / 40 + r["penalty"] * prior[thermal.NODES.index(r["node"])]
        z, step = np.zeros(d), 1 / np.linalg.eigvalsh(a)[-1]
        for _ in range(20_000):
            z = np.maximum(z - step * (a @ z - b), 0)
        assert np.allclose(r["coef"], z, atol=1e-6)


def test_wide_distances_and_shrinkage_equal_narrow_rules(spark):
    """A table wider than NARROW, against numpy."""
    from tracewell.operators import covariance

    d = 20
    x = np.random.default_rng(11).normal(size=(150, d)) @ np.random.default_rng(12).normal(size=(d, d)) + 3
    names = [f"c{i}" for i in range(d)]
    frame = spark.createDataFrame(x.tolist(), ", ".join(f"{n} double" for n in names))
    location, cov, weight = covariance.shrunk_covariance(frame, names)
    centered = x - x.mean(axis=0)
    plain = centered.T @ centered / len(x)
    level = np.trace(plain) / d
    spread = (plain ** 2).sum() / d - level ** 2
    noise = min((((centered ** 2).sum(axis=1) ** 2).mean() - (plain ** 2).sum()) / (len(x) * d), spread)
    assert np.isclose(weight, noise / spread) and np.allclose(location, x.mean(axis=0))
    assert np.allclose(cov, (1 - weight) * plain + weight * level * np.eye(d))
    precision = covariance.precision_of(cov)
    got = [r[0] for r in frame.select(covariance.distance(names, precision, location)).collect()]
    assert np.allclose(sorted(got), sorted(((centered @ precision) * centered).sum(axis=1)))
