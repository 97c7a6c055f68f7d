"""Classifiers, regressors, density ratios and curve surrogates on pyspark.ml and normal equations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell import session
from tracewell.functions.basis import Basis, fit_basis
from tracewell.functions.scalars import clip, hash_draw
from tracewell.functions.spectral import fourier_decode
from tracewell.operators import logistic
from tracewell.operators.ranks import quantiles

DOUBLES = T.ArrayType(T.DoubleType())
#: Rows for which a task of a boosting round is worth its start.
ROWS_PER_TASK = 50_000


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """n / (2 n_class) per row of a 0/1 label; the counts are two numbers."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("p")).first()
    n, p = float(row["n"]), float(row["p"] or 0.0)
    if p <= 0 or p >= n:
        raise ValueError("both classes are needed")
    return df.withColumn(name, F.when(F.col(label) == 1, n / (2 * p)).otherwise(n / (2 * (n - p))))


def classifier(kind: str, features: Sequence[str], label: str, *, seed: int = 711, size: int = 50) -> Pipeline:
    """Boosted trees or a random forest on scaled columns, with a weight column."""
    assemble = VectorAssembler(inputCols=list(features), outputCol="_raw")
    scale = StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True)
    common = {"featuresCol": "_features", "labelCol": label, "weightCol": "weight"}
    if kind == "boosted":
        last = GBTClassifier(maxIter=size, maxDepth=4, stepSize=0.06, minInstancesPerNode=5, seed=seed, **common)
    elif kind == "forest":
        last = RandomForestClassifier(numTrees=size, maxDepth=8, minInstancesPerNode=5, seed=seed, **common)
    else:
        raise ValueError(f"unknown classifier: {kind}")
    return Pipeline(stages=[assemble, scale, last])


def logistic_scores(train: DataFrame, df: DataFrame, features: Sequence[str], label: str, *, strength: float = 1.0, name: str = "score") -> DataFrame:
    """Margin of a scaled logistic regression with a weight column, penalty as 1 / (2 C)."""
    columns = [F.col(f).cast("double") for f in features]
    model = logistic.fit_path(logistic.stage(train, columns, label, "weight"), [strength])[logistic.ALL, float(strength)]
    return df.withColumn(name, model.margin(columns))


def classifier_scores(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    """Raw margin of the positive class."""
    out = model.transform(df).withColumn(name, vector_to_array("rawPrediction")[1])
    return out.select(*df.columns, name)


def multi_target(kind: str, train: DataFrame, features: Sequence[str], targets: Sequence[str], *, seed: int = 42,
                 size: int = 50, rows: int | None = None):
    """Fit one baseline per target and return a function that adds p_<target> columns."""
    if kind == "median":
        long = train.select(F.lit(0).alias("_k"), *[F.col(x).cast("double").alias(x) for x in targets]).unpivot(["_k"], list(targets), "t", "v")
        mid = {r["t"]: r["m"] for r in quantiles(long, ["t"], "v", {"m": 0.5}, rows=rows, few=True).collect()}  # one row per target
        return lambda df: df.withColumns({f"p_{x}": F.lit(float(mid[x])) for x in targets})
    cells, center, spread = _cells(train, features, targets)
    scaled = [((F.col(f).cast("double") - F.lit(center[f])) * F.lit(1.0 / spread[f] if spread[f] > 0 else 0.0)).alias(f"_z{i}") for i, f in enumerate(features)]
    assemble = VectorAssembler(inputCols=[f"_z{i}" for i in range(len(features))], outputCol="_features")
    ready, fitted = assemble.transform(cells.select("*", *scaled)).persist(), {}
    for x in targets:
        own = ready.filter(F.col(f"_n_{x}") > 0).select("_features", F.col(f"_n_{x}").cast("double").alias("_w"), F.col(f"_m_{x}").alias(x), f"_q_{x}")
        if kind == "ridge":
            n, q, m, mm = own.agg(F.sum("_w"), F.sum(f"_q_{x}"), F.sum(F.col("_w") * F.col(x)), F.sum(F.col("_w") * F.col(x) * F.col(x))).first()
            # the penalty is divided by the deviation of the labels, which is smaller among means than among rows
            among, all_rows = math.sqrt(max(mm / n - (m / n) ** 2, 0.0)), math.sqrt(max(q / n - (m / n) ** 2, 0.0))
            est = LinearRegression(featuresCol="_features", labelCol=x, weightCol="_w", predictionCol=f"p_{x}", elasticNetParam=0.0,
                                   regParam=(among / all_rows if among > 0 and all_rows > 0 else 1.0) / n, standardization=False)
        elif kind == "boosted":
            est = GBTRegressor(featuresCol="_features", labelCol=x, weightCol="_w", predictionCol=f"p_{x}", maxIter=size, maxDepth=5, stepSize=0.08, seed=seed)
        else:
            raise ValueError(f"unknown regressor: {kind}")
        fitted[x] = est.fit(own)
    ready.unpersist()

    def apply(df: DataFrame) -> DataFrame:
        out = assemble.transform(df.select("*", *scaled))
        for x in targets:
            out = fitted[x].transform(out)
        return out.select(*df.columns, *[f"p_{x}" for x in targets])

    return apply


def _cells(train: DataFrame, features: Sequence[str], targets: Sequence[str]) -> tuple[DataFrame, dict[str, float], dict[str, float]]:
    """Rows of equal features as one, with count ``_n_``, mean ``_m_`` and sum of squares ``_q_`` of each target; means and sample deviations of the features.

    Squared errors of a function of the features depend on nothing else, so weighted fits of the cells are those of all rows.
    Rows without a value of a target don't count for it.
    """
    y = {x: F.col(x).cast("double") for x in targets}
    cells = train.groupBy(*[F.col(f).cast("double").alias(f) for f in features]).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(v).alias(f"_n_{x}") for x, v in y.items()], *[F.avg(v).alias(f"_m_{x}") for x, v in y.items()],
        *[F.sum(v * v).alias(f"_q_{x}") for x, v in y.items()])
    cells = session.landed(cells, "cells")
    total = cells.agg(F.sum("_n"), *[F.sum(F.col("_n") * F.col(f)) for f in features]).first()
    center = {f: v / total[0] for f, v in zip(features, total[1:])}
    squares = cells.agg(*[F.sum(F.col("_n") * F.pow(F.col(f) - F.lit(center[f]), F.lit(2))) for f in features]).first()
    return cells, center, {f: math.sqrt(v / max(total[0] - 1, 1)) for f, v in zip(features, squares)}


def residual_boosters(train: DataFrame, features: Sequence[str], residual: str, weight: str, *, rounds: int = 200, seed: int = 711):
    """Boosted trees on the residual of another model."""
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # the rounds' lineage ends at checkpoints
        context.setCheckpointDir(session.shared_folder(train.sparkSession))
    assemble = VectorAssembler(inputCols=list(features), outputCol="_features")
    est = GBTRegressor(featuresCol="_features", labelCol=residual, weightCol=weight, predictionCol="_boost", maxIter=rounds,
                       stepSize=0.05, maxDepth=4, minInstancesPerNode=50, seed=seed)
    ready = train.select(*features, residual, weight).persist()
    # a round is several passes, so small tables go to few tasks
    model = Pipeline(stages=[assemble, est]).fit(ready.coalesce(max(1, math.ceil(ready.count() / ROWS_PER_TASK))))
    ready.unpersist()
    return model


@dataclass
class DensityRatio:
    """Target over source density from a balanced quadratic domain classifier; ``losses`` are those of all strengths."""

    features: list[str]
    model: logistic.LogisticModel
    clip: float
    losses: dict[float, float]

    @property
    def strength(self) -> float:
        return self.model.strength

    @classmethod
    def fit(cls, source: DataFrame, target: DataFrame, features: Sequence[str], row_id: str, *,
            strengths: Sequence[float] = (1e-4, 1e-3, 1e-2, 1e-1, 1.0), folds: int = 3, seed: int = 711, limit: float = 30.0) -> DensityRatio:
        """All folds and strengths share their passes; the smallest held-out loss wins, the stronger penalty on ties."""
        cols = [row_id, *features]
        both = source.select(*cols, F.lit(0.0).alias("domain")).unionByName(target.select(*cols, F.lit(1.0).alias("domain")))
        fold = hash_draw(F.lit(seed), "domain", row_id) % folds
        data = logistic.stage(balanced_weights(both, "domain"), quadratic_terms(features), "domain", "weight", fold)
        losses = logistic.held_out_losses(data, logistic.fit_path(data, strengths, list(range(folds))))
        best = min(sorted(losses), key=losses.get)
        return cls(list(features), logistic.fit_path(data, [best])[logistic.ALL, best], limit, losses)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("log_ratio", self.model.margin(quadratic_terms(self.features)))
        return out.withColumn("ratio", F.exp(clip("log_ratio", -self.clip, self.clip)))


def quadratic_terms(features: Sequence[str]) -> list[Column]:
    """The columns, then all products of two of them."""
    x = [F.col(f).cast("double") for f in features]
    return x + [x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))]


@dataclass
class CurveSurrogate:
    """Quadratic ridge from design parameters to Fourier coordinates, decoded to whole curves."""

    parameters: list[str]
    basis: Basis
    coef: np.ndarray
    positions: int

    @classmethod
    def fit_grid(cls, df: DataFrame, parameters: Sequence[str], curve: str, *, alphas: Sequence[float], retained: int = 11,
                 positions: int = 64) -> list[CurveSurrogate]:
        """One surrogate per penalty from one pass: they share the cross products."""
        sums, shape = _surrogate_sums(df.withColumn("_fold", F.lit(0)), parameters, curve, retained)
        return _surrogates(sums[0], shape, list(parameters), alphas, retained, positions)

    def transform(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        basis, coef = self.basis, self.coef

        @F.pandas_udf(DOUBLES)
        def code(x: pd.Series) -> pd.Series:
            if x.empty:
                return pd.Series([], dtype=object)
            return pd.Series(list(coef[0] + basis.expand(np.stack(x.to_numpy()).astype(float)) @ coef[1:]))

        coded = df.withColumn("_code", code(F.array(*[F.col(p).cast("double") for p in self.parameters])))
        return coded.withColumn(name, fourier_decode("_code", F.lit(self.positions))).drop("_code")


def _surrogate_sums(df: DataFrame, parameters: Sequence[str], curve: str, retained: int) -> tuple[dict[int, np.ndarray], Basis]:
    """Cross products of [1, quadratic terms, Fourier coordinates] per fold, in one rough common scaling."""
    x = [F.col(p).cast("double") for p in parameters]
    row = df.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(v) for v in x]).alias("s"), F.array(*[F.sum(v * v) for v in x]).alias("q"),
                 F.array(*[F.min(v) for v in x]).alias("l"), F.array(*[F.max(v) for v in x]).alias("h")).first()
    shape = fit_basis("quadratic", row["n"], *[np.array(row[k]) for k in "sqlh"])

    def partial(batches):
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            fold = pdf["_fold"].to_numpy()
            for f in np.unique(fold):
                part = pdf[fold == f]
                b = shape.expand(np.stack(part["x"].to_numpy()).astype(float))
                y = np.fft.rfft(np.stack(part["y"].to_numpy()).astype(float), axis=1)[:, :retained]
                m = np.hstack([np.ones((len(b), 1)), b, y.real, y[:, 1:].imag])
                held[int(f)] = held.get(int(f), 0.0) + m.T @ m
        for f, m in held.items():
            yield pd.DataFrame({"f": f, "p": np.arange(m.size), "v": m.ravel()})

    rows = df.select("_fold", F.array(*x).alias("x"), F.col(curve).alias("y"))
    cells = rows.mapInPandas(partial, "f int, p int, v double").groupBy("f", "p").agg(F.sum("v").alias("v"))
    table = cells.toPandas()  # (1 + terms + coordinates)^2 cells per fold
    out = {}
    for f, part in table.groupby("f"):
        width = math.isqrt(len(part))
        g = np.zeros(len(part))
        g[part["p"].to_numpy()] = part["v"].to_numpy()
        out[int(f)] = g.reshape(width, width)
    return out, shape


def _surrogates(g: np.ndarray, shape: Basis, parameters: list[str], alphas: Sequence[float], retained: int, positions: int) -> list[CurveSurrogate]:
    """Ridge solutions in the scaling of the summed rows themselves.

    Means and deviations of these rows follow from the sums. The quadratic terms in the new scaling are
    linear in the old ones, so their cross products are a congruence of the old block.
    """
    d, k = len(shape.axes), 2 * retained - 1
    i, j = np.triu_indices(d)
    p, n = d + len(i), g[0, 0]
    mean = g[0, 1:1 + d] / n
    square = np.array([g[0, 1 + d + int(np.flatnonzero((i == a) & (j == a))[0])] for a in range(d)]) / n
    spread = np.sqrt(np.maximum(square - mean ** 2, 0.0))
    spread = np.where(spread > 0, spread, 1.0)
    a, b = 1.0 / spread, -mean / spread
    t = np.zeros((1 + p + k, 1 + p + k))
    t[0, 0] = 1.0
    t[1 + p:, 1 + p:] = np.eye(k)
    for axis in range(d):
        t[1 + axis, [0, 1 + axis]] = b[axis], a[axis]
    for row, (u, v) in enumerate(zip(i, j), start=1 + d):
        t[row, row] = a[u] * a[v]
        t[row, 1 + u] += a[u] * b[v]
        t[row, 1 + v] += a[v] * b[u]
        t[row, 0] = b[u] * b[v]
    g = t @ g @ t.T
    center = g[0] / n
    moved = g - n * np.outer(center, center)
    basis = Basis("quadratic", shape.axes, shape.mean + shape.scale * mean, shape.scale * spread)
    out = []
    for alpha in alphas:
        beta = np.linalg.solve(moved[1:1 + p, 1:1 + p] + alpha * np.eye(p), moved[1:1 + p, 1 + p:])
        out.append(CurveSurrogate(parameters, basis, np.vstack([center[1 + p:] - center[1:1 + p] @ beta, beta]), positions))
    return out


def select_surrogate(df: DataFrame, parameters: Sequence[str], curve: str, row_id: str, *, alphas: Sequence[float], folds: int = 3,
                     seed: int = 711, retained: int = 11, positions: int = 64) -> DataFrame:
    """K-fold curve error of every penalty with the smallest one flagged, the first on ties.

    One pass sums every fold, the training sums of a fold are the total minus its own, and one more
    pass scores each row under all penalties of the models that did not see it.
    """
    data = df.select(row_id, *parameters, curve).withColumn("_fold", (hash_draw(F.lit(seed), row_id) % folds).cast("int"))
    sums, shape = _surrogate_sums(data, parameters, curve, retained)
    total = sum(sums.values())
    fitted = {f: _surrogates(total - g, shape, list(parameters), alphas, retained, positions) for f, g in sums.items()}

    @F.pandas_udf(DOUBLES)
    def errors(fold: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        if x.empty:
            return pd.Series([], dtype=object)
        rows, truth, which = np.stack(x.to_numpy()).astype(float), np.stack(y.to_numpy()).astype(float), fold.to_numpy()
        out = np.zeros((len(rows), 2 * len(alphas)))
        for f, candidates in fitted.items():
            at = which == f
            for c, m in enumerate(candidates):
                code = m.coef[0] + m.basis.expand(rows[at]) @ m.coef[1:]
                spec = np.zeros((len(code), positions // 2 + 1), dtype=complex)
                spec[:, :retained] = code[:, :retained]
                spec[:, 1:retained] += 1j * code[:, retained:]
                e = np.abs(np.fft.irfft(spec, n=positions, axis=1) - truth[at])
                out[at, 2 * c], out[at, 2 * c + 1] = e.mean(axis=1), e.max(axis=1)
        return pd.Series(list(out))

    scored = data.select("_fold", errors("_fold", F.array(*[F.col(p).cast("double") for p in parameters]), curve).alias("e"))
    cells = [F.struct(F.lit(c).alias("candidate"), F.lit(float(v)).alias("alpha"), F.col("e")[2 * c].alias("mae"),
                      F.col("e")[2 * c + 1].alias("peak")) for c, v in enumerate(alphas)]
    per_fold = scored.select("_fold", F.inline(F.array(*cells))).groupBy("candidate", "alpha", "_fold").agg(
        F.avg("mae").alias("mae"), F.avg("peak").alias("peak"))
    table = per_fold.groupBy("candidate", "alpha").agg(F.avg("mae").alias("cv_mae"), F.avg("peak").alias("cv_max_error"))
    best = Window.partitionBy(F.lit(0))  # one row per penalty
    return table.withColumn("selected", F.struct("cv_mae", "candidate") == F.min(F.struct("cv_mae", "candidate")).over(best))
