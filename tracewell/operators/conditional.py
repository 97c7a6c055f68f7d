"""Healthy residuals given an operating context, cross-fitted by whole groups.

Fits read the data as sums. Context moments per fold give every fold's basis by subtraction, one
pass of per-partition cross products gives every fold's normal equations, and predictions are row-wise.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell import session
from tracewell.functions.basis import Basis, fit_basis
from tracewell.operators import covariance
from tracewell.operators.ranks import quantiles
from tracewell.operators.roles import group_folds
from tracewell.operators.scaling import robust_parameters

ALL = -1


def _bases(df: DataFrame, context: Sequence[str], kind: str, folds: int) -> dict[int, Basis]:
    """One basis per left-out fold and one for all rows, from one aggregation by fold."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(context):
        x = F.col(c).cast("double")
        aggs += [F.sum(x).alias(f"s{i}"), F.sum(x * x).alias(f"q{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
    rows = {r["fold"]: r for r in df.groupBy("fold").agg(*aggs).collect()}  # one row per fold
    d, out = range(len(context)), {}
    for left in [*range(folds), ALL]:
        use = [r for f, r in rows.items() if f != left]
        out[left] = fit_basis(kind, sum(r["n"] for r in use), np.array([sum(r[f"s{i}"] for r in use) for i in d]),
                              np.array([sum(r[f"q{i}"] for r in use) for i in d]), np.array([min(r[f"l{i}"] for r in use) for i in d]),
                              np.array([max(r[f"h{i}"] for r in use) for i in d]))
    return out


def _coefficients(df: DataFrame, context: Sequence[str], targets: Sequence[str], bases: dict[int, Basis],
                  alpha: float, folds: int) -> dict[int, np.ndarray]:
    """Ridge coefficients, intercept first, per left-out fold and for all rows.

    Each task adds up [1, basis, targets] cross products for every model a row trains, so the result
    of the pass is a handful of small blocks whatever the number of rows.
    """
    ctx, out_cols = list(context), list(targets)

    def partial(batches):
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            x, y, fold = pdf[ctx].to_numpy(float), pdf[out_cols].to_numpy(float), pdf["fold"].to_numpy()
            for left, basis in bases.items():
                keep = fold != left
                if keep.any():
                    m = np.hstack([np.ones((int(keep.sum()), 1)), basis.expand(x[keep]), y[keep]])
                    held[left] = held.get(left, 0.0) + m.T @ m
        if held:
            yield pd.DataFrame({"model": list(held), "g": [b.ravel() for b in held.values()]})

    blocks = df.select("fold", *[F.col(c).cast("double").alias(c) for c in [*ctx, *out_cols]]).mapInPandas(partial, "model int, g array<double>")
    cells = blocks.select("model", F.posexplode("g").alias("p", "v")).groupBy("model", "p").agg(F.sum("v").alias("v"))
    sums: dict[int, dict[int, float]] = {}
    for r in cells.collect():  # (basis + targets)^2 cells per model
        sums.setdefault(r["model"], {})[r["p"]] = r["v"]
    found = {}
    for left, cell in sums.items():
        width = int(round(len(cell) ** 0.5))
        g = np.array([cell[i] for i in range(width * width)]).reshape(width, width)
        q = len(out_cols)
        p = width - 1 - q
        n, mean = g[0, 0], g[0] / g[0, 0]
        centered = g - n * np.outer(mean, mean)
        beta = np.zeros((p, q))
        if p:
            a = centered[1:1 + p, 1:1 + p]
            beta = np.linalg.solve(a + alpha * np.eye(p), centered[1:1 + p, 1 + p:])
        found[left] = np.vstack([mean[1 + p:] - mean[1:1 + p] @ beta, beta])
    return found


def _predict(df: DataFrame, context: Sequence[str], bases: dict[int, Basis], coefs: dict[int, np.ndarray], model: str, name: str) -> DataFrame:
    """Add the struct ``name`` with one field p0, p1, ... per outcome."""
    fields = [f"p{i}" for i in range(next(iter(coefs.values())).shape[1])]

    @F.pandas_udf(", ".join(f"{f} double" for f in fields))
    def guess(x: pd.DataFrame) -> pd.DataFrame:
        rows, w = x.iloc[:, 1:].to_numpy(float), x.iloc[:, 0].to_numpy()
        out = np.zeros((len(rows), len(fields)))
        for left, basis in bases.items():
            at = w == left
            if at.any():
                out[at] = coefs[left][0] + basis.expand(rows[at]) @ coefs[left][1:]
        return pd.DataFrame(out, columns=fields)

    return df.withColumn(name, guess(F.struct(F.expr(model).alias("model"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(context)])))


@dataclass
class ConditionalResidual:
    """Fitted detector: mean model, residual center and scale, optional local scale, shrunk geometry."""

    context: list[str]
    outcomes: list[str]
    bases: dict[int, Basis]
    coefs: dict[int, np.ndarray]
    center: np.ndarray
    scale: np.ndarray
    local: tuple[dict[int, Basis], dict[int, np.ndarray]] | None
    clip: tuple[float, float]
    location: np.ndarray
    precision: np.ndarray
    shrinkage: float

    @classmethod
    def fit(cls, df: DataFrame, context: Sequence[str], outcomes: Sequence[str], group: str, *, mean_model: str = "spline",
            local_scale: bool = True, splits: int = 5, alpha: float = 1.0, clip: tuple[float, float] = (0.25, 4.0),
            rows: int | None = None) -> ConditionalResidual:
        context, outcomes = list(context), list(outcomes)
        folds = group_folds(df, group, splits, rows=rows)
        data = session.join_null_safe(df.select(group, *context, *outcomes), folds, [group])
        bases = _bases(data, context, mean_model, splits)
        medians = None
        if mean_model == "constant" or not bases[ALL].axes:
            medians = cls._fold_medians(data, outcomes, splits, rows)
        coefs = medians or _coefficients(data, context, outcomes, bases, alpha, splits)
        oof = _predict(data, context, bases, coefs, "fold", "_p")
        res = [f"_r{i}" for i in range(len(outcomes))]
        oof = oof.withColumns({r: F.col(o) - F.col("_p")[f"p{i}"] for i, (r, o) in enumerate(zip(res, outcomes))})
        # several fits below read the out-of-fold residuals, so they are computed once
        oof = oof.select("fold", *context, *res).persist()
        params = cls._robust(oof, res, rows, "centered")
        center = np.array([params[r][0] for r in res])
        scale = np.array([params[r][1] for r in res])
        local = None
        if local_scale:
            logs = [f"_l{i}" for i in range(len(res))]
            logged = oof.withColumns({l: F.ln(F.abs(F.col(r) - F.lit(float(c))) + F.lit(0.05 * float(s)))
                                      for l, r, c, s in zip(logs, res, center, scale)})
            lb = {ALL: _bases(data, context, "spline", splits)[ALL]}
            local = (lb, _coefficients(logged, context, logs, lb, alpha, splits))
        model = cls(context, outcomes, bases, coefs, center, scale, local, clip, np.zeros(len(res)), np.eye(len(res)), 0.0)
        z = model._standardized(oof, res)
        location, cov, weight = covariance.shrunk_covariance(z, model._z)
        model.location, model.precision, model.shrinkage = location, covariance.precision_of(cov), weight
        oof.unpersist()
        return model

    @staticmethod
    def _robust(df: DataFrame, columns: Sequence[str], rows: int | None, rule: str = "eps") -> dict[str, tuple[float, float]]:
        long = df.select(F.lit(0).alias("_k"), *columns).unpivot(["_k"], list(columns), "feature", "value")
        found = robust_parameters(long, ["feature"], "value", rule=rule, rows=rows and rows * len(columns), few=True)
        return {r["feature"]: (r["center"], r["scale"]) for r in found.collect()}  # one row per outcome

    @staticmethod
    def _fold_medians(data: DataFrame, outcomes: Sequence[str], splits: int, rows: int | None) -> dict[int, np.ndarray]:
        """Medians of the rows outside each fold and of all rows; a row is copied to the models it trains."""
        models = F.array(*[F.lit(f) for f in [*range(splits), ALL]])
        fan = data.select("fold", *outcomes).withColumn("model", F.explode(F.filter(models, lambda m: m != F.col("fold"))))
        long = fan.select("model", *outcomes).unpivot(["model"], list(outcomes), "feature", "value")
        bound = rows and rows * len(outcomes) * splits
        mid = {(r["model"], r["feature"]): r["m"] for r in quantiles(long, ["model", "feature"], "value", {"m": 0.5}, rows=bound, few=True).collect()}
        return {m: np.array([[mid[(m, o)] for o in outcomes]]) for m in [*range(splits), ALL]}

    @property
    def _z(self) -> list[str]:
        return [f"_z{i}" for i in range(len(self.outcomes))]

    def _standardized(self, df: DataFrame, residuals: Sequence[str]) -> DataFrame:
        out = df
        if self.local is not None:
            out = _predict(out, self.context, self.local[0], self.local[1], str(ALL), "_ls")
        cells = {}
        for i, (z, r) in enumerate(zip(self._z, residuals)):
            s = F.lit(float(self.scale[i]))
            if self.local is not None:
                s = F.least(F.greatest(F.exp(F.col("_ls")[f"p{i}"]), s * self.clip[0]), s * self.clip[1])
            cells[z] = (F.col(r) - F.lit(float(self.center[i]))) / s
        return out.withColumns(cells)

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Squared distance of the standardized residual; larger is more anomalous."""
        guessed = _predict(df, self.context, self.bases, self.coefs, str(ALL), "_p")
        res = [f"_r{i}" for i in range(len(self.outcomes))]
        guessed = guessed.withColumns({r: F.col(o) - F.col("_p")[f"p{i}"] for i, (r, o) in enumerate(zip(res, self.outcomes))})
        z = self._standardized(guessed, res)
        return z.withColumn(name, F.greatest(covariance.distance(self._z, self.precision, self.location), F.lit(0.0))).select(*df.columns, name)


@dataclass
class SessionAnchored:
    """Shrinkage geometry of healthy within-session residuals."""

    features: list[str]
    params: dict[str, tuple[float, float]]
    location: np.ndarray
    precision: np.ndarray

    @classmethod
    def fit(cls, residuals: DataFrame, features: Sequence[str], *, rows: int | None = None) -> SessionAnchored:
        features = list(features)
        params = ConditionalResidual._robust(residuals, features, rows)
        model = cls(features, params, np.zeros(len(features)), np.eye(len(features)))
        location, cov, _ = covariance.shrunk_covariance(model._scaled(residuals), model._z)
        model.location, model.precision = location, covariance.precision_of(cov)
        return model

    @property
    def _z(self) -> list[str]:
        return [f"_z_{f}" for f in self.features]

    def _scaled(self, df: DataFrame) -> DataFrame:
        return df.withColumns({z: (F.col(f) - F.lit(self.params[f][0])) / F.lit(self.params[f][1]) for z, f in zip(self._z, self.features)})

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        out = self._scaled(df).withColumn(name, F.greatest(covariance.distance(self._z, self.precision, self.location), F.lit(0.0)))
        return out.select(*df.columns, name)
