"""Logistic regression for all folds and penalties at once, by Newton steps on summed cross products.

Every pass over the rows adds up, for each model that still moves, the gradient, the curvature and
the loss at its current coefficients. The sums are small, so the Newton step is solved on the driver.
Columns are centered and scaled by their own training rows, with the population deviation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import session
from tracewell.functions.scalars import sum_of

#: A fold number that leaves nothing out.
ALL = -1


@dataclass
class LogisticModel:
    """Coefficients in units of the raw columns, with the number of Newton steps and whether they settled."""

    coef: np.ndarray
    intercept: float
    strength: float
    steps: int
    converged: bool

    def margin(self, columns: Sequence[Column]) -> Column:
        """Log odds of the positive class; null where a column is null."""
        return sum_of([F.lit(float(b)) * c for b, c in zip(self.coef, columns)]) + F.lit(self.intercept)


def stage(df: DataFrame, columns: Sequence[Column], label: str, weight: str | None = None, fold: Column | None = None) -> DataFrame:
    """Rows as arrays, written once; rows with a null among the columns or the label take no part."""
    x = F.array(*[c.cast("double") for c in columns])
    rows = df.select(x.alias("x"), F.col(label).cast("double").alias("y"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"),
                     (F.lit(0) if fold is None else fold).cast("int").alias("fold"))
    return session.landed(rows.filter(F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))), "logistic")


def _added(data: DataFrame, build) -> dict[int, np.ndarray]:
    """Sum over all rows of the arrays by number that ``build(x, y, w, fold)`` returns for a part of them."""

    def partial(batches):
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, v in build(np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy(), pdf["w"].to_numpy(), pdf["fold"].to_numpy()).items():
                held[k] = held.get(k, 0.0) + v
        for k, v in held.items():
            yield pd.DataFrame({"k": k, "p": np.arange(len(v)), "v": v})

    cells = data.mapInPandas(partial, "k long, p long, v double").groupBy("k", "p").agg(F.sum("v").alias("v")).toPandas()
    return {int(k): part.sort_values("p")["v"].to_numpy() for k, part in cells.groupby("k")}


def _loss(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, margin) - y * margin


def fit_path(data: DataFrame, strengths: Sequence[float], folds: Sequence[int] = (ALL,), *, limit: int = 100, tolerance: float = 1e-10) -> dict[tuple[int, float], LogisticModel]:
    """One model per (fold left out, strength C): least 0.5 |b|^2 + C * sum of weighted losses, no penalty on the intercept.

    ``data`` comes from ``stage``. A step that does not lower the objective is halved, so it falls to the end.
    """
    sums = _added(data, lambda x, y, w, fold: {int(f): np.concatenate([[np.sum(fold == f)], x[fold == f].sum(0), (x[fold == f] ** 2).sum(0)]) for f in np.unique(fold)})
    if not sums:
        raise ValueError("logistic regression needs training rows")
    width = (len(next(iter(sums.values()))) - 1) // 2
    scales = {}
    for f in folds:
        total = np.sum([v for k, v in sums.items() if k != f], axis=0)
        mean = total[1:1 + width] / total[0]
        spread = np.sqrt(np.maximum(total[1 + width:] / total[0] - mean ** 2, 0.0))
        scales[f] = mean, np.where(spread > 1e-12 * np.maximum(np.abs(mean), 1e-300), spread, 1.0)
    keys = [(f, float(c)) for f in folds for c in strengths]
    at = {k: np.zeros(width + 1) for k in keys}
    back, best, steps, live = dict(at), dict.fromkeys(keys, np.inf), dict.fromkeys(keys, 0), set(keys)
    settled: set = set()
    ridge = np.diag([0.0] + [1.0] * width)
    while live:
        numbered = {i: k for i, k in enumerate(keys) if k in live}

        def build(x, y, w, fold, numbered=numbered, now={k: at[k] for k in live}):
            out = {}
            for f in {k[0] for k in numbered.values()}:
                use = fold != f
                if not use.any():
                    continue
                mean, spread = scales[f]
                z = np.hstack([np.ones((int(use.sum()), 1)), (x[use] - mean) / spread])
                for i, k in numbered.items():
                    if k[0] != f:
                        continue
                    margin = z @ now[k]
                    p = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
                    h = (z * (w[use] * p * (1.0 - p))[:, None]).T @ z
                    out[i] = np.concatenate([[(w[use] * _loss(margin, y[use])).sum()], z.T @ (w[use] * (y[use] - p)), h.ravel()])
            return out

        found = _added(data, build)
        for i, k in numbered.items():
            c, v = k[1], found[i]
            value = c * v[0] + 0.5 * (at[k][1:] ** 2).sum()
            steps[k] += 1
            if value > best[k] + 1e-12 * abs(best[k]):
                at[k] = (at[k] + back[k]) / 2.0
                if steps[k] >= limit:
                    live.discard(k)
                continue
            gradient = c * v[1:2 + width] - ridge @ at[k]
            step = np.linalg.lstsq(c * v[2 + width:].reshape(width + 1, width + 1) + ridge, gradient, rcond=None)[0]
            best[k], back[k] = value, at[k]
            if gradient @ step <= tolerance * max(1.0, abs(value)):
                settled.add(k)
                live.discard(k)
                at[k] = at[k] + step
            elif steps[k] >= limit:
                live.discard(k)
            else:
                at[k] = at[k] + step
    out = {}
    for k in keys:
        mean, spread = scales[k[0]]
        coef = at[k][1:] / spread
        out[k] = LogisticModel(coef, float(at[k][0] - coef @ mean), k[1], steps[k], k in settled)
    return out


def held_out_losses(data: DataFrame, models: dict[tuple[int, float], LogisticModel]) -> dict[float, float]:
    """Mean over folds of the weighted log loss of every strength on the fold its model did not see."""
    keys = sorted(models)

    def build(x, y, w, fold):
        out = {}
        for i, k in enumerate(keys):
            use = fold == k[0]
            if use.any():
                out[i] = np.array([(w[use] * _loss(x[use] @ models[k].coef + models[k].intercept, y[use])).sum(), w[use].sum()])
        return out

    found = _added(data, build)
    per: dict[float, list[float]] = {}
    for i, k in enumerate(keys):
        if i in found:
            per.setdefault(k[1], []).append(found[i][0] / found[i][1])
    return {c: float(np.mean(v)) for c, v in per.items()}
