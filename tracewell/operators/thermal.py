"""Thermal profiles: loss proxies, transition fits and bounded closed-loop forecasts.

One normal-equation row per (profile, node) is the only thing a fit needs from the samples. Ridge,
nonnegative, pooled and per-profile models, and every penalty candidate, are solved from that table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.physics import MAGNITUDES, loss_proxies, magnitudes
from tracewell.operators.ordered import running
from tracewell.operators.ranks import quantiles

NODES = ("temp_winding", "temp_core", "temp_rotor")
LOSSES = tuple(f"loss_{i}" for i in range(1, 6))
FEATURES = ("other_1", "other_2", "coolant", "ambient", *LOSSES)
DOUBLES = T.ArrayType(T.DoubleType())


def magnitude_floors(profiles: DataFrame, key: str, index: str, *, prefix: int, rows: int | None = None) -> dict[str, float]:
    """5 % of the median profile p95 of each magnitude; prefixes are bounded, medians exact."""
    m = profiles.filter(F.col(index) < prefix).select(key, *[c.alias(n) for n, c in magnitudes().items()])
    p95 = m.groupBy(key).agg(*[F.percentile(n, F.lit(0.95)).alias(n) for n in MAGNITUDES])
    long = p95.unpivot([key], list(MAGNITUDES), "magnitude", "value")
    mid = quantiles(long, ["magnitude"], "value", {"m": 0.5}, rows=rows).collect()  # one row per magnitude
    return {r["magnitude"]: max(0.05 * r["m"], 1e-6) for r in mid}


def normalized_losses(df: DataFrame, key: str, index: str, floors: Mapping[str, float], *, prefix: int) -> DataFrame:
    """Loss proxies of magnitudes divided by each profile's own prefix p95."""
    m = magnitudes()
    p95 = df.filter(F.col(index) < prefix).groupBy(key).agg(
        *[F.percentile(m[n], F.lit(0.95)).alias(f"_s_{n}") for n in MAGNITUDES])
    scaled = df.join(p95, key)
    parts = [m[n] / F.greatest(F.col(f"_s_{n}"), F.lit(floors[n])) for n in MAGNITUDES]
    return scaled.withColumns(dict(zip(LOSSES, loss_proxies(*parts)))).drop(*[f"_s_{n}" for n in MAGNITUDES])


def raw_loss_scales(profiles: DataFrame, key: str, index: str, *, cap: int | None = None, rows: int | None = None) -> list[float]:
    """Median over profiles of the p95 of each raw loss, on all rows or the first ``cap``."""
    m = magnitudes()
    raw = (profiles if cap is None else profiles.filter(F.col(index) < cap)).select(
        key, *[F.abs(c).alias(n) for n, c in zip(LOSSES, loss_proxies(*[m[k] for k in MAGNITUDES]))])
    p95 = quantiles(raw.unpivot([key], list(LOSSES), "loss", "value"), [key, "loss"], "value", {"p95": 0.95}, rows=rows and rows * len(LOSSES))
    mid = quantiles(p95, ["loss"], "p95", {"m": 0.5}, rows=rows).collect()
    found = {r["loss"]: max(r["m"], 1e-9) for r in mid}
    return [found[n] for n in LOSSES]


def raw_losses(df: DataFrame, scales: Sequence[float]) -> DataFrame:
    m = magnitudes()
    return df.withColumns({n: c / F.lit(float(s)) for n, c, s in zip(LOSSES, loss_proxies(*[m[k] for k in MAGNITUDES]), scales)})


def transitions(df: DataFrame, key: str, index: str, *, rows: int | None = None, largest: int | None = None) -> DataFrame:
    """One-step design per node: previous-state differences, boundaries, losses and the state change."""
    used = df.select(key, index, "coolant", "ambient", *LOSSES, *NODES)
    lagged = running(used, [key], [index], lags={f"_p_{n}": n for n in NODES}, rows=rows, largest=largest).filter(F.col(f"_p_{NODES[0]}").isNotNull())
    cells = []
    for n in NODES:
        own = F.col(f"_p_{n}")
        others = [F.col(f"_p_{o}") - own for o in NODES if o != n]
        x = F.array(*others, F.col("coolant") - own, F.col("ambient") - own, *[F.col(c) for c in LOSSES])
        cells.append(F.struct(F.lit(n).alias("node"), x.alias("x"), (F.col(n) - own).alias("y")))
    return lagged.select(key, index, F.inline(F.array(*cells)))


def normal_equations(design: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count, cross products (upper triangle), column sums and right side per key."""
    d = len(FEATURES)
    g = ", ".join(f"sum(x[{i}] * x[{j}])" for i in range(d) for j in range(i, d))
    return design.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"array({g})").alias("g"),
        F.expr("array(" + ", ".join(f"sum(x[{i}] * y)" for i in range(d)) + ")").alias("b"),
        F.expr("array(" + ", ".join(f"sum(x[{i}])" for i in range(d)) + ")").alias("sx"), F.sum("y").alias("sy"))


def square(upper: Sequence[float], d: int = len(FEATURES)) -> np.ndarray:
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = upper
    return out + np.triu(out, 1).T


def pooled(equations: DataFrame) -> dict[str, dict]:
    """Profile-balanced sums per node: each profile counts once whatever its length."""
    d = len(FEATURES)
    size = d * (d + 1) // 2

    def mean_of(name: str, k: int) -> Column:
        return F.expr("array(" + ", ".join(f"sum({name}[{i}] / n)" for i in range(k)) + ")").alias(name)

    rows = equations.groupBy("node").agg(F.count(F.lit(1)).alias("profiles"), mean_of("g", size), mean_of("b", d), mean_of("sx", d),
                                         F.sum(F.col("sy") / F.col("n")).alias("sy")).collect()  # one row per node
    return {r["node"]: r.asDict() for r in rows}


def ridge_from(sums: Mapping[str, dict], alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and intercepts per node of the centered ridge problem."""
    coef, intercept = [], []
    for node in NODES:
        s = sums[node]
        w = float(s["profiles"])
        mean_x, mean_y = np.array(s["sx"]) / w, s["sy"] / w
        a = square(s["g"]) - w * np.outer(mean_x, mean_x)
        b = np.array(s["b"]) - w * mean_x * mean_y
        beta = np.linalg.solve(a + alpha * np.eye(len(b)), b)
        coef.append(beta)
        intercept.append(mean_y - mean_x @ beta)
    return np.array(coef), np.array(intercept)


def nonnegative_solution(gram: np.ndarray, right: np.ndarray, tolerance: float = 1e-12, start: np.ndarray | None = None) -> np.ndarray:
    """Least squares with nonnegative coefficients from a small Gram matrix, by active sets.

    ``start`` is the solution of a near problem: if its positive coefficients alone solve this one with
    positive values, the search goes on from there. Raises when the sets do not settle.
    """
    d = len(right)
    x, free = np.zeros(d), np.zeros(d, dtype=bool)
    if start is not None and (start > 0).any():
        warm = start > 0
        trial = np.zeros(d)
        trial[warm] = np.linalg.lstsq(gram[np.ix_(warm, warm)], right[warm], rcond=None)[0]
        if (trial[warm] > 0).all():
            x, free = trial, warm
    size = max(1.0, float(np.abs(right).max()))
    for _ in range(100 * d):
        slope = right - gram @ x
        enter = np.where(free, -np.inf, slope)
        if enter.max() <= tolerance * size:
            break
        free[enter.argmax()] = True
        while free.any():
            trial = np.zeros(d)
            trial[free] = np.linalg.lstsq(gram[np.ix_(free, free)], right[free], rcond=None)[0]
            low = free & (trial <= 0)
            if not low.any():
                x = trial
                break
            step = np.min(x[low] / np.maximum(x[low] - trial[low], 1e-300))
            x = x + step * (trial - x)
            free &= x > 1e-15
            x[~free] = 0.0
    else:
        raise ArithmeticError("the active sets of a nonnegative fit did not settle")
    return x


def nonnegative_grid(equations: DataFrame, prior: np.ndarray, ridges: Sequence[float], penalties: Sequence[float]) -> DataFrame:
    """Coefficients of every (ridge, penalty) per row of normal equations, as rows (..., ridge, penalty, coef).

    Least |Xb - y|^2 / n + ridge |b|^2 + penalty |b - prior|^2 with b >= 0. One pass solves the whole grid of a
    row, each problem from the solution before it.
    """
    anchor = {n: prior[i] for i, n in enumerate(NODES)}
    grid = [(a, p) for a in ridges for p in penalties]

    @F.pandas_udf(T.ArrayType(DOUBLES))
    def solve(node: pd.Series, n: pd.Series, g: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for name, count, upper, right in zip(node, n, g, b):
            a, r, near, found = square(upper) / count, np.asarray(right) / count, None, []
            for ridge, penalty in grid:
                near = nonnegative_solution(a + (ridge + penalty) * np.eye(len(r)), r + penalty * anchor[name], start=near)
                found.append(near.tolist())
            out.append(found)
        return pd.Series(out)

    cells = F.array(*[F.struct(F.lit(float(a)).alias("ridge"), F.lit(float(p)).alias("penalty"), F.col("_c")[i].alias("coef")) for i, (a, p) in enumerate(grid)])
    keys = [c for c in equations.columns if c not in ("n", "g", "b", "sx", "sy")]
    return equations.withColumn("_c", solve("node", "n", "g", "b")).select(*keys, F.inline(cells))


def nonnegative_from(sums: Mapping[str, dict]) -> np.ndarray:
    """Pooled nonnegative coefficients, one row per node."""
    return np.array([nonnegative_solution(square(sums[n]["g"]), np.array(sums[n]["b"])) for n in NODES])


def nonnegative_per_profile(equations: DataFrame, prior: np.ndarray | None = None, penalty: float = 0.0) -> DataFrame:
    """Nonnegative coefficients per (profile, node) row, optionally pulled to a source prior."""
    anchor = {n: (prior[i] if prior is not None else np.zeros(len(FEATURES))) for i, n in enumerate(NODES)}

    @F.pandas_udf(DOUBLES)
    def solve(node: pd.Series, n: pd.Series, g: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for name, count, upper, right in zip(node, n, g, b):
            a = square(upper) / count + penalty * np.eye(len(right))
            out.append(nonnegative_solution(a, np.asarray(right) / count + penalty * anchor[name]))
        return pd.Series(out)

    return equations.withColumn("coef", solve("node", "n", "g", "b"))


def coefficient_rows(models: Mapping[str, np.ndarray]) -> list[tuple[str, str, str, float]]:
    """(method, node, feature, value) rows of a few coefficient matrices."""
    return [(m, NODES[i], FEATURES[j], float(c[i, j])) for m, c in models.items() for i in range(len(NODES)) for j in range(len(FEATURES))]


def horizon_rows(df: DataFrame, key: str, index: str, *, start: int, end: int | None = None) -> DataFrame:
    """Inputs of [start, end) and the state before them as one row per profile that is long enough.

    Without an end a horizon is all that a profile has from start on, in profiles with one row there at least. A forecast needs
    the steps of its profile one after another, so the ordered lists hold one horizon each.
    """
    inputs = F.struct(F.col(index), F.array("coolant", "ambient", *LOSSES).alias("u"), F.array(*NODES).alias("t"))
    held = df.filter(F.col(index) >= start - 1)
    held = held if end is None else held.filter(F.col(index) < end)
    g = held.groupBy(key).agg(F.array_sort(F.collect_list(inputs)).alias("_r"))
    g = g.filter((F.size("_r") > 1) & (F.col("_r")[0][index] == start - 1) if end is None else F.size("_r") == end - start + 1)
    rest = F.slice("_r", F.lit(2), F.size("_r") - 1)
    return g.select(key, F.col("_r")[0]["t"].alias("state"), F.col("_r")[0]["u"].alias("u0"),
                    F.flatten(F.transform(rest, lambda s: s["u"])).alias("inputs"),
                    F.flatten(F.transform(rest, lambda s: s["t"])).alias("truth"))


ROLL = T.StructType([T.StructField("prediction", DOUBLES), T.StructField("clip_count", T.LongType()),
                     T.StructField("nonfinite_count", T.LongType())])


def rollout(horizons: DataFrame, coef: Column | str = "coef", intercept: Column | str = "intercept", *,
            guard: tuple[float, float] = (-50.0, 250.0)) -> DataFrame:
    """Closed-loop forecast of every row: the batch advances one step at a time for all its profiles.

    ``coef`` holds the node-by-feature matrix row by row and ``intercept`` one number per node. Values
    outside the guard are clipped and counted; non-finite steps keep the previous state. Horizons may differ in length:
    the longest come first, and a step advances those that reach it.
    """
    k, f = len(NODES), len(FEATURES)
    pick = np.array([[o for o in range(k) if o != n] for n in range(k)])

    @F.pandas_udf(ROLL)
    def advance(state: pd.Series, inputs: pd.Series, coefs: pd.Series, shift: pd.Series) -> pd.DataFrame:
        if state.empty:
            return pd.DataFrame({"prediction": [], "clip_count": [], "nonfinite_count": []})
        size = np.array([len(x) for x in inputs]) // (f - 2)
        order = np.argsort(-size, kind="stable")
        found, clips, bad = [None] * len(size), np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
        for rows in (order[at:at + 512] for at in range(0, len(order), 512)):
            s = np.stack(state.iloc[rows].to_numpy()).astype(float)
            c = np.stack(coefs.iloc[rows].to_numpy()).astype(float).reshape(len(s), k, f)
            h = np.stack(shift.iloc[rows].to_numpy()).astype(float)
            u = np.zeros((len(s), size[rows[0]], f - 2))
            for i, x in enumerate(inputs.iloc[rows]):
                u[i, :size[rows[i]]] = np.asarray(x, dtype=float).reshape(-1, f - 2)
            out = np.empty((len(s), u.shape[1], k))
            for step in range(u.shape[1]):
                n = int((size[rows] > step).sum())
                now, ins = s[:n], u[:n, step]
                edge = np.stack([now[:, pick[:, 0]] - now, now[:, pick[:, 1]] - now, ins[:, 0:1] - now, ins[:, 1:2] - now], axis=2)
                ahead = now + np.einsum("rnf,rnf->rn", edge, c[:n, :, :4]) + np.einsum("rf,rnf->rn", ins[:, 2:], c[:n, :, 4:]) + h[:n]
                broken = ~np.isfinite(ahead)
                bad[rows[:n]] += broken.sum(axis=1)
                ahead = np.where(broken, now, ahead)
                clips[rows[:n]] += ((ahead < guard[0]) | (ahead > guard[1])).sum(axis=1)
                s = np.clip(ahead, *guard)
                out[:n, step] = s
            for i, row in enumerate(rows):
                found[row] = out[i, :size[row]].ravel()
        return pd.DataFrame({"prediction": found, "clip_count": clips, "nonfinite_count": bad})

    return horizons.withColumn("_f", advance("state", "inputs", coef, intercept)).select("*", "_f.*").drop("_f")


def persistence(horizons: DataFrame, *, shift: bool, guard: tuple[float, float] = (-50.0, 250.0)) -> DataFrame:
    """Hold the last state, optionally moved with the mean boundary temperature."""
    width, k = len(FEATURES) - 2, len(NODES)
    steps = F.sequence(F.lit(0), F.floor(F.size("inputs") / width).cast("int") - 1)

    def level(i: Column) -> Column:
        move = F.lit(0.0)
        if shift:
            now = (F.get("inputs", i * width) + F.get("inputs", i * width + 1)) / 2.0
            move = now - (F.col("u0")[0] + F.col("u0")[1]) / 2.0
        return F.array(*[F.col("state")[n] + move for n in range(k)])

    raw = F.flatten(F.transform(steps, level))
    lo, hi = F.lit(guard[0]), F.lit(guard[1])
    return (horizons.withColumn("_raw", raw)
            .withColumn("prediction", F.transform("_raw", lambda v: F.least(F.greatest(v, lo), hi)))
            .withColumn("clip_count", F.size(F.filter("_raw", lambda v: (v < lo) | (v > hi))).cast("long"))
            .withColumn("nonfinite_count", F.lit(0).cast("long")).drop("_raw"))


def rollout_errors(forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RMSE, MAE and largest error per node and their macro mean, straight from the arrays."""
    k = len(NODES)
    err = F.zip_with("prediction", "truth", lambda p, t: p - t)
    staged = forecasts.withColumn("_e", err).withColumn("_n", F.size("_e") / k)

    def node(i: int, name: str) -> Column:
        own = F.filter("_e", lambda v, at: at % k == i)
        total = F.aggregate(own, F.lit(0.0), lambda a, v: a + v * v)
        absolute = F.aggregate(own, F.lit(0.0), lambda a, v: a + F.abs(v))
        return F.struct(F.lit(name).alias("node"), F.sqrt(total / F.col("_n")).alias("rmse"), (absolute / F.col("_n")).alias("mae"),
                        F.array_max(F.transform(own, lambda v: F.abs(v))).alias("max_abs"))

    rows = staged.withColumn("_r", F.array(*[node(i, n) for i, n in enumerate(NODES)]))

    def mean(field: str) -> Column:
        return sum((F.col("_r")[i][field] for i in range(1, k)), F.col("_r")[0][field]) / float(k)

    macro = F.struct(F.lit("macro").alias("node"), mean("rmse").alias("rmse"), mean("mae").alias("mae"), mean("max_abs").alias("max_abs"))
    return rows.select(*keys, "clip_count", "nonfinite_count", F.inline(F.concat(F.col("_r"), F.array(macro))))


def constant_model(coef: np.ndarray, intercept: np.ndarray | None = None) -> tuple[Column, Column]:
    """Literal columns of one model that is applied to every profile."""
    shift = np.zeros(len(NODES)) if intercept is None else intercept
    return (F.array(*[F.lit(float(v)) for v in np.asarray(coef).ravel()]), F.array(*[F.lit(float(v)) for v in shift]))
