"""Covariances of healthy references. Fits aggregate on Spark; only d x d algebra runs on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import DOUBLE_EPS, SQRT_EPS, col, dot, sum_of

NARROW = 16


def gram_sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Row count, column sums and cross-product sums per key from per-partition partial sums.

    Each task keeps one d x d block per key it meets, so the shuffle carries blocks and not rows.
    """
    d, names = len(columns), list(columns)
    types = dict(df.dtypes)

    def partial(batches):
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(list(keys), dropna=False) if keys else [((), pdf)]
            for key, part in groups:
                x = np.column_stack([np.ones(len(part)), part[names].to_numpy(float)])
                key = key if isinstance(key, tuple) else (key,)
                held[key] = held.get(key, 0.0) + x.T @ x
        if held:
            out = pd.DataFrame(list(held), columns=list(keys)) if keys else pd.DataFrame(index=range(1))
            out["g"] = [m.ravel() for m in held.values()]
            yield out

    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["g array<double>"])
    blocks = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(partial, schema)
    cells = blocks.select(*keys, F.posexplode("g").alias("_p", "_v")).groupBy(*keys, "_p").agg(F.sum("_v").alias("_v"))
    # (d + 1)^2 cells per key, so the collected list is bounded by the width of the table
    ordered = F.array_sort(F.collect_list(F.struct("_p", "_v")))
    return cells.groupBy(*keys).agg(F.transform(ordered, lambda s: s["_v"]).alias("g"))


def sample_covariance(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long-form sample covariance (keys, i, j, value, n) of groups with at least two rows.

    Narrow tables use the numerically stable built-in aggregate for each pair, wide ones the
    partial cross-product sums of centered values.
    """
    d = len(columns)
    if d <= NARROW:
        cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.covar_samp(columns[i], columns[j]).alias("value"))
                 for i in range(d) for j in range(i, d)]
        per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*cells).alias("_c")).filter("n > 1")
        half = per.select(*keys, "n", F.inline("_c"))
    else:
        middle = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
        moved = df.select(*keys, *[(F.col(c) - F.lit(middle[c])).alias(c) for c in columns])
        g, n, span = F.col("g"), F.col("g")[0], d + 1
        index = F.sequence(F.lit(0), F.lit(d - 1))

        def cell(i: Column, j: Column) -> Column:
            cross = F.get(g, (i + 1) * span + j + 1) - F.get(g, i + 1) * F.get(g, j + 1) / n
            return F.struct(i.alias("i"), j.alias("j"), (cross / (n - 1)).alias("value"))

        cells = F.flatten(F.transform(index, lambda i: F.transform(index, lambda j: cell(i, j))))
        per = gram_sums(moved, keys, columns).filter(n > 1)
        return per.select(*keys, n.cast("long").alias("n"), F.inline(cells))
    mirror = half.filter("i <> j").select(*keys, "n", F.col("j").alias("i"), F.col("i").alias("j"), "value")
    return half.unionByName(mirror)


def regularized(long: DataFrame, keys: Sequence[str], d: int, ridge: float) -> DataFrame:
    """Add ridge * max(mean variance, eps) to the diagonal of each long-form matrix."""
    trace = long.filter("i = j").groupBy(*keys).agg((F.sum("value") / d).alias("_v"))
    extra = F.lit(ridge) * F.greatest(F.col("_v"), F.lit(DOUBLE_EPS))
    joined = long.join(trace, list(keys)) if keys else long.withColumn("_k", F.lit(0)).join(
        F.broadcast(trace.withColumn("_k", F.lit(0))), "_k").drop("_k")
    return joined.withColumn("value", F.col("value") + F.when(F.col("i") == F.col("j"), extra).otherwise(0.0)).drop("_v")


def entity_mean(long: DataFrame, d: int, ridge: float) -> DataFrame:
    """Arithmetic mean of one covariance per entity, then a ridge."""
    return regularized(long.groupBy("i", "j").agg(F.avg("value").alias("value")), [], d, ridge)


def matrices(long: DataFrame, keys: Sequence[str], d: int) -> dict[tuple, np.ndarray]:
    """Bring d x d matrices of a few entities to the driver."""
    out: dict[tuple, np.ndarray] = {}
    for row in long.collect():
        out.setdefault(tuple(row[k] for k in keys), np.zeros((d, d)))[row["i"], row["j"]] = row["value"]
    return out


def with_ridge(matrix: np.ndarray, ridge: float) -> np.ndarray:
    level = max(float(np.trace(matrix)) / len(matrix), DOUBLE_EPS)
    return matrix + ridge * level * np.eye(len(matrix))


def spectral_map(matrix: np.ndarray, fn) -> np.ndarray:
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return vectors @ np.diag(fn(values)) @ vectors.T


def log_euclidean_mean(found: Sequence[np.ndarray], ridge: float) -> np.ndarray:
    """exp of the mean matrix logarithm of the ridged covariances."""
    logs = [spectral_map(with_ridge(m, ridge), np.log) for m in found]
    return spectral_map(sum(logs) / len(logs), np.exp)


def precision_of(matrix: np.ndarray) -> np.ndarray:
    return np.linalg.pinv((matrix + matrix.T) / 2, hermitian=True)


def shrunk_covariance(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """Location, shrinkage covariance and shrinkage weight from two aggregations, or three of a wide table.

    They give means and population covariances, wide ones by partial cross-product sums, and at last the mean fourth
    power of the centered row norm, which is the only fourth-order quantity the weight needs.
    """
    d = len(columns)
    means = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]]
    if d <= NARROW:
        pairs = [F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
        first = df.agg(*means, *pairs).first()
        cov = np.array([[first[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        n, location = first["n"], np.array([first[f"m{i}"] for i in range(d)])
    else:
        first = df.agg(*means).first()
        n, location = first["n"], np.array([first[f"m{i}"] for i in range(d)])
        moved = df.select(*[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(columns, location)])
        sums = np.array(gram_sums(moved, [], columns).first()["g"]).reshape(d + 1, d + 1)
        shift = sums[0, 1:] / n
        cov = sums[1:, 1:] / n - np.outer(shift, shift)
    norm = sum_of([(F.col(c) - F.lit(float(m))) * (F.col(c) - F.lit(float(m))) for c, m in zip(columns, location)])
    fourth = df.agg(F.avg(norm * norm)).first()[0]
    level = np.trace(cov) / d
    spread = float((cov ** 2).sum() - d * level ** 2) / d
    noise = min((fourth - float((cov ** 2).sum())) / (n * d), spread)
    weight = noise / spread if noise > 0 and spread > 0 else 0.0
    return location, (1 - weight) * cov + weight * level * np.eye(d), weight


def distance(columns: Sequence[str], precision: np.ndarray, location: Sequence[float] | None = None) -> Column:
    """Squared Mahalanobis distance as one expression of constants, ready for code generation.

    The matrix is symmetric, so only its upper triangle is written out. A wide matrix is one array constant that is read
    row by row instead, as its written form would be too long to compile.
    """
    if len(columns) > NARROW:
        return _wide_distance(columns, precision, location)
    center = [0.0] * len(columns) if location is None else [float(v) for v in location]
    x = [f"(`{c}` - {m!r}D)" if m else f"`{c}`" for c, m in zip(columns, center)]
    p = np.asarray(precision, dtype=float)
    terms = []
    for i in range(len(x)):
        row = [f"{float(p[i, i])!r}D * {x[i]}"] + [f"{float(p[i, j] + p[j, i])!r}D * {x[j]}" for j in range(i + 1, len(x))]
        terms.append(f"{x[i]} * ({' + '.join(row)})")
    return F.expr(" + ".join(terms))


def _wide_distance(columns: Sequence[str], precision: np.ndarray, location: Sequence[float] | None) -> Column:
    d, zero = len(columns), F.lit(0.0)
    center = np.zeros(d) if location is None else np.asarray(location, float)
    x = F.array(*[F.col(c) - F.lit(float(m)) for c, m in zip(columns, center)])
    cells = F.lit(np.asarray(precision, float).ravel())

    def along(i: Column) -> Column:
        products = F.zip_with(x, F.slice(cells, i * d + 1, d), lambda a, b: a * b)
        return F.get(x, i) * F.aggregate(products, zero, lambda a, b: a + b)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), along), zero, lambda a, b: a + b)


def contributions(columns: Sequence[str], precision: np.ndarray) -> Column:
    """Array of (feature, contribution): x_j times row j of the precision applied to x."""
    return F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) * dot(columns, row)).alias("contribution"))
                     for c, row in zip(columns, np.asarray(precision).tolist())])


def with_shares(df: DataFrame, score: str = "score", parts: str = "parts") -> DataFrame:
    """Explode contributions with their share of the score and of the absolute sum."""
    total = F.aggregate(F.col(parts), F.lit(0.0), lambda a, p: a + F.abs(p["contribution"]))
    return df.withColumn("_t", total).select(
        *[c for c in df.columns if c != parts], "_t", F.inline(parts)).withColumns({
            "share": F.try_divide(F.col("contribution"), F.col(score)),
            "absolute_share": F.try_divide(F.abs("contribution"), F.col("_t"))}).drop("_t")


def method_scores(df: DataFrame, columns: Sequence[str], methods: Mapping[str, tuple[np.ndarray, Sequence[float] | None]]) -> DataFrame:
    """Scores under every method of a short registry, from one pass over the rows."""
    cells = [F.struct(F.lit(name).alias("method"), distance(columns, precision_of(m), loc).alias("score"))
             for name, (m, loc) in methods.items()]
    return df.select("*", F.inline(F.array(*cells)))


def independent_columns(df: DataFrame, columns: Sequence[str], tolerance: float = SQRT_EPS) -> list[str]:
    """Full-rank column subset by pivoted elimination on the centered cross products.

    A column whose remaining length falls under tolerance times the first pivot is redundant. The
    cross products hold squared lengths, so the smallest resolvable ratio is about sqrt(eps).
    """
    d = len(columns)
    g = matrices(sample_covariance(df, [], columns), [], d)[()].copy()
    left, kept, first = list(range(d)), [], None
    while left:
        best = max(left, key=lambda j: (g[j, j], -j))
        length = np.sqrt(max(g[best, best], 0.0))
        if first is None:
            if length == 0:
                raise ValueError("no column varies")
            first = length
        if length <= tolerance * first or g[best, best] <= d * DOUBLE_EPS * first ** 2:
            break
        kept.append(best)
        left.remove(best)
        factor = g[:, best] / g[best, best]
        g = g - np.outer(factor, g[best, :])
    return [columns[j] for j in sorted(kept)]


def columns_of(matrix: np.ndarray, names: Sequence[str]) -> list[tuple[str, str, float]]:
    """Matrix as (row, column, value) tuples for a parameter table."""
    return [(names[i], names[j], float(matrix[i, j])) for i in range(len(names)) for j in range(len(names))]


def is_finite_array(values: Column | str) -> Column:
    return F.forall(col(values), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
