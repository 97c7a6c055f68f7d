"""Robust centers and scales of long-form features, with the three published floor rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import session
from tracewell.functions.scalars import IQR_TO_SIGMA, MAD_TO_SIGMA, SQRT_EPS
from tracewell.operators.ranks import quantiles


def pick_scale(rule: str) -> Column:
    """Scale from mad, std, center, peak and iqr columns under one floor rule.

    relative  MAD, then population deviation, then 1; floor 1e-8 * max(|center|, 1)
    eps       MAD, then population deviation, then 1; floor sqrt(eps) * max(max|x|, 1)
    centered  as eps, with the peak measured from the center
    spread    MAD, then IQR / 1.349, then 1; floor 1e-12
    """
    one = F.lit(1.0)
    if rule == "relative":
        floor, second = F.lit(1e-8) * F.greatest(F.abs("center"), one), F.col("std")
    elif rule in ("eps", "centered"):
        floor, second = F.lit(SQRT_EPS) * F.greatest(F.col("peak"), one), F.col("std")
    elif rule == "spread":
        floor, second = F.lit(1e-12), F.col("iqr") / F.lit(IQR_TO_SIGMA)
    else:
        raise ValueError(f"unknown floor rule: {rule}")
    return F.when(F.col("mad") > floor, F.col("mad")).when(second > floor, second).otherwise(one)


def robust_parameters(long: DataFrame, keys: Sequence[str], value: str, *, rule: str,
                      rows: int | None = None, few: bool = False) -> DataFrame:
    """One row per key with center, mad and scale; medians are exact at any group size.

    The center comes first, then everything that is measured around it. ``few`` says that there are few keys.
    """
    base = long.select(*keys, F.col(value).cast("double").alias("_x"))
    limit = session.rows_per_chunk(base.sparkSession)
    if rows is None:
        rows = base.count()
    wanted = {"center": 0.5, "_q1": 0.25, "_q3": 0.75} if rule == "spread" else {"center": 0.5}
    mid = quantiles(base, keys, "_x", wanted, rows=rows, few=few)
    if few and rows > limit:
        mid = session.landed(mid, "centers")  # several passes read it
    away = session.join_null_safe(base, mid, list(keys)).withColumn("_d", F.abs(F.col("_x") - F.col("center")))
    peak = F.max("_d") if rule == "centered" else F.max(F.abs("_x"))
    stats = [F.stddev_pop("_x").alias("std"), peak.alias("peak"), *[F.max(c).alias(c) for c in wanted]]
    if rows <= limit:
        wide = away.groupBy(*keys).agg(F.median("_d").alias("_mad"), *stats)
    else:
        wide = session.join_null_safe(away.groupBy(*keys).agg(*stats), quantiles(away, keys, "_d", {"_mad": 0.5}, rows=rows, few=few), list(keys))
    wide = wide.withColumn("mad", F.lit(MAD_TO_SIGMA) * F.col("_mad"))
    if rule == "spread":
        wide = wide.withColumn("iqr", F.col("_q3") - F.col("_q1"))
    return wide.withColumn("scale", pick_scale(rule)).select(*keys, "center", "mad", "scale")


def fit_one(df: DataFrame, value: str, *, rule: str, rows: int | None = None) -> tuple[float, float]:
    """Center and scale of a single feature as numbers, for use as constants in later plans."""
    keyed = df.select(F.lit(0).alias("_g"), value)
    row = robust_parameters(keyed, ["_g"], value, rule=rule, rows=rows, few=True).first()
    if row is None:
        raise ValueError("no reference rows to fit on")
    return float(row["center"]), float(row["scale"])


def standardize(long: DataFrame, parameters: DataFrame, keys: Sequence[str], value: str,
                name: str = "z") -> DataFrame:
    """(value - center) / scale; the parameter side has one row per key, and a null key meets a null key."""
    slim = parameters.select(*keys, "center", "scale")
    return (session.join_null_safe(long, slim, list(keys))
            .withColumn(name, (F.col(value) - F.col("center")) / F.col("scale")).drop("center", "scale"))


def range_bounds(reference: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Minimum and maximum of each column of a reference subset; a constant column is an error."""
    aggs = [f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    row = reference.agg(*aggs).first()
    found = {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns}
    flat = [c for c, (lo, hi) in found.items() if lo is None or hi <= lo]
    if flat:
        raise ValueError(f"columns do not vary in the reference: {flat}")
    return found


def range_normalize(df: DataFrame, bounds: dict[str, tuple[float, float]], columns: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min) with the bounds of the reference subset."""
    return df.withColumns({c: (F.col(c) - F.lit(bounds[c][0])) / F.lit(bounds[c][1] - bounds[c][0]) for c in columns})


def outside_range(bounds: dict[str, tuple[float, float]], columns: Sequence[str]) -> Column:
    """True when any column leaves the reference range."""
    out = F.lit(False)
    for c in columns:
        out = out | (F.col(c) < F.lit(bounds[c][0])) | (F.col(c) > F.lit(bounds[c][1]))
    return out
