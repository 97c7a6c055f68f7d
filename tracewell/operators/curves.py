"""Curve errors, bands and their coverage. A curve is an array of fixed length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import col, is_finite, wilson
from tracewell.operators.ranks import quantiles


def absolute_errors(truth: Column | str, guess: Column | str) -> Column:
    return F.zip_with(col(truth), col(guess), lambda y, p: F.abs(y.cast("double") - p.cast("double")))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def array_mean(values: Column) -> Column:
    return array_sum(F.transform(values, lambda v: v.cast("double"))) / F.size(values)


def curve_max_error(truth: Column | str, guess: Column | str) -> Column:
    """Largest absolute error over the whole grid of a curve."""
    return F.array_max(absolute_errors(truth, guess))


def curve_metrics(df: DataFrame, keys: Sequence[str], truth: str, guess: str) -> DataFrame:
    """MAE, RMSE, MAPE, mean maximum error, mean-level MAE and ripple MAE."""
    y, p = F.col(truth), F.col(guess)
    err = absolute_errors(truth, guess)
    relative = F.zip_with(err, y, lambda e, v: e / F.abs(v.cast("double")))
    level = F.abs(array_mean(y) - array_mean(p))
    ripple = F.abs((F.array_max(y).cast("double") - F.array_min(y)) - (F.array_max(p).cast("double") - F.array_min(p)))
    per = df.select(*keys, F.size(y).alias("_k"), array_sum(err).alias("_a"),
                    array_sum(F.transform(err, lambda e: e * e)).alias("_q"), array_sum(relative).alias("_r"),
                    F.array_max(err).alias("_m"), level.alias("_l"), ripple.alias("_w"))
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("designs"), (F.sum("_a") / F.sum("_k")).alias("mae"),
        F.sqrt(F.sum("_q") / F.sum("_k")).alias("rmse"), (F.sum("_r") / F.sum("_k") * 100.0).alias("mape_percent"),
        F.avg("_m").alias("mean_max_error"), F.avg("_l").alias("level_mae"), F.avg("_w").alias("ripple_mae"))


def band_coverage(df: DataFrame, keys: Sequence[str], *, errors: str, half_width: str, support_p: str,
                  support_alpha: float, rows: int | None = None) -> DataFrame:
    """Curvewise and pointwise coverage, widths and support rejections."""
    width = F.col(half_width)
    base = df.withColumn("_c", F.array_max(errors) <= width).withColumn(
        "_in", F.size(F.filter(errors, lambda e: e <= width))).withColumn("_ok", F.col(support_p) > F.lit(support_alpha))
    hit = F.col("_c").cast("int")
    out = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("designs"), F.sum(hit).alias("covered"), F.avg(hit).alias("coverage"),
        (F.sum("_in") / F.sum(F.size(errors))).alias("pointwise"), F.avg(width).alias("mean_width"),
        F.count_if(~F.col("_ok")).alias("rejected"), F.avg(F.when(F.col("_ok"), hit)).alias("accepted_coverage"))
    low, high = wilson("covered", "designs")
    p90 = quantiles(base, keys, half_width, {"p90_width": 0.9}, rows=rows)
    return out.withColumn("wilson_low", low).withColumn("wilson_high", high).join(p90, list(keys))


def vacuous_summary(df: DataFrame, keys: Sequence[str], *, error: str, half_width: str) -> DataFrame:
    """Coverage that keeps infinite bands visible."""
    w = F.col(half_width)
    finite = is_finite(half_width)
    hit = (F.col(error) <= w).cast("int")
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("designs"), F.count_if(finite).alias("finite_bands"), F.sum(hit).alias("covered"),
        F.avg(hit).alias("coverage_with_vacuous"), F.avg(F.when(finite, hit)).alias("finite_coverage"),
        F.avg(F.when(finite, w)).alias("mean_finite_width"))
    return out.withColumn("vacuous_rate", F.lit(1.0) - F.col("finite_bands") / F.col("designs"))
