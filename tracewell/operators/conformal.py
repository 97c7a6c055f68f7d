"""Split-conformal thresholds, p-values, bands and weighted quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import session
from tracewell.operators.ordered import asof, running
from tracewell.operators.ranks import order_statistic

INF = float("inf")


def threshold(calibration: DataFrame, keys: Sequence[str], score: str, alpha: float, *,
              overflow: str = "inf", name: str = "threshold", rows: int | None = None) -> DataFrame:
    """Order statistic of rank ceil((n + 1)(1 - alpha)) per key.

    overflow='inf' gives an infinite threshold when the rank exceeds n; 'clamp' takes the maximum.
    """
    rank = F.ceil((F.col("_total") + 1) * F.lit(1.0 - alpha)).cast("long")
    if overflow == "clamp":
        rank = F.least(rank, F.col("_total"))
    elif overflow != "inf":
        raise ValueError("overflow must be 'inf' or 'clamp'")
    table = order_statistic(calibration, keys, score, rank, name, rows=rows)
    return table.withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(INF)))


def coverage_quantile(calibration: DataFrame, keys: Sequence[str], score: str, coverage: float, *,
                      name: str = "half_width", rows: int | None = None) -> DataFrame:
    """Order statistic of rank ceil((n + 1) * coverage), infinite when the rank exceeds n."""
    rank = F.ceil((F.col("_total") + 1) * F.lit(coverage)).cast("long")
    table = order_statistic(calibration, keys, score, rank, name, rows=rows)
    return table.withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(INF)))


def p_values(df: DataFrame, keys: Sequence[str], score: str, calibration: Column, *,
             name: str = "p_value", rows: int | None = None) -> DataFrame:
    """Upper-tail conformal p-value of every row against the calibration rows of its key.

    (1 + #{calibration >= s}) / (n + 1) comes from one ordered pass over the distinct scores and
    goes back to the rows by an equi-join, so no row is compared with every calibration row. An
    input that is known to be small takes the same count from one range window instead.
    """
    limit = session.rows_per_chunk(df.sparkSession)
    if rows is None:
        rows = df.count()
    if rows <= limit:
        group = Window.partitionBy(*keys)
        above = group.orderBy(F.col(score).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        hit = F.when(calibration, 1)
        return df.withColumn(name, (F.count(hit).over(above) + 1.0) / (F.count(hit).over(group) + 1.0))
    counts = df.groupBy(*keys, score).agg(F.count_if(calibration).alias("_c"))
    walked = running(counts, keys, [score], sums={"_upto": F.col("_c")}, totals={"_all": F.col("_c")}, rows=rows)
    at_least = F.col("_all") - F.col("_upto") + F.col("_c")
    table = walked.select(*keys, score, ((at_least + 1.0) / (F.col("_all") + 1.0)).alias(name))
    return session.join_null_safe(df, table, [*keys, score])


def weighted_quantiles(calibration: DataFrame, tests: DataFrame, keys: Sequence[str], *, score: str,
                       weight: str, test_weight: str, id_cols: Sequence[str], alpha: float,
                       name: str = "half_width", rows: int | None = None) -> DataFrame:
    """Weighted split-conformal quantile per test row, infinite when the mass cannot be reached."""
    mass = calibration.groupBy(*keys, score).agg(F.sum(weight).alias("_w"))
    steps = running(mass, keys, [score], sums={"_cum": F.col("_w")}, rows=rows)
    total = calibration.groupBy(*keys).agg(F.sum(weight).alias("_total"))
    needed = session.join_null_safe(tests, total, list(keys)).withColumn(
        "_need", F.lit(1.0 - alpha) * (F.col("_total") + F.col(test_weight)))
    # the smallest score whose cumulative mass reaches the need: a forward as-of on the mass axis;
    # scores rise with the mass, so the smallest score at one mass is kept by negating twice
    steps = steps.select(*keys, F.col("_cum").alias("_need"), (-F.col(score)).alias("_neg"))
    found = asof(needed, steps, keys, at="_need", value="_neg", direction="forward",
                 name="_hit", id_cols=[*id_cols, test_weight], rows=rows)
    return found.select(*keys, *id_cols, test_weight, F.coalesce(-F.col("_hit"), F.lit(INF)).alias(name))
