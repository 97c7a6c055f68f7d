"""Data contracts. Every check returns one row per violation or per rule; ``enforce`` raises."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import is_finite
from tracewell.operators.ordered import running


class ContractError(ValueError):
    """A data contract does not hold."""


def require_columns(df: DataFrame, required: Sequence[str], forbidden: Sequence[str] = ()) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    unwanted = sorted(set(forbidden) & set(df.columns))
    if missing or unwanted:
        raise ContractError(f"missing columns {missing}, forbidden columns {unwanted}")
    return df


def enforce(violations: DataFrame, message: str) -> None:
    """Raise when a violation table is not empty; reads at most one row."""
    first = violations.take(1)
    if first:
        raise ContractError(f"{message}: {first[0].asDict()}")


def check_row(rule: str, df: DataFrame, failed: Column) -> DataFrame:
    """One row (rule, checked, failed, passed)."""
    return df.agg(F.count(F.lit(1)).alias("checked"), F.count_if(failed).alias("failed")).select(
        F.lit(rule).alias("rule"), "checked", "failed", (F.col("failed") == 0).alias("passed"))


def check_log(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def nonfinite_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null and non-finite counts per column from one aggregation."""
    per = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(~is_finite(c)).alias("bad")) for c in columns])
                 .alias("_c"))
    return per.select(F.inline("_c"))


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    keys = list(columns or df.columns)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def key_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return duplicate_rows(df, key)


def count_mismatches(df: DataFrame, category: str, expected: Mapping[str, int]) -> DataFrame:
    """Categories whose row count differs from the expectation, on either side."""
    want = F.map_from_arrays(F.array(*[F.lit(k) for k in expected]), F.array(*[F.lit(int(v)) for v in expected.values()]))
    seen = df.groupBy(category).agg(F.count(F.lit(1)).alias("observed"))
    listed = df.sparkSession.createDataFrame([(k,) for k in expected], f"{category} string")
    return (listed.join(seen, category, "full")
            .select(category, F.coalesce(want[F.col(category)], F.lit(0)).cast("long").alias("expected"),
                    F.coalesce("observed", F.lit(0)).cast("long").alias("observed"))
            .filter(F.col("expected") != F.col("observed")))


def missing_cells(df: DataFrame, factor_a: str, factor_b: str, levels_b: Sequence) -> DataFrame:
    """Combinations of the observed levels of one factor with a short list of levels that have no row."""
    grid = df.select(factor_a).distinct().withColumn(factor_b, F.explode(F.array(*[F.lit(v) for v in levels_b])))
    return grid.join(df.select(factor_a, factor_b).distinct(), [factor_a, factor_b], "left_anti")


def broken_runs(df: DataFrame, order: Sequence[str], key: str, *, rows: int | None = None) -> DataFrame:
    """Keys that occur in more than one contiguous run along the stored order."""
    one = df.select(F.lit(0).alias("_g"), *order, key)
    walked = running(one, ["_g"], list(order), lags={"_prev": key}, rows=rows)
    starts = F.count_if(F.col("_prev").isNull() | (F.col("_prev") != F.col(key)))
    return walked.groupBy(key).agg(starts.alias("runs")).filter("runs > 1")


def step_report(df: DataFrame, keys: Sequence[str], order: Sequence[str], t: str, *,
                rows: int | None = None) -> DataFrame:
    """Smallest, mean and largest time step per key and the largest relative deviation."""
    walked = running(df, keys, order, lags={"_before": t}, rows=rows)
    step = F.col(t) - F.col("_before")
    return (walked.withColumn("_d", step).groupBy(*keys)
            .agg(F.min("_d").alias("min_step"), F.avg("_d").alias("mean_step"), F.max("_d").alias("max_step"))
            .withColumn("increasing", F.col("min_step") > 0)
            .withColumn("jitter", F.try_divide(F.greatest(F.abs(F.col("max_step") - F.col("mean_step")),
                                                          F.abs(F.col("mean_step") - F.col("min_step"))), F.col("mean_step"))))


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str],
              tolerance: float) -> DataFrame:
    """Rows missing on either side, the largest deviation and the count beyond tolerance, per value."""
    both = left.select(*keys, F.lit(1).alias("_a"), *[F.col(v).alias(f"_a_{v}") for v in values]).join(
        right.select(*keys, F.lit(1).alias("_b"), *[F.col(v).alias(f"_b_{v}") for v in values]), list(keys), "full")
    parts = []
    for v in values:
        gap = F.abs(F.col(f"_a_{v}") - F.col(f"_b_{v}"))
        parts.append(F.struct(F.lit(v).alias("value"), F.count_if(F.col("_a").isNull()).alias("only_right"),
                              F.count_if(F.col("_b").isNull()).alias("only_left"), F.max(gap).alias("max_gap"),
                              F.count_if(gap > tolerance).alias("beyond")))
    return both.agg(F.array(*parts).alias("_p")).select(F.inline("_p"))


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Many-to-one join that raises when the right key repeats or, for a left join, a row finds no partner."""
    enforce(key_violations(right, on), "the right side of a many-to-one join repeats its key")
    if how == "left":
        enforce(left.select(*on).distinct().join(right.select(*on), list(on), "left_anti"), "rows without a partner")
    return left.join(right, list(on), how)


def leaking_groups(df: DataFrame, group: str, role: str) -> DataFrame:
    """Groups that appear under more than one role."""
    per = df.groupBy(group).agg(F.min(role).alias("_a"), F.max(role).alias("_b"))
    return per.filter(F.col("_a") != F.col("_b")).select(group)


def population_gaps(df: DataFrame, key: Sequence[str], method: str, methods: Sequence[str]) -> DataFrame:
    """Keys that are not present once for every method."""
    have = [F.count_if(F.col(method) == m).alias(f"_{i}") for i, m in enumerate(methods)]
    per = df.groupBy(*key).agg(*have)
    wrong = reduce(lambda a, b: a | b, [F.col(f"_{i}") != 1 for i in range(len(methods))])
    return per.filter(wrong).select(*key)


def protocol_differences(left: DataFrame, right: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Field-by-field comparison of two one-row metadata documents."""
    a = left.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("left"))
                                       for f in fields])))
    b = right.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("right"))
                                        for f in fields])))
    return a.join(b, "field").withColumn("equal", F.col("left").eqNullSafe(F.col("right")))
