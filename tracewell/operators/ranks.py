"""Rank and quantile operators built on counts per distinct value.

Grouping by ``(keys, value)`` first means ties collapse map-side and the ordered pass sees each
distinct value once, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import session
from tracewell.functions.scalars import ratio
from tracewell.operators.ordered import running

#: Bins between the smallest and the largest value of a group.
BINS = 4096


def value_counts(df: DataFrame, keys: Sequence[str], value: str,
                 weights: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per distinct value with its row count and summed weights."""
    extra = [F.sum(expr).alias(name) for name, expr in (weights or {}).items()]
    return (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
            .agg(F.count(F.lit(1)).alias("n"), *extra))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float], *,
              higher: bool = False, rows: int | None = None, largest: int | None = None, few: bool = False) -> DataFrame:
    """Exact quantiles per group: linear interpolation, or the next higher order statistic.

    Groups that are known to be small (``rows`` bounds the input, ``largest`` one group) use the exact percentile aggregate, whose buffer is then
    bounded; otherwise an ordered pass over the distinct values finds the ranks. ``few`` says that there are few groups: their values are then
    counted in bins first, and only the bins that hold a wanted rank are ordered.
    """
    limit = session.rows_per_chunk(df.sparkSession)
    if rows is None:
        rows = df.count()
    if min(rows, rows if largest is None else largest) <= limit and not higher:
        found = df.groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(q)) for q in wanted.values()])).alias("_q"))
        return found.filter("_q is not null").select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(wanted)])
    if few:
        placed = _near_ranks(df, keys, value, list(wanted.values()))
    else:
        counts = value_counts(df, keys, value)
        placed = running(counts, keys, [value], sums={"_hi": F.col("n")}, totals={"_total": F.col("n")}, rows=rows, largest=largest)
    low = F.col("_hi") - F.col("n")
    out, names = [], []
    for i, (name, q) in enumerate(wanted.items()):
        pos = F.lit(float(q)) * (F.col("_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        holds_lo = (low <= lo) & (lo < F.col("_hi"))
        holds_hi = (low <= hi) & (hi < F.col("_hi"))
        out += [F.max(F.when(holds_lo, F.col(value))).alias(f"_lo{i}"),
                F.max(F.when(holds_hi, F.col(value))).alias(f"_hi{i}"),
                F.max(pos - lo).alias(f"_f{i}"), F.max(lo + 1 - pos).alias(f"_g{i}")]
        names.append((name, i))
    table = placed.groupBy(*keys).agg(*out)
    final = []
    for name, i in names:
        a, b = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        # the weights of the percentile aggregate, so that both ways agree to the last bit
        between = F.when(a == b, a).otherwise(a * F.col(f"_g{i}") + b * F.col(f"_f{i}"))
        final.append((b if higher else between).alias(name))
    return table.select(*keys, *final)


def _near_ranks(df: DataFrame, keys: Sequence[str], value: str, wanted: Sequence[float]) -> DataFrame:
    """Counts of the distinct values next to the wanted ranks, with the rows up to each (``_hi``) and of its whole group (``_total``).

    Bins are a non-decreasing function of the value between a group's finite ends; there are at most BINS + 2 a group.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    base = df.select(*keys, value).filter(F.col(value).isNotNull())
    finite = F.when(F.abs(x) < F.lit(float("inf")), x)
    ends = base.groupBy(*keys).agg((F.min(finite) * 0.5).alias("_a"), (F.max(finite) * 0.5).alias("_b"))  # halves: the width is finite
    share = F.coalesce(F.try_divide(x * 0.5 - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0))
    cell = F.when(x * 0.5 > F.col("_b"), BINS).when(x * 0.5 < F.col("_a"), -1).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
    binned = session.join_null_safe(base, F.broadcast(ends), keys).select(*keys, value, cell.cast("int").alias("_bin"))
    sizes = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*keys)
    upto = F.sum("_c").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sizes = sizes.select(*keys, "_bin", "_c", (upto - F.col("_c")).alias("_before"), F.sum("_c").over(group).alias("_total"))
    at = F.col("_total") - 1
    hit = F.lit(False)
    for q in wanted:
        for rank in (F.floor(F.lit(float(q)) * at), F.ceil(F.lit(float(q)) * at)):
            hit = hit | ((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_c")))
    held = session.landed(sizes.filter(hit), "quantile-bins")
    rows = held.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    counts = value_counts(session.join_null_safe(binned, F.broadcast(held.select(*keys, "_bin")), [*keys, "_bin"]), [*keys, "_bin"], value)
    inside = running(counts, [*keys, "_bin"], [value], sums={"_in": F.col("n")}, rows=rows)
    placed = session.join_null_safe(inside, F.broadcast(held.drop("_c")), [*keys, "_bin"])
    return placed.select(*keys, value, "n", (F.col("_in") + F.col("_before")).alias("_hi"), "_total")


def order_statistic(df: DataFrame, keys: Sequence[str], value: str, rank: Column, name: str, *,
                    rows: int | None = None) -> DataFrame:
    """Value at a 1-based rank given as an expression of ``_total``; null when rank > total."""
    counts = value_counts(df, keys, value)
    placed = running(counts, keys, [value], sums={"_hi": F.col("n")}, totals={"_total": F.col("n")},
                     rows=rows).withColumn("_rank", rank)
    hit = (F.col("_rank") > F.col("_hi") - F.col("n")) & (F.col("_rank") <= F.col("_hi"))
    return placed.groupBy(*keys).agg(
        F.max(F.when(hit, F.col(value))).alias(name), F.max("_rank").alias("rank"),
        F.max("_total").alias("n"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str, *,
                  rows: int | None = None) -> DataFrame:
    """Table of distinct values with their tie-averaged 1-based rank."""
    counts = value_counts(df, keys, value)
    walked = running(counts, keys, [value], sums={"_hi": F.col("n")}, rows=rows)
    return walked.select(*keys, value, (F.col("_hi") - (F.col("n") - 1) / 2.0).alias(name))


def auroc(df: DataFrame, keys: Sequence[str], score: str, positive: Column, *,
          rows: int | None = None, name: str = "auroc") -> DataFrame:
    """Area under the ROC curve with ties counted half; null when a class is missing."""
    pos, neg = positive.cast("long"), (~positive).cast("long")
    counts = value_counts(df, keys, score, {"_p": pos, "_q": neg})
    walked = running(counts, keys, [score], sums={"_cq": F.col("_q")}, rows=rows)
    wins = F.col("_p") * (F.col("_cq") - F.col("_q") / 2.0)
    return (walked.groupBy(*keys)
            .agg(F.sum("_p").cast("long").alias("positives"), F.sum("_q").cast("long").alias("negatives"),
                 F.sum(wins).alias("_w"))
            .select(*keys, "positives", "negatives",
                    ratio("_w", F.col("positives") * F.col("negatives")).alias(name)))


def average_precision(df: DataFrame, keys: Sequence[str], score: str, positive: Column, *,
                      rows: int | None = None, name: str = "auprc") -> DataFrame:
    """Step-wise area under the precision-recall curve, one step per distinct score."""
    counts = value_counts(df, keys, score, {"_p": positive.cast("long")})
    counts = counts.withColumn("_down", -F.col(score).cast("double"))
    walked = running(counts, keys, ["_down"], sums={"_tp": F.col("_p"), "_all": F.col("n")}, rows=rows)
    step = F.col("_p") * F.col("_tp") / F.col("_all")
    return walked.groupBy(*keys).agg(ratio(F.sum(step), F.sum("_p")).alias(name))


def guarded_corr(x: str, y: str, floor: float = 1e-12) -> Column:
    """Pearson correlation, null when either side is constant."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > floor) & (sy > floor), F.try_divide(F.covar_pop(x, y), sx * sy))


def correlations(df: DataFrame, keys: Sequence[str], x: str, y: str, *,
                 rows: int | None = None) -> DataFrame:
    """Pearson and Spearman per group, null for constant inputs."""
    base = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    rx = average_ranks(base, keys, "_x", "_rx", rows=rows)
    ry = average_ranks(base, keys, "_y", "_ry", rows=rows)
    ranked = session.join_null_safe(session.join_null_safe(base, rx, [*keys, "_x"]), ry, [*keys, "_y"])
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), guarded_corr("_x", "_y").alias("pearson"),
        guarded_corr("_rx", "_ry").alias("spearman"))
