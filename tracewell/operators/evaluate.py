"""Evaluation of detectors for many methods, folds or candidates in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import ratio, wilson
from tracewell.operators import conformal, covariance
from tracewell.operators.ranks import auroc


def evaluate_methods(blocks: DataFrame, keys: Sequence[str], *, far_limit: float = 0.05,
                     rows: int | None = None) -> DataFrame:
    """False alarms with Wilson bounds, pooled, macro and any detection, AUROC and the gate per key."""
    keys = list(keys)
    healthy, fault = F.col("role") == "health_test", F.col("role") == "fault_test"
    per_record = blocks.groupBy(*keys, "record_id").agg(
        F.count_if(healthy & F.col("alarm")).alias("_fa"), F.count_if(healthy).alias("_hb"),
        F.count_if(fault & F.col("alarm")).alias("_de"), F.count_if(fault).alias("_fb"))
    rate = ratio("_de", "_fb")
    table = per_record.groupBy(*keys).agg(
        F.sum("_fa").alias("false_alarms"), F.sum("_hb").alias("healthy_blocks"),
        ratio(F.sum("_de"), F.sum("_fb")).alias("detection"), F.avg(F.when(F.col("_fb") > 0, rate)).alias("macro_detection"),
        F.avg(F.when(F.col("_fb") > 0, (F.col("_de") > 0).cast("int"))).alias("any_detection"))
    low, high = wilson("false_alarms", "healthy_blocks")
    table = table.withColumns({"far": ratio("false_alarms", "healthy_blocks"), "far_low": low, "far_high": high})
    curve = auroc(blocks.filter(healthy | fault), keys, "score", fault, rows=rows).select(*keys, "auroc")
    return table.join(curve, keys).withColumn("far_gate", F.col("far") <= F.lit(far_limit))


def nested_ridge_selection(df: DataFrame, columns: Sequence[str], *, entity: str, healthy: str, order: str,
                           candidates: Sequence[float], alpha: float, rows: int | None = None) -> DataFrame:
    """Score every ridge candidate on every pseudo-target and flag the best mean objective.

    Covariances of all entities come from one aggregation; each (pseudo-target, candidate) pair is a
    constant matrix, and one pass scores the rows of each target under all of its candidates.
    """
    d = len(columns)
    found = covariance.matrices(covariance.sample_covariance(df.filter(healthy), [entity], columns), [entity], d)
    scored = None
    for (target,), _ in sorted(found.items()):
        sources = [m for (e,), m in found.items() if e != target]
        methods = {f"{c:g}": (covariance.log_euclidean_mean(sources, c), None) for c in candidates}
        part = covariance.method_scores(df.filter(F.col(entity) == target), columns, methods).withColumn("target", F.lit(target))
        scored = part if scored is None else scored.unionByName(part)
    calibration = F.col(healthy) & (F.col(order) % 2 == 0)
    p = conformal.p_values(scored, ["target", "method"], "score", calibration, rows=rows)
    alarm = (F.col("p_value") <= F.lit(alpha)).cast("int")
    fold = p.groupBy("target", "method").agg(
        F.avg(F.when(~F.col(healthy), alarm)).alias("detection"),
        F.avg(F.when(F.col(healthy) & (F.col(order) % 2 == 1), alarm)).alias("far"))
    mean = fold.groupBy("method").agg(F.avg("detection").alias("detection"), F.avg("far").alias("far"), F.count(F.lit(1)).alias("folds"))
    mean = mean.withColumn("objective", F.col("detection") - 2.0 * F.col("far"))
    best = mean.agg(F.max(F.struct("objective", (-F.col("method").cast("double")).alias("small"), "method"))["method"].alias("best"))
    return mean.join(F.broadcast(best), F.col("method") == F.col("best"), "left").withColumn(
        "selected", F.col("best").isNotNull()).drop("best")
