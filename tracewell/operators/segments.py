"""Windows, blocks, onsets and session anchors over ordered samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import MAD_TO_SIGMA, col
from tracewell.operators.ordered import explode_range, first_sustained, trailing_mean


def array_median(values: str) -> Column:
    """Median of a sorted array, null for an empty one."""
    n = F.size(values)
    low, high = F.get(values, F.floor((n - 1) / 2).cast("int")), F.get(values, F.floor(n / 2).cast("int"))
    return (low + high) / 2.0


def complete_block(index: Column | str, total: Column | str, block: int) -> Column:
    """Block number of a sample, null in the incomplete tail."""
    b = F.floor(col(index) / block)
    return F.when(b < F.floor(col(total) / block), b)


def window_starts(records: DataFrame, keys: Sequence[str], total: str, *, window: int, stride: int,
                  block: int) -> DataFrame:
    """All windows that lie inside complete blocks: block_id, window_id, start and stop."""
    if not 0 < window <= block or stride <= 0:
        raise ValueError("windows must fit in a block")
    per_block = (block - window) // stride + 1
    blocks = F.floor(F.col(total) / block).cast("long")
    out = explode_range(records.select(*keys, total), blocks, "block_id")
    out = out.withColumn("_w", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(per_block - 1).cast("long"))))
    start = F.col("block_id") * block + F.col("_w") * stride
    return out.select(*keys, "block_id", (F.col("block_id") * per_block + F.col("_w")).alias("window_id"),
                      start.alias("start"), (start + window).alias("stop"))


def assign_windows(samples: DataFrame, index: str, *, window: int, stride: int, block: int,
                   total: str) -> DataFrame:
    """Copy each sample into every window of its complete block that covers it.

    The fan-out is at most ceil(window / stride), a constant of the protocol; no join is needed.
    """
    per_block = (block - window) // stride + 1
    b = complete_block(index, total, block)
    offset = F.col(index) % block
    first = F.greatest(F.lit(0).cast("long"), F.floor((offset - window) / stride) + 1)
    last = F.least(F.lit(per_block - 1).cast("long"), F.floor(offset / stride))
    placed = samples.withColumn("block_id", b).filter(F.col("block_id").isNotNull() & (first <= last))
    return (placed.withColumn("_w", F.explode(F.sequence(first, last)))
            .withColumn("window_id", F.col("block_id") * per_block + F.col("_w")).drop("_w"))


def interval_means(samples: DataFrame, windows: DataFrame, keys: Sequence[str], *, index: str, value: str,
                   width: int, id_cols: Sequence[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """Mean of the samples in [start, stop) per window, for windows of any position and length.

    Samples are first summed per aligned bucket of ``width`` rows. A window takes whole buckets from
    that table and single samples only from its two edge buckets, both through equi-joins.
    """
    s = samples.select(*keys, F.col(index).alias("_i"), F.col(value).cast("double").alias("_v"),
                       F.floor(F.col(index) / width).alias("_b"))
    sums = s.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
    w = windows.select(*keys, *id_cols, start, stop)
    first_full = F.ceil(F.col(start) / width).cast("long")
    last_full = F.floor(F.col(stop) / width).cast("long") - 1
    full = (w.filter(first_full <= last_full).withColumn("_b", F.explode(F.sequence(first_full, last_full)))
            .join(sums, [*keys, "_b"]).select(*keys, *id_cols, "_s", "_n"))
    left, right = F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width)
    edges = F.array_distinct(F.filter(F.array(left, right), lambda b: (b < first_full) | (b > last_full)))
    part = (w.withColumn("_b", F.explode(edges)).join(s, [*keys, "_b"])
            .filter((F.col("_i") >= F.col(start)) & (F.col("_i") < F.col(stop)))
            .groupBy(*keys, *id_cols).agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n")))
    total = full.unionByName(part).groupBy(*keys, *id_cols).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("samples"))
    return total.select(*keys, *id_cols, "samples", F.try_divide(F.col("_s"), F.col("samples")).alias("mean"))


def onset(samples: DataFrame, keys: Sequence[str], index: str, value: str, *, rms: int, persistence: int,
          baseline_fraction: float = 0.2, baseline_cap: int, sigmas: float = 10.0, peak_fraction: float = 0.02,
          rows: int | None = None) -> DataFrame:
    """First sustained rise of the trailing RMS over a baseline threshold, per record.

    threshold = max(median + sigmas * 1.4826 * MAD of the baseline RMS, peak_fraction * peak RMS)
    """
    sizes = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    x = F.col(value).cast("double")
    walked = trailing_mean(samples.select(*keys, index, value), keys, index, x * x, rms, "_ms")
    level = (walked.filter(F.col("_ms").isNotNull()).join(sizes, list(keys))
             .select(*keys, index, F.sqrt("_ms").alias("rms"), F.least(
                 F.floor(F.lit(baseline_fraction) * F.col("_total")), F.lit(baseline_cap).cast("long")).alias("_stop")))
    # the baseline holds at most baseline_cap samples of a record, so its sorted list is bounded
    base = F.sort_array(F.collect_list(F.when(F.col(index) < F.col("_stop"), F.col("rms"))))
    fit = (level.groupBy(*keys).agg(base.alias("_b"), F.max("rms").alias("peak_rms"), F.max("_stop").alias("baseline_stop"))
           .withColumn("baseline_median", array_median("_b"))
           .withColumn("_d", F.sort_array(F.transform("_b", lambda v: F.abs(v - F.col("baseline_median")))))
           .withColumn("baseline_sigma", F.lit(MAD_TO_SIGMA) * array_median("_d"))
           .withColumn("threshold", F.greatest(F.col("baseline_median") + F.lit(sigmas) * F.col("baseline_sigma"),
                                               F.lit(peak_fraction) * F.col("peak_rms"))).drop("_b", "_d"))
    flagged = level.join(fit.select(*keys, "threshold"), list(keys))
    start = first_sustained(flagged, keys, index, F.col("rms") >= F.col("threshold"), persistence, rows=rows)
    onset_at = F.when(F.col("start_index") >= F.col("baseline_stop"), F.col("start_index"))
    return (fit.join(start, list(keys), "left").withColumn("onset_index", onset_at)
            .select(*keys, "baseline_median", "baseline_sigma", "peak_rms", "baseline_stop", "threshold", "onset_index"))


def onset_windows(records: DataFrame, keys: Sequence[str], *, total: str, onset_index: str, window: int, guard: int,
                  horizon: int | None = None) -> DataFrame:
    """Guarded windows before the onset from the record start, complete windows after it."""
    n, at = F.col(total), F.col(onset_index)
    pre = F.floor((at - guard) / window)
    stop = F.least(n, at + horizon) if horizon is not None else n
    post = F.floor((stop - at) / window)
    found = records.filter(at.isNotNull()).select(*keys, total, onset_index)

    def run(count: Column, first: Column, segment: str) -> DataFrame:
        start = first + F.col("position") * window
        return explode_range(found, count, "position").select(
            *keys, F.lit(segment).alias("segment"), "position", start.alias("start"), (start + window).alias("stop"))

    return run(pre, F.lit(0).cast("long"), "pre").unionByName(run(post, at, "post"))


def session_residuals(windows: DataFrame, keys: Sequence[str], position: str, features: Sequence[str], *,
                      anchors: int = 2, segment: Column | None = None) -> DataFrame:
    """Subtract the median of the first anchor windows of each record from its later windows.

    The anchor has a fixed small number of rows, so its median is a bounded aggregate.
    """
    where = segment if segment is not None else F.lit(True)
    anchor = (windows.filter(where & (F.col(position) < anchors)).groupBy(*keys)
              .agg(F.count(F.lit(1)).alias("_n"), F.min(position).alias("anchor_first"), F.max(position).alias("anchor_last"),
                   *[F.median(f).alias(f"_a_{f}") for f in features]).filter(F.col("_n") == anchors))
    scored = windows.filter(~(where & (F.col(position) < anchors))).join(anchor, list(keys))
    return scored.select(*windows.columns, "anchor_first", "anchor_last",
                         *[(F.col(f) - F.col(f"_a_{f}")).alias(f"residual_{f}") for f in features])
