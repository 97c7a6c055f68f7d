"""Window features of three-phase recordings and whole-record decimation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import spectral
from tracewell.functions.scalars import DOUBLE_EPS, col
from tracewell.functions.spectral import PHASES

EPS = DOUBLE_EPS
HARMONICS = (2, 3, 4, 5)


def _mean(values: Sequence[Column]) -> Column:
    total = values[0]
    for v in values[1:]:
        total = total + v
    return total / float(len(values))


def _deviation(values: Sequence[Column]) -> Column:
    m = _mean(values)
    return F.sqrt(_mean([(v - m) * (v - m) for v in values]))


def time_features(samples: DataFrame, keys: Sequence[str], *, index: str, size: int,
                  phases: Sequence[str] = ("ia", "ib", "ic")) -> DataFrame:
    """One aggregation per window: level, shape and Clarke features, and the ordered sample arrays.

    A window has ``size`` samples by construction, so its arrays are bounded; other windows drop out.
    """
    alpha, beta, zero = spectral.clarke(*phases)
    radius = F.hypot(alpha, beta)
    aggs = [F.count(F.lit(1)).alias("_n"), F.avg(radius).alias("clarke_radius_mean"),
            F.stddev_pop(radius).alias("_radius_sd"), F.sqrt(F.avg(zero * zero)).alias("zero_sequence_rms"),
            F.sort_array(F.collect_list(F.struct(F.col(index), *[F.col(p).cast("double").alias(f"v{i}")
                                                                 for i, p in enumerate(phases)]))).alias("_s")]
    for p, name in zip(PHASES, phases):
        x = F.col(name).cast("double")
        aggs += [F.sqrt(F.avg(x * x)).alias(f"rms_{p}"), F.max(F.abs(x)).alias(f"_peak_{p}"),
                 F.stddev_pop(x).alias(f"_sd_{p}"), F.avg(x).alias(f"_m_{p}"), F.avg(x * x).alias(f"_m2_{p}"),
                 F.avg(x * x * x).alias(f"_m3_{p}"), F.avg(x * x * x * x).alias(f"_m4_{p}")]
    g = samples.groupBy(*keys).agg(*aggs).filter(F.col("_n") == size)
    rms = [F.col(f"rms_{p}") for p in PHASES]
    level = _mean(rms) + F.lit(EPS)
    cols = {"phase_rms_cv": _deviation(rms) / level, "zero_sequence_ratio": F.col("zero_sequence_rms") / level,
            "clarke_radius_cv": F.col("_radius_sd") / (F.col("clarke_radius_mean") + F.lit(EPS))}
    for i, p in enumerate(PHASES):
        m, m2, m3, m4 = (F.col(f"_m{k}_{p}") for k in ("", "2", "3", "4"))
        fourth = m4 - 4.0 * m * m3 + 6.0 * m * m * m2 - 3.0 * m * m * m * m
        var = F.col(f"_sd_{p}") * F.col(f"_sd_{p}")
        cols |= {f"rms_ratio_{p}": F.col(f"rms_{p}") / level,
                 f"crest_{p}": F.col(f"_peak_{p}") / (F.col(f"rms_{p}") + F.lit(EPS)),
                 f"kurtosis_{p}": F.try_divide(fourth, var * var),
                 f"wave_{p}": F.col("_s")[f"v{i}"]}
    return g.withColumns(cols).select(
        *keys, *[f"wave_{p}" for p in PHASES], "clarke_radius_mean", "clarke_radius_cv", "zero_sequence_rms",
        "zero_sequence_ratio", "phase_rms_cv",
        *[f"{n}_{p}" for p in PHASES for n in ("rms", "rms_ratio", "crest", "kurtosis")])


def with_spectrum(windows: DataFrame) -> DataFrame:
    """Add the spectra of the wave arrays and their magnitudes."""
    spec = windows.withColumn("spec", spectral.spectrum("wave_a", "wave_b", "wave_c"))
    return spectral.with_magnitudes(spec)


def spectral_features(windows: DataFrame, *, rate: float, size: int) -> DataFrame:
    """Fundamental, unbalance, harmonics, side bands and entropy as array expressions on one row per window."""
    step = rate / size
    bins = F.size("mag")
    k0 = F.col("_k0")
    fundamental = k0 * F.lit(step)
    out = windows.withColumn("_k0", spectral.strongest_bin("mag", step))
    amp = [F.get(F.col(f"mag_{p}"), k0) for p in PHASES]
    mean_amp = _mean(amp)
    cols = {
        "fundamental_hz": fundamental,
        "sequence_unbalance": spectral.unbalance([F.get(F.col("spec")[f"re_{p}"], k0) for p in PHASES],
                                                 [F.get(F.col("spec")[f"im_{p}"], k0) for p in PHASES]),
        "fundamental_amplitude_mean": mean_amp,
        "fundamental_amplitude_cv": _deviation(amp) / (mean_amp + F.lit(EPS)),
        "spectral_entropy": spectral.entropy("mag_a", "mag_b", "mag_c", step, rate / 2.0)}
    for label, factor in (("lower", 0.75), ("upper", 1.25)):
        at = spectral.nearest_bin(fundamental * factor, step, bins)
        cols[f"sideband_{label}_ratio"] = F.get("mag", at) / (mean_amp + F.lit(EPS))
    squares = [F.lit(0.0)] * 3
    for h in HARMONICS:
        at = spectral.nearest_bin(fundamental * float(h), step, bins)
        ratios = [F.get(F.col(f"mag_{p}"), at) / (a + F.lit(EPS)) for p, a in zip(PHASES, amp)]
        squares = [s + q * q for s, q in zip(squares, ratios)]
        cols |= {f"harmonic_{h}_ratio_mean": _mean(ratios), f"harmonic_{h}_ratio_max": F.greatest(*ratios)}
    cols["thd_2_to_5_mean"] = _mean([F.sqrt(s) for s in squares])
    return out.withColumns(cols).drop("_k0")


def window_features(samples: DataFrame, keys: Sequence[str], *, index: str, size: int, rate: float,
                    phases: Sequence[str] = ("ia", "ib", "ic")) -> DataFrame:
    """The full feature row of every complete window: one shuffle, then row-wise work."""
    t = time_features(samples, keys, index=index, size=size, phases=phases)
    full = spectral_features(with_spectrum(t), rate=rate, size=size)
    return full.drop("spec", "mag", *[f"{n}_{p}" for n in ("mag", "wave") for p in PHASES])


def decimate(samples: DataFrame, keys: Sequence[str], index: str, value: str, down: int, *,
             block: int = 100_000) -> DataFrame:
    """Anti-aliased integer decimation of whole records.

    The straight line from the first to the last sample is removed before filtering and added back.
    Records are cut into blocks of output steps; each block receives its own samples and the filter's
    reach on either side, so no task sees a whole record.
    """
    taps = np.asarray(spectral.lowpass_taps(down))
    half, span = 10 * down, block * down
    ends = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(index, value))[value].alias("_first"),
        F.max(F.struct(index, value))[value].alias("_last"))
    slope = (F.col("_last") - F.col("_first")) / (F.col("_n") - 1)
    flat = samples.select(*keys, index, value).join(ends, list(keys)).withColumn(
        "_x", F.col(value) - F.col("_first") - slope * F.col(index))
    low = F.greatest(F.floor((F.col(index) - half) / span), F.lit(0).cast("long"))
    high = F.least(F.floor((F.col(index) + half) / span), F.floor((F.col("_n") - 1) / span))
    placed = flat.withColumn("_b", F.explode(F.sequence(low, high)))

    def filter_block(pdf: pd.DataFrame) -> pd.DataFrame:
        b, n = int(pdf["_b"].iloc[0]), int(pdf["_n"].iloc[0])
        start, stop = b * span, min((b + 1) * span, n)
        line = np.zeros(stop - start + 2 * half)
        line[pdf[index].to_numpy() - (start - half)] = pdf["_x"].to_numpy()
        smooth = np.convolve(line, taps, mode="valid")[::down]
        steps = np.arange(start // down, start // down + len(smooth))
        first, last = pdf["_first"].iloc[0], pdf["_last"].iloc[0]
        base = first + (last - first) * n / (n - 1) * steps / (-(-n // down))
        head = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame({**head, "step": steps, "value": smooth + base})

    types = dict(samples.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["step long", "value double"])
    return placed.groupBy(*keys, "_b").applyInPandas(filter_block, schema)


def phase_columns(alpha: Column | str, beta: Column | str) -> dict[str, Column]:
    """Named pseudo three-phase columns from alpha and beta."""
    return dict(zip(("ia", "ib", "ic"), spectral.inverse_clarke(col(alpha), col(beta))))
