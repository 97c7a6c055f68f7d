"""Spectra of short windows held as arrays, and features read from them with array expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.scalars import DOUBLE_EPS, col, sum_of

PHASES = ("a", "b", "c")
DOUBLES = T.ArrayType(T.DoubleType())
SPECTRUM_TYPE = T.StructType([T.StructField(f"{part}_{p}", DOUBLES) for p in PHASES for part in ("re", "im")])


def _hann_spectrum(values: np.ndarray) -> np.ndarray:
    taper = np.hanning(values.shape[1])
    centered = values - values.mean(axis=1, keepdims=True)
    return 2.0 / taper.sum() * np.fft.rfft(centered * taper, axis=1)


@F.pandas_udf(SPECTRUM_TYPE)
def spectrum(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
    """Hann-weighted, mean-removed spectra of the three phases of each window."""
    out = {f"{part}_{p}": pd.Series([None] * len(a), dtype=object) for p in PHASES for part in ("re", "im")}
    for _, rows in a.groupby(a.map(len)).groups.items():
        for p, series in zip(PHASES, (a, b, c)):
            spec = _hann_spectrum(np.stack(series.loc[rows].to_numpy()).astype(float))
            out[f"re_{p}"].loc[rows] = pd.Series(list(spec.real), index=rows)
            out[f"im_{p}"].loc[rows] = pd.Series(list(spec.imag), index=rows)
    return pd.DataFrame(out)


def magnitude(spec: Column | str, phase: str) -> Column:
    s = col(spec)
    return F.zip_with(s[f"re_{phase}"], s[f"im_{phase}"], lambda re, im: F.hypot(re, im))


def mean_of_three(a: Column, b: Column, c: Column) -> Column:
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), c.alias("c")), lambda s: (s["a"] + s["b"] + s["c"]) / 3.0)


def with_magnitudes(df, spec: str = "spec"):
    """Add mag_a, mag_b, mag_c and their mean per bin."""
    out = df.withColumns({f"mag_{p}": magnitude(spec, p) for p in PHASES})
    return out.withColumn("mag", mean_of_three(F.col("mag_a"), F.col("mag_b"), F.col("mag_c")))


def strongest_bin(mag: Column | str, step_hz: float, low: float = 20.0, high: float = 500.0) -> Column:
    """Index of the strongest bin inside [low, high] Hz; the first one on ties."""
    m = col(mag)
    slack = DOUBLE_EPS * max(abs(high), 1.0) * 16
    indexed = F.transform(m, lambda v, k: F.struct(v.alias("v"), (-k).alias("first"), k.alias("k")))
    band = F.filter(indexed, lambda s: (s["k"] * step_hz >= low - slack) & (s["k"] * step_hz <= high + slack))
    return F.array_max(band)["k"]


def nearest_bin(target_hz: Column, step_hz: float, bins: Column) -> Column:
    """Bin closest to a frequency, the lower one on ties, kept inside the spectrum."""
    k = F.ceil(target_hz / F.lit(step_hz) - F.lit(0.5)).cast("int")
    return F.least(F.greatest(k, F.lit(0)), bins - 1)


def entropy(mag_a: str, mag_b: str, mag_c: str, step_hz: float, nyquist: float, low: float = 20.0,
            high: float = 2000.0) -> Column:
    """Normalised spectral entropy of the mean power on [low, min(high, Nyquist)]."""
    first, last = math.ceil(low / step_hz - 1e-9), math.floor(min(high, nyquist) / step_hz + 1e-9)
    count = last - first + 1
    power = F.slice(F.transform(F.arrays_zip(F.col(mag_a).alias("a"), F.col(mag_b).alias("b"), F.col(mag_c).alias("c")),
                                lambda s: (s["a"] * s["a"] + s["b"] * s["b"] + s["c"] * s["c"]) / 3.0), first + 1, count)
    total = F.aggregate(power, F.lit(0.0), lambda acc, v: acc + v) + F.lit(DOUBLE_EPS)
    term = F.aggregate(power, F.lit(0.0), lambda acc, v: acc - v / total * F.ln(v / total + F.lit(DOUBLE_EPS)))
    return term / F.lit(math.log(max(count, 2)))


def unbalance(re: list[Column], im: list[Column]) -> Column:
    """Smaller over larger symmetrical sequence magnitude of three phasors; 0 for a dead window."""
    h = math.sqrt(3.0) / 2.0
    zr = sum_of([re[0], F.lit(-0.5) * (re[1] + re[2])])
    zi = sum_of([im[0], F.lit(-0.5) * (im[1] + im[2])])
    cross_r, cross_i = F.lit(h) * (im[1] - im[2]), F.lit(h) * (re[1] - re[2])
    one = F.hypot(zr - cross_r, zi + cross_i) / 3.0
    two = F.hypot(zr + cross_r, zi - cross_i) / 3.0
    larger = F.greatest(one, two)
    return F.when(larger <= F.lit(DOUBLE_EPS), F.lit(0.0)).otherwise(F.least(one, two) / larger)


def clarke(a: Column | str, b: Column | str, c: Column | str) -> tuple[Column, Column, Column]:
    """Amplitude-invariant alpha, beta and zero components."""
    a, b, c = col(a), col(b), col(c)
    alpha = (a - (b + c) / 2.0) * F.lit(2.0 / 3.0)
    beta = (b - c) * F.lit(1.0 / math.sqrt(3.0))
    return alpha, beta, (a + b + c) / 3.0


def inverse_clarke(alpha: Column | str, beta: Column | str) -> tuple[Column, Column, Column]:
    """Balanced three phases from alpha and beta, with no zero component."""
    x, y = col(alpha), col(beta) * F.lit(math.sqrt(3.0))
    return x, (y - x) / 2.0, (-x - y) / 2.0


@F.pandas_udf(DOUBLES)
def fourier_encode(curve: pd.Series, kept: pd.Series) -> pd.Series:
    """DC and real parts of the first harmonics, then their imaginary parts."""
    if curve.empty:
        return pd.Series([], dtype=object)
    k = int(kept.iloc[0])
    spec = np.fft.rfft(np.stack(curve.to_numpy()).astype(float), axis=1)[:, :k]
    return pd.Series(list(np.hstack([spec.real, spec[:, 1:].imag])))


@F.pandas_udf(DOUBLES)
def fourier_decode(coordinates: pd.Series, positions: pd.Series) -> pd.Series:
    """Curve values from DC, real and imaginary coordinates."""
    if coordinates.empty:
        return pd.Series([], dtype=object)
    n, c = int(positions.iloc[0]), np.stack(coordinates.to_numpy())
    k = (c.shape[1] + 1) // 2
    spec = c[:, :k].astype(complex)
    spec[:, 1:] += 1j * c[:, k:]
    return pd.Series(list(np.fft.irfft(spec, n=n, axis=1)))


@F.pandas_udf(T.DoubleType())
def retained_energy(curve: pd.Series, kept: pd.Series) -> pd.Series:
    """Share of the squared spectrum held by the first coefficients."""
    if curve.empty:
        return pd.Series([], dtype=float)
    e = np.abs(np.fft.rfft(np.stack(curve.to_numpy()).astype(float), axis=1)) ** 2
    return pd.Series(e[:, :int(kept.iloc[0])].sum(axis=1) / e.sum(axis=1))


def lowpass_taps(down: int, beta: float = 5.0) -> list[float]:
    """Unit-gain Kaiser low-pass taps for integer decimation, ten output steps to each side."""
    half = 10 * down
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / down) * np.kaiser(2 * half + 1, beta)
    return [float(v) for v in taps / taps.sum()]
