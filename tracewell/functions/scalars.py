"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the published constants for equal results.
WILSON_Z = 1.959963984540054
MAD_TO_SIGMA = 1.4826
IQR_TO_SIGMA = 1.349
DOUBLE_EPS = 2.220446049250313e-16
SQRT_EPS = 1.4901161193847656e-08


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r6(x: Column | str) -> Column:
    """Round to six places and turn negative zero into zero.

    The small shift moves exact halves of the sixth place off the rounding edge, where the order of a
    floating-point sum would decide.
    """
    return F.round(col(x).cast("double") + F.lit(1e-9), 6) + F.lit(0.0)


def is_finite(x: Column | str) -> Column:
    """True for values that are neither null, NaN nor infinite."""
    c = col(x).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def all_finite(columns: Iterable[str]) -> Column:
    out = F.lit(True)
    for name in columns:
        out = out & is_finite(name)
    return out


def ratio(a: Column | str, b: Column | str) -> Column:
    """Division that yields null for a zero divisor, also in ANSI mode."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(x: Column | str, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.least(F.greatest(col(x), low), high)


def wilson(successes: Column | str, trials: Column | str, *, z: float = WILSON_Z,
           clamp: bool = True) -> tuple[Column, Column]:
    """Lower and upper Wilson score bounds; null when there are no trials."""
    k = col(successes).cast("double")
    n = F.when(col(trials) > 0, col(trials).cast("double"))
    p = k / n
    z2 = float(z) * float(z)
    scale = F.lit(1.0) + F.lit(z2) / n
    middle = (p + F.lit(z2) / (n * 2.0)) / scale
    spread = F.lit(float(z)) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z2) / (n * n * 4.0)) / scale
    low, high = middle - spread, middle + spread
    return (F.greatest(low, F.lit(0.0)), F.least(high, F.lit(1.0))) if clamp else (low, high)


def strict_boolean(text: Column | str) -> Column:
    """'true' and 'false' in any case, blanks trimmed; null for anything else."""
    t = F.lower(F.trim(col(text).cast("string")))
    return F.when(t == "true", F.lit(True)).when(t == "false", F.lit(False))


def trimmed_number(x: Column | str, places: int = 6) -> Column:
    """Render a number without trailing zeros or a trailing point."""
    text = F.format_string(f"%.{places}f", col(x).cast("double"))
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def number_token(x: Column | str, places: int = 6) -> Column:
    """Number text safe for identifiers: the decimal point becomes a p."""
    return F.replace(trimmed_number(x, places), F.lit("."), F.lit("p"))


def whole_units(amount: Column | str, unit: float, *, tolerance: float = 1e-9) -> Column:
    """Amount divided by unit as a long; null unless it is a positive whole number."""
    q = col(amount).cast("double") / F.lit(float(unit))
    whole = F.rint(q)
    return F.when((F.abs(q - whole) < tolerance) & (whole >= 1), whole.cast("long"))


def minimum_calibration(alpha: Column | float) -> Column:
    """Fewest calibration units that give a finite threshold at this level."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    needed = F.ceil(F.lit(1.0) / a - F.lit(1.0) - F.lit(1e-12)).cast("long")
    return F.greatest(F.lit(1).cast("long"), needed)


def hash_draw(*parts: Column | str) -> Column:
    """A reproducible 32-bit non-negative integer from the md5 of the joined parts."""
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def sum_of(columns: Sequence[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


def dot(columns: Sequence[Column | str], weights: Sequence[float]) -> Column:
    return sum_of([col(c) * F.lit(float(w)) for c, w in zip(columns, weights)])
