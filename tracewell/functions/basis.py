"""Context bases of the mean models: linear, quadratic and uniform-knot splines."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

KINDS = ("constant", "linear", "quadratic", "spline")


def _bsplines(x: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """All B-splines of a uniform knot vector at x, by the recurrence on the degree."""
    values = ((x[:, None] >= knots[None, :-1]) & (x[:, None] < knots[None, 1:])).astype(float)
    for k in range(1, degree + 1):
        m = values.shape[1] - 1
        rise = (x[:, None] - knots[None, :m]) / (knots[k:k + m] - knots[:m])
        fall = (knots[None, k + 1:k + 1 + m] - x[:, None]) / (knots[k + 1:k + 1 + m] - knots[1:1 + m])
        values = rise * values[:, :-1] + fall * values[:, 1:]
    return values


def spline_columns(x: np.ndarray, low: float, high: float, *, knots: int, degree: int) -> np.ndarray:
    """Spline basis on [low, high], continued linearly outside, without its last column."""
    step = (high - low) / (knots - 1)
    grid = low + step * np.arange(-degree, knots + degree)
    tiny = step * 1e-7
    inside = np.clip(x, low, high - step * 1e-12)
    base = _bsplines(inside, grid, degree)
    for edge, inward, away in ((low, 1.0, x < low), (high, -1.0, x > high)):
        if away.any():
            at = np.array([min(edge, high - step * 1e-12), edge + inward * tiny])
            ends = _bsplines(at, grid, degree)
            slope = (ends[1] - ends[0]) / (at[1] - at[0])
            base[away] = ends[0] + (x[away, None] - edge) * slope
    return base[:, :-1]


@dataclass
class Basis:
    """A fitted context basis: which axes vary, how they are scaled and where the knots lie."""

    kind: str
    axes: list[int]
    mean: np.ndarray
    scale: np.ndarray
    low: np.ndarray = field(default_factory=lambda: np.zeros(0))
    high: np.ndarray = field(default_factory=lambda: np.zeros(0))
    knots: int = 4
    degree: int = 2

    def expand(self, context: np.ndarray) -> np.ndarray:
        """Columns of the basis without an intercept; none when the model is constant."""
        if self.kind == "constant" or not self.axes:
            return np.zeros((len(context), 0))
        z = (context[:, self.axes] - self.mean) / self.scale
        if self.kind == "linear":
            return z
        if self.kind == "quadratic":
            i, j = np.triu_indices(z.shape[1])
            return np.hstack([z, z[:, i] * z[:, j]])
        return np.hstack([spline_columns(z[:, a], self.low[a], self.high[a], knots=self.knots, degree=self.degree)
                          for a in range(z.shape[1])])


def fit_basis(kind: str, n: float, total: np.ndarray, square: np.ndarray, low: np.ndarray, high: np.ndarray, *,
              knots: int = 4, degree: int = 2) -> Basis:
    """Basis from counts, sums, sums of squares and ranges; constant axes are left out."""
    if kind not in KINDS:
        raise ValueError(f"unknown mean model: {kind}")
    size = np.maximum(np.maximum(np.abs(low), np.abs(high)), 1.0)
    axes = [int(a) for a in np.flatnonzero((high - low) > np.sqrt(np.finfo(float).eps) * size)]
    mean = total[axes] / n
    scale = np.sqrt(np.maximum(square[axes] / n - mean ** 2, 0.0))
    scale = np.where(scale > 0, scale, 1.0)
    return Basis(kind, axes, mean, scale, (low[axes] - mean) / scale, (high[axes] - mean) / scale, knots, degree)
