"""Support of new points by a healthy reference: radius, profile and difficulty rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import DOUBLE_EPS
from tracewell.operators.neighbours import nearest
from tracewell.operators.ranks import quantiles
from tracewell.operators.scaling import robust_parameters


def _parameters(df: DataFrame, features: Sequence[str], rule: str, rows: int | None) -> dict[str, tuple[float, float]]:
    long = df.select(F.lit(0).alias("_r"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        ["_r"], list(features), "feature", "value")
    found = robust_parameters(long, ["feature"], "value", rule=rule, rows=rows).collect()  # one row per feature
    return {r["feature"]: (r["center"], r["scale"]) for r in found}


def _scaled(df: DataFrame, features: Sequence[str], params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f"_z_{f}": (F.col(f) - F.lit(params[f][0])) / F.lit(params[f][1]) for f in features})


@dataclass
class ContextSupport:
    """Supported when the nearest fit context is within the calibrated radius and every axis in range."""

    fit_rows: DataFrame
    features: list[str]
    params: dict[str, tuple[float, float]]
    limits: dict[str, tuple[float, float]]
    radius: float

    @classmethod
    def fit(cls, fit: DataFrame, calibration: DataFrame, features: Sequence[str], *, multiplier: float = 1.0,
            rows: int | None = None) -> ContextSupport:
        features = list(features)
        params = _parameters(fit, features, "eps", rows)
        span = fit.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))]).first()
        limits = {c: (span[f"lo_{c}"], span[f"hi_{c}"]) for c in features}
        model = cls(_scaled(fit, features, params), features, params, limits, 0.0)
        far = model._distance(calibration).agg(F.max("distance")).first()[0]
        model.radius = max(far * multiplier, 1e-12)
        return model

    def _distance(self, df: DataFrame) -> DataFrame:
        names = [f"_z_{f}" for f in self.features]
        return nearest(_scaled(df, self.features, self.params), self.fit_rows, names).drop(*names)

    def evaluate(self, df: DataFrame, *, axis_bounds: bool = True) -> DataFrame:
        slack = 32 * DOUBLE_EPS
        ok = F.col("distance") <= F.lit(self.radius + slack * max(self.radius, 1.0))
        if axis_bounds:
            for c, (lo, hi) in self.limits.items():
                room = slack * max(abs(lo), abs(hi), 1.0)
                ok = ok & (F.col(c) >= F.lit(lo - room)) & (F.col(c) <= F.lit(hi + room))
        return self._distance(df).withColumn("supported", ok)


@dataclass
class ProfileSupport:
    """Support of profile summaries by the 95 % 'higher' quantile of leave-one-out distances."""

    reference: DataFrame
    profile: str
    features: list[str]
    params: dict[str, tuple[float, float]]
    threshold: float

    @classmethod
    def fit(cls, summaries: DataFrame, profile: str, features: Sequence[str], *, q: float = 0.95,
            rows: int | None = None) -> ProfileSupport:
        features = list(features)
        params = _parameters(summaries, features, "spread", rows)
        reference = _scaled(summaries, features, params)
        names = [f"_z_{f}" for f in features]
        loo = nearest(reference, reference, names, k=2).withColumn("_g", F.lit(0))
        threshold = quantiles(loo, ["_g"], "distance", {"t": q}, higher=True, rows=rows).first()["t"]
        return cls(reference, profile, features, params, float(threshold))

    def evaluate(self, summaries: DataFrame) -> DataFrame:
        names = [f"_z_{f}" for f in self.features]
        out = nearest(_scaled(summaries, self.features, self.params), self.reference, names, reference_id=self.profile,
                      neighbour="nearest_profile").drop(*names)
        return out.withColumn("threshold", F.lit(self.threshold)).withColumn("supported", F.col("distance") <= F.col("threshold"))


@dataclass
class DifficultyScale:
    """Distance to the k-th reference neighbour over the median leave-one-out distance, floored."""

    reference: DataFrame
    features: list[str]
    k: int
    floor: float
    typical: float

    @classmethod
    def fit(cls, reference: DataFrame, features: Sequence[str], *, k: int = 5, floor: float = 0.25,
            rows: int | None = None) -> DifficultyScale:
        own = nearest(reference, reference, features, k=k + 1).withColumn("_g", F.lit(0))
        typical = quantiles(own, ["_g"], "distance", {"m": 0.5}, rows=rows).first()["m"]
        if not typical or typical <= 0:
            raise ValueError("the typical neighbour distance must be positive")
        return cls(reference, list(features), k, floor, float(typical))

    def transform(self, df: DataFrame) -> DataFrame:
        out = nearest(df, self.reference, self.features, k=self.k)
        return out.withColumn("scale", F.greatest(F.col("distance") / F.lit(self.typical), F.lit(self.floor)))
