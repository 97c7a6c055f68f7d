"""Paired comparison of methods: signed ranks, bootstraps by hashed Poisson weights and step-down correction."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell import session
from tracewell.operators.ordered import running
from tracewell.operators.ranks import average_ranks


def holm(df: DataFrame, family: Sequence[str], p: str, tie: str, *, name: str = "holm_p",
         rows: int | None = None) -> DataFrame:
    """Step-down adjusted p-values inside each family."""
    placed = running(df, family, [p, tie], position="_i", totals={"_m": F.lit(1)}, rows=rows)
    scaled = placed.withColumn("_v", (F.col("_m") - F.col("_i")) * F.col(p))
    walked = running(scaled, family, [p, tie], maxima={name: F.col("_v")}, rows=rows)
    return walked.withColumn(name, F.least(F.lit(1.0), F.col(name))).drop("_i", "_m", "_v")


#: Draws are numbers below this prime; fifth powers are one-to-one modulo it.
PRIME = 2_147_483_647
SPREAD = 1_000_003
TURN = 7_919
#: Cells of one block of weights, and groups whose sums a task holds before it hands them on.
WEIGHT_CELLS = 2_000_000
HELD_GROUPS = 256


def poisson_cuts() -> list[int]:
    """Counts of a Poisson variable with mean one by inversion: a draw at or above k of these cuts counts k times."""
    out, term, total = [], math.exp(-1.0), 0.0
    for k in range(1, 13):
        total += term
        out.append(int(PRIME * total))
        term /= k
    return out


def _fifth(x: np.ndarray) -> np.ndarray:
    x = x % PRIME
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def poisson_weights(iterations: np.ndarray, slots: np.ndarray, seed: int) -> np.ndarray:
    """How often each record counts in each iteration, from the record and the iteration alone."""
    start = _fifth(iterations.astype(np.int64) * SPREAD + seed)
    mixed = _fifth(_fifth(start[:, None] + (slots.astype(np.int64) % PRIME)[None, :]) + TURN)
    return np.searchsorted(np.array(poisson_cuts()), mixed, side="right")


def bootstrap_means(records: DataFrame, strata: Sequence[str], value: str, order: str, *, iterations: int, seed: int,
                    by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Resampled mean per iteration, the strata in their observed shares.

    Every record counts a Poisson number of times in every iteration, drawn from the record's own number
    ``order``, so weights need no join and no order: a task adds up weights and weighted values of its
    records for all iterations, and only these sums are shuffled. A stratum that no record of an iteration
    fell to keeps its observed mean. Rows without a value take no part.
    """
    keys = [*by, *strata]
    if not keys:
        raise ValueError("at least one key: use a constant for a single stratum")
    kinds = dict(records.dtypes)
    number = F.col(order).cast("long") if kinds[order] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(order)
    slim = records.select(*keys, F.pmod(number, F.lit(PRIME)).alias("_slot"), F.col(value).cast("double").alias("_v")).filter("_v is not null")
    step = np.arange(iterations)

    def sums(batches):
        held: dict[tuple, np.ndarray] = {}

        def hand_on():
            for key, s in held.items():
                yield pd.DataFrame({**{k: pd.Series([v] * iterations, dtype=object) for k, v in zip(keys, key)}, "iteration": step, "_s": s[0], "_w": s[1]})
            held.clear()

        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                if key not in held and len(held) >= HELD_GROUPS:
                    yield from hand_on()
                total = held.setdefault(key, np.zeros((2, iterations)))
                v, slot = part["_v"].to_numpy(), part["_slot"].to_numpy()
                block = max(1, WEIGHT_CELLS // len(v))
                for start in range(0, iterations, block):
                    w = poisson_weights(step[start:start + block], slot, seed)
                    total[0, start:start + block] += w @ v
                    total[1, start:start + block] += w.sum(axis=1)
        yield from hand_on()

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["iteration long, _s double, _w double"])
    cells = slim.mapInPandas(sums, schema).groupBy(*keys, "iteration").agg(F.sum("_s").alias("_s"), F.sum("_w").alias("_w"))
    sizes = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_m"))
    joined = session.join_null_safe(cells, sizes, keys)
    mean = F.when(F.col("_w") > 0, F.col("_s") / F.col("_w")).otherwise(F.col("_m"))
    return joined.groupBy(*by, "iteration").agg((F.sum(F.col("_n") * mean) / F.sum("_n")).alias("mean"))


def bootstrap_interval(records: DataFrame, strata: Sequence[str], value: str, order: str, *, iterations: int = 10_000,
                       seed: int, by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Observed mean, percentile interval and the centered-null two-sided p-value per ``by`` key.

    Centering shifts every resampled mean by the observed mean, so both come from one set of draws.
    The percentile buffers hold one number per iteration.
    """
    by = list(by)
    keyed = records if by else records.withColumn("_all", F.lit(0))
    group = by or ["_all"]
    means = bootstrap_means(keyed, strata, value, order, iterations=iterations, seed=seed, by=group)
    observed = keyed.groupBy(*group).agg(F.avg(F.col(value).cast("double")).alias("observed"), F.count(F.lit(1)).alias("n"))
    joined = session.join_null_safe(means, observed, group)
    # a mean that equals twice the observed one is as far; sums in another order must not decide
    far = F.abs(F.col("mean") - F.col("observed")) >= F.abs("observed") - 1e-12
    out = joined.groupBy(*group).agg(
        F.max("n").alias("n"), F.max("observed").alias("observed"), F.percentile("mean", F.lit(0.025)).alias("ci_low"),
        F.percentile("mean", F.lit(0.975)).alias("ci_high"),
        ((F.count_if(far) + 1.0) / (F.count(F.lit(1)) + 1.0)).alias("p_value"),
        F.count_if(F.col("mean") > 1e-12).alias("_up"), F.count_if(F.col("mean") < -1e-12).alias("_down"), F.count(F.lit(1)).alias("_b"))
    sign = F.least(F.lit(1.0), F.lit(2.0) * (F.least("_up", "_down") + 1.0) / (F.col("_b") + 1.0))
    return out.withColumn("sign_p", sign).drop("_up", "_down", "_b", "_all")


def signed_ranks(pairs: DataFrame, keys: Sequence[str], difference: str, *, rows: int | None = None) -> DataFrame:
    """Wins, ties, losses and the signed-rank statistic with its tie-corrected normal score.

    Zero differences are dropped from the ranking; ties share the average rank.
    """
    d = F.col(difference).cast("double")
    base = pairs.select(*keys, d.alias("_d"), F.abs(d).alias("_a"))
    live = base.filter("_d <> 0")
    ranks = average_ranks(live, keys, "_a", "_r", rows=rows)
    ties = live.groupBy(*keys, "_a").agg(F.count(F.lit(1)).alias("_t")).groupBy(*keys).agg(
        F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).cast("double").alias("_tie"),
        F.max("_t").alias("largest_tie"))
    sums = live.join(ranks, [*keys, "_a"]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ranked"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("_plus"),
        F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("_minus"))
    counts = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("_d") > 0).alias("wins"),
        F.count_if(F.col("_d") == 0).alias("ties"), F.count_if(F.col("_d") < 0).alias("losses"),
        F.avg("_d").alias("mean_difference"))
    n = F.col("ranked").cast("double")
    w = F.least("_plus", "_minus")
    spread = F.sqrt(n * (n + 1) * (2.0 * n + 1) / 24.0 - F.col("_tie") / 48.0)
    out = counts.join(sums.join(ties, list(keys)), list(keys), "left")
    return out.withColumn("statistic", w).withColumn("z", F.try_divide(w - n * (n + 1) / 4.0, spread)).drop("_plus", "_minus", "_tie")


def wilcoxon_p(ranked: Column | str, statistic: Column | str, z: Column | str, ties: Column) -> Column:
    """Two-sided p: exact for up to 50 distinct differences without zeros or ties, else normal."""
    @F.pandas_udf(T.DoubleType())
    def p(n: pd.Series, w: pd.Series, score: pd.Series, tied: pd.Series) -> pd.Series:
        out = []
        for size, stat, zed, has_ties in zip(n, w, score, tied):
            if size is None or pd.isna(size) or size == 0:
                out.append(1.0)
            elif has_ties or size > 50:
                out.append(math.erfc(abs(zed) / math.sqrt(2.0)))
            else:
                ways = np.zeros(int(size * (size + 1) // 2) + 1)
                ways[0] = 1.0
                for k in range(1, int(size) + 1):
                    ways[k:] = ways[k:] + ways[:-k].copy()
                out.append(min(1.0, 2.0 * ways[: int(stat) + 1].sum() / 2.0 ** int(size)))
        return pd.Series(out)

    return p(ranked, statistic, z, ties)
