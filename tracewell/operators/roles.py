"""Role and fold tables. Each takes the small table of groups or blocks it assigns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalars import col, hash_draw
from tracewell.operators.ordered import running, with_position


def grouped_split(groups: DataFrame, key: str, *, seed: int, test: float = 0.2, validation: float = 0.2,
                  rows: int | None = None) -> DataFrame:
    """Whole groups to train, validation or test: hash order, cut by fraction."""
    drawn = groups.select(key).distinct().withColumn("_g", F.lit(0)).withColumn("_h", hash_draw(F.lit(seed), key))
    placed = running(drawn, ["_g"], ["_h", key], position="_i", sums={}, totals={"_n": F.lit(1)}, rows=rows)
    n_test = F.ceil(F.col("_n") * F.lit(test))
    n_val = F.ceil((F.col("_n") - n_test) * F.lit(validation))
    split = F.when(F.col("_i") < n_test, "test").when(F.col("_i") < n_test + n_val, "validation").otherwise("train")
    return placed.select(key, split.alias("split"))


def leave_one_out_folds(entities: Sequence[str]) -> Column:
    """Array of (target, entity, role) rows for a short list of entities."""
    cells = [F.struct(F.lit(t).alias("target"), F.lit(e).alias("entity"),
                      F.lit("target" if t == e else "source").alias("role")) for t in entities for e in entities]
    return F.array(*cells)


def contiguous_role(block: Column | str, n: Column | str, *, adaptation: float = 0.25, calibration: float = 0.25,
                    guard: int = 1) -> Column:
    """Adaptation, guard, calibration, guard and test ranges of n ordered blocks."""
    b, total = col(block), col(n)
    usable = total - 2 * guard
    a = F.greatest(F.lit(1).cast("long"), F.floor(usable * F.lit(adaptation)))
    c = F.greatest(F.lit(1).cast("long"), F.floor(usable * F.lit(calibration)))
    role = (F.when(b < a, "adaptation").when(b < a + guard, "guard").when(b < a + guard + c, "calibration")
            .when(b < a + c + 2 * guard, "guard").otherwise("test"))
    return F.when((total >= 5) & (usable - a - c >= 1), role)


def budget_role(block: Column | str, *, adaptation: int, calibration: int, guard: int = 1,
                horizon: int | None = None) -> Column:
    """Budget roles; with a horizon the calibration start is fixed and spare prefix blocks stay unused."""
    b, start = col(block), horizon if horizon is not None else adaptation
    if adaptation > start:
        raise ValueError("the adaptation budget exceeds the horizon")
    return (F.when(b < adaptation, "adaptation").when(b < start, "unused").when(b < start + guard, "guard")
            .when(b < start + guard + calibration, "calibration")
            .when(b < start + calibration + 2 * guard, "guard").otherwise("test"))


def alternating_split(pairs: DataFrame, heldout: str, candidate: str, *, salt: str, rows: int | None = None) -> DataFrame:
    """Per held-out record, order the candidates by salted SHA-256 and alternate fit and calibration."""
    key = F.concat_ws("|", F.lit(salt), F.col(heldout).cast("string"), F.col(candidate).cast("string"))
    digest = pairs.withColumn("_d", F.sha2(key, 256))
    lead = digest.withColumn("_o", F.conv(F.substring("_d", 1, 13), 16, 10).cast("long"))
    placed = with_position(lead, [heldout], ["_o", "_d"], "_i", rows=rows)
    return placed.select(heldout, candidate, F.when(F.col("_i") % 2 == 0, "fit").otherwise("calibration").alias("split"))


def grid_role(load: Column | str, fit_loads: Mapping[float, Sequence[float]]) -> Column:
    """Array of (test_load, role) for one load under every fold of a fixed fit table."""
    cells = []
    for test, fit in fit_loads.items():
        role = F.when(col(load) == F.lit(test), "test").when(col(load).isin(*fit), "fit").otherwise("calibration")
        cells.append(F.struct(F.lit(test).alias("test_load"), role.alias("role")))
    return F.array(*cells)


def bracket_violations(fit_loads: Mapping[float, Sequence[float]], loads: Sequence[float]) -> list[float]:
    """Folds whose calibration or test load is not bracketed by fit loads."""
    bad = []
    for test, fit in fit_loads.items():
        held = [x for x in loads if x != test and x not in fit]
        inside = all(min(fit) <= x <= max(fit) for x in held)
        between = test in (min(loads), max(loads)) or (min(fit) < test < max(fit))
        if not (inside and between):
            bad.append(test)
    return bad


# Fit loads of every test load in the conditioned protocol.
LOADS = (0.0, 5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 35.0)
FIT_LOADS = {
    0.0: (5.0, 15.0, 25.0, 35.0), 5.0: (0.0, 10.0, 20.0, 35.0), 10.0: (0.0, 5.0, 15.0, 35.0),
    15.0: (0.0, 10.0, 20.0, 35.0), 20.0: (0.0, 15.0, 25.0, 35.0), 25.0: (0.0, 20.0, 30.0, 35.0),
    30.0: (0.0, 15.0, 25.0, 35.0), 35.0: (0.0, 10.0, 20.0, 30.0),
}


def late_block_role(is_healthy: Column | str, block: Column | str, *, train_last: int, calibration_first: int) -> Column:
    """Source rows: early healthy blocks and all faults train, late healthy blocks calibrate."""
    h, b = col(is_healthy), col(block)
    return F.when(~h | (b <= train_last), "train").when(b >= calibration_first, "calibration").otherwise("unused")


def evenly_spaced(blocks: DataFrame, keys: Sequence[str], block: str, *, k: Column | None = None,
                  rule: str = "rint", rows: int | None = None) -> DataFrame:
    """Choose k of the n ordered blocks of each group; k defaults to the smallest group size.

    rint   positions rint(i (n-1)/(k-1))
    floor  positions floor(i n/k)
    A block at position p is chosen when some i maps to it, which is tested for the nearest i, so
    no index table is joined.
    """
    walked = running(blocks.select(*keys, block).distinct(), keys, [block], position="_p",
                     totals={"_n": F.lit(1)}, rows=rows)
    if k is None:
        smallest = walked.agg(F.min("_n")).first()[0]
        k = F.lit(int(smallest or 1))
    p, n, k = F.col("_p"), F.col("_n"), k.cast("double")
    if rule == "rint":
        step = F.when(k > 1, (n - 1) / (k - 1)).otherwise(F.lit(0.0))
        guess = F.rint(F.coalesce(F.try_divide(p, step), F.lit(0.0)))
        hits = [(g >= 0) & (g <= k - 1) & (F.rint(g * step) == p) for g in (guess - 1, guess, guess + 1)]
        hits.append(p == 0)
    elif rule == "floor":
        guess = F.ceil(p * k / n)
        hits = [(g >= 0) & (g <= k - 1) & (F.floor(g * n / k) == p) for g in (guess - 1, guess, guess + 1)]
    else:
        raise ValueError("rule must be 'rint' or 'floor'")
    chosen = hits[0]
    for h in hits[1:]:
        chosen = chosen | h
    return walked.filter(chosen).select(*keys, block)


def permuted_split(designs: DataFrame, key: str, *, development: int, fit: int, seed: int,
                   rows: int | None = None) -> DataFrame:
    """Fixed tail test, hash-ordered fit and calibration inside the development pool."""
    pool = designs.select(key, (F.col(key) < development).alias("_dev")).withColumn("_h", hash_draw(F.lit(seed), key))
    placed = with_position(pool, ["_dev"], ["_h", key], "_i", rows=rows)
    role = F.when(~F.col("_dev"), "test").when(F.col("_i") < fit, "fit").otherwise("calibration")
    return placed.select(key, role.alias("role"))


def rotating_role(bucket: Column | str, fold: Column | str, buckets: int = 3) -> Column:
    """Test the fold's bucket, calibrate on the next one, fit on the rest."""
    offset = F.pmod(col(bucket) - col(fold) + F.lit(buckets), F.lit(buckets))
    return F.when(offset == 0, "test").when(offset == 1, "calibration").otherwise("fit")


def group_folds(groups: DataFrame, key: str, folds: int, *, rows: int | None = None) -> DataFrame:
    """Fold number per whole group: rank by descending size, dealt in turn."""
    sized = groups.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).withColumn("_g", F.lit(0)).withColumn("_d", -F.col("_c"))
    placed = with_position(sized, ["_g"], ["_d", key], "_i", rows=rows)
    return placed.select(key, (F.col("_i") % folds).cast("int").alias("fold"))


def bucket_in_family(cases: DataFrame, family: str, order: Sequence[str], buckets: int) -> DataFrame:
    """Index of a case inside its family and its balanced bucket; families hold a short list of cases."""
    w = Window.partitionBy(family).orderBy(*order)
    index = F.row_number().over(w) - 1
    return cases.withColumn("case_index", index).withColumn("bucket", F.col("case_index") % buckets)
