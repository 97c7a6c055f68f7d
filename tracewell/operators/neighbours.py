"""Exact nearest-neighbour distances without a cross join.

A reference set within the broadcast limit travels to the tasks as one matrix. A larger one is
searched through a pivot table. Pivots are far-apart rows of a bounded sample; every reference row
belongs to the ring of its nearest pivot that holds its distance, and for every ring the smallest
and largest distance to each pivot are known. A bounded sample gives each query an upper bound of
its k-th distance. By the triangle inequality a ring can hold a neighbour only if the query's
distance to every pivot, give or take that bound, meets the ring's range, so queries join only
those rings, by number. In more than PIVOT_DIMS dimensions such bounds spare little, so blocks of
queries meet blocks of reference rows by matrix products, and the few rows that can be among the
nearest of a block are measured exactly. Equal vectors are collapsed to one row with a count on both sides, so
copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import session
from tracewell.functions.scalars import is_finite, sum_of

PIVOTS = 64
#: Rings are about this share of the broadcast limit, and never more than MAX_RINGS in all.
RING_SHARE = 8
MAX_RINGS = 8_192
#: Most dimensions of a pivot table, and rows of one block of the search in more.
PIVOT_DIMS = 16
BLOCK_ROWS = 32_768
#: Numbers of one block of a distance matrix.
CELLS = 2_000_000


def complete(features: Sequence[str]) -> Column:
    """True where no feature is null, NaN or infinite."""
    out = F.lit(True)
    for f in features:
        out = out & F.coalesce(is_finite(f), F.lit(False))
    return out


def _distinct(df: DataFrame, features: Sequence[str], id_col: str | None = None) -> DataFrame:
    cast = df.filter(complete(features)).select(*[F.col(f).cast("double").alias(f) for f in features], *([F.col(id_col).alias("_id")] if id_col else []))
    first = F.min("_id") if id_col else F.lit(0).cast("long")
    return cast.groupBy(*features).agg(F.count(F.lit(1)).alias("_n"), first.alias("_id"))


def _squared(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(points)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - points[None, :, j]) ** 2
    return out


def _broadcast_search(queries: DataFrame, reference: list, features: Sequence[str], ks: Sequence[int], kind: str) -> DataFrame:
    """Add _d0, _d1 ... (k-th distances) and _nn (id of the nearest row) by blocks of a small matrix."""
    names = list(features)
    ordered = sorted(reference, key=lambda r: (r["_id"] is None, r["_id"]))
    matrix = np.array([[r[f] for f in names] for r in ordered], dtype=float).reshape(len(ordered), len(names))
    counts, ids = np.array([r["_n"] for r in ordered], dtype=np.int64), [r["_id"] for r in ordered]
    step = max(1, CELLS // max(len(ordered), 1))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[names].to_numpy(float)
            out, near = np.full((len(x), len(ks)), np.inf), np.full(len(x), -1, dtype=np.int64)
            for at in range(0, len(x) if len(ordered) else 0, step):
                sq = _squared(x[at:at + step], matrix)
                near[at:at + step] = sq.argmin(axis=1)  # ids are in order, so the first is the smallest
                m = min(max(ks), len(ordered))
                cols = np.argpartition(sq, m - 1, axis=1)[:, :m]
                part = np.take_along_axis(sq, cols, axis=1)
                order = np.argsort(part, axis=1, kind="stable")
                part, held = np.take_along_axis(part, order, axis=1), np.cumsum(np.take_along_axis(counts[cols], order, axis=1), axis=1)
                for c, k in enumerate(ks):
                    reach = held >= k
                    dist = np.sqrt(np.take_along_axis(part, reach.argmax(axis=1)[:, None], axis=1)[:, 0])
                    out[at:at + step, c] = np.where(reach.any(axis=1), dist, np.inf)
            yield pdf.assign(**{f"_d{c}": out[:, c] for c in range(len(ks))}, _nn=[ids[i] if i >= 0 else None for i in near])

    schema = ", ".join([f"`{f}` double" for f in names] + [f"_d{c} double" for c in range(len(ks))] + [f"_nn {kind}"])
    return queries.select(*names).mapInPandas(search, schema)


def far_apart(points: np.ndarray, count: int) -> np.ndarray:
    """Rows of ``points``, each the one farthest from those before it; fewer if all are equal to one of them."""
    if not len(points):
        return points
    center = points.mean(axis=0)
    chosen = [int(((points - center) ** 2).sum(axis=1).argmax())]
    away = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(points)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def _with_distances(df: DataFrame, features: Sequence[str], pivots: np.ndarray) -> DataFrame:
    """Add _cell (number of the nearest pivot), _r (its distance) and _p (distances to all pivots)."""
    names, extra = list(features), [c for c in df.columns if c not in features]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            away = np.sqrt(_squared(pdf[names].to_numpy(float), pivots))
            cell = away.argmin(axis=1)
            yield pdf.assign(_cell=cell.astype("int32"), _r=away[np.arange(len(away)), cell], _p=list(away))

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{f}` {kinds[f]}" for f in [*names, *extra]] + ["_cell int", "_r double", "_p array<double>"])
    return df.select(*names, *extra).mapInPandas(measure, schema)


def _rings(reference: DataFrame, pivots: np.ndarray, total: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(reference rows with _ring, ring table): cells are cut at quantiles of the distance to their pivot."""
    per_cell = max(1, min(MAX_RINGS // len(pivots), -(-total * RING_SHARE // (limit * len(pivots)))))
    grid = [i / per_cell for i in range(1, per_cell)]
    if not grid:
        placed = reference.withColumn("_ring", F.col("_cell").cast("long"))
    else:
        cuts = reference.groupBy("_cell").agg(F.percentile_approx("_r", grid, max(200, 20 * per_cell)).alias("_cuts"))
        inside = F.size(F.filter("_cuts", lambda c: c < F.col("_r")))
        placed = reference.join(F.broadcast(cuts), "_cell").withColumn("_ring", F.col("_cell").cast("long") * per_cell + inside).drop("_cuts")
    m = len(pivots)
    ends = [f(F.get("_p", F.lit(i))) for f in (F.min, F.max) for i in range(m)]
    return placed, placed.groupBy("_ring").agg(F.array(*ends[:m]).alias("low"), F.array(*ends[m:]).alias("high"))


def _visits(bounded: DataFrame, features: Sequence[str], pivots: np.ndarray, rings: list, last: str) -> DataFrame:
    """One row per query and ring that its bound ``last`` can reach."""
    names, extra = list(features), [c for c in bounded.columns if c not in features]
    number = np.array([r["_ring"] for r in rings], dtype=np.int64)
    low, high = np.array([r["low"] for r in rings]), np.array([r["high"] for r in rings])
    step = max(1, CELLS // max(low.size, 1))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, reach = pdf[names].to_numpy(float), pdf[last].to_numpy(float)
            for at in range(0, len(pdf), step):
                away = np.sqrt(_squared(x[at:at + step], pivots))
                near = reach[at:at + step, None] + 1e-9 * (1.0 + away)  # more than rounding can shift
                hit = np.ones((len(away), len(number)), bool)
                for j in range(low.shape[1]):
                    hit &= ((away[:, j] + near[:, j])[:, None] >= low[None, :, j]) & ((away[:, j] - near[:, j])[:, None] <= high[None, :, j])
                row, ring = np.nonzero(hit)
                yield pdf.iloc[at + row].assign(_ring=number[ring])

    kinds = dict(bounded.dtypes)
    schema = ", ".join([f"`{f}` {kinds[f]}" for f in [*names, *extra]] + ["_ring long"])
    return bounded.select(*names, *extra).mapInPandas(visit, schema)


def pivot_pairs(queries: DataFrame, reference: DataFrame, features: Sequence[str], ks: Sequence[int], total: int, limit: int, kind: str) -> DataFrame:
    """Candidate pairs of distinct queries and distinct reference rows, with _q (distance), _n and _id; complete up to the largest k."""
    small, names, deepest = max(2 * max(ks), limit // 2), list(features), max(ks)
    # a hash share of the distinct rows, bounded in size; it gives pivots and upper bounds, never answers
    sample = (reference.withColumn("_h", F.pmod(F.xxhash64(*features), F.lit(1_000_000_007)) / 1_000_000_007.0)
              .filter(F.col("_h") < min(1.0, small / total)).drop("_h").limit(2 * limit).collect())
    points = np.array([[r[f] for f in names] for r in sample], dtype=float).reshape(len(sample), len(names))
    pivots = far_apart(points, PIVOTS) if len(points) else np.zeros((1, len(names)))
    placed, table = _rings(_with_distances(reference, features, pivots), pivots, total, limit)
    rings = table.collect()  # at most MAX_RINGS rows of two ranges per pivot
    bounded = _broadcast_search(queries, sample, features, [deepest], kind).drop("_nn").withColumnRenamed("_d0", "_ub")
    left = _visits(bounded, features, pivots, rings, "_ub")
    right = placed.select("_ring", "_n", "_id", *[F.col(f).alias(f"_r_{f}") for f in features])
    sq = sum_of([(F.col(f) - F.col(f"_r_{f}")) * (F.col(f) - F.col(f"_r_{f}")) for f in features])
    return left.join(right, "_ring").withColumn("_q", F.sqrt(sq))


def _pivot_search(queries: DataFrame, reference: DataFrame, features: Sequence[str], ks: Sequence[int], total: int, limit: int, kind: str) -> DataFrame:
    pairs = pivot_pairs(queries, reference, features, ks, total, limit, kind)
    pairs = pairs.filter(F.col("_q") <= F.col("_ub") * F.lit(1.0 + 1e-12) + F.lit(1e-300))
    if max(ks) == 1:
        best = pairs.groupBy(*features).agg(F.min(F.struct("_q", "_id")).alias("_b"))
        return best.select(*features, F.col("_b._q").alias("_d0"), F.col("_b._id").alias("_nn"))
    # candidates within the bound, counted per distinct distance before they are ordered
    steps = pairs.groupBy(*features, "_q").agg(F.sum("_n").alias("_n"), F.min("_id").alias("_id"))
    w = Window.partitionBy(*features).orderBy("_q").rowsBetween(Window.unboundedPreceding, 0)
    reached = steps.withColumn("_c", F.sum("_n").over(w))
    found = [F.coalesce(F.min(F.when(F.col("_c") >= k, F.col("_q"))), F.lit(float("inf"))).alias(f"_d{c}") for c, k in enumerate(ks)]
    return reached.groupBy(*features).agg(*found, F.min(F.struct("_q", "_id"))["_id"].alias("_nn"))


def _least(x: np.ndarray, y: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, reference, squared distance) of the m nearest rows of ``y`` for every row of ``x``, the first rows on ties.

    Products give the distances but for rounding; all rows that are near enough to the m-th are measured again.
    """
    center, rows, cols, found = y.mean(axis=0), [], [], []
    u, v = x - center, y - center
    uu, vv = (u * u).sum(axis=1), (v * v).sum(axis=1)
    m, step = min(m, len(y)), max(1, CELLS // len(y))
    for at in range(0, len(x), step):
        with np.errstate(over="ignore", invalid="ignore"):
            rough = uu[at:at + step, None] + vv[None, :] - 2.0 * (u[at:at + step] @ v.T)
        if np.isfinite(rough).all():
            slack = 1e-12 * (uu[at:at + step] + vv.max())  # more than rounding can shift
        else:
            rough, slack = _squared(x[at:at + step], y), np.zeros(len(rough))
        row, col = np.nonzero(rough <= (np.partition(rough, m - 1, axis=1)[:, m - 1] + 2 * slack)[:, None])
        sq = np.zeros(len(row))
        for j in range(x.shape[1]):
            sq += (x[at + row, j] - y[col, j]) ** 2
        order = np.lexsort((col, sq, row))
        row, col, sq = row[order], col[order], sq[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        keep = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row))) < m
        rows.append(at + row[keep])
        cols.append(col[keep])
        found.append(sq[keep])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(found)


def _block_search(queries: DataFrame, reference: DataFrame, features: Sequence[str], ks: Sequence[int], total: int, kind: str) -> DataFrame:
    """Every block of queries meets every block of reference rows in a task of its own; the nearest of all blocks are merged."""
    names, deepest = list(features), max(ks)
    points = session.landed(queries.select(*names).withColumn("_at", F.monotonically_increasing_id()), "points")
    per_side = [max(1, -(-n // max(1, min(BLOCK_ROWS, -(-n // 8))))) for n in (points.count(), total)]
    hashed = F.xxhash64(*[F.col(f) for f in names])

    def spread(df: DataFrame, own: str, other: str, sizes: Sequence[int]) -> DataFrame:
        cut = df.withColumn(own, F.pmod(hashed, F.lit(sizes[0])).cast("int"))
        copied = cut.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(sizes[1] - 1))))
        return copied.repartition(3 * per_side[0] * per_side[1], "_qb", "_rb")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"_at": [], "_q": [], "_id": [], "_n": []})
        right = right.sort_values("_id", kind="stable")
        row, col, sq = _least(left[names].to_numpy(float), right[names].to_numpy(float), deepest)
        return pd.DataFrame({"_at": left["_at"].to_numpy()[row], "_q": np.sqrt(sq), "_id": right["_id"].to_numpy()[col], "_n": right["_n"].to_numpy()[col]})

    left = spread(points, "_qb", "_rb", per_side).groupBy("_qb", "_rb")
    right = spread(reference, "_rb", "_qb", per_side[::-1]).groupBy("_qb", "_rb")
    near = left.cogroup(right).applyInPandas(meet, f"_at long, _q double, _id {kind}, _n long")
    # at most the largest k of each block for a query
    best = near.groupBy("_at").agg(F.slice(F.array_sort(F.collect_list(F.struct("_q", "_id", "_n"))), 1, deepest).alias("_c"))

    def reached(k: int) -> Column:
        def upto(e: Column) -> Column:
            return F.aggregate(F.filter("_c", lambda o: o["_q"] <= e["_q"]), F.lit(0).cast("long"), lambda a, o: a + o["_n"])

        return F.coalesce(F.array_min(F.transform(F.filter("_c", lambda e: upto(e) >= k), lambda e: e["_q"])), F.lit(float("inf")))

    found = best.select("_at", *[reached(k).alias(f"_d{c}") for c, k in enumerate(ks)], F.col("_c")[0]["_id"].alias("_nn"))
    return points.join(found, "_at").drop("_at")


def nearest(queries: DataFrame, reference: DataFrame, features: Sequence[str], *, k: int | Sequence[int] = 1,
            reference_id: str | None = None, distance: str | Sequence[str] = "distance", neighbour: str | None = None,
            searched: str | None = None) -> DataFrame:
    """Distance of each query row to its k-th nearest reference row, copies counted.

    Several k with as many ``distance`` names share one search. With ``neighbour`` the id of the nearest
    row is added, the smallest id on ties; ids may be of any type that can be ordered. Query rows with a
    null or non-finite feature stay, with null results and false in the ``searched`` column if one is
    named; such reference rows are no neighbours. Too few reference rows give an infinite distance.
    Distances to a reference that contains the query itself are leave-one-out distances when k is raised
    by one.
    """
    ks, names = ([k], [distance]) if isinstance(k, int) else (list(k), list(distance))
    if len(ks) != len(names) or not ks:
        raise ValueError("one distance name for each k")
    limit = session.broadcast_rows(queries.sparkSession)
    ref = _distinct(reference, features, reference_id)
    kind = dict(ref.dtypes)["_id"]
    head = ref.limit(limit + 1).collect()
    points = queries.filter(complete(features)).select(*[F.col(f).cast("double").alias(f) for f in features]).distinct()
    if len(head) <= limit:
        found = _broadcast_search(points, head, features, ks, kind)
    elif len(features) > PIVOT_DIMS:
        found = _block_search(points, ref, features, ks, ref.count(), kind)
    else:
        found = _pivot_search(points, ref, features, ks, ref.count(), limit, kind)
    added = [F.col(f"_d{c}").alias(name) for c, name in enumerate(names)] + ([F.col("_nn").alias(neighbour)] if neighbour else [])
    table = found.select(*[F.col(f).alias(f"_k_{f}") for f in features], *added)
    match = [F.col(f).cast("double") == F.col(f"_k_{f}") for f in features]
    out = queries.join(table, match, "left").drop(*[f"_k_{f}" for f in features])
    return out.withColumn(searched, complete(features)) if searched else out
