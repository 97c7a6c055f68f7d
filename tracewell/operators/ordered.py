"""Ordered per-group work that never puts an unbounded group into one task.

A window function keyed by record sends the whole record to one task. Here the rows are first
range-partitioned by their order, the window runs inside ``(keys, range)``, and each row then
receives the carry of all earlier ranges from a table that has one row per key and range. When the
input is known to be small there is a single range and the plan is an ordinary window.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import session

CHUNK = "_chunk"
MAX_CHUNKS = 20_000
RANGE_STEP = 4096


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
            position: str | None = None, sums: Mapping[str, Column] | None = None,
            maxima: Mapping[str, Column] | None = None, lags: Mapping[str, str] | None = None,
            totals: Mapping[str, Column] | None = None,
            rows: int | None = None, limit: int | None = None, largest: int | None = None) -> DataFrame:
    """Running aggregates over ``order`` inside ``keys``.

    position  0-based row position
    sums      inclusive running sums, output name to expression
    maxima    inclusive running maxima, nulls skipped
    lags      value of the previous row, output name to column name
    totals    sums over the whole group

    ``order`` must identify a row inside its group; its columns may be of any type that can be ordered,
    but must not be null. Above the limit the rows are range-partitioned by the order, the window runs
    inside (keys, range) and its output is written once; the last row of every range gives what later
    ranges carry. The source is read twice: for the range bounds and for the rows. ``largest`` is a proven bound
    of the rows of one group: groups within the limit need no ranges, however many there are.
    """
    sums, maxima, lags, totals = dict(sums or {}), dict(maxima or {}), dict(lags or {}), dict(totals or {})
    if position:
        sums[position] = F.lit(1).cast("long")
    limit = limit or session.rows_per_chunk(df.sparkSession)
    if rows is None:
        rows = df.count()
    split = min(rows, rows if largest is None else largest) > limit
    if split:
        chunks = min(MAX_CHUNKS, math.ceil(rows / limit) + 1)
        staged = df.repartitionByRange(chunks, *order).withColumn(CHUNK, F.spark_partition_id().cast("long"))
    else:
        staged = df.withColumn(CHUNK, F.lit(0).cast("long"))
    for i, expr in enumerate(sums.values()):
        staged = staged.withColumn(f"_s{i}", expr)
    for i, expr in enumerate(maxima.values()):
        staged = staged.withColumn(f"_m{i}", expr)
    inner = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local: dict[str, Column] = {}
    for i in range(len(sums)):
        local[f"_S{i}"] = F.sum(f"_s{i}").over(upto)
    for i in range(len(maxima)):
        local[f"_M{i}"] = F.max(f"_m{i}").over(upto)
    for i, name in enumerate(lags.values()):
        local[f"_L{i}"] = F.lag(F.struct(F.col(name).alias("v"))).over(inner)
    if split:
        local |= {f"_T{i}": expr for i, expr in enumerate(totals.values())}
    else:
        local |= {name: F.sum(expr).over(Window.partitionBy(*keys)) for name, expr in totals.items()}
    out = staged.withColumns(local)  # column names ignore case: the running values take the place of _s and _m
    if split:
        out = session.landed(out, "scan")
        held = [*[f"_S{i}" for i in range(len(sums))], *[f"_M{i}" for i in range(len(maxima))]]
        last = F.max_by(F.struct(F.lit(0).alias("_"), *held, *[F.struct(F.col(name).alias("v")).alias(f"_l{i}") for i, name in enumerate(lags.values())]),
                        F.struct(*order))
        ends = out.groupBy(*keys, CHUNK).agg(last.alias("_e"), *[F.sum(f"_T{i}").alias(f"_tt{i}") for i in range(len(totals))])
        chain = Window.partitionBy(*keys).orderBy(CHUNK)
        before = chain.rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.select(
            *keys, CHUNK,
            *[F.sum(f"_e._S{i}").over(before).alias(f"_cs{i}") for i in range(len(sums))],
            *[F.max(f"_e._M{i}").over(before).alias(f"_cm{i}") for i in range(len(maxima))],
            *[F.lag(f"_e._l{i}").over(chain).alias(f"_cl{i}") for i in range(len(lags))],
            *[F.sum(f"_tt{i}").over(Window.partitionBy(*keys)).alias(name) for i, name in enumerate(totals)],
        )
        out = session.join_null_safe(out, carry, [*keys, CHUNK], "left")
    final: dict[str, Column] = {name: F.col(name) for name in totals}
    for i, name in enumerate(sums):
        value = F.col(f"_S{i}")
        if split:
            value = F.coalesce(value, F.when(F.col(f"_cs{i}").isNotNull(), 0)) + F.coalesce(F.col(f"_cs{i}"), F.lit(0))
        final[name] = value - 1 if name == position else value
    for i, name in enumerate(maxima):
        final[name] = F.greatest(F.col(f"_M{i}"), F.col(f"_cm{i}")) if split else F.col(f"_M{i}")
    for i, name in enumerate(lags):
        value = F.coalesce(F.col(f"_L{i}"), F.col(f"_cl{i}")) if split else F.col(f"_L{i}")
        final[name] = value["v"]
    extra = set(final) - set(df.columns)
    return out.withColumns(final).select(*df.columns, *[n for n in final if n in extra])


def explode_range(df: DataFrame, count: Column, name: str) -> DataFrame:
    """One row per integer in [0, count); built in two steps so that no long array sits in a row."""
    steps = F.ceil(count / RANGE_STEP).cast("long")
    coarse = df.filter(count > 0).withColumn("_n", count).withColumn(
        "_c", F.explode(F.sequence(F.lit(0).cast("long"), steps - 1)))
    low = F.col("_c") * RANGE_STEP
    high = F.least(low + RANGE_STEP, F.col("_n").cast("long")) - 1
    return coarse.withColumn(name, F.explode(F.sequence(low, high))).drop("_n", "_c")


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, *,
                  rows: int | None = None, largest: int | None = None) -> DataFrame:
    """0-based position of each row in its group."""
    return running(df, keys, order, position=name, rows=rows, largest=largest)


def prefix(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, *,
           rows: int | None = None) -> DataFrame:
    """First n rows of each group."""
    return with_position(df, keys, order, "_pos", rows=rows).filter(F.col("_pos") < n).drop("_pos")


def every_kth(df: DataFrame, keys: Sequence[str], order: Sequence[str], stride: int, *,
              rows: int | None = None) -> DataFrame:
    """Keep rows at positions 0, k, 2k and so on."""
    placed = with_position(df, keys, order, "_pos", rows=rows)
    return placed.filter(F.col("_pos") % stride == 0).drop("_pos")


def with_runs(df: DataFrame, keys: Sequence[str], index: str, flag: Column, *,
              rows: int | None = None) -> DataFrame:
    """Maximal runs of true rows: key columns, first index, last index and length.

    ``index`` is a gapless position. The run number is a running count of false rows, so the final
    grouping aggregates map-side and a long run never sits in one task.
    """
    marked = df.select(*keys, index, F.coalesce(flag, F.lit(False)).alias("_on"))
    walked = running(marked, keys, [index], sums={"_run": (~F.col("_on")).cast("long")}, rows=rows)
    return (walked.filter("_on").groupBy(*keys, "_run")
            .agg(F.min(index).alias("first_index"), F.max(index).alias("last_index"),
                 F.count(F.lit(1)).alias("length")).drop("_run"))


def first_sustained(df: DataFrame, keys: Sequence[str], index: str, flag: Column, length: int, *,
                    rows: int | None = None) -> DataFrame:
    """Start of the first run of at least ``length`` true rows per group."""
    runs = with_runs(df, keys, index, flag, rows=rows)
    return (runs.filter(F.col("length") >= length).groupBy(*keys)
            .agg(F.min("first_index").alias("start_index")))


def trailing_mean(df: DataFrame, keys: Sequence[str], index: str, value: Column, width: int,
                  name: str, *, block: int = 1_000_000) -> DataFrame:
    """Mean over the last ``width`` rows, null until that many rows exist.

    ``index`` is a gapless position, so blocks of rows are fixed by integer division; the last
    ``width - 1`` rows of a block are copied to the next block as its lead-in.
    """
    if width > block:
        raise ValueError("the frame must fit in one block")
    staged = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(index) / block))
    lead_in = staged.filter(F.col(index) % block >= block - (width - 1)).withColumn("_b", F.col("_b") + 1)
    both = staged.withColumn("_own", F.lit(True)).unionByName(lead_in.withColumn("_own", F.lit(False)))
    frame = Window.partitionBy(*keys, "_b").orderBy(index).rowsBetween(-(width - 1), 0)
    return (both.withColumn("_n", F.count("_v").over(frame)).withColumn("_a", F.avg("_v").over(frame))
            .filter("_own").withColumn(name, F.when(F.col("_n") == width, F.col("_a")))
            .select(*df.columns, name))


def asof(queries: DataFrame, lookup: DataFrame, keys: Sequence[str], *, at: str, value: str,
         direction: str = "backward", name: str = "matched", id_cols: Sequence[str] = (),
         rows: int | None = None) -> DataFrame:
    """Attach the lookup value at the last lookup point <= ``at`` (or the first >= ``at``).

    One sorted pass over the union of both sides; equal points match. Among lookup rows at the
    same point the largest value wins.
    """
    sign = 1.0 if direction == "backward" else -1.0
    left = queries.select(*keys, *id_cols, F.col(at), (F.col(at).cast("double") * sign).alias("_p"),
                          F.lit(1).alias("_side"), F.xxhash64(*id_cols).alias("_tie"),
                          F.lit(None).cast("double").alias("_v"))
    points = lookup.groupBy(*keys, (F.col(at).cast("double") * sign).alias("_p")).agg(
        F.max(F.col(value).cast("double")).alias("_v"))
    right = points.withColumn("_side", F.lit(0)).withColumn("_tie", F.lit(0).cast("long"))
    both = left.unionByName(right, allowMissingColumns=True)
    both = both.withColumn("_z", F.when(F.col("_side") == 0, F.struct("_p", "_v")))
    walked = running(both, keys, ["_p", "_side", "_tie", *id_cols], maxima={"_hit": F.col("_z")}, rows=rows)
    return (walked.filter("_side = 1").withColumn(name, F.col("_hit._v"))
            .select(*keys, *id_cols, at, name))
