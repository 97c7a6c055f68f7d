"""Grouped report tables: roll-ups, macro averages, facets, horizons, bins and effect sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import is_finite, r6, ratio, wilson
from tracewell.operators.ranks import quantiles


def record_rollup(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks, alarms, alarm rate, mean and maximum score per key."""
    return (blocks.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("blocks"), F.count_if("alarm").alias("alarms"),
                 F.avg("score").alias("mean_score"), F.max("score").alias("max_score"))
            .withColumn("block_alarm_rate", ratio("alarms", "blocks")))


def block_quantile(windows: DataFrame, keys: Sequence[str], score: str, q: float, size: int,
                   name: str = "score") -> DataFrame:
    """'Higher' quantile of the window scores of complete blocks.

    A block holds exactly ``size`` windows, because window ids are unique inside a record and the
    block id is their integer quotient, so the sorted list is bounded by ``size``.
    """
    index = F.ceil(F.lit(q) * (F.lit(size) - 1)).cast("int") + 1
    return (windows.groupBy(*keys)
            .agg(F.sort_array(F.collect_list(score)).alias("_s"))
            .filter(F.size("_s") == size)
            .select(*keys, F.element_at("_s", index).alias(name)))


def system_blocks(windows: DataFrame, keys: Sequence[str], *, member: str, members: Sequence[str],
                  score: str, per_member: int, supported: Column | None = None) -> DataFrame:
    """Maximum over windows, then over members; complete member sets only.

    Window counts and the member set are checked as flags; grouping keeps null keys. A system block
    is supported only when every window is.
    """
    support = supported if supported is not None else F.lit(True)
    part = (windows.withColumn("_ok", support).groupBy(*keys, member)
            .agg(F.count(F.lit(1)).alias("_n"), F.max(score).alias("_s"), F.bool_and("_ok").alias("_ok")))
    return (part.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("members"), F.max("_s").alias("score"),
                 F.bool_and("_ok").alias("supported"),
                 F.bool_and(F.col("_n") == per_member).alias("_full"),
                 *[F.max(F.when(F.col(member) == m, F.col("_s"))).alias(f"score_{m}") for m in members])
            .filter(F.col("_full") & (F.col("members") == len(members))).drop("_full"))


def macro_micro(records: DataFrame, group: str, hits: str, trials: str) -> DataFrame:
    """Pooled rate, mean of group rates and worst group rate in one row."""
    per_group = records.groupBy(group).agg(F.sum(hits).alias("_h"), F.sum(trials).alias("_t"))
    rate = ratio("_h", "_t")
    return per_group.agg(ratio(F.sum("_h"), F.sum("_t")).alias("pooled"), F.avg(rate).alias("macro"),
                         F.min(rate).alias("worst"), F.count(F.lit(1)).alias("groups"))


def horizon_table(blocks: DataFrame, keys: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """Record-level alarms for growing block prefixes.

    Blocks are reduced to one row per record and horizon before anything else: the fan-out is the
    number of horizons, a short constant list.
    """
    stops = F.array(*[F.lit(h).cast("long") for h in horizons])
    fanned = blocks.withColumn("horizon", F.explode(F.filter(stops, lambda h: F.col("block_id") < h)))
    record = (fanned.groupBy(*keys, "horizon", "record_id")
              .agg(F.count(F.lit(1)).alias("_b"), F.count_if("alarm").alias("_a")))
    return (record.groupBy(*keys, "horizon")
            .agg(F.count(F.lit(1)).alias("records"), F.sum("_b").alias("blocks"), F.sum("_a").alias("alarms"),
                 F.count_if(F.col("_a") > 0).alias("records_any")))


def first_alarm(blocks: DataFrame, keys: Sequence[str], *, start: float, seconds: float) -> DataFrame:
    """First alarmed block per record with its time span and score; nulls when there is none."""
    hit = F.min(F.when(F.col("alarm"), F.struct("block_id", "score")))
    return (blocks.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("blocks"), F.count_if("alarm").alias("alarms"), hit.alias("_f"))
            .select(*keys, "blocks", "alarms", (F.col("alarms") > 0).alias("any_alarm"),
                    F.col("_f.block_id").alias("first_block"),
                    (F.lit(start) + F.col("_f.block_id") * F.lit(seconds)).alias("first_start"),
                    (F.lit(start) + (F.col("_f.block_id") + 1) * F.lit(seconds)).alias("first_stop"),
                    F.col("_f.score").alias("first_score")))


def population_tags(healthy: str, role: str) -> Column:
    """Overlapping populations of a row: all healthy, healthy of a role, or fault."""
    return F.explode(F.when(F.col(healthy), F.array(F.lit("healthy_all"),
                                                    F.concat(F.lit("healthy_"), F.col(role))))
                     .otherwise(F.array(F.lit("fault"))))


def column_profile(df: DataFrame, columns: Sequence[str], *, rows: int | None = None) -> DataFrame:
    """Minimum, p01, median, p99, maximum, nulls and non-finite counts per column."""
    long = df.select(F.lit(1).alias("_r"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ["_r"], list(columns), "column", "value")
    good = long.filter(is_finite("value"))
    q = quantiles(good, ["column"], "value", {"p01": .01, "median": .5, "p99": .99}, rows=rows)
    base = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"),
        F.count_if(F.col("value").isNotNull() & ~is_finite("value")).alias("nonfinite"),
        F.min(F.when(is_finite("value"), F.col("value"))).alias("minimum"),
        F.max(F.when(is_finite("value"), F.col("value"))).alias("maximum"))
    return base.join(q, "column", "left")


def bin_profile(df: DataFrame, scale: str, bins: int, measures: Mapping[str, Column], *,
                rows: int | None = None) -> DataFrame:
    """Measures per quantile bin of ``scale``; bins are [lo, hi) and the last one is closed."""
    keyed = df.withColumn("_g", F.lit(1))
    cuts = quantiles(keyed, ["_g"], scale, {f"_c{i}": i / bins for i in range(bins + 1)}, rows=rows)
    placed = keyed.join(F.broadcast(cuts), "_g")  # one row of cut points
    number = F.lit(1)
    for i in range(1, bins):
        number = number + F.when(F.col(scale) >= F.col(f"_c{i}"), 1).otherwise(0)
    edges = F.array(*[F.col(f"_c{i}") for i in range(bins + 1)])
    return (placed.withColumn("bin", number).withColumn("_e", edges).groupBy("bin")
            .agg(F.count(F.lit(1)).alias("n"), F.max(F.col("_e")[F.col("bin") - 1]).alias("lower"),
                 F.max(F.col("_e")[F.col("bin")]).alias("upper"),
                 *[m.alias(name) for name, m in measures.items()]))


def hedges_g(x: str, fault: Column) -> Column:
    """Small-sample corrected standardized mean difference; null when the spread is zero."""
    a, b = F.when(fault, F.col(x)), F.when(~fault, F.col(x))
    na, nb = F.count(a).cast("double"), F.count(b).cast("double")
    pooled = F.try_divide((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b), na + nb - 2)
    d = F.try_divide(F.avg(a) - F.avg(b), F.sqrt(F.when(pooled > 0, pooled)))
    return (F.lit(1.0) - F.try_divide(F.lit(3.0), F.lit(4.0) * (na + nb) - 9)) * d


def paired_dz(difference: str) -> Column:
    """Mean difference over its sample deviation; null when the spread is zero."""
    sd = F.stddev_samp(difference)
    return F.try_divide(F.avg(difference), F.when(sd > 0, sd))


def error_rows(df: DataFrame, keys: Sequence[str], nodes: Mapping[str, tuple[str, str]]) -> DataFrame:
    """RMSE, MAE and maximum error per key and node, plus a macro row per key.

    ``nodes`` maps a node name to its (truth, prediction) columns.
    """
    aggs = []
    for node, (truth, guess) in nodes.items():
        e = F.col(guess).cast("double") - F.col(truth).cast("double")
        aggs.append(F.struct(F.lit(node).alias("node"), F.sqrt(F.avg(e * e)).alias("rmse"),
                             F.avg(F.abs(e)).alias("mae"), F.max(F.abs(e)).alias("max_abs"),
                             F.count(F.lit(1)).alias("n_rows")))
    per_key = df.groupBy(*keys).agg(F.array(*aggs).alias("_n"))

    def mean_of(field: str) -> Column:
        values = F.transform("_n", lambda s: s[field])
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.lit(float(len(nodes)))

    macro = F.struct(F.lit("macro").alias("node"), mean_of("rmse").alias("rmse"), mean_of("mae").alias("mae"),
                     mean_of("max_abs").alias("max_abs"), F.col("_n")[0]["n_rows"].alias("n_rows"))
    return per_key.select(*keys, F.inline(F.concat(F.col("_n"), F.array(macro))))


def rounded(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Round every double column to six places."""
    return df.select(*[r6(c).alias(c) if t == "double" and c not in keep else F.col(c)
                       for c, t in df.dtypes])


def with_wilson(df: DataFrame, hits: str, trials: str) -> DataFrame:
    low, high = wilson(hits, trials)
    return df.withColumn("wilson_low", low).withColumn("wilson_high", high)
