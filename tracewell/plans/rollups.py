"""Aggregation and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import hash_draw, r6, ratio, wilson
from tracewell.operators import ranks, report, scaling
from tracewell.operators.ordered import running
from tracewell.operators.report import rounded
from tracewell.plans.registry import Tables, bounds, query, r
from tracewell.plans.views import BLOCKS_SQL, SCORES_SQL, WINDOWS_SQL, blocks, scored_windows, windows

DIMS = 64
XS = [f"x{i}" for i in range(DIMS)]


def features(t: Tables) -> DataFrame:
    """All embedding dimensions as double columns x0, x1, ... with entity and role."""
    e = F.col("embedding")
    return t("embeddings").select(
        "vec_id", "label", (F.col("label") % 3).alias("entity"), (F.col("label") != 0).alias("is_reference"),
        *[e[i].cast("double").alias(f"x{i}") for i in range(DIMS)])


def long_features(t: Tables) -> DataFrame:
    """Features as (vec_id, label, entity, feature, value), with one constant feature."""
    wide = features(t).withColumn("one", F.lit(1.0))
    return wide.unpivot(["vec_id", "label", "entity", "is_reference"], [*XS, "one"], "feature", "value")


FEATURES_SQL = """
f as (select vec_id, label, label % 3 as entity, label <> 0 as is_reference,
      """ + ", ".join(f"embedding[{i + 1}]::double as x{i}" for i in range(DIMS)) + """ from embeddings)"""
LONG_SQL = FEATURES_SQL + """,
lf as (""" + " union all ".join(
    f"select vec_id, label, entity, is_reference, 'x{i}' as feature, x{i} as value from f" for i in range(DIMS)) + """
 union all select vec_id, label, entity, is_reference, 'one', 1.0::double from f)"""


@query("e1_record_rollup", f"""
with {BLOCKS_SQL}
select record_id, role, count(*) as blocks, count(*) filter (where alarm) as alarms,
       {r('avg(score)')} as mean_score, {r('max(score)')} as max_score,
       {r('count(*) filter (where alarm)::double / count(*)')} as block_alarm_rate
from blk group by 1, 2""")
def e1(t: Tables) -> DataFrame:
    return rounded(report.record_rollup(blocks(t), ["record_id", "role"]))


@query("e2_grouped_quantiles", f"""
select l_returnflag, l_linestatus, {r('quantile_cont(l_extendedprice, 0.5)')} as median_price,
       {r('quantile_cont(l_extendedprice, 0.9)')} as p90_price
from lineitem group by 1, 2""")
def e2(t: Tables) -> DataFrame:
    return rounded(ranks.quantiles(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice",
                                   {"median_price": .5, "p90_price": .9}, rows=t.rows("lineitem")))


@query("e3_block_higher_quantile", f"""
with {SCORES_SQL}
select record_id, block_id, {r('list_sort(list(z))[cast(ceil(0.6::double * 4) as int) + 1]')} as score
from sw group by 1, 2 having count(*) = 5""")
def e3(t: Tables) -> DataFrame:
    return rounded(report.block_quantile(scored_windows(t), ["record_id", "block_id"], "z", 0.6, 5))


@query("e4_any_all", """
select o_orderpriority, bool_or(o_totalprice > 499000) as any_large, bool_and(o_totalprice > 1000) as all_positive,
       count(*) filter (where o_orderstatus = 'F') as filled
from orders group by 1""")
def e4(t: Tables) -> DataFrame:
    return t("orders").groupBy("o_orderpriority").agg(
        F.bool_or(F.col("o_totalprice") > 499000).alias("any_large"),
        F.bool_and(F.col("o_totalprice") > 1000).alias("all_positive"),
        F.count_if(F.col("o_orderstatus") == "F").alias("filled"))


SYSTEM_SQL = SCORES_SQL + """,
sub as (select record_id, load, case when is_healthy then null else 'a' end as fault_phase, window_id // 10 as system_block,
               case when window_id % 2 = 0 then 'even' else 'odd' end as subsystem, z, x from sw),
part as (select record_id, load, fault_phase, system_block, subsystem, count(*) as n, max(z) as s,
                bool_and(x < 150) as ok
         from sub group by all)"""


def subsystem_windows(t: Tables) -> DataFrame:
    return scored_windows(t).select(
        "record_id", "load", F.when(~F.col("is_healthy"), "a").alias("fault_phase"),
        F.floor(F.col("window_id") / 10).alias("system_block"),
        F.when(F.col("window_id") % 2 == 0, "even").otherwise("odd").alias("subsystem"), "z", "x")


@query("e5_system_block_scores", f"""
with {SYSTEM_SQL}
select record_id, load, system_block, count(*) as members, {r('max(s)')} as score,
       {r("max(s) filter (where subsystem = 'even')")} as score_even,
       {r("max(s) filter (where subsystem = 'odd')")} as score_odd
from part group by 1, 2, 3 having bool_and(n = 5) and count(*) = 2""")
def e5(t: Tables) -> DataFrame:
    out = report.system_blocks(subsystem_windows(t), ["record_id", "load", "system_block"], member="subsystem",
                               members=["even", "odd"], score="z", per_member=5)
    return rounded(out.drop("supported"))


@query("e6_supported_system_blocks", f"""
with {SYSTEM_SQL}
select record_id, load, fault_phase, system_block, count(*) as members, {r('max(s)')} as score,
       bool_and(ok) as supported
from part group by 1, 2, 3, 4 having bool_and(n = 5) and count(*) = 2""")
def e6(t: Tables) -> DataFrame:
    out = report.system_blocks(subsystem_windows(t), ["record_id", "load", "fault_phase", "system_block"],
                               member="subsystem", members=["even", "odd"], score="z", per_member=5,
                               supported=F.col("x") < 150)
    return rounded(out.drop("score_even", "score_odd"))


@query("e7_macro_micro", f"""
with {BLOCKS_SQL}, g as (select load, sum(alarm::int)::double as h, count(*) as n from blk group by 1)
select {r('sum(h) / sum(n)')} as pooled, {r('avg(h / n)')} as macro, {r('min(h / n)')} as worst, count(*) as groups from g""")
def e7(t: Tables) -> DataFrame:
    b = blocks(t).select("load", F.col("alarm").cast("long").alias("h"), F.lit(1).alias("n"))
    return rounded(report.macro_micro(b, "load", "h", "n"))


FIRST_SQL = BLOCKS_SQL + """,
fa as (select record_id, role, count(*) as blocks, count(*) filter (where alarm) as alarms,
              min(block_id) filter (where alarm) as first_block from blk group by 1, 2)"""


def first_alarms(t: Tables) -> DataFrame:
    return report.first_alarm(blocks(t), ["record_id", "role"], start=12.0, seconds=3.0)


@query("e8_value_counts", f"""
with {FIRST_SQL}, c as (select role, coalesce(first_block::varchar, 'never') as first_alarm_block, count(*) as records
                        from fa group by 1, 2)
select *, {r('records::double / sum(records) over (partition by role)')} as record_fraction from c""")
def e8(t: Tables) -> DataFrame:
    fa = first_alarms(t).withColumn("first_alarm_block", F.coalesce(F.col("first_block").cast("string"), F.lit("never")))
    counts = fa.groupBy("role", "first_alarm_block").agg(F.count(F.lit(1)).alias("records"))
    total = fa.groupBy("role").agg(F.count(F.lit(1)).alias("_n"))
    return counts.join(total, "role").select("role", "first_alarm_block", "records",
                                             r6(ratio("records", "_n")).alias("record_fraction"))


@query("e9_argmax_row", f"""
with {SCORES_SQL}, k as (select *, row_number() over (partition by record_id order by z desc, window_id) as rn from sw)
select record_id, window_id, event_type, {r('x')} as x, {r('z')} as z from k where rn = 1""")
def e9(t: Tables) -> DataFrame:
    best = F.max(F.struct("z", (-F.col("window_id")).alias("first"), "window_id", "event_type", "x"))
    return rounded(scored_windows(t).groupBy("record_id").agg(best.alias("b")).select(
        "record_id", "b.window_id", "b.event_type", "b.x", "b.z"))


@query("e10_first_alarm", f"""
with {FIRST_SQL}
select fa.record_id, fa.role, blocks, alarms, alarms > 0 as any_alarm, first_block,
       12.0::double + 3.0::double * first_block as first_start, 12.0::double + 3.0::double * (first_block + 1) as first_stop,
       {r('blk.score')} as first_score
from fa left join blk on blk.record_id = fa.record_id and blk.block_id = fa.first_block""")
def e10(t: Tables) -> DataFrame:
    return rounded(first_alarms(t))


@query("e11_horizons", f"""
with {BLOCKS_SQL}, h as (select unnest([1, 2, 4, 8, 16])::bigint as horizon),
rec as (select role, horizon, record_id, count(*) as b, count(*) filter (where alarm) as a
        from blk join h on block_id < horizon group by 1, 2, 3)
select role, horizon, count(*) as records, cast(sum(b) as bigint) as blocks, cast(sum(a) as bigint) as alarms,
       count(*) filter (where a > 0) as records_any, {r('sum(a)::double / sum(b)')} as block_rate,
       {r('count(*) filter (where a > 0)::double / count(*)')} as record_rate
from rec group by 1, 2""")
def e11(t: Tables) -> DataFrame:
    h = report.horizon_table(blocks(t), ["role"], [1, 2, 4, 8, 16])
    return rounded(h.withColumn("block_rate", ratio("alarms", "blocks"))
                   .withColumn("record_rate", ratio("records_any", "records")))


NODES = {"quantity": ("l_quantity", "g_quantity"), "discount": ("l_discount", "g_discount"), "tax": ("l_tax", "g_tax")}
NODE_SQL = """
n as (select l_suppkey, 'quantity' as node, l_linenumber * 7.0::double - l_quantity as e from lineitem
      union all select l_suppkey, 'discount', 0.01::double * l_linenumber - l_discount from lineitem
      union all select l_suppkey, 'tax', 0.04::double - l_tax from lineitem),
er as (select l_suppkey, node, sqrt(avg(e * e)) as rmse, avg(abs(e)) as mae, max(abs(e)) as max_abs, count(*) as n_rows
       from n group by 1, 2)"""


def predictions(t: Tables) -> DataFrame:
    return t("lineitem").withColumns({
        "g_quantity": F.col("l_linenumber") * F.lit(7.0), "g_discount": F.lit(0.01) * F.col("l_linenumber"),
        "g_tax": F.lit(0.04)})


@query("e12_error_rows", f"""
with {NODE_SQL}
select l_suppkey, node, {r('rmse')} as rmse, {r('mae')} as mae, {r('max_abs')} as max_abs, n_rows from er
union all
select l_suppkey, 'macro', {r('avg(rmse)')}, {r('avg(mae)')}, {r('avg(max_abs)')}, any_value(n_rows) from er group by 1""")
def e12(t: Tables) -> DataFrame:
    return rounded(report.error_rows(predictions(t), ["l_suppkey"], NODES))


@query("e12_regression_metrics", f"""
with m as (select 'quantity' as target, l_quantity as y, l_linenumber * 7.0::double as g from lineitem
           union all select 'discount', l_discount, 0.01::double * l_linenumber from lineitem
           union all select 'tax', l_tax, 0.04::double from lineitem),
s as (select target, avg(abs(g - y)) as mae, sqrt(avg((g - y) * (g - y))) as rmse,
             1 - avg((g - y) * (g - y)) / var_pop(y) as r2 from m group by 1)
select target, {r('mae')} as mae, {r('rmse')} as rmse, {r('r2')} as r2 from s
union all select 'macro', {r('avg(mae)')}, {r('avg(rmse)')}, {r('avg(r2)')} from s""")
def e12b(t: Tables) -> DataFrame:
    p = predictions(t)
    pairs = [F.struct(F.lit(k).alias("target"), F.col(y).cast("double").alias("y"), F.col(g).alias("g"))
             for k, (y, g) in NODES.items()]
    e = F.col("g") - F.col("y")
    per = (p.select(F.inline(F.array(*pairs))).groupBy("target")
           .agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                (F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop("y"))).alias("r2")))
    macro = per.agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("r2").alias("r2"))
    return rounded(per.unionByName(macro.select(F.lit("macro").alias("target"), "mae", "rmse", "r2")))


@query("e13_auroc", f"""
with {WINDOWS_SQL}, s as (select entity_id, round(x, 0) as s, event_type = 'error' as pos from w),
k as (select *, rank() over (partition by entity_id order by s) + (count(*) over (partition by entity_id, s) - 1) / 2.0::double as rk from s)
select entity_id, count(*) filter (where pos) as positives, count(*) filter (where not pos) as negatives,
       {r('(sum(rk) filter (where pos) - count(*) filter (where pos) * (count(*) filter (where pos) + 1) / 2.0::double) / (count(*) filter (where pos) * count(*) filter (where not pos))')} as auroc
from k group by 1""")
def e13(t: Tables) -> DataFrame:
    e = t("events").select((F.col("user_id") % 3).alias("entity_id"), F.round("value", 0).alias("s"), "event_type")
    return rounded(ranks.auroc(e, ["entity_id"], "s", F.col("event_type") == "error", rows=t.rows("events")))


@query("e14_average_precision", f"""
with s as (select user_id % 3 as entity_id, round(value, 0) as s, (event_type = 'error')::int as pos from events),
g as (select entity_id, s, sum(pos) as p, count(*) as n from s group by 1, 2),
c as (select *, sum(p) over (partition by entity_id order by s desc) as tp, sum(n) over (partition by entity_id order by s desc) as seen,
             sum(p) over (partition by entity_id) as tot from g)
select entity_id, {r('sum(p * tp::double / seen) / any_value(tot)')} as auprc from c group by 1""")
def e14(t: Tables) -> DataFrame:
    e = t("events").select((F.col("user_id") % 3).alias("entity_id"), F.round("value", 0).alias("s"), "event_type")
    return rounded(ranks.average_precision(e, ["entity_id"], "s", F.col("event_type") == "error", rows=t.rows("events")))


CORR_SQL = f"""
select {{key}}, count(*) as n, {r('case when stddev_pop(a) > 1e-12 and stddev_pop(b) > 1e-12 then corr(a, b) end')} as pearson,
       {r('case when stddev_pop(ra) > 1e-12 and stddev_pop(rb) > 1e-12 then corr(ra, rb) end')} as spearman
from rk group by 1"""


@query("e15_correlations", """
with c as (select user_id % 3 as entity_id, round(value, 0) as a, event_id % 24 as b from events
           union all select 9, value, 1 from events),
rk as (select *, rank() over (partition by entity_id order by a) + (count(*) over (partition by entity_id, a) - 1) / 2.0::double as ra,
              rank() over (partition by entity_id order by b) + (count(*) over (partition by entity_id, b) - 1) / 2.0::double as rb from c)
""" + CORR_SQL.format(key="entity_id"))
def e15(t: Tables) -> DataFrame:
    e = t("events")
    c = e.select((F.col("user_id") % 3).alias("entity_id"), F.round("value", 0).alias("a"), (F.col("event_id") % 24).alias("b"))
    c = c.unionByName(e.select(F.lit(9).cast("long").alias("entity_id"), F.col("value").alias("a"), F.lit(1).cast("long").alias("b")))
    return rounded(ranks.correlations(c, ["entity_id"], "a", "b", rows=t.rows("events", 2)))


def _robust_sql(rule: str) -> str:
    floor = {"relative": "1e-8 * greatest(abs(c), 1)", "eps": "1.4901161193847656e-08 * greatest(peak, 1)",
             "spread": "1e-12"}[rule]
    second = "iqr / 1.349::double" if rule == "spread" else "sd"
    return f"""
with {LONG_SQL}, m as (select entity, feature, median(value) as c from lf group by 1, 2),
d as (select entity, feature, any_value(c) as c, 1.4826::double * median(abs(value - c)) as mad, stddev_pop(value) as sd,
             max(abs(value)) as peak, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr
      from lf join m using (entity, feature) group by 1, 2)
select entity, feature, {r('c')} as center, {r('mad')} as mad,
       {r(f'case when mad > {floor} then mad when {second} > {floor} then {second} else 1 end')} as scale from d"""


def _robust(t: Tables, rule: str) -> DataFrame:
    return rounded(scaling.robust_parameters(long_features(t), ["entity", "feature"], "value", rule=rule,
                                             rows=t.rows("embeddings", DIMS + 1)))


@query("e16a_robust_scale_relative", _robust_sql("relative"))
def e16a(t: Tables) -> DataFrame:
    return _robust(t, "relative")


@query("e16b_robust_scale_eps", _robust_sql("eps"))
def e16b(t: Tables) -> DataFrame:
    return _robust(t, "eps")


@query("e16c_robust_scale_spread", _robust_sql("spread"))
def e16c(t: Tables) -> DataFrame:
    return _robust(t, "spread")


_cl, _ch = bounds("k", "n")
_ul, _uh = bounds("k", "n", clamp=False)


@query("e17_wilson", f"""
with c as (select p_brand, count(*) filter (where p_size > 40) as k, count(*) as n from part group by 1)
select p_brand, k, n, {r(_cl)} as low, {r(_ch)} as high, {r(_ul)} as raw_low, {r(_uh)} as raw_high from c""")
def e17(t: Tables) -> DataFrame:
    c = t("part").groupBy("p_brand").agg(F.count_if(F.col("p_size") > 40).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = wilson("k", "n")
    raw_low, raw_high = wilson("k", "n", clamp=False)
    return rounded(c.withColumns({"low": low, "high": high, "raw_low": raw_low, "raw_high": raw_high}))


_G = """(1 - 3.0::double / (4 * (na + nb) - 9)) * (ma - mb) / sqrt(nullif(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2), 0))"""


@query("e18_effect_sizes", f"""
with {LONG_SQL},
s as (select feature, count(*) filter (where label = 0)::double as na, count(*) filter (where label <> 0)::double as nb,
             avg(value) filter (where label = 0) as ma, avg(value) filter (where label <> 0) as mb,
             var_samp(value) filter (where label = 0) as va, var_samp(value) filter (where label <> 0) as vb from lf group by 1),
d as (select feature, case when stddev_samp(v) > 0 then avg(v) / stddev_samp(v) end as dz from
      (select 'x' || i as feature, embedding[i + 1]::double - embedding[(i + 1) % {DIMS} + 1]::double as v from embeddings, unnest(range({DIMS})) u(i)
       union all select 'one', 0.0::double from embeddings) group by 1)
select feature, {r(_G)} as hedges_g, {r('dz')} as paired_dz from s join d using (feature)""")
def e18(t: Tables) -> DataFrame:
    g = long_features(t).groupBy("feature").agg(report.hedges_g("value", F.col("label") == 0).alias("hedges_g"))
    pairs = [F.struct(F.lit(f"x{i}").alias("feature"), (F.col(f"x{i}") - F.col(f"x{(i + 1) % DIMS}")).alias("d"))
             for i in range(DIMS)] + [F.struct(F.lit("one").alias("feature"), F.lit(0.0).alias("d"))]
    z = features(t).select(F.inline(F.array(*pairs))).groupBy("feature").agg(report.paired_dz("d").alias("paired_dz"))
    return rounded(g.join(z, "feature"))


@query("e19_profile_manifest", f"""
with {WINDOWS_SQL}
select record_id, count(*) as rows, min(window_id) as first_index, max(window_id) as last_index, {r('min(x)')} as min_x,
       {r('max(x)')} as max_x, {r('(count(*) - 1) * 0.5::double')} as duration_seconds from w group by 1""")
def e19(t: Tables) -> DataFrame:
    return rounded(windows(t).groupBy("record_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("window_id").alias("first_index"), F.max("window_id").alias("last_index"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"),
        ((F.count(F.lit(1)) - 1) * 0.5).alias("duration_seconds")))


@query("e20_resample_bins", f"""
with {WINDOWS_SQL}
select record_id, window_id // 2 as bin, {r('avg(x)')} as mean_x, {r('max_by(x, window_id)')} as last_x,
       max_by(event_type, window_id) as last_type, count(*) as rows from w group by 1, 2""")
def e20(t: Tables) -> DataFrame:
    """Bin keys come from the row position, so a bin has at most two rows and the odd tail is kept."""
    return rounded(windows(t).groupBy("record_id", F.floor(F.col("window_id") / 2).alias("bin")).agg(
        F.avg("x").alias("mean_x"), F.max_by("x", "window_id").alias("last_x"),
        F.max_by("event_type", "window_id").alias("last_type"), F.count(F.lit(1)).alias("rows")))


PROFILED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("e21_column_profile", "with l as (" + " union all ".join(
    f'select \'{c}\' as "column", {c} as value from lineitem' for c in PROFILED) + f""")
select "column", count(*) as n, count(*) filter (where value is null) as nulls,
       count(*) filter (where value is not null and not isfinite(value)) as nonfinite, {r('min(value)')} as minimum,
       {r('quantile_cont(value, 0.01)')} as p01, {r('median(value)')} as median, {r('quantile_cont(value, 0.99)')} as p99,
       {r('max(value)')} as maximum from l group by 1""")
def e21(t: Tables) -> DataFrame:
    return rounded(report.column_profile(t("lineitem"), PROFILED, rows=t.rows("lineitem", len(PROFILED))))


@query("e22_facets", f"""
select l_returnflag, l_linestatus, grouping(l_returnflag) * 2 + grouping(l_linestatus) as level, count(*) as n,
       {r('avg(l_quantity)')} as mean_quantity
from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())""")
def e22(t: Tables) -> DataFrame:
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    return rounded(t("lineitem").groupingSets([[a, b], [a], [b], []], a, b).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean_quantity")))


POPULATION_SQL = """
pop as (select unnest(case when is_healthy then ['healthy_all', 'healthy_' || role] else ['fault'] end) as population, * from sw)"""


@query("e23_populations", f"""
with {SCORES_SQL}, {POPULATION_SQL}
select population, block_id, count(*) as units, count(distinct record_id) as records, {r('avg(x)')} as raw_mean,
       {r('stddev_samp(x)')} as raw_std, {r('quantile_cont(x, 0.25)')} as raw_q25, {r('median(x)')} as raw_median,
       {r('quantile_cont(x, 0.75)')} as raw_q75, {r('median(z)')} as z_median
from pop group by 1, 2""")
def e23(t: Tables) -> DataFrame:
    p = scored_windows(t).withColumn("population", report.population_tags("is_healthy", "role"))
    keys, rows = ["population", "block_id"], t.rows("events", 2)
    base = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("units"), F.countDistinct("record_id").alias("records"),
                                F.avg("x").alias("raw_mean"), F.stddev_samp("x").alias("raw_std"))
    qx = ranks.quantiles(p, keys, "x", {"raw_q25": .25, "raw_median": .5, "raw_q75": .75}, rows=rows)
    qz = ranks.quantiles(p, keys, "z", {"z_median": .5}, rows=rows)
    return rounded(base.join(qx, keys).join(qz, keys))


@query("e24_quantile_bins", f"""
with c as (select quantile_cont(o_totalprice, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) as q from orders),
b as (select o_totalprice, o_orderstatus, q, 1 + (o_totalprice >= q[2])::int + (o_totalprice >= q[3])::int
             + (o_totalprice >= q[4])::int + (o_totalprice >= q[5])::int as bin from orders, c)
select bin, count(*) as n, {r('max(q[bin])')} as lower, {r('max(q[bin + 1])')} as upper, {r('avg(o_totalprice)')} as mean_price,
       {r("avg((o_orderstatus = 'F')::int)")} as filled_rate from b group by 1""")
def e24(t: Tables) -> DataFrame:
    return rounded(report.bin_profile(t("orders"), "o_totalprice", 5, {
        "mean_price": F.avg("o_totalprice"), "filled_rate": F.avg((F.col("o_orderstatus") == "F").cast("int"))},
        rows=t.rows("orders")))


@query("e25_effective_sample_size", f"""
select l_returnflag, {r('sum(l_quantity) * sum(l_quantity) / sum(l_quantity * l_quantity)')} as ess,
       {r('max(l_quantity) / sum(l_quantity)')} as max_mass, {r('quantile_cont(l_quantity, 0.5)')} as w50,
       {r('quantile_cont(l_quantity, 0.95)')} as w95 from lineitem group by 1""")
def e25(t: Tables) -> DataFrame:
    li, w = t("lineitem"), F.col("l_quantity")
    base = li.groupBy("l_returnflag").agg(
        F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)).alias("ess"), F.try_divide(F.max(w), F.sum(w)).alias("max_mass"))
    q = ranks.quantiles(li, ["l_returnflag"], "l_quantity", {"w50": .5, "w95": .95}, rows=t.rows("lineitem"))
    return rounded(base.join(q, "l_returnflag"))


@query("e26_seed_ranges", f"""
with g as (select o_orderstatus as method, s.seed, o_totalprice,
                  ('0x' || substr(md5(concat_ws('|', o_orderkey::varchar, s.seed::varchar)), 1, 8))::bigint as h
           from orders, (select unnest([711, 712, 713, 714, 715]) as seed) s),
m as (select method, seed, avg(o_totalprice * (1 + (h % 1000) / 10000.0::double)) as v from g group by 1, 2),
p as (select method, v as primary_v from m where seed = 711)
select m.method, count(*) as seeds, {r('avg(v)')} as mean, {r('stddev_samp(v)')} as sd, {r('min(v)')} as minimum, {r('max(v)')} as maximum,
       {r('max(v) - min(v)')} as spread, {r('max(abs(v - primary_v))')} as max_change from m join p using (method) group by 1""")
def e26(t: Tables) -> DataFrame:
    seeds = F.explode(F.array(*[F.lit(s) for s in range(711, 716)]))
    g = t("orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("method"), seeds.alias("seed"))
    jitter = F.lit(1.0) + (hash_draw("o_orderkey", "seed") % 1000) / 10000.0
    m = g.groupBy("method", "seed").agg(F.avg(F.col("o_totalprice") * jitter).alias("v"))
    ref = m.filter("seed = 711").select("method", F.col("v").alias("_p"))
    v = F.col("v")
    return rounded(m.join(ref, "method").groupBy("method").agg(
        F.count(F.lit(1)).alias("seeds"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("minimum"),
        F.max(v).alias("maximum"), (F.max(v) - F.min(v)).alias("spread"), F.max(F.abs(v - F.col("_p"))).alias("max_change")))


@query("e27_paired_feature_shift", f"""
with p as (select 'x' || i as feature, vec_id, embedding[i + 1]::double as old, embedding[i + 1 + {DIMS // 2}]::double as new
           from embeddings, (select unnest(range({DIMS // 2})) as i)),
k as (select *, rank() over (partition by feature order by old) + (count(*) over (partition by feature, old) - 1) / 2.0::double as ra,
             rank() over (partition by feature order by new) + (count(*) over (partition by feature, new) - 1) / 2.0::double as rb from p)
select feature, count(*) as windows, {r('median(old)')} as old_median, {r('median(new)')} as new_median,
       {r('median(new - old)')} as median_delta, {r('median(abs(new - old))')} as median_abs_delta,
       {r('quantile_cont(old, 0.75) - quantile_cont(old, 0.25)')} as old_iqr,
       {r('median(abs(new - old)) / (quantile_cont(old, 0.75) - quantile_cont(old, 0.25))')} as delta_per_iqr,
       {r('sqrt(avg((new - old) * (new - old)))')} as rms_delta, {r('corr(old, new)')} as pearson, {r('corr(ra, rb)')} as spearman
from k group by 1""")
def e27(t: Tables) -> DataFrame:
    half = DIMS // 2
    e, key, rows = F.col("embedding"), ["feature"], t.rows("embeddings", half)
    pairs = [F.struct(F.lit(f"x{i}").alias("feature"), e[i].cast("double").alias("old"),
                      e[i + half].cast("double").alias("new")) for i in range(half)]
    p = t("embeddings").select("vec_id", F.inline(F.array(*pairs)))
    p = p.withColumn("d", F.col("new") - F.col("old")).withColumn("a", F.abs("d"))
    out = p.groupBy(*key).agg(F.count(F.lit(1)).alias("windows"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms_delta"))
    out = out.join(ranks.quantiles(p, key, "old", {"old_median": .5, "_q1": .25, "_q3": .75}, rows=rows), key)
    out = out.join(ranks.quantiles(p, key, "new", {"new_median": .5}, rows=rows), key)
    out = out.join(ranks.quantiles(p, key, "d", {"median_delta": .5}, rows=rows), key)
    out = out.join(ranks.quantiles(p, key, "a", {"median_abs_delta": .5}, rows=rows), key)
    out = out.join(ranks.correlations(p, key, "old", "new", rows=rows).drop("n"), key)
    iqr = F.col("_q3") - F.col("_q1")
    return rounded(out.withColumn("old_iqr", iqr).withColumn(
        "delta_per_iqr", F.try_divide(F.col("median_abs_delta"), iqr)).drop("_q1", "_q3"))


@query("e28_block_inventory", f"""
with {WINDOWS_SQL}
select record_id, block_id, count(*) as rows, {r('min(x)')} as min_x, {r('median(x)')} as median_x, {r('max(x)')} as max_x,
       {r('avg((x between 5 and 100)::int)')} as in_band, bool_and(x between 5 and 100) as all_in_band from w group by 1, 2""")
def e28(t: Tables) -> DataFrame:
    """A block has at most five windows, so the median of a block is a bounded aggregate."""
    band = F.col("x").between(5, 100)
    return rounded(windows(t).groupBy("record_id", "block_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("x").alias("min_x"), F.median("x").alias("median_x"), F.max("x").alias("max_x"),
        F.avg(band.cast("int")).alias("in_band"), F.bool_and(band).alias("all_in_band")))


@query("e33_distinct_metadata", """
with m as (select user_id, user_id % 3 as entity_id, (user_id % 8) * 5 as load, user_id % 5 <> 0 as is_healthy from events),
d as (select distinct * from m)
select *, count(*) over (partition by user_id) = 1 as consistent from d""")
def e33(t: Tables) -> DataFrame:
    u = F.col("user_id")
    d = t("events").select("user_id", (u % 3).alias("entity_id"), (u % 8 * 5).alias("load"), (u % 5 != 0).alias("is_healthy")).distinct()
    n = d.groupBy("user_id").agg((F.count(F.lit(1)) == 1).alias("consistent"))
    return d.join(n, "user_id")


@query("e34_content_aliases", """
with h as (select doc_id, lang, md5(text) as digest from documents)
select digest, min(doc_id) as canonical, count(*) as copies, count(distinct lang) = 1 as same_label from h group by 1""")
def e34(t: Tables) -> DataFrame:
    """One canonical row per content hash; aliases with another label are flagged, not dropped."""
    h = t("documents").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("digest"))
    return h.groupBy("digest").agg(F.min("doc_id").alias("canonical"), F.count(F.lit(1)).alias("copies"),
                                   (F.min("lang") == F.max("lang")).alias("same_label"))


@query("e36_support_stratified", f"""
with {NODE_SQL}, mac as (select l_suppkey, avg(rmse) as rmse from er group by 1),
s as (select s_suppkey, s_acctbal, s_acctbal < 5000 as supported, s_nationkey % 2 as dataset from supplier),
j as (select * from mac join s on l_suppkey = s_suppkey)
select dataset, supported, count(*) as profiles, {r('avg(rmse)')} as mean_rmse, {r('median(rmse)')} as median_rmse, {r('max(rmse)')} as worst_rmse,
       {r('avg(s_acctbal)')} as mean_distance from j group by 1, 2""")
def e36(t: Tables) -> DataFrame:
    macro = report.error_rows(predictions(t), ["l_suppkey"], NODES).filter("node = 'macro'")
    s = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal", (F.col("s_acctbal") < 5000).alias("supported"),
                             (F.col("s_nationkey") % 2).alias("dataset"))
    j, keys = macro.join(s, "l_suppkey"), ["dataset", "supported"]
    base = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("profiles"), F.avg("rmse").alias("mean_rmse"),
                                F.max("rmse").alias("worst_rmse"), F.avg("s_acctbal").alias("mean_distance"))
    return rounded(base.join(ranks.quantiles(j, keys, "rmse", {"median_rmse": .5}, rows=t.rows("supplier")), keys))


@query("e36_transport_degradation", f"""
with {NODE_SQL}, j as (select node, s_nationkey % 2 as d, rmse from er join supplier on l_suppkey = s_suppkey),
m as (select node, avg(rmse) filter (where d = 0) as source_mean, avg(rmse) filter (where d = 1) as target_mean from j group by 1)
select node, {r('source_mean')} as source_mean, {r('target_mean')} as target_mean, {r('target_mean - source_mean')} as delta,
       {r('target_mean / source_mean')} as ratio from m""")
def e36b(t: Tables) -> DataFrame:
    rows = report.error_rows(predictions(t), ["l_suppkey"], NODES).filter("node <> 'macro'")
    s = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 2).alias("d"))
    m = (rows.join(s, "l_suppkey").groupBy("node").pivot("d", [0, 1]).agg(F.avg("rmse"))
         .withColumnsRenamed({"0": "source_mean", "1": "target_mean"}))
    return rounded(m.withColumn("delta", F.col("target_mean") - F.col("source_mean"))
                   .withColumn("ratio", ratio("target_mean", "source_mean")))


@query("e37_calibration_feasibility", f"""
with c as (select user_id, count(*) // 5 as blocks from events group by 1)
select user_id, blocks, blocks * 3.0::double as calibration_seconds, {r('1.0::double / (blocks + 1)')} as smallest_p, 19 as needed_blocks,
       blocks >= 19 as finite_threshold,
       concat_ws('; ', case when blocks < 19 then 'too few calibration blocks' end,
                 case when blocks < 6 then 'no test block left' end) as reason,
       greatest(blocks - 6, 0) as test_blocks from c""")
def e37(t: Tables) -> DataFrame:
    from tracewell.functions.scalars import minimum_calibration

    c = t("events").groupBy("user_id").agg(F.floor(F.count(F.lit(1)) / 5).alias("blocks"))
    need = minimum_calibration(0.05).cast("int")
    b = F.col("blocks")
    return rounded(c.select(
        "user_id", "blocks", (b * F.lit(3.0)).alias("calibration_seconds"), (F.lit(1.0) / (b + 1)).alias("smallest_p"),
        need.alias("needed_blocks"), (b >= need).alias("finite_threshold"),
        F.concat_ws("; ", F.when(b < need, "too few calibration blocks"), F.when(b < 6, "no test block left")).alias("reason"),
        F.greatest(b - 6, F.lit(0).cast("long")).alias("test_blocks")))


@query("e38_operating_summary", f"""
with {WINDOWS_SQL}, p as (select record_id, x as s1, abs(x - 50) as s2, sqrt(x * x + load * load) as s3 from w where window_id < 20)
select record_id, {r('median(s1)')} as s1_median, {r('quantile_cont(s1, 0.95)')} as s1_p95, {r('median(s2)')} as s2_median,
       {r('quantile_cont(s2, 0.95)')} as s2_p95, {r('median(s3)')} as s3_median, {r('quantile_cont(s3, 0.95)')} as s3_p95 from p group by 1""")
def e38(t: Tables) -> DataFrame:
    """The prefix has at most twenty rows per record, so exact percentiles are bounded aggregates."""
    p = windows(t).filter("window_id < 20").select("record_id", F.col("x").alias("s1"), F.abs(F.col("x") - 50).alias("s2"),
                                                   F.hypot("x", "load").alias("s3"))
    aggs = []
    for s in ("s1", "s2", "s3"):
        aggs += [F.median(s).alias(f"{s}_median"), F.percentile(s, F.lit(0.95)).alias(f"{s}_p95")]
    return rounded(p.groupBy("record_id").agg(*aggs))


@query("e39_wide_summary", f"""
with {BLOCKS_SQL},
fa as (select role, record_id, min(block_id) filter (where alarm) as fb from blk group by 1, 2),
a as (select role, count(*) as records, count(*) filter (where fb is null) as never, median(fb) as median_first from fa group by 1),
h as (select role, avg(alarm::int) filter (where block_id < 4) as rate_4, avg(alarm::int) filter (where block_id < 8) as rate_8 from blk group by 1),
s as (select role, max(score) as worst from blk group by 1)
select role, records, never, {r('median_first')} as median_first, {r('rate_4')} as rate_4, {r('rate_8')} as rate_8, {r('worst')} as worst
from a join h using (role) join s using (role)""")
def e39(t: Tables) -> DataFrame:
    b = blocks(t)
    fa = report.first_alarm(b, ["role", "record_id"], start=12.0, seconds=3.0)
    a = fa.groupBy("role").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("first_block").isNull()).alias("never"))
    q = ranks.quantiles(fa, ["role"], "first_block", {"median_first": .5}, rows=t.rows("events"))
    hit = F.col("alarm").cast("int")
    h = b.groupBy("role").agg(F.avg(F.when(F.col("block_id") < 4, hit)).alias("rate_4"),
                              F.avg(F.when(F.col("block_id") < 8, hit)).alias("rate_8"), F.max("score").alias("worst"))
    return rounded(a.join(q, "role", "left").join(h, "role"))


@query("e40_score_drift", f"""
with {BLOCKS_SQL}, m as (select role, block_id, count(*) as blocks, median(score) as mid from blk group by 1, 2)
select role, block_id, blocks, {r('mid')} as median_score,
       coalesce(mid >= lag(mid) over (partition by role order by block_id), true) as not_falling from m""")
def e40(t: Tables) -> DataFrame:
    b, keys = blocks(t), ["role", "block_id"]
    m = ranks.quantiles(b, keys, "score", {"median_score": .5}, rows=t.rows("events"))
    n = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"))
    walked = running(m.join(n, keys), ["role"], ["block_id"], lags={"_before": "median_score"}, rows=t.rows("events"))
    return rounded(walked.withColumn("not_falling", F.coalesce(F.col("median_score") >= F.col("_before"), F.lit(True))).drop("_before"))
