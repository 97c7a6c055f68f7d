"""Covariance, neighbour, conformal and comparison queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import r6
from tracewell.operators import compare, conformal, covariance, neighbours, ranks, report
from tracewell.operators.report import rounded
from tracewell.plans.registry import Tables, bounds, query, r
from tracewell.plans.rollups import DIMS, FEATURES_SQL, LONG_SQL, XS, features
from tracewell.plans.views import BLOCKS_SQL, SCORES_SQL, WINDOWS_SQL, blocks, scored_windows, windows, with_record_labels

X8 = XS[:8]
X3 = XS[:3]

COV_SQL = LONG_SQL + """,
lx as (select * from lf where feature <> 'one'),
cv as (select a.entity, a.feature as fi, b.feature as fj, covar_samp(a.value, b.value) as v, count(*) as n
       from lx a join lx b using (vec_id, entity) where a.is_reference group by 1, 2, 3)"""


def reference(t: Tables) -> DataFrame:
    return features(t).filter("is_reference")


def named(long: DataFrame) -> DataFrame:
    return long.withColumn("fi", F.concat(F.lit("x"), F.col("i").cast("string"))).withColumn(
        "fj", F.concat(F.lit("x"), F.col("j").cast("string"))).drop("i", "j")


@query("l1_sample_covariance", f"with {COV_SQL} select entity, fi, fj, n, {r('v')} as value from cv")
def l1(t: Tables) -> DataFrame:
    return rounded(named(covariance.sample_covariance(reference(t), ["entity"], XS)))


@query("l1_wide_covariance", f"""
with s as (select vec_id, label % 2 as half, i, embedding[i + 1]::double as v from embeddings, unnest(range(24)) u(i))
select a.half, 'x' || a.i as fi, 'x' || b.i as fj, count(*) as n, {r('covar_samp(a.v, b.v)')} as value from s a join s b using (vec_id, half) group by 1, 2, 3""")
def l1b(t: Tables) -> DataFrame:
    e = F.col("embedding")
    wide = t("embeddings").select((F.col("label") % 2).alias("half"), *[e[i].cast("double").alias(f"x{i}") for i in range(24)])
    return rounded(named(covariance.sample_covariance(wide, ["half"], [f"x{i}" for i in range(24)])))


@query("l2_ridge", f"""
with {COV_SQL}, tr as (select entity, sum(v) / {DIMS} as t from cv where fi = fj group by 1)
select entity, fi, fj, n, {r('v + case when fi = fj then 1e-3 * t else 0 end')} as value from cv join tr using (entity)""")
def l2(t: Tables) -> DataFrame:
    long = covariance.sample_covariance(reference(t), ["entity"], XS)
    return rounded(named(covariance.regularized(long, ["entity"], DIMS, 1e-3)))


@query("l3_entity_mean", f"""
with {COV_SQL}, m as (select fi, fj, avg(v) as v from cv group by 1, 2), tr as (select sum(v) / {DIMS} as t from m where fi = fj)
select fi, fj, {r('v + case when fi = fj then 1e-3 * t else 0 end')} as value from m, tr""")
def l3(t: Tables) -> DataFrame:
    long = covariance.sample_covariance(reference(t), ["entity"], XS)
    return rounded(named(covariance.entity_mean(long, DIMS, 1e-3)))


def entity_matrices(t: Tables, columns=XS) -> list:
    found = covariance.matrices(covariance.sample_covariance(reference(t), ["entity"], columns), ["entity"], len(columns))
    return [found[k] for k in sorted(found)]


@query("l4_log_euclidean_mean")
def l4(t: Tables) -> DataFrame:
    """Log-Euclidean mean of the entity covariances, applied as a distance to every vector."""
    mean = covariance.log_euclidean_mean(entity_matrices(t), 1e-2)
    score = covariance.distance(XS, covariance.precision_of(mean))
    return features(t).select("vec_id", "entity", r6(score).alias("score"))


INVERSE_SQL = """
q as (select max(v) filter (where fi = 'x0' and fj = 'x0') as a, max(v) filter (where fi = 'x0' and fj = 'x1') as b, max(v) filter (where fi = 'x0' and fj = 'x2') as c,
             max(v) filter (where fi = 'x1' and fj = 'x1') as d, max(v) filter (where fi = 'x1' and fj = 'x2') as e, max(v) filter (where fi = 'x2' and fj = 'x2') as g from m3),
det as (select *, a * (d * g - e * e) - b * (b * g - c * e) + c * (b * e - c * d) as det from q),
inv as (select (d * g - e * e) / det as p00, (c * e - b * g) / det as p01, (b * e - c * d) / det as p02, (a * g - c * c) / det as p11, (b * c - a * e) / det as p12, (a * d - b * b) / det as p22 from det)"""
MEAN3_SQL = COV_SQL + """,
m2 as (select fi, fj, avg(v) as v from cv where fi in ('x0', 'x1', 'x2') and fj in ('x0', 'x1', 'x2') group by 1, 2),
m3 as (select fi, fj, v + case when fi = fj then 1e-3 * (select sum(v) / 3 from m2 where fi = fj) else 0 end as v from m2),""" + INVERSE_SQL + """,
ct as (select vec_id, entity, label, x0 * (p00 * x0 + p01 * x1 + p02 * x2) as c0, x1 * (p01 * x0 + p11 * x1 + p12 * x2) as c1, x2 * (p02 * x0 + p12 * x1 + p22 * x2) as c2 from f, inv),
cs as (select *, c0 + c1 + c2 as score from ct)"""


def mean_precision(t: Tables):
    long = covariance.sample_covariance(reference(t), ["entity"], X3)
    return covariance.precision_of(covariance.matrices(covariance.entity_mean(long, 3, 1e-3), [], 3)[()])


@query("l5_mahalanobis", f"with {MEAN3_SQL} select vec_id, entity, {r('score')} as score from cs")
def l5(t: Tables) -> DataFrame:
    return features(t).select("vec_id", "entity", r6(covariance.distance(X3, mean_precision(t))).alias("score"))


def contribution_rows(t: Tables) -> DataFrame:
    p = mean_precision(t)
    parts = features(t).select("vec_id", "entity", "label", covariance.distance(X3, p).alias("score"),
                               covariance.contributions(X3, p).alias("parts"))
    return covariance.with_shares(parts)


SHARE_SQL = MEAN3_SQL + """,
sh as (select vec_id, entity, label, score, unnest(['x0', 'x1', 'x2']) as feature, unnest([c0, c1, c2]) as contribution, abs(c0) + abs(c1) + abs(c2) as t from cs)"""


@query("l6_contributions", f"""
with {SHARE_SQL} select vec_id, feature, {r('contribution')} as contribution, {r('contribution / score')} as share, {r('abs(contribution) / t')} as absolute_share from sh""")
def l6(t: Tables) -> DataFrame:
    return rounded(contribution_rows(t).select("vec_id", "feature", "contribution", "share", "absolute_share"))


@query("l6_winning_rows", f"""
with {SHARE_SQL}, w as (select entity, arg_max(vec_id, score) as vec_id from cs group by 1)
select sh.entity, sh.vec_id, feature, {r('score')} as score, {r('contribution / score')} as share from sh join w using (vec_id, entity)""")
def l6b(t: Tables) -> DataFrame:
    """The winning vector of each entity with its whole contribution vector, from one aggregate."""
    p = mean_precision(t)
    row = F.struct(covariance.distance(X3, p).alias("score"), (-F.col("vec_id")).alias("first"), "vec_id",
                   covariance.contributions(X3, p).alias("parts"))
    won = features(t).groupBy("entity").agg(F.max(row).alias("w")).select("entity", "w.vec_id", "w.score", "w.parts")
    return rounded(covariance.with_shares(won).select("entity", "vec_id", "feature", "score", "share"))


@query("e35_contribution_summary", f"""
with {SHARE_SQL}
select feature, entity, grouping(entity) as all_entities, count(*) as n, {r('avg(contribution)')} as mean_signed, {r('avg(abs(contribution))')} as mean_absolute,
       {r('avg(contribution / score)')} as mean_share, {r('avg(abs(contribution) / t)')} as mean_absolute_share, {r('avg((contribution < 0)::int)')} as negative_fraction
from sh group by grouping sets ((feature, entity), (feature))""")
def e35(t: Tables) -> DataFrame:
    f, e, c = F.col("feature"), F.col("entity"), F.col("contribution")
    g = contribution_rows(t).groupingSets([[f, e], [f]], f, e)
    return rounded(g.agg(F.grouping("entity").cast("long").alias("all_entities"), F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean_signed"),
                         F.avg(F.abs(c)).alias("mean_absolute"), F.avg("share").alias("mean_share"),
                         F.avg("absolute_share").alias("mean_absolute_share"), F.avg((c < 0).cast("int")).alias("negative_fraction")))


@query("l7_shrinkage", f"""
with {LONG_SQL}, lx as (select * from lf where feature <> 'one' and is_reference), mu as (select feature, avg(value) as m from lx group by 1),
c as (select vec_id, feature, value - m as v from lx join mu using (feature)),
cv as (select a.feature as fi, b.feature as fj, avg(a.v * b.v) as v from c a join c b using (vec_id) group by 1, 2),
q as (select avg(s * s) as fourth, count(*) as n from (select vec_id, sum(v * v) as s from c group by 1)),
p as (select (select sum(v) / {DIMS} from cv where fi = fj) as level, (select sum(v * v) from cv) as ss, fourth, n from q),
k as (select level, n, least((fourth - ss) / (n * {DIMS}), (ss - {DIMS} * level * level) / {DIMS}) / ((ss - {DIMS} * level * level) / {DIMS}) as w from p)
select fi, fj, {r('w')} as weight, {r('(1 - w) * v + case when fi = fj then w * level else 0 end')} as value from cv, k""")
def l7(t: Tables) -> DataFrame:
    _, cov, weight = covariance.shrunk_covariance(reference(t), XS)
    cells = covariance.columns_of(cov, XS)
    table = t.spark.createDataFrame(cells, "fi string, fj string, value double")
    return rounded(table.withColumn("weight", F.lit(weight)))


@query("l8_covariance_family")
def l8(t: Tables) -> DataFrame:
    """Five covariance methods scored in one pass, summarised per method and label."""
    per = entity_matrices(t, X8)
    ref = reference(t)
    loc, shrunk, _ = covariance.shrunk_covariance(ref.filter("entity = 0"), X8)
    methods = {
        "target_sample": (covariance.with_ridge(per[0], 1e-3), None),
        "source_mean": (covariance.with_ridge(sum(per[1:]) / len(per[1:]), 1e-3), None),
        "entity_mean": (covariance.with_ridge(sum(per) / len(per), 1e-3), None),
        "log_euclidean": (covariance.log_euclidean_mean(per, 1e-2), None),
        "target_shrunk": (shrunk, loc)}
    s = covariance.method_scores(features(t), X8, methods)
    return rounded(s.groupBy("method", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score")))


@query("l15_independent_columns")
def l15(t: Tables) -> DataFrame:
    """Columns kept when an exact linear relation and a constant are added to the features."""
    wide = features(t).withColumn("linear", F.col("x0") + F.col("x1") - 2 * F.col("x2")).withColumn("one", F.lit(1.0))
    kept = covariance.independent_columns(wide.filter("is_reference"), [*X8, "linear", "one"])
    return wide.select("vec_id", *kept).unpivot(["vec_id"], kept, "feature", "value").groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"), r6(F.stddev_samp("value")).alias("deviation"))


# ---------------------------------------------------------------- neighbours

SQUARES = " + ".join(f"(a.x{i} - b.x{i}) ** 2" for i in range(DIMS))


@query("d8_kth_neighbour", f"""
with {FEATURES_SQL}, p as (select a.vec_id, sqrt({SQUARES}) as d, row_number() over (partition by a.vec_id order by {SQUARES}, b.vec_id) as rn, b.vec_id as nb from f a, f b where a.label = 0 and b.label <> 0)
select vec_id, {r('max(d) filter (where rn = 5)')} as distance_5, {r('max(d) filter (where rn = 1)')} as distance_1, max(nb) filter (where rn = 1) as neighbour from p group by 1""")
def d8(t: Tables) -> DataFrame:
    f = features(t)
    q, ref = f.filter("label = 0"), f.filter("is_reference")
    out = neighbours.nearest(q, ref, XS, k=[1, 5], reference_id="vec_id", distance=["distance_1", "distance_5"], neighbour="neighbour")
    return rounded(out.select("vec_id", "distance_5", "distance_1", "neighbour"))


@query("d9_leave_one_out", f"""
with {FEATURES_SQL} select a.vec_id, {r(f'min(sqrt({SQUARES}))')} as nearest from f a, f b where a.vec_id <> b.vec_id group by 1""")
def d9(t: Tables) -> DataFrame:
    f = features(t)
    return rounded(neighbours.nearest(f, f, XS, k=2, distance="nearest").select("vec_id", "nearest"))


SCALED3 = " + ".join(f"((a.x{i} - b.x{i}) / s{i}) ** 2" for i in range(3))
SUPPORT_SQL = LONG_SQL + """,
fit as (select feature, median(value) as c from lf where label >= 4 group by 1),
dv as (select feature, 1.4826::double * median(abs(value - c)) as mad, stddev_pop(value) as sd, max(abs(value)) as peak, min(value) as lo, max(value) as hi from lf join fit using (feature) where label >= 4 group by 1),
sc as (select feature, case when mad > 1.4901161193847656e-08 * greatest(peak, 1) then mad when sd > 1.4901161193847656e-08 * greatest(peak, 1) then sd else 1 end as s, lo, hi from dv),
sw as (select """ + ", ".join(f"max(s) filter (where feature = 'x{i}') as s{i}, max(lo) filter (where feature = 'x{i}') as lo{i}, max(hi) filter (where feature = 'x{i}') as hi{i}" for i in range(3)) + f""" from sc),
nd as (select a.vec_id, a.label, min(sqrt({SCALED3})) as d, bool_and(a.x0 between lo0 and hi0 and a.x1 between lo1 and hi1 and a.x2 between lo2 and hi2) as inside from f a, f b, sw where b.label >= 4 group by 1, 2),
ra as (select max(d) * 0.9::double as radius from nd where label in (1, 2, 3))"""


@query("l11_context_support", f"with {SUPPORT_SQL} select vec_id, {r('d')} as distance, {r('radius')} as radius, d <= radius and inside as supported from nd, ra where label = 0")
def l11(t: Tables) -> DataFrame:
    from tracewell.operators.support import ContextSupport

    f = features(t)
    model = ContextSupport.fit(f.filter("label >= 4"), f.filter("label in (1, 2, 3)"), X3, multiplier=0.9, rows=t.rows("embeddings", 3))
    out = model.evaluate(f.filter("label = 0")).withColumn("radius", F.lit(model.radius))
    return rounded(out.select("vec_id", "distance", "radius", "supported"))


PROFILE_SQL = WINDOWS_SQL + """,
sm as (select record_id, is_healthy, median(x) as a, quantile_cont(x, 0.95) as b, median(abs(x - 50)) as c from w where window_id < 20 group by 1, 2),
md as (select median(a) as ma, median(b) as mb, median(c) as mc, quantile_cont(a, 0.75) - quantile_cont(a, 0.25) as ia, quantile_cont(b, 0.75) - quantile_cont(b, 0.25) as ib, quantile_cont(c, 0.75) - quantile_cont(c, 0.25) as ic from sm where is_healthy),
sd as (select 1.4826::double * median(abs(a - ma)) as sa, 1.4826::double * median(abs(b - mb)) as sb, 1.4826::double * median(abs(c - mc)) as sc from sm, md where is_healthy),
st as (select record_id, is_healthy, (a - ma) / sa as a, (b - mb) / sb as b, (c - mc) / sc as c from sm, md, sd),
lo as (select p.record_id, min(sqrt((p.a - q.a) ** 2 + (p.b - q.b) ** 2 + (p.c - q.c) ** 2)) as d from st p, st q where p.is_healthy and q.is_healthy and p.record_id <> q.record_id group by 1),
th as (select list_sort(list(d))[cast(ceil(0.95::double * (count(*) - 1)) as int) + 1] as threshold from lo),
ts as (select p.record_id, min(sqrt((p.a - q.a) ** 2 + (p.b - q.b) ** 2 + (p.c - q.c) ** 2)) as d, arg_min(q.record_id, (p.a - q.a) ** 2 + (p.b - q.b) ** 2 + (p.c - q.c) ** 2) as nn from st p, st q where not p.is_healthy and q.is_healthy group by 1)"""


@query("l12_profile_support", f"with {PROFILE_SQL} select record_id, {r('d')} as distance, {r('threshold')} as threshold, d <= threshold as supported, nn as nearest_profile from ts, th")
def l12(t: Tables) -> DataFrame:
    from tracewell.operators.support import ProfileSupport

    sm = windows(t).filter("window_id < 20").groupBy("record_id", "is_healthy").agg(
        F.median("x").alias("a"), F.percentile("x", F.lit(0.95)).alias("b"), F.median(F.abs(F.col("x") - 50)).alias("c"))
    model = ProfileSupport.fit(sm.filter("is_healthy"), "record_id", ["a", "b", "c"], rows=t.rows("events"))
    return rounded(model.evaluate(sm.filter("not is_healthy")).select("record_id", "distance", "threshold", "supported", "nearest_profile"))


KNN_SQL = FEATURES_SQL + f""",
pr as (select a.vec_id, a.label, b.vec_id as nb, sqrt({SQUARES}) as d, row_number() over (partition by a.vec_id order by {SQUARES}) as rn from f a, f b where b.is_reference),
kd as (select vec_id, label, max(d) filter (where rn = 5) as d5, max(d) filter (where rn = 6) as d6 from pr group by 1, 2),
rf as (select median(d6) as ref from kd where label <> 0)"""


@query("l14_difficulty_scale", f"""
with {KNN_SQL}, sc as (select vec_id, label, greatest(d5 / ref, 0.25::double) as scale, d5 from kd, rf),
ca as (select list(d5) as g, count(*) as n from sc where label = 1)
select vec_id, {r('scale')} as scale, {r('(1 + len(list_filter(g, lambda v: v >= d5)))::double / (n + 1)')} as support_p from sc, ca where label = 0""")
def l14(t: Tables) -> DataFrame:
    from tracewell.operators.support import DifficultyScale

    f = features(t)
    model = DifficultyScale.fit(f.filter("is_reference"), XS, k=5, floor=0.25, rows=t.rows("embeddings"))
    scored = model.transform(f.filter("label in (0, 1)"))
    p = conformal.p_values(scored, [], "distance", F.col("label") == 1, name="support_p", rows=t.rows("embeddings"))
    return rounded(p.filter("label = 0").select("vec_id", "scale", "support_p"))


# ---------------------------------------------------------------- methods compared on the same records

METHOD_SQL = SCORES_SQL + """,
um as (select record_id, median(x) as um from w group by 1),
ms as (select 'robust' as method, record_id, role, load, block_id, z as s from sw
       union all select 'centered', record_id, role, load, block_id, abs(x - um) from sw join um using (record_id)
       union all select 'raw', record_id, role, load, block_id, x from sw),
mb as (select method, record_id, any_value(role) as role, any_value(load) as load, block_id, max(s) as score from ms group by method, record_id, block_id having count(*) = 5),
mp as (select *, (1 + count(*) filter (where role = 'calibration') over (partition by method order by score desc range between unbounded preceding and current row))::double
                 / (1 + count(*) filter (where role = 'calibration') over (partition by method)) as p_value from mb),
ma as (select *, p_value <= 0.05::double as alarm from mp),
mr as (select method, record_id, any_value(load) as load, count(*) as blocks, avg(alarm::int) as rate, avg(score) as mean_score from ma where role = 'fault_test' group by 1, 2)"""


def method_blocks(t: Tables) -> DataFrame:
    """Three scores of every window side by side, reduced to blocks, then one conformal pass for all methods."""
    sw = scored_windows(t)
    um = ranks.quantiles(sw, ["record_id"], "x", {"um": 0.5}, rows=t.rows("events"), largest=t.largest("events", "user_id"))
    wide = sw.join(um, "record_id").groupBy("record_id", "block_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("z").alias("robust"),
        F.max(F.abs(F.col("x") - F.col("um"))).alias("centered"), F.max("x").alias("raw")).filter("_n = 5").drop("_n")
    long = with_record_labels(wide).unpivot(["record_id", "block_id", "role", "load"], ["robust", "centered", "raw"], "method", "score")
    p = conformal.p_values(long, ["method"], "score", F.col("role") == "calibration", rows=t.rows("events"))
    return p.withColumn("alarm", F.col("p_value") <= F.lit(0.05))


def method_records(t: Tables) -> DataFrame:
    return method_blocks(t).filter("role = 'fault_test'").groupBy("method", "record_id", "load").agg(
        F.count(F.lit(1)).alias("blocks"), F.avg(F.col("alarm").cast("int")).alias("rate"),
        F.avg("score").alias("mean_score"))


def fifth(name: str, x: str) -> str:
    """SQL text of the fifth power of ``x`` modulo the prime of the draws, as column ``name``."""
    p = compare.PRIME
    return f"({x}) % {p} as {name}0, {name}0 * {name}0 % {p} as {name}2, {name}2 * {name}2 % {p} * {name}0 % {p} as {name}"


BOOT_SQL = f"""
its as (select it, {fifth('a', f'it * {compare.SPREAD} + 711')} from range(10000) u(it)),
dr as (select g, stratum, it, v, {fifth('b', 'a + slot')}, {fifth('c', f'b + {compare.TURN}')}, {' + '.join(f'(c >= {k})::int' for k in compare.poisson_cuts())} as w from src, its),
st as (select g, stratum, it, sum(w * v) as s, sum(w)::double as w from dr group by 1, 2, 3),
sz as (select g, stratum, count(*) as n, avg(v) as m from src group by 1, 2),
me as (select g, it, sum(n * case when w > 0 then s / w else sz.m end) / sum(n) as m from st join sz using (g, stratum) group by 1, 2),
ob as (select g, avg(v) as o, count(*) as n from src group by 1),
bt as (select g, any_value(n) as n, any_value(o) as observed, quantile_cont(m, 0.025) as ci_low, quantile_cont(m, 0.975) as ci_high,
              (1 + count(*) filter (where abs(m - o) >= abs(o) - 1e-12::double))::double / (count(*) + 1) as p_value,
              least(1, 2.0::double * (1 + least(count(*) filter (where m > 1e-12::double), count(*) filter (where m < -1e-12::double))) / (count(*) + 1)) as sign_p
       from me join ob using (g) group by 1)"""


@query("l19_stratified_bootstrap", f"""
with src as (select s_nationkey % 3 as g, s_nationkey % 5 as stratum, s_suppkey as slot, (s_acctbal - 4500) / 10000.0::double as v from supplier), {BOOT_SQL}
select g, n, {r('observed')} as observed, {r('ci_low')} as ci_low, {r('ci_high')} as ci_high, {r('p_value')} as p_value, {r('sign_p')} as sign_p from bt""")
def l19(t: Tables) -> DataFrame:
    s = t("supplier").select((F.col("s_nationkey") % 3).alias("g"), (F.col("s_nationkey") % 5).alias("stratum"), "s_suppkey",
                             ((F.col("s_acctbal") - 4500) / 10000.0).alias("v"))
    out = compare.bootstrap_interval(s, ["stratum"], "v", "s_suppkey", seed=711, by=["g"], rows=t.rows("supplier"))
    return rounded(out)


def method_pairs(t: Tables) -> DataFrame:
    """Every baseline minus the robust candidate per record, as one pivot."""
    wide = method_records(t).groupBy("record_id").pivot("method", ["robust", "centered", "raw"]).agg(F.first("rate"))
    load = (F.col("record_id") % 8 * 5).alias("load")
    pairs = wide.select("record_id", load, F.col("robust"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("baseline"), F.col(m).alias("rate")) for m in ("centered", "raw")])))
    return pairs.withColumn("difference", F.col("rate") - F.col("robust"))


PAIR_SQL = METHOD_SQL + """,
pp as (select b.method as baseline, b.record_id, b.load, b.rate - a.rate as d, a.rate as ra, b.rate as rb from mr a join mr b using (record_id) where a.method = 'robust' and b.method <> 'robust'),
src as (select baseline as g, load as stratum, record_id as slot, d as v from pp)"""


@query("l20_method_comparison", f"""
with {PAIR_SQL}, {BOOT_SQL},
ct as (select baseline, count(*) as pairs, count(*) filter (where d > 0) as wins, count(*) filter (where d = 0) as ties, count(*) filter (where d < 0) as losses, avg(rb) as baseline_rate, avg(ra) as candidate_rate from pp group by 1),
h as (select g, observed, ci_low, ci_high, p_value, row_number() over (order by p_value, g) as rn, count(*) over () as m from bt)
select baseline, pairs, wins, ties, losses, {r('baseline_rate')} as baseline_rate, {r('candidate_rate')} as candidate_rate, {r('observed')} as difference, {r('ci_low')} as ci_low,
       {r('ci_high')} as ci_high, {r('p_value')} as p_value, {r('least(1, max((m - rn + 1) * p_value) over (order by p_value, g rows unbounded preceding))')} as holm_p from ct join h on baseline = g""")
def l20(t: Tables) -> DataFrame:
    pairs = method_pairs(t)
    d = F.col("difference")
    counts = pairs.groupBy("baseline").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"),
        F.avg("rate").alias("baseline_rate"), F.avg("robust").alias("candidate_rate"))
    boot = compare.bootstrap_interval(pairs, ["load"], "difference", "record_id", seed=711, by=["baseline"], rows=t.rows("events"))
    family = boot.withColumn("_f", F.lit(0))
    adjusted = compare.holm(family, ["_f"], "p_value", "baseline", rows=2)
    return rounded(counts.join(adjusted, "baseline").select("baseline", "pairs", "wins", "ties", "losses", "baseline_rate", "candidate_rate",
                                                            F.col("observed").alias("difference"), "ci_low", "ci_high", "p_value", "holm_p"))


RANK_SQL = """
lv as (select k, abs(d) as a, d, rank() over (partition by k order by abs(d)) + (count(*) over (partition by k, abs(d)) - 1) / 2.0::double as rk, count(*) over (partition by k, abs(d)) as t from src where d <> 0),
sm as (select k, count(*) as ranked, coalesce(sum(rk) filter (where d > 0), 0) as wp, coalesce(sum(rk) filter (where d < 0), 0) as wm, sum(t * t - 1) as tie, max(t) as largest_tie from lv group by 1),
cn as (select k, count(*) as pairs, count(*) filter (where d > 0) as wins, count(*) filter (where d = 0) as ties, count(*) filter (where d < 0) as losses, avg(d) as mean_difference from src group by 1)"""


@query("l20_signed_ranks", f"""
with src as (select l_suppkey as k, l_linenumber * 7 - l_quantity as d from lineitem), {RANK_SQL}
select k as l_suppkey, pairs, wins, ties, losses, {r('mean_difference')} as mean_difference, ranked, largest_tie, {r('least(wp, wm)')} as statistic,
       {r('(least(wp, wm) - ranked * (ranked + 1) / 4.0::double) / sqrt(ranked * (ranked + 1) * (2.0::double * ranked + 1) / 24 - tie / 48.0::double)')} as z from cn join sm using (k)""")
def l20b(t: Tables) -> DataFrame:
    p = t("lineitem").select("l_suppkey", (F.col("l_linenumber") * 7 - F.col("l_quantity")).alias("d"))
    return rounded(compare.signed_ranks(p, ["l_suppkey"], "d", rows=t.rows("lineitem")))


@query("l20_wilcoxon_p")
def l20c(t: Tables) -> DataFrame:
    """Signed-rank p-values with a step-down correction over the suppliers of a nation."""
    p = t("lineitem").select("l_suppkey", (F.col("l_linenumber") * 7 - F.col("l_quantity")).alias("d"))
    s = compare.signed_ranks(p, ["l_suppkey"], "d", rows=t.rows("lineitem"))
    tied = (F.col("largest_tie") > 1) | (F.col("ties") > 0)
    s = s.withColumn("p_value", compare.wilcoxon_p("ranked", "statistic", "z", tied)).withColumn("_f", F.col("l_suppkey") % 5)
    return rounded(compare.holm(s, ["_f"], "p_value", "l_suppkey", rows=t.rows("supplier")).select("l_suppkey", "p_value", "holm_p"))


@query("l21_alarms", f"""
with {METHOD_SQL} select method, record_id, block_id, {r('p_value')} as p_value, alarm, alarm and load < 25 as actionable from ma""")
def l21(t: Tables) -> DataFrame:
    b = method_blocks(t)
    return rounded(b.select("method", "record_id", "block_id", "p_value", "alarm", (F.col("alarm") & (F.col("load") < 25)).alias("actionable")))


@query("l36_same_block_effects", f"""
with {BLOCKS_SQL}, lv as (select block_id, score, is_healthy, load, record_id from blk union all select -1, score, is_healthy, load, record_id from blk),
rk as (select *, rank() over (partition by block_id order by score) + (count(*) over (partition by block_id, score) - 1) / 2.0::double as rk from lv),
au as (select block_id, count(*) filter (where is_healthy) as healthy_units, count(*) filter (where not is_healthy) as fault_units,
              (sum(rk) filter (where not is_healthy) - count(*) filter (where not is_healthy) * (count(*) filter (where not is_healthy) + 1) / 2.0::double)
              / (count(*) filter (where not is_healthy) * count(*) filter (where is_healthy)) as auc,
              count(*) filter (where not is_healthy)::double as na, count(*) filter (where is_healthy)::double as nb, avg(score) filter (where not is_healthy) as ma, avg(score) filter (where is_healthy) as mb,
              var_samp(score) filter (where not is_healthy) as va, var_samp(score) filter (where is_healthy) as vb from rk group by 1),
hb as (select load, block_id, avg(score) as h from blk where is_healthy group by 1, 2),
df as (select b.block_id, score - h as d from blk b join hb using (load, block_id) where not is_healthy), dl as (select * from df union all select -1, d from df),
dz as (select block_id, count(*) as pairs, avg(d) as md, median(d) as mdd, avg(d) / nullif(stddev_samp(d), 0) as dz from dl group by 1)
select au.block_id, healthy_units, fault_units, {r('auc')} as auroc, {r('greatest(auc, 1 - auc)')} as direction_free,
       {r('(1 - 3.0::double / (4 * (na + nb) - 9)) * (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))')} as hedges_g, pairs,
       {r('md')} as matched_mean, {r('mdd')} as matched_median, {r('dz')} as matched_dz from au join dz using (block_id)""")
def l36(t: Tables) -> DataFrame:
    """Every block and an all-block level come from one fan-out by two."""
    rows = t.rows("events", 2)
    b = blocks(t)
    levels = F.explode(F.array(F.col("block_id"), F.lit(-1).cast("long")))
    lv = b.select("load", "record_id", "score", "is_healthy", levels.alias("block_id"))
    key, fault = ["block_id"], ~F.col("is_healthy")
    auc = ranks.auroc(lv, key, "score", fault, rows=rows).withColumnsRenamed({"positives": "fault_units", "negatives": "healthy_units"})
    g = lv.groupBy(*key).agg(report.hedges_g("score", fault).alias("hedges_g"))
    healthy = b.filter("is_healthy").groupBy("load", "block_id").agg(F.avg("score").alias("_h"))
    d = b.filter("not is_healthy").join(healthy, ["load", "block_id"]).select((F.col("score") - F.col("_h")).alias("d"), levels.alias("block_id"))
    dz = d.groupBy(*key).agg(F.count(F.lit(1)).alias("pairs"), F.avg("d").alias("matched_mean"), report.paired_dz("d").alias("matched_dz"))
    mid = ranks.quantiles(d, key, "d", {"matched_median": .5}, rows=rows)
    a = F.col("auroc")
    return rounded(auc.join(g, key).join(dz, key).join(mid, key).withColumn("direction_free", F.greatest(a, F.lit(1.0) - a)))


@query("l37_block_matched_auroc", f"""
with {METHOD_SQL}, s as (select method, block_id, score, role = 'fault_test' as pos from ma where role in ('fault_test', 'health_test')),
lv as (select method, block_id, score, pos from s union all select method, -1, score, pos from s),
rk as (select *, rank() over (partition by method, block_id order by score) + (count(*) over (partition by method, block_id, score) - 1) / 2.0::double as rk from lv),
au as (select method, block_id, (sum(rk) filter (where pos) - count(*) filter (where pos) * (count(*) filter (where pos) + 1) / 2.0::double) / (count(*) filter (where pos) * count(*) filter (where not pos)) as a from rk group by 1, 2)
select method, {r('avg(a) filter (where block_id >= 0)')} as equal_weight_mean, {r('min(a) filter (where block_id >= 0)')} as minimum, {r('max(a) filter (where block_id >= 0)')} as maximum,
       {r('max(a) filter (where block_id = -1)')} as pooled from au group by 1""")
def l37(t: Tables) -> DataFrame:
    s = method_blocks(t).filter("role in ('fault_test', 'health_test')")
    lv = s.select("method", "score", "role", F.explode(F.array(F.col("block_id"), F.lit(-1).cast("long"))).alias("block_id"))
    a = ranks.auroc(lv, ["method", "block_id"], "score", F.col("role") == "fault_test", rows=t.rows("events", 2))
    one = F.when(F.col("block_id") >= 0, F.col("auroc"))
    return rounded(a.groupBy("method").agg(F.avg(one).alias("equal_weight_mean"), F.min(one).alias("minimum"), F.max(one).alias("maximum"),
                                           F.max(F.when(F.col("block_id") == -1, F.col("auroc"))).alias("pooled")))


_fl, _fh = bounds("fa", "hb")


@query("l38_fold_evaluation", f"""
with {METHOD_SQL},
e as (select method, count(*) filter (where role = 'health_test' and alarm) as fa, count(*) filter (where role = 'health_test') as hb, count(*) filter (where role = 'fault_test' and alarm) as de,
             count(*) filter (where role = 'fault_test') as fb from ma group by 1),
q as (select method, avg(rate) as macro, avg((rate > 0)::int) as any_rate from mr group by 1),
s as (select method, score, role = 'fault_test' as pos from ma where role in ('fault_test', 'health_test')),
rk as (select *, rank() over (partition by method order by score) + (count(*) over (partition by method, score) - 1) / 2.0::double as rk from s),
au as (select method, (sum(rk) filter (where pos) - count(*) filter (where pos) * (count(*) filter (where pos) + 1) / 2.0::double) / (count(*) filter (where pos) * count(*) filter (where not pos)) as auc from rk group by 1)
select method, fa as false_alarms, hb as healthy_blocks, {r('fa::double / hb')} as far, {r(_fl)} as far_low, {r(_fh)} as far_high, {r('de::double / fb')} as detection,
       {r('macro')} as macro_detection, {r('any_rate')} as any_detection, {r('auc')} as auroc, fa::double / hb <= 0.1::double as far_gate from e join q using (method) join au using (method)""")
def l38(t: Tables) -> DataFrame:
    from tracewell.operators.evaluate import evaluate_methods

    return rounded(evaluate_methods(method_blocks(t), ["method"], rows=t.rows("events"), far_limit=0.1))


@query("l35_nested_selection")
def l35(t: Tables) -> DataFrame:
    """Ridge candidates under pseudo-targets: objective = detection - 2 FAR, best candidate flagged."""
    from tracewell.operators.evaluate import nested_ridge_selection

    return rounded(nested_ridge_selection(features(t), X8, entity="entity", healthy="is_reference", order="vec_id",
                                          candidates=[1e-3, 1e-2, 1e-1], alpha=0.1, rows=t.rows("embeddings", 9)))


BUDGETS = (1_000, 5_000, 10_000)


@query("e40_bootstrap_budget", f"""
with src as (select 0 as g, s_nationkey % 5 as stratum, s_suppkey as slot, (s_acctbal - 4500) / 10000.0::double as v from supplier), {BOOT_SQL}
select b as budget, {r('quantile_cont(m, 0.975) - quantile_cont(m, 0.025)')} as width from me, (select unnest({list(BUDGETS)}) as b) where it < b group by 1""")
def e40b(t: Tables) -> DataFrame:
    s = t("supplier").select((F.col("s_nationkey") % 5).alias("stratum"), "s_suppkey", ((F.col("s_acctbal") - 4500) / 10000.0).alias("v"), F.lit(0).alias("g"))
    m = compare.bootstrap_means(s, ["stratum"], "v", "s_suppkey", iterations=max(BUDGETS), seed=711, by=["g"])
    fan = m.select("mean", F.explode(F.filter(F.array(*[F.lit(b) for b in BUDGETS]), lambda b: F.col("iteration") < b)).alias("budget"))
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return rounded(fan.groupBy("budget").agg(q.alias("q")).select("budget", (F.col("q")[1] - F.col("q")[0]).alias("width")))


@query("e36_adaptation_differences", f"""
with {METHOD_SQL}, p as (select record_id, load < 25 as supported, max(rate) filter (where method = 'robust') as robust, max(rate) filter (where method = 'centered') as centered, max(rate) filter (where method = 'raw') as raw from mr group by 1, 2)
select record_id, supported, {r('centered - robust')} as centered_minus_robust, {r('raw - robust')} as raw_minus_robust from p""")
def e36c(t: Tables) -> DataFrame:
    m = method_records(t).withColumn("supported", F.col("load") < 25)
    wide = m.groupBy("record_id", "supported").pivot("method", ["robust", "centered", "raw"]).agg(F.first("rate"))
    return rounded(wide.select("record_id", "supported", (F.col("centered") - F.col("robust")).alias("centered_minus_robust"),
                               (F.col("raw") - F.col("robust")).alias("raw_minus_robust")))
