"""Thermal queries over records read as profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators import ranks, thermal
from tracewell.operators.report import rounded
from tracewell.plans.registry import Tables, query, r
from tracewell.plans.views import WINDOWS_SQL, windows

PREFIX = 20
START, END = 10, 26

PROFILES_SQL = WINDOWS_SQL + """,
th as (select record_id as profile_id, window_id as idx, is_healthy, x / 10 as i_d, load / 10.0::double as i_q, x / 5 as u_d, (window_id % 7)::double as u_q, 100 + x as speed_rpm,
              1 + load / 5.0::double as torque_nm, 20 + load / 10.0::double as coolant, 25.0::double + (window_id % 5) as ambient, 40 + x / 10 as temp_winding,
              35 + (event_id % 17) / 2.0::double as temp_core, 30 + (event_id % 23) / 3.0::double as temp_rotor from w),
mg as (select *, sqrt(i_d * i_d + i_q * i_q) as mc, sqrt(u_d * u_d + u_q * u_q) as mv, abs(speed_rpm) as ms, abs(torque_nm) as mt from th),
p9 as (select profile_id, any_value(is_healthy) as h, quantile_cont(mc, 0.95) as pc, quantile_cont(mv, 0.95) as pv, quantile_cont(ms, 0.95) as ps, quantile_cont(mt, 0.95) as pt from mg where idx < 20 group by 1),
fo as (select greatest(0.05::double * median(pc), 1e-6) as fc, greatest(0.05::double * median(pv), 1e-6) as fv, greatest(0.05::double * median(ps), 1e-6) as fs, greatest(0.05::double * median(pt), 1e-6) as ft from p9 where h),
nm as (select mg.*, mc / greatest(pc, fc) as c, mv / greatest(pv, fv) as v, ms / greatest(ps, fs) as s, mt / greatest(pt, ft) as q from mg join p9 using (profile_id), fo),
ls as (select *, c * c as loss_1, c * c * s as loss_2, v * c as loss_3, q * s * (2 * pi() / 60) as loss_4, s * s as loss_5 from nm)"""


def profiles(t: Tables) -> DataFrame:
    x, load, i, e = F.col("x"), F.col("load"), F.col("window_id"), F.col("event_id")
    return windows(t).select(
        F.col("record_id").alias("profile_id"), i.alias("idx"), "is_healthy", (x / 10).alias("i_d"), (load / 10.0).alias("i_q"),
        (x / 5).alias("u_d"), (i % 7).cast("double").alias("u_q"), (x + 100).alias("speed_rpm"), (load / 5.0 + 1).alias("torque_nm"),
        (load / 10.0 + 20).alias("coolant"), (F.lit(25.0) + i % 5).alias("ambient"), (x / 10 + 40).alias("temp_winding"),
        ((e % 17) / 2.0 + 35).alias("temp_core"), ((e % 23) / 3.0 + 30).alias("temp_rotor"))


def with_losses(t: Tables) -> DataFrame:
    p = profiles(t)
    floors = thermal.magnitude_floors(p.filter("is_healthy"), "profile_id", "idx", prefix=PREFIX, rows=t.rows("events"))
    return thermal.normalized_losses(p, "profile_id", "idx", floors, prefix=PREFIX)


@query("l28_normalized_losses", f"with {PROFILES_SQL} select profile_id, idx, " + ", ".join(f"{r(n)} as {n}" for n in thermal.LOSSES) + " from ls")
def l28(t: Tables) -> DataFrame:
    return rounded(with_losses(t).select("profile_id", "idx", *thermal.LOSSES))


@query("l28_raw_losses", f"""
with {PROFILES_SQL}, rw as (select profile_id, idx, is_healthy, mc * mc as a, mc * mc * ms as b, mv * mc as c, mt * ms * (2 * pi() / 60) as d, ms * ms as e from mg),
q as (select profile_id, quantile_cont(a, 0.95) as a, quantile_cont(b, 0.95) as b, quantile_cont(c, 0.95) as c, quantile_cont(d, 0.95) as d, quantile_cont(e, 0.95) as e from rw where is_healthy group by 1),
s as (select median(a) as sa, median(b) as sb, median(c) as sc, median(d) as sd, median(e) as se from q)
select profile_id, idx, {r('a / sa')} as loss_1, {r('b / sb')} as loss_2, {r('c / sc')} as loss_3, {r('d / sd')} as loss_4, {r('e / se')} as loss_5 from rw, s""")
def l28b(t: Tables) -> DataFrame:
    p = profiles(t)
    scales = thermal.raw_loss_scales(p.filter("is_healthy"), "profile_id", "idx", rows=t.rows("events"))
    return rounded(thermal.raw_losses(p, scales).select("profile_id", "idx", *thermal.LOSSES))


def design(t: Tables) -> DataFrame:
    return thermal.transitions(with_losses(t), "profile_id", "idx", rows=t.rows("events"), largest=t.largest("events", "user_id"))


def source_sums(t: Tables) -> dict:
    d = with_losses(t).filter("is_healthy")
    steps = thermal.transitions(d, "profile_id", "idx", rows=t.rows("events"), largest=t.largest("events", "user_id"))
    return thermal.pooled(thermal.normal_equations(steps, ["profile_id", "node"]))


OTHERS = {"temp_winding": ("temp_core", "temp_rotor"), "temp_core": ("temp_winding", "temp_rotor"), "temp_rotor": ("temp_winding", "temp_core")}
DESIGN_SQL = PROFILES_SQL + """,
pv as (select *, """ + ", ".join(f"lag({n}) over (partition by profile_id order by idx) as p_{n}" for n in thermal.NODES) + """ from ls),
ds as (""" + " union all ".join(
    f"select profile_id, idx, '{n}' as node, p_{a} - p_{n} as o1, p_{b} - p_{n} as o2, coolant - p_{n} as co, ambient - p_{n} as am, loss_1, loss_2, loss_3, loss_4, loss_5, {n} - p_{n} as y from pv where p_{n} is not null"
    for n, (a, b) in OTHERS.items()) + ")"


@query("f7_transition_design", f"with {DESIGN_SQL} select profile_id, idx, node, {r('o1')} as other_1, {r('o2')} as other_2, {r('co')} as coolant, {r('am')} as ambient, {r('y')} as delta from ds")
def f7(t: Tables) -> DataFrame:
    x = F.col("x")
    return rounded(design(t).select("profile_id", "idx", "node", x[0].alias("other_1"), x[1].alias("other_2"), x[2].alias("coolant"),
                                    x[3].alias("ambient"), F.col("y").alias("delta")))


@query("l30_normal_equations", f"""
with {DESIGN_SQL} select profile_id, node, count(*) as n, {r('sum(o1 * o1)')} as g_11, {r('sum(o1 * co)')} as g_13, {r('sum(loss_5 * loss_5)')} as g_99, {r('sum(am * y)')} as b_4, {r('sum(loss_2 * y)')} as b_6 from ds group by 1, 2""")
def l30a(t: Tables) -> DataFrame:
    e = thermal.normal_equations(design(t), ["profile_id", "node"])
    return rounded(e.select("profile_id", "node", "n", F.col("g")[0].alias("g_11"), F.col("g")[2].alias("g_13"), F.col("g")[44].alias("g_99"),
                            F.col("b")[3].alias("b_4"), F.col("b")[5].alias("b_6")))


def coefficient_table(t: Tables, models: dict) -> DataFrame:
    return rounded(t.spark.createDataFrame(thermal.coefficient_rows(models), "method string, node string, feature string, value double"))


@query("l29_ridge_coefficients")
def l29(t: Tables) -> DataFrame:
    """Profile-balanced ridge transition model as coefficient rows."""
    coef, _ = thermal.ridge_from(source_sums(t), 1.0)
    return coefficient_table(t, {"ridge": coef})


@query("l30_nonnegative_coefficients")
def l30(t: Tables) -> DataFrame:
    """Pooled nonnegative coefficients, then per-profile prefix fits pulled to them."""
    d = with_losses(t)
    source = thermal.nonnegative_from(source_sums(t))
    steps = thermal.transitions(d.filter(f"idx < {PREFIX}"), "profile_id", "idx", rows=t.rows("events"), largest=t.largest("events", "user_id"))
    fits = thermal.nonnegative_per_profile(thermal.normal_equations(steps, ["profile_id", "node"]), source, 0.1)
    return rounded(fits.select("profile_id", "node", F.posexplode("coef").alias("position", "value")))


@query("i5_coefficient_rows")
def i5(t: Tables) -> DataFrame:
    sums = source_sums(t)
    return coefficient_table(t, {"nonnegative": thermal.nonnegative_from(sums), "ridge_1": thermal.ridge_from(sums, 1.0)[0],
                                 "ridge_10": thermal.ridge_from(sums, 10.0)[0]})


# one set of coefficients for the forecast check; the guard is tight so that clipping occurs
COEF = np.array([[0.05, 0.02, 0.10, 0.03, 0.4, 0.2, 0.3, 0.1, 0.2], [0.04, 0.03, 0.08, 0.05, 0.2, 0.1, 0.2, 0.3, 0.1],
                 [0.06, 0.01, 0.05, 0.04, 0.1, 0.3, 0.1, 0.2, 0.3]])
GUARD = (20.0, 48.0)


def _step(n: int) -> str:
    names = ["w", "c", "q"]
    others = [names[i] for i in range(3) if i != n]
    k = COEF[n]
    s = names[n]
    inner = (f"r.{s} + {k[0]}::double * (r.{others[0]} - r.{s}) + {k[1]}::double * (r.{others[1]} - r.{s}) + {k[2]}::double * (l.coolant - r.{s}) + {k[3]}::double * (l.ambient - r.{s})"
             + "".join(f" + {k[4 + i]}::double * l.loss_{i + 1}" for i in range(5)))
    return inner


ROLL_SQL = PROFILES_SQL.replace("with ", "") + f""",
ok as (select profile_id from ls group by 1 having count(*) >= {END}),
ro(profile_id, idx, w, c, q, clips) as (
  select profile_id, idx, temp_winding, temp_core, temp_rotor, 0 from ls where idx = {START - 1} and profile_id in (select profile_id from ok)
  union all
  select profile_id, idx, least(greatest(a, {GUARD[0]}::double), {GUARD[1]}::double), least(greatest(b, {GUARD[0]}::double), {GUARD[1]}::double), least(greatest(d, {GUARD[0]}::double), {GUARD[1]}::double),
         clips + (a < {GUARD[0]} or a > {GUARD[1]})::int + (b < {GUARD[0]} or b > {GUARD[1]})::int + (d < {GUARD[0]} or d > {GUARD[1]})::int
  from (select r.profile_id, l.idx, {_step(0)} as a, {_step(1)} as b, {_step(2)} as d, clips from ro r join ls l on l.profile_id = r.profile_id and l.idx = r.idx + 1 where l.idx < {END})),
an as (select profile_id, temp_winding as w, temp_core as c, temp_rotor as q, (coolant + ambient) / 2 as bd from ls where idx = {START - 1} and profile_id in (select profile_id from ok)),
fc as (select 'network' as method, ro.profile_id, ro.idx, w, c, q, clips from ro where idx >= {START}
       union all select 'hold', an.profile_id, idx, an.w, an.c, an.q, 0 from an join ls using (profile_id) where idx >= {START} and idx < {END}
       union all select 'shifted', an.profile_id, idx, an.w + (coolant + ambient) / 2 - bd, an.c + (coolant + ambient) / 2 - bd, an.q + (coolant + ambient) / 2 - bd, 0 from an join ls using (profile_id) where idx >= {START} and idx < {END}),
er as (select method, profile_id, max(clips) as clips, sqrt(avg((fc.w - temp_winding) ** 2)) as rw, sqrt(avg((fc.c - temp_core) ** 2)) as rc, sqrt(avg((fc.q - temp_rotor) ** 2)) as rq,
              max(abs(fc.w - temp_winding)) as xw, max(abs(fc.c - temp_core)) as xc, max(abs(fc.q - temp_rotor)) as xq from fc join ls using (profile_id, idx) group by 1, 2)"""


def forecasts(t: Tables) -> DataFrame:
    h = thermal.horizon_rows(with_losses(t), "profile_id", "idx", start=START, end=END)
    coef, shift = thermal.constant_model(COEF)
    net = thermal.rollout(h.withColumn("coef", coef).withColumn("intercept", shift), guard=GUARD).drop("coef", "intercept")
    parts = [("network", net), ("hold", thermal.persistence(h, shift=False)), ("shifted", thermal.persistence(h, shift=True))]
    out = None
    for name, df in parts:
        df = df.withColumn("method", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


@query("l32_rollout_errors", f"""
with recursive {ROLL_SQL}
select method, profile_id, clips::bigint as clip_count, node, {r('rmse')} as rmse, {r('max_abs')} as max_abs from (
  select method, profile_id, clips, unnest(['temp_winding', 'temp_core', 'temp_rotor', 'macro']) as node, unnest([rw, rc, rq, (rw + rc + rq) / 3]) as rmse, unnest([xw, xc, xq, (xw + xc + xq) / 3]) as max_abs from er)""")
def l32(t: Tables) -> DataFrame:
    e = thermal.rollout_errors(forecasts(t), ["method", "profile_id"])
    return rounded(e.select("method", "profile_id", "clip_count", "node", "rmse", "max_abs"))


ALPHAS = (1e-3, 0.01, 0.1, 1.0, 10.0)
RIDGES = (0.0, 1e-3)
PENALTIES = (0.0, 1e-3, 1e-2, 0.1, 1.0)


@query("l33_validation_tuning")
def l33(t: Tables) -> DataFrame:
    """Ridge candidates by rollout error on held-out profiles; every candidate comes from one normal-equation table."""
    d = with_losses(t)
    sums = source_sums(t)
    h = thermal.horizon_rows(d.filter("not is_healthy"), "profile_id", "idx", start=START)
    cells = []
    for alpha in ALPHAS:
        coef, shift = thermal.constant_model(*thermal.ridge_from(sums, alpha))
        cells.append(F.struct(F.lit(alpha).alias("alpha"), coef.alias("coef"), shift.alias("intercept")))
    runs = thermal.rollout(h.select("*", F.inline(F.array(*cells))))
    per = thermal.rollout_errors(runs, ["alpha", "profile_id"]).filter("node = 'macro'")
    table = per.groupBy("alpha").agg(F.count(F.lit(1)).alias("profiles"), F.avg("rmse").alias("mean_rmse"), F.sum("clip_count").alias("clips"))
    best = F.min(F.struct("mean_rmse", "alpha")).over(Window.partitionBy())["alpha"]  # one row per candidate
    return rounded(table.withColumn("selected", F.col("alpha") == best))


@query("l33_prior_penalty")
def l33b(t: Tables) -> DataFrame:
    """Ridge and prior penalties of prefix fits by rollout error over the rest, on held-out profiles; one pass solves the grid."""
    d = with_losses(t).filter("not is_healthy")
    source = thermal.nonnegative_from(source_sums(t))
    steps = thermal.transitions(d.filter(f"idx < {START}"), "profile_id", "idx", rows=t.rows("events"), largest=t.largest("events", "user_id"))
    equations = thermal.normal_equations(steps, ["profile_id", "node"])
    fits = thermal.nonnegative_grid(equations, source, RIDGES, PENALTIES)
    wide = fits.groupBy("profile_id", "ridge", "penalty").pivot("node", list(thermal.NODES)).agg(F.first("coef"))
    model = wide.select("profile_id", "ridge", "penalty", F.concat(*thermal.NODES).alias("coef"), F.array(*[F.lit(0.0)] * 3).alias("intercept"))
    h = thermal.horizon_rows(d, "profile_id", "idx", start=START)
    per = thermal.rollout_errors(thermal.rollout(h.join(model, "profile_id")), ["profile_id", "ridge", "penalty"]).filter("node = 'macro'")
    table = per.groupBy("ridge", "penalty").agg(F.count(F.lit(1)).alias("profiles"), F.avg("rmse").alias("mean_rmse"))
    best = F.min(F.struct("mean_rmse", "ridge", "penalty")).over(Window.partitionBy(F.lit(0)))  # one row per cell of the grid
    return rounded(table.withColumn("selected", F.struct("ridge", "penalty") == F.struct(best["ridge"].alias("ridge"), best["penalty"].alias("penalty"))),
                   keep=["ridge", "penalty"])


@query("l34_budget_sensitivity")
def l34(t: Tables) -> DataFrame:
    """Prefix fits under growing commissioning budgets, forecast over one shared segment."""
    d = with_losses(t)
    source, out = thermal.nonnegative_from(source_sums(t)), None
    h = thermal.horizon_rows(d, "profile_id", "idx", start=20)
    steps = thermal.transitions(d.filter("idx < 20"), "profile_id", "idx", rows=t.rows("events"), largest=t.largest("events", "user_id"))
    budgets = steps.withColumn("budget", F.explode(F.filter(F.array(*[F.lit(b) for b in (8, 12, 20)]), lambda b: F.col("idx") < b)))
    fits = thermal.nonnegative_per_profile(thermal.normal_equations(budgets, ["profile_id", "budget", "node"]), source, 0.1)
    wide = fits.groupBy("profile_id", "budget").pivot("node", list(thermal.NODES)).agg(F.first("coef"))
    model = wide.select("profile_id", "budget", F.concat(*thermal.NODES).alias("coef"), F.array(*[F.lit(0.0)] * 3).alias("intercept"))
    out = thermal.rollout_errors(thermal.rollout(h.join(model, "profile_id")), ["profile_id", "budget"]).filter("node = 'macro'")
    q = ranks.quantiles(out, ["budget"], "rmse", {"median_rmse": 0.5}, rows=t.rows("events"))
    base = out.groupBy("budget").agg(F.count(F.lit(1)).alias("profiles"), F.avg("rmse").alias("mean_rmse"), F.max("rmse").alias("worst_rmse"))
    return rounded(base.join(q, "budget"))


@query("i4_forecast_rows", f"""
with recursive {ROLL_SQL} select profile_id, idx, {r('fc.w')} as predicted, {r('temp_winding')} as truth from fc join ls using (profile_id, idx) where method = 'network'""")
def i4(t: Tables) -> DataFrame:
    k = len(thermal.NODES)
    f = forecasts(t).filter("method = 'network'")
    own = [F.filter(c, lambda v, at: at % k == 0).alias(n) for c, n in (("prediction", "predicted"), ("truth", "truth"))]
    rows = F.posexplode(F.arrays_zip(*own)).alias("step", "v")
    return rounded(f.select("profile_id", rows).select("profile_id", (F.col("step") + START).cast("long").alias("idx"), "v.predicted", "v.truth"))
