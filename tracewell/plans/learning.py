"""Detector and model queries; fits are checked by numpy references in the tests."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalars import hash_draw
from tracewell.operators import conformal, forests, models, ranks, report, roles, segments, thermal
from tracewell.operators.conditional import ConditionalResidual, SessionAnchored
from tracewell.operators.oneclass import IsolationForest, RobustCovariance
from tracewell.operators.report import rounded
from tracewell.plans.registry import Tables, query, r
from tracewell.plans.rollups import XS, features
from tracewell.plans.thermal import source_sums, with_losses
from tracewell.plans.views import WINDOWS_SQL, windows


def contextual(t: Tables) -> DataFrame:
    """Line items with a context (quantity, line number) and three outcomes; a record is a supplier."""
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("record_id"), (F.col("l_returnflag") != "R").alias("is_healthy"),
        q.alias("speed"), n.alias("load"), (F.col("l_extendedprice") / 1000.0 + q).alias("y0"),
        (F.col("l_discount") * 100 + n * n).alias("y1"), (F.col("l_tax") * 100 + q * n / 50.0).alias("y2"))


@query("l9_conditional_residuals")
def l9(t: Tables) -> DataFrame:
    """Spline mean with local scale, fitted on healthy rows, scored on all rows and summarised per record."""
    d = contextual(t)
    model = ConditionalResidual.fit(d.filter("is_healthy"), ["speed", "load"], ["y0", "y1", "y2"], "record_id", rows=t.rows("lineitem"))
    return rounded(model.score(d).groupBy("record_id", "is_healthy").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score")))


@query("l10_mean_models")
def l10(t: Tables) -> DataFrame:
    """The four mean models side by side on the same rows."""
    d, out = contextual(t), None
    for kind in ("constant", "linear", "quadratic", "spline"):
        model = ConditionalResidual.fit(d.filter("is_healthy"), ["speed", "load"], ["y0", "y1"], "record_id", mean_model=kind,
                                        local_scale=False, rows=t.rows("lineitem"))
        s = model.score(d).groupBy("is_healthy").agg(F.count(F.lit(1)).alias("rows"), F.avg("score").alias("mean_score"))
        s = s.withColumn("mean_model", F.lit(kind)).withColumn("shrinkage", F.lit(model.shrinkage))
        out = s if out is None else out.unionByName(s)
    return rounded(out)


ANCHOR_SQL = WINDOWS_SQL + """,
v as (select record_id, is_healthy, window_id, x, sqrt(x) as y from w), a as (select record_id, median(x) as ax, median(y) as ay from v where window_id < 2 group by 1 having count(*) = 2),
rs as (select v.record_id, is_healthy, window_id, x - ax as rx, y - ay as ry from v join a using (record_id) where window_id >= 2),
m as (select median(rx) as mx, median(ry) as my from rs where is_healthy),
s0 as (select 1.4826::double * median(abs(rx - mx)) as dx, 1.4826::double * median(abs(ry - my)) as dy from rs, m where is_healthy),
z as (select rs.*, (rx - mx) / dx as zx, (ry - my) / dy as zy from rs, m, s0),
c as (select avg(zx) as lx, avg(zy) as ly, covar_pop(zx, zx) as vxx, covar_pop(zx, zy) as vxy, covar_pop(zy, zy) as vyy, count(*) as n from z where is_healthy),
q as (select avg(((zx - lx) ** 2 + (zy - ly) ** 2) ** 2) as fourth from z, c where is_healthy),
k as (select *, (vxx + vyy) / 2 as level, vxx ** 2 + 2 * vxy ** 2 + vyy ** 2 as ss from c, q),
h as (select *, least((fourth - ss) / (n * 2), (ss - 2 * level ** 2) / 2) / ((ss - 2 * level ** 2) / 2) as wt from k),
g as (select lx, ly, (1 - wt) * vxx + wt * level as gxx, (1 - wt) * vxy as gxy, (1 - wt) * vyy + wt * level as gyy from h)"""


@query("l13_session_anchor", f"""
with {ANCHOR_SQL}
select record_id, window_id, {r('greatest((gyy * (zx - lx) ** 2 - 2 * gxy * (zx - lx) * (zy - ly) + gxx * (zy - ly) ** 2) / (gxx * gyy - gxy ** 2), 0)')} as score from z, g""")
def l13(t: Tables) -> DataFrame:
    """Anchored residual geometry of healthy sessions applied to every session."""
    w = windows(t).select("record_id", "is_healthy", "window_id", "x", F.sqrt("x").alias("y"))
    res = segments.session_residuals(w, ["record_id"], "window_id", ["x", "y"])
    model = SessionAnchored.fit(res.filter("is_healthy"), ["residual_x", "residual_y"], rows=t.rows("events"))
    return rounded(model.score(res).select("record_id", "window_id", "score"))


@query("l16_isolation_forest")
def l16(t: Tables) -> DataFrame:
    f = features(t)
    forest = IsolationForest.fit(f.filter("is_reference"), XS[:8], "vec_id")
    return rounded(forest.score(f).select("vec_id", "label", "score"))


@query("l17_robust_covariance")
def l17(t: Tables) -> DataFrame:
    f = features(t)
    model = RobustCovariance.fit(f.filter("is_reference"), XS[:8])
    return rounded(model.score(f).select("vec_id", "label", "score", F.lit(model.converged).alias("converged")))


@query("l18_source_classifiers")
def l18(t: Tables) -> DataFrame:
    """Three balanced classifiers trained on source entities and scored on the target entity."""
    f = features(t).withColumn("y", (F.col("label") % 2).cast("double"))
    train, test = models.balanced_weights(f.filter("entity <> 0"), "y"), f.filter("entity = 0")
    out = models.logistic_scores(train, test, XS, "y").select("vec_id", "y", "score", F.lit("logistic").alias("method"))
    for kind in ("boosted", "forest"):
        model = models.classifier(kind, XS, "y").fit(train)
        out = out.unionByName(models.classifier_scores(model, test).select("vec_id", "y", "score", F.lit(kind).alias("method")))
    return rounded(ranks.auroc(out, ["method"], "score", F.col("y") == 1, rows=t.rows("embeddings", 3)))


@query("l24_density_ratio")
def l24(t: Tables) -> DataFrame:
    """Ratio of returned to kept line items, with its effective sample size."""
    li = t("lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    cols = ["l_quantity", "l_discount", "l_tax"]
    source, target = li.filter("l_returnflag = 'N'"), li.filter("l_returnflag = 'R'")
    model = models.DensityRatio.fit(source, target, cols, "id")
    w = model.transform(source.select("l_linestatus", *cols))
    r = F.col("ratio")
    return rounded(w.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(r).alias("mean_ratio"), F.try_divide(F.sum(r) * F.sum(r), F.sum(r * r)).alias("ess"))
        .withColumn("strength", F.lit(model.strength)), keep=["strength"])


@query("l25_multi_target")
def l25(t: Tables) -> DataFrame:
    """Median, ridge and boosted baselines per target, evaluated on held-out profiles."""
    d = contextual(t)
    train, test, targets = d.filter("record_id % 5 <> 0"), d.filter("record_id % 5 = 0"), ["y0", "y1"]
    out = None
    for kind in ("median", "ridge", "boosted"):
        p = models.multi_target(kind, train, ["speed", "load"], targets, size=5, rows=t.rows("lineitem", 2))(test)
        e = report.error_rows(p, ["record_id"], {x: (x, f"p_{x}") for x in targets}).withColumn("method", F.lit(kind))
        out = e if out is None else out.unionByName(e)
    return rounded(out.groupBy("method", "node").agg(F.avg("rmse").alias("mean_rmse"), F.max("rmse").alias("worst_rmse"), F.avg("mae").alias("mean_mae")))


def designs(t: Tables) -> DataFrame:
    """Vectors as designs: six parameters from the first components, the curve from the 48 that follow them."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    raw = t("embeddings").select("vec_id", "label", F.slice(e, 1, 16).alias("p"), F.slice(e, 17, 48).alias("c"))
    # a curve that the parameters explain in part: its level and first waves follow them, the vector's own components stay as noise
    wave = F.transform(F.sequence(F.lit(0), F.lit(POSITIONS - 1)), lambda k: F.col("p")[0] * F.col("p")[1] * 20 + F.col("p")[2] * F.cos(k * (2 * math.pi / POSITIONS))
                       + F.col("p")[3] * F.abs(F.col("p")[4]) * 10 * F.sin(k * (4 * math.pi / POSITIONS)) + F.col("c")[k] * 0.2 + F.col("p")[5])
    return raw.select("vec_id", "label", *[F.col("p")[i].alias(f"d{i}") for i in range(6)], wave.alias("curve"))


DESIGN = [f"d{i}" for i in range(6)]
POSITIONS = 48


@query("l26_curve_surrogate")
def l26(t: Tables) -> DataFrame:
    """Quadratic ridge surrogate and forests of whole curves on held-out designs."""
    from tracewell.operators.curves import curve_metrics

    d = designs(t)
    train, test = d.filter("vec_id % 4 <> 0"), d.filter("vec_id % 4 = 0")
    ridge = models.CurveSurrogate.fit_grid(train, DESIGN, "curve", alphas=[1e-1], positions=POSITIONS)[0]
    trees = forests.CurveForest.fit(train, DESIGN, "curve", positions=POSITIONS)
    both = ridge.transform(test).withColumn("method", F.lit("ridge")).unionByName(trees.transform(test).withColumn("method", F.lit("trees")))
    m = curve_metrics(both, ["method"], "curve", "predicted")
    return rounded(m.select("method", "designs", "mae", "rmse", "mean_max_error", "level_mae", "ripple_mae"))


@query("l27_surrogate_selection")
def l27(t: Tables) -> DataFrame:
    """Cross-validated curve errors of four penalties and three leaf sizes, the best of each family flagged."""
    d = designs(t)
    ridge = models.select_surrogate(d, DESIGN, "curve", "vec_id", alphas=[1e-3, 1e-1, 1e1, 1e3], positions=POSITIONS)
    fold = (hash_draw(F.lit(711), "vec_id") % 3).cast("int")
    trees = forests.select_leaf(d, DESIGN, "curve", fold, positions=POSITIONS)
    best = F.min(F.struct("cv_mae", "candidate")).over(Window.partitionBy(F.lit(0)))  # one row per leaf size
    trees = trees.withColumn("selected", F.struct("cv_mae", "candidate") == best)
    both = ridge.withColumn("method", F.lit("ridge")).unionByName(trees.withColumn("method", F.lit("trees")), allowMissingColumns=True)
    return rounded(both, keep=["alpha"])


@query("l31_residual_boosting")
def l31(t: Tables) -> DataFrame:
    """Boosted trees on what the nonnegative network leaves over, per node."""
    coef = thermal.nonnegative_from(source_sums(t))
    d = with_losses(t).filter("is_healthy")
    steps = thermal.transitions(d, "profile_id", "idx", rows=t.rows("events"), largest=t.largest("events", "user_id"))
    sizes = steps.groupBy("profile_id", "node").agg((F.lit(1.0) / F.count(F.lit(1))).alias("w"))
    names = [f"f{j}" for j in range(9)]

    def hybrid(i: int) -> DataFrame:
        node = thermal.NODES[i]
        fit = sum((F.col("x")[j] * F.lit(float(coef[i, j])) for j in range(1, 9)), F.col("x")[0] * F.lit(float(coef[i, 0])))
        part = steps.filter(F.col("node") == node).join(sizes.filter(F.col("node") == node).drop("node"), "profile_id")
        part = part.withColumn("left", F.col("y") - fit).withColumns({f"f{j}": F.col("x")[j] for j in range(9)})
        boosted = models.residual_boosters(part, names, "left", "w").transform(part)
        return boosted.agg(F.sqrt(F.avg(F.col("left") * F.col("left"))).alias("rmse_network"),
                           F.sqrt(F.avg(F.pow(F.col("left") - F.col("_boost"), F.lit(2)))).alias("rmse_hybrid")).withColumn("node", F.lit(node))

    # the nodes' rounds go side by side: a round is a few short jobs
    with ThreadPoolExecutor(len(thermal.NODES)) as pool:
        parts = list(pool.map(inheritable_thread_target(t.spark)(hybrid), range(len(thermal.NODES))))
    return rounded(reduce(DataFrame.unionByName, parts))


@query("l39_method_registry")
def l39(t: Tables) -> DataFrame:
    """Registry of scope, detector and seed: fit, score, calibrate and report every cell."""
    f = features(t)
    target = f.filter("is_reference and entity = 0 and vec_id % 2 = 0")
    balanced = roles.evenly_spaced(f.filter("is_reference").select("entity", "vec_id"), ["entity"], "vec_id", rows=t.rows("embeddings"))
    pooled = f.filter("is_reference").join(balanced, ["entity", "vec_id"])
    out = None
    for scope, train in (("target", target), ("balanced", pooled)):
        for seed in (711, 712):
            forest = IsolationForest.fit(train, XS[:8], "vec_id", seed=seed)
            s = forest.score(f).select("vec_id", "label", "is_reference", "score").withColumns(
                {"method": F.lit(f"{scope}_forest"), "seed": F.lit(seed)})
            out = s if out is None else out.unionByName(s)
        s = RobustCovariance.fit(train, XS[:8]).score(f).select(
            "vec_id", "label", "is_reference", "score").withColumns({"method": F.lit(f"{scope}_robust"), "seed": F.lit(711)})
        out = out.unionByName(s)
    p = conformal.p_values(out, ["method", "seed"], "score", F.col("is_reference") & (F.col("vec_id") % 2 == 1), rows=t.rows("embeddings", 6))
    alarm = (F.col("p_value") <= 0.1).cast("int")
    return rounded(p.groupBy("method", "seed").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.when(~F.col("is_reference"), alarm)).alias("detection"),
                                                   F.avg(F.when(F.col("is_reference"), alarm)).alias("far")))
