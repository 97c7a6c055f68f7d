"""Signal, curve and band queries over the embedding vectors read as waveforms and curves."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import spectral
from tracewell.functions.scalars import r6
from tracewell.operators import conformal, curves, report, signal
from tracewell.operators.ordered import with_position
from tracewell.operators.report import rounded
from tracewell.plans.registry import Tables, bounds, query, r
from tracewell.plans.rollups import NODES, predictions
from tracewell.plans.views import WINDOWS_SQL, windows

SIZE, RATE = 64, 1280.0
STEP = RATE / SIZE

SAMPLES_SQL = """
s as (select vec_id, i, embedding[i + 1]::double as a, embedding[(i + 21) % 64 + 1]::double as b, embedding[(i + 42) % 64 + 1]::double as c
      from embeddings, unnest(range(64)) u(i))"""

SPECTRUM_SQL = SAMPLES_SQL + """,
mu as (select vec_id, avg(a) as ma, avg(b) as mb, avg(c) as mc from s group by 1),
hw as (select i, 0.5::double - 0.5::double * cos(2 * pi() * i / 63) as h from (select unnest(range(64)) as i)),
hs as (select 2.0::double / sum(h) as g from hw),
t as (select s.vec_id, i, (a - ma) * h * g as a, (b - mb) * h * g as b, (c - mc) * h * g as c from s join mu using (vec_id) join hw using (i), hs),
sp as (select vec_id, k, sum(a * cos(2 * pi() * k * i / 64)) as ra, -sum(a * sin(2 * pi() * k * i / 64)) as ia,
              sum(b * cos(2 * pi() * k * i / 64)) as rb, -sum(b * sin(2 * pi() * k * i / 64)) as ib,
              sum(c * cos(2 * pi() * k * i / 64)) as rc, -sum(c * sin(2 * pi() * k * i / 64)) as ic
       from t, unnest(range(33)) v(k) group by 1, 2),
m as (select *, sqrt(ra * ra + ia * ia) as ga, sqrt(rb * rb + ib * ib) as gb, sqrt(rc * rc + ic * ic) as gc from sp),
mm as (select *, (ga + gb + gc) / 3 as g from m),
k0 as (select vec_id, arg_max(k, g) as k0 from mm where k * 20 between 20 and 500 group by 1),
f0 as (select mm.*, k0, (ga + gb + gc) / 3 as am from mm join k0 using (vec_id) where k = k0)"""
EPS_SQL = "2.220446049250313e-16::double"


def samples(t: Tables) -> DataFrame:
    """Each vector as a window of 64 three-phase samples."""
    e = F.col("embedding")
    rows = F.transform(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda i: F.struct(
        i.alias("i"), F.get(e, i).cast("double").alias("ia"), F.get(e, (i + 21) % SIZE).cast("double").alias("ib"),
        F.get(e, (i + 42) % SIZE).cast("double").alias("ic")))
    return t("embeddings").select("vec_id", F.inline(rows))


@query("k3_clarke", f"""
with {SAMPLES_SQL}, c as (select vec_id, i, 2.0::double / 3 * (a - 0.5 * b - 0.5 * c) as alpha, (b - c) / sqrt(3.0::double) as beta, (a + b + c) / 3 as zero from s)
select vec_id, i, {r('alpha')} as alpha, {r('beta')} as beta, {r('zero')} as zero, {r('(-alpha + sqrt(3.0::double) * beta) / 2')} as pseudo_b,
       {r('(-alpha - sqrt(3.0::double) * beta) / 2')} as pseudo_c from c""")
def k3(t: Tables) -> DataFrame:
    a, b, z = spectral.clarke("ia", "ib", "ic")
    c = samples(t).select("vec_id", "i", a.alias("alpha"), b.alias("beta"), z.alias("zero"))
    p = signal.phase_columns("alpha", "beta")
    return rounded(c.withColumn("pseudo_b", p["ib"]).withColumn("pseudo_c", p["ic"]))


TIME_SQL = SAMPLES_SQL + """,
q as (select vec_id, sqrt(avg(a * a)) as rms_a, sqrt(avg(b * b)) as rms_b, sqrt(avg(c * c)) as rms_c, max(abs(a)) as pa, max(abs(b)) as pb, max(abs(c)) as pc,
             kurtosis_pop(a) + 3 as kurtosis_a, kurtosis_pop(b) + 3 as kurtosis_b, kurtosis_pop(c) + 3 as kurtosis_c,
             avg(sqrt(pow(2.0::double / 3 * (a - 0.5 * b - 0.5 * c), 2) + pow((b - c) / sqrt(3.0::double), 2))) as radius,
             stddev_pop(sqrt(pow(2.0::double / 3 * (a - 0.5 * b - 0.5 * c), 2) + pow((b - c) / sqrt(3.0::double), 2))) as radius_sd,
             sqrt(avg(pow((a + b + c) / 3, 2))) as zero from s group by 1),
tf as (select *, (rms_a + rms_b + rms_c) / 3 as level, sqrt(((rms_a - (rms_a + rms_b + rms_c) / 3) ** 2 + (rms_b - (rms_a + rms_b + rms_c) / 3) ** 2
              + (rms_c - (rms_a + rms_b + rms_c) / 3) ** 2) / 3) as spread from q)"""
TIME_COLUMNS = f"""{r('radius')} as clarke_radius_mean, {r('radius_sd / radius')} as clarke_radius_cv, {r('zero')} as zero_sequence_rms,
 {r('zero / level')} as zero_sequence_ratio, {r('spread / level')} as phase_rms_cv, """ + ", ".join(
    f"{r(f'rms_{p}')} as rms_{p}, {r(f'rms_{p} / level')} as rms_ratio_{p}, {r(f'p{p} / rms_{p}')} as crest_{p}, {r(f'kurtosis_{p}')} as kurtosis_{p}"
    for p in "abc")


@query("k4_time_features", f"with {TIME_SQL} select vec_id, {TIME_COLUMNS} from tf")
def k4(t: Tables) -> DataFrame:
    f = signal.time_features(samples(t), ["vec_id"], index="i", size=SIZE)
    return rounded(f.drop("wave_a", "wave_b", "wave_c"))


def spectra(t: Tables) -> DataFrame:
    return signal.with_spectrum(signal.time_features(samples(t), ["vec_id"], index="i", size=SIZE))


@query("k5_spectrum", f"with {SPECTRUM_SQL} select vec_id, k, {r('ra')} as re_a, {r('ia')} as im_a, {r('rb')} as re_b, {r('ib')} as im_b, {r('rc')} as re_c, {r('ic')} as im_c from sp")
def k5(t: Tables) -> DataFrame:
    names = [f"{part}_{p}" for p in "abc" for part in ("re", "im")]
    rows = F.posexplode(F.arrays_zip(*[F.col("spec")[n].alias(n) for n in names])).alias("k", "z")
    return rounded(spectra(t).select("vec_id", rows).select("vec_id", "k", *[F.col("z")[n].alias(n) for n in names]))


def spectral_table(t: Tables) -> DataFrame:
    return signal.spectral_features(spectra(t), rate=RATE, size=SIZE)


@query("k6_fundamental", f"with {SPECTRUM_SQL} select vec_id, {r('k0 * 20')} as fundamental_hz, {r('am')} as fundamental_amplitude_mean from f0")
def k6(t: Tables) -> DataFrame:
    return rounded(spectral_table(t).select("vec_id", "fundamental_hz", "fundamental_amplitude_mean"))


def _ratio_sql(target: str) -> str:
    """Rows at the bin nearest to a frequency given in bins, the lower bin on ties."""
    return f"least(greatest(ceil({target} - 0.5::double), 0), 32)"


HARMONIC_SQL = SPECTRUM_SQL + f""",
hh as (select f0.vec_id, h, mm.ga / (f0.ga + {EPS_SQL}) as qa, mm.gb / (f0.gb + {EPS_SQL}) as qb, mm.gc / (f0.gc + {EPS_SQL}) as qc
       from f0, (select unnest([2, 3, 4, 5]) as h), mm where mm.vec_id = f0.vec_id and mm.k = {_ratio_sql('k0 * h')}),
hr as (select vec_id, """ + ", ".join(
    f"max((qa + qb + qc) / 3) filter (where h = {h}) as h{h}_mean, max(greatest(qa, qb, qc)) filter (where h = {h}) as h{h}_max" for h in (2, 3, 4, 5)) + f""",
       (sqrt(sum(qa * qa)) + sqrt(sum(qb * qb)) + sqrt(sum(qc * qc))) / 3 as thd from hh group by 1),
sb as (select f0.vec_id, max(mm.g / (am + {EPS_SQL})) filter (where mm.k = {_ratio_sql('k0 * 0.75::double')}) as lower_ratio,
              max(mm.g / (am + {EPS_SQL})) filter (where mm.k = {_ratio_sql('k0 * 1.25::double')}) as upper_ratio from f0 join mm using (vec_id) group by 1)"""
HARMONIC_COLUMNS = ", ".join(f"{r(f'h{h}_mean')} as harmonic_{h}_ratio_mean, {r(f'h{h}_max')} as harmonic_{h}_ratio_max" for h in (2, 3, 4, 5)) + f""",
  {r('thd')} as thd_2_to_5_mean, {r('lower_ratio')} as sideband_lower_ratio, {r('upper_ratio')} as sideband_upper_ratio"""
HARMONIC_NAMES = [f"harmonic_{h}_ratio_{s}" for h in (2, 3, 4, 5) for s in ("mean", "max")] + [
    "thd_2_to_5_mean", "sideband_lower_ratio", "sideband_upper_ratio"]


@query("k7_harmonics", f"with {HARMONIC_SQL} select vec_id, {HARMONIC_COLUMNS} from hr join sb using (vec_id)")
def k7(t: Tables) -> DataFrame:
    return rounded(spectral_table(t).select("vec_id", *HARMONIC_NAMES))


ENTROPY_SQL = """
ep as (select vec_id, (ga * ga + gb * gb + gc * gc) / 3 as p from mm where k between 1 and 32),
et as (select vec_id, sum(p) + 2.220446049250313e-16::double as tot, count(*) as n from ep group by 1),
en as (select vec_id, -sum(p / tot * ln(p / tot + 2.220446049250313e-16::double)) / ln(any_value(n)) as entropy from ep join et using (vec_id) group by 1)"""


@query("k8_spectral_entropy", f"with {SPECTRUM_SQL}, {ENTROPY_SQL} select vec_id, {r('entropy')} as spectral_entropy from en")
def k8(t: Tables) -> DataFrame:
    return rounded(spectral_table(t).select("vec_id", "spectral_entropy"))


UNBALANCE_SQL = f"""
un as (select vec_id, sqrt((ra - (rb + rc) / 2 - {math.sqrt(3) / 2} * (ib - ic)) ** 2 + (ia - (ib + ic) / 2 + {math.sqrt(3) / 2} * (rb - rc)) ** 2) as s1,
              sqrt((ra - (rb + rc) / 2 + {math.sqrt(3) / 2} * (ib - ic)) ** 2 + (ia - (ib + ic) / 2 - {math.sqrt(3) / 2} * (rb - rc)) ** 2) as s2 from f0)"""


@query("k9_sequence_unbalance", f"with {SPECTRUM_SQL}, {UNBALANCE_SQL} select vec_id, {r('least(s1, s2) / greatest(s1, s2)')} as sequence_unbalance from un")
def k9(t: Tables) -> DataFrame:
    return rounded(spectral_table(t).select("vec_id", "sequence_unbalance"))


AMP_CV = r("sqrt(((f0.ga - am) ** 2 + (f0.gb - am) ** 2 + (f0.gc - am) ** 2) / 3) / am")


@query("k12_feature_rows", f"""
with {HARMONIC_SQL}, {ENTROPY_SQL}, {UNBALANCE_SQL}, {TIME_SQL[TIME_SQL.index('q as'):]}
select f0.vec_id, {r('k0 * 20')} as fundamental_hz, {r('am')} as fundamental_amplitude_mean, {AMP_CV} as fundamental_amplitude_cv,
       {r('least(s1, s2) / greatest(s1, s2)')} as sequence_unbalance, {r('entropy')} as spectral_entropy, {HARMONIC_COLUMNS}, {TIME_COLUMNS}
from f0 join hr using (vec_id) join sb using (vec_id) join en using (vec_id) join un using (vec_id) join tf using (vec_id)""")
def k12(t: Tables) -> DataFrame:
    return rounded(signal.window_features(samples(t), ["vec_id"], index="i", size=SIZE, rate=RATE))


@query("k10_decimation", f"""
with {WINDOWS_SQL}, e as (select record_id, count(*) as n, min_by(x, window_id) as f, max_by(x, window_id) as l from w group by 1),
d as (select w.record_id, window_id as i, x - f - (l - f) / (n - 1) * window_id as x, n, f, l from w join e using (record_id)),
tap as (select unnest({spectral.lowpass_taps(2)}::double[]) as h, unnest(range(41)) - 20 as k),
o as (select record_id, (i - k) // 2 as step, sum(h * x) as y, any_value(n) as n, any_value(f) as f, any_value(l) as l from d, tap
      where (i - k) % 2 = 0 and i - k between 0 and n - 1 group by 1, 2)
select record_id, step, {r('y + f + (l - f) * n / (n - 1) * step / ceil(n / 2.0::double)')} as value from o""")
def k10(t: Tables) -> DataFrame:
    w = windows(t).select("record_id", "window_id", "x")
    return rounded(signal.decimate(w, ["record_id"], "window_id", "x", 2))


@query("k11_fourier_codes", f"""
with s as (select vec_id, i, embedding[i + 1]::double as y from embeddings, unnest(range(64)) u(i)),
c as (select vec_id, k, sum(y * cos(2 * pi() * k * i / 64)) as re, -sum(y * sin(2 * pi() * k * i / 64)) as im from s, unnest(range(33)) v(k) group by 1, 2),
en as (select vec_id, sum((re * re + im * im)) filter (where k < 11) / sum(re * re + im * im) as kept from c group by 1),
dec as (select s.vec_id, s.i, sum(case when k = 0 then re else 2 * (re * cos(2 * pi() * k * i / 64) - im * sin(2 * pi() * k * i / 64)) end) / 64 as y from s join c using (vec_id) where k < 11 group by 1, 2)
select vec_id, {r('kept')} as retained_energy, {r('max(re) filter (where k = 3)')} as re_3, {r('max(im) filter (where k = 10)')} as im_10,
       (select {r('max(y)')} from dec where dec.vec_id = c.vec_id) as decoded_peak from c join en using (vec_id) group by vec_id, kept""")
def k11(t: Tables) -> DataFrame:
    e = t("embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("y"))
    e = e.withColumn("code", spectral.fourier_encode("y", F.lit(11))).withColumn("energy", spectral.retained_energy("y", F.lit(11)))
    back = spectral.fourier_decode("code", F.lit(SIZE))
    return e.select("vec_id", r6("energy").alias("retained_energy"), r6(F.col("code")[3]).alias("re_3"), r6(F.col("code")[20]).alias("im_10"),
                    r6(F.array_max(back)).alias("decoded_peak"))


# ---------------------------------------------------------------- curves and bands

PAIRS_SQL = """
c as (select label, vec_id, embedding::double[] as e, row_number() over (partition by label order by vec_id) - 1 as pos from embeddings),
pr as (select a.vec_id, a.label, a.e as y, b.e as p, a.pos // 2 % 2 = 0 as is_cal from c a join c b on a.label = b.label and b.pos = a.pos + 1 where a.pos % 2 = 0),
er as (select *, list_transform(range(1, 65), lambda i: abs(y[i] - p[i])) as e, sqrt(list_sum(list_transform(y, lambda v: v * v))) as scale from pr),
em as (select *, list_max(e) as emax from er)"""


def curve_pairs(t: Tables) -> DataFrame:
    """Consecutive curves of one label: the first is the truth, the second the prediction."""
    c = with_position(t("embeddings"), ["label"], ["vec_id"], "pos", rows=t.rows("embeddings"))
    e = F.transform("embedding", lambda v: v.cast("double"))
    c = c.select("label", F.floor(F.col("pos") / 2).alias("pair"), F.col("pos") % 2 == 0, "vec_id", e.alias("e"))
    c = c.toDF("label", "pair", "first", "vec_id", "e")
    g = c.groupBy("label", "pair").agg(F.max(F.when(F.col("first"), F.struct("vec_id", "e"))).alias("a"),
                                       F.max(F.when(~F.col("first"), F.struct("vec_id", "e"))).alias("b"))
    return g.filter("a is not null and b is not null").select(
        "a.vec_id", "label", F.col("a.e").alias("y"), F.col("b.e").alias("p"), (F.col("pair") % 2 == 0).alias("is_cal"))


def curve_errors(t: Tables) -> DataFrame:
    y = F.col("y")
    return curve_pairs(t).withColumn("e", curves.absolute_errors("y", "p")).withColumn("emax", F.array_max("e")).withColumn(
        "scale", F.sqrt(curves.array_sum(F.transform(y, lambda v: v * v))))


@query("e29_curve_metrics", f"""
with {PAIRS_SQL}, q as (select label, e, emax, list_sum(e) as sa, list_sum(list_transform(e, lambda v: v * v)) as sq, list_sum(list_transform(range(1, 65), lambda i: e[i] / abs(y[i]))) as sr,
   abs(list_avg(y) - list_avg(p)) as lv, abs((list_max(y) - list_min(y)) - (list_max(p) - list_min(p))) as rp from em)
select label, count(*) as designs, {r('sum(sa) / (64 * count(*))')} as mae, {r('sqrt(sum(sq) / (64 * count(*)))')} as rmse, round(sum(sr) / (64 * count(*)) * 100, 3) + 0.0 as mape_percent,
       {r('avg(emax)')} as mean_max_error, {r('avg(lv)')} as level_mae, {r('avg(rp)')} as ripple_mae from q group by 1""")
def e29(t: Tables) -> DataFrame:
    m = curves.curve_metrics(curve_pairs(t), ["label"], "y", "p")
    return rounded(m.withColumn("mape_percent", F.round("mape_percent", 3) + 0.0))


@query("e30_curve_max_error", f"with {PAIRS_SQL} select vec_id, label, {r('emax')} as max_error from em")
def e30(t: Tables) -> DataFrame:
    return rounded(curve_pairs(t).select("vec_id", "label", curves.curve_max_error("y", "p").alias("max_error")))


_bl, _bh = bounds("covered", "designs")
BANDS_SQL = PAIRS_SQL + """,
qc as (select list_sort(list(emax)) as s, list_sort(list(emax / scale)) as q, list_sort(list(scale)) as g, count(*) as n, least(ceil((count(*) + 1) * (1 - 0.1::double)), count(*))::int as k from em where is_cal),
te as (select em.*, s[k] as global_width, q[k] * scale as scaled_width, (1 + len(list_filter(g, lambda v: v >= scale)))::double / (n + 1) as support_p from em, qc where not is_cal),
bd as (select 'global' as band, *, global_width as width from te union all select 'scaled', *, scaled_width from te),
cv as (select band, count(*) as designs, sum((emax <= width)::int)::bigint as covered, avg((emax <= width)::int) as coverage,
              sum(len(list_filter(e, lambda v: v <= width)))::double / sum(len(e)) as pointwise, avg(width) as mean_width, count(*) filter (where support_p <= 0.1::double) as rejected,
              avg((emax <= width)::int) filter (where support_p > 0.1::double) as accepted_coverage, quantile_cont(width, 0.9) as p90_width from bd group by 1)"""


def banded(t: Tables) -> DataFrame:
    """Test curves with the global and the locally scaled band and a support p-value."""
    rows = t.rows("embeddings")
    e = curve_errors(t).withColumn("ratio", F.col("emax") / F.col("scale"))
    cal = e.filter("is_cal")
    g, s = (F.lit(conformal.threshold(cal, [], c, 0.1, overflow="clamp", rows=rows).first()["threshold"]) for c in ("emax", "ratio"))
    p = conformal.p_values(e, [], "scale", F.col("is_cal"), name="support_p", rows=rows).filter("not is_cal")
    both = F.inline(F.array(F.struct(F.lit("global").alias("band"), g.alias("width")),
                            F.struct(F.lit("scaled").alias("band"), (s * F.col("scale")).alias("width"))))
    return p.select("vec_id", "e", "emax", "scale", "support_p", both)


@query("e31_band_coverage", f"""
with {BANDS_SQL} select band, designs, covered, {r('coverage')} as coverage, {r('pointwise')} as pointwise, {r('mean_width')} as mean_width, rejected,
    {r('accepted_coverage')} as accepted_coverage, {r('p90_width')} as p90_width, {r(_bl)} as wilson_low, {r(_bh)} as wilson_high from cv""")
def e31(t: Tables) -> DataFrame:
    return rounded(curves.band_coverage(banded(t), ["band"], errors="e", half_width="width", support_p="support_p", support_alpha=0.1,
                                        rows=t.rows("embeddings", 2)))


@query("l22_scaled_bands", f"with {BANDS_SQL} select vec_id, {r('scaled_width')} as half_width, emax <= scaled_width as covered, {r('support_p')} as support_p from te")
def l22(t: Tables) -> DataFrame:
    return rounded(banded(t).filter("band = 'scaled'").select("vec_id", F.col("width").alias("half_width"),
                                                              (F.col("emax") <= F.col("width")).alias("covered"), "support_p"))


TRAJ_SQL = """
n as (select l_suppkey, l_linestatus as horizon, 'quantity' as node, l_linenumber * 7.0::double - l_quantity as e from lineitem
      union all select l_suppkey, l_linestatus, 'discount', 0.01::double * l_linenumber - l_discount from lineitem
      union all select l_suppkey, l_linestatus, 'tax', 0.04::double - l_tax from lineitem),
er as (select l_suppkey, horizon, node, avg(abs(e)) as mae, l_suppkey % 2 = 0 as is_cal from n group by 1, 2, 3),
ca as (select horizon, node, list_sort(list(mae)) as s, count(*) as n, ceil((count(*) + 1) * 0.9::double)::bigint as rank from er where is_cal group by 1, 2),
bw as (select horizon, node, n, rank, s[rank] as half_width from ca),
ap as (select er.*, half_width, mae <= half_width as ok from er join bw using (horizon, node) where not is_cal)"""


def trajectory_bands(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = predictions(t).withColumnRenamed("l_linestatus", "horizon")
    er = report.error_rows(p, ["l_suppkey", "horizon"], NODES).filter("node <> 'macro'").withColumn("is_cal", F.col("l_suppkey") % 2 == 0)
    bands = conformal.coverage_quantile(er.filter("is_cal"), ["horizon", "node"], "mae", 0.9, rows=t.rows("supplier", 6))
    applied = er.filter("not is_cal").join(bands.select("horizon", "node", "half_width"), ["horizon", "node"])
    return bands, applied.withColumn("ok", F.col("mae") <= F.col("half_width"))


_tl, _th = bounds("covered", "profiles")


@query("e32_band_calibration", f"with {TRAJ_SQL} select horizon, node, n, rank, {r('half_width')} as half_width from bw")
def e32(t: Tables) -> DataFrame:
    return rounded(trajectory_bands(t)[0].select("horizon", "node", "n", "rank", "half_width"))


@query("e32_band_application", f"""
with {TRAJ_SQL}, c as (select horizon, node, count(*) filter (where ok) as covered, count(*) as profiles, any_value(half_width) as half_width from ap group by 1, 2)
select horizon, node, covered, profiles, {r('covered::double / profiles')} as coverage, {r('half_width')} as half_width, {r(_tl)} as wilson_low, {r(_th)} as wilson_high from c""")
def e32b(t: Tables) -> DataFrame:
    c = trajectory_bands(t)[1].groupBy("horizon", "node").agg(F.count_if("ok").alias("covered"), F.count(F.lit(1)).alias("profiles"),
                                                              F.max("half_width").alias("half_width"))
    return rounded(report.with_wilson(c.withColumn("coverage", F.col("covered") / F.col("profiles")), "covered", "profiles"))


@query("e32_joint_coverage", f"""
with {TRAJ_SQL}, j as (select horizon, l_suppkey, bool_and(ok) as all_ok, count(*) as nodes from ap group by 1, 2)
select horizon, count(*) as profiles, count(*) filter (where all_ok) as covered, {r('avg(all_ok::int)')} as coverage from j where nodes = 3 group by 1""")
def e32c(t: Tables) -> DataFrame:
    j = trajectory_bands(t)[1].groupBy("horizon", "l_suppkey").agg(F.bool_and("ok").alias("all_ok"), F.count(F.lit(1)).alias("nodes")).filter("nodes = 3")
    return rounded(j.groupBy("horizon").agg(F.count(F.lit(1)).alias("profiles"), F.count_if("all_ok").alias("covered"),
                                            F.avg(F.col("all_ok").cast("int")).alias("coverage")))


@query("l23_weighted_conformal", f"""
with c as (select l_suppkey % 7 as g, l_orderkey, l_extendedprice as s, sqrt(l_quantity) + l_discount as w, l_linenumber from lineitem),
cal as (select g, s, sum(w) as w from c where l_linenumber <= 4 group by 1, 2),
cum as (select g, s, sum(w) over (partition by g order by s) as cum, sum(w) over (partition by g) as tot from cal),
te as (select g, l_orderkey, l_linenumber, s, case when l_orderkey % 100 = 0 then 1e9::double else w end as tw, row_number() over (partition by g, l_orderkey, l_linenumber order by s, w) as rn from c where l_linenumber > 4),
nd as (select te.g, l_orderkey, l_linenumber, rn, s as err, 0.9::double * (tot + tw) as need from te join (select g, any_value(tot) as tot from cum group by 1) using (g)),
re as (select nd.*, cum.s as width from nd asof left join cum on nd.g = cum.g and nd.need <= cum.cum)
select g, count(*) as designs, count(width) as finite_bands, count(*) filter (where width is null or err <= width) as covered,
       {r('count(*) filter (where width is null or err <= width)::double / count(*)')} as coverage_with_vacuous,
       {r('avg((err <= width)::int)')} as finite_coverage, {r('avg(width)')} as mean_finite_width, {r('1 - count(width)::double / count(*)')} as vacuous_rate from re group by 1""")
def l23(t: Tables) -> DataFrame:
    rows = t.rows("lineitem", 2)
    c = t("lineitem").select((F.col("l_suppkey") % 7).alias("g"), "l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_quantity",
                             F.col("l_extendedprice").alias("s"), (F.sqrt("l_quantity") + F.col("l_discount")).alias("w"))
    cal = c.filter("l_linenumber <= 4")
    te = c.filter("l_linenumber > 4").withColumn("tw", F.when(F.col("l_orderkey") % 100 == 0, F.lit(1e9)).otherwise(F.col("w")))
    out = conformal.weighted_quantiles(cal, te, ["g"], score="s", weight="w", test_weight="tw",
                                       id_cols=["l_orderkey", "l_linenumber", "l_partkey", "s", "l_tax", "l_quantity"], alpha=0.1, rows=rows)
    return rounded(curves.vacuous_summary(out, ["g"], error="s", half_width="half_width"))
