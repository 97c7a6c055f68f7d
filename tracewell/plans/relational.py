"""Source, projection, join, window, selection, set and reshape queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import labels
from tracewell.functions.scalars import (all_finite, minimum_calibration, number_token, r6, strict_boolean,
                                         trimmed_number, whole_units)
from tracewell.operators import conformal, contracts, ordered, ranks, roles, segments
from tracewell.operators.report import rounded
from tracewell.plans.registry import Tables, query, r
from tracewell.plans.rollups import FEATURES_SQL, XS, features
from tracewell.plans.views import BLOCKS_SQL, SCORES_SQL, WINDOWS_SQL, block_scores, blocks, scored_windows, windows
from tracewell.sources import inventory
from tracewell.sources.inventory import ledger

# ---------------------------------------------------------------- sources


@query("a2_validated_load", """
select count(*) as rows, count(*) filter (where o_orderkey is null or o_totalprice is null) as nulls,
       count(*) - count(distinct o_orderkey) as repeated_keys, min(o_orderkey) as first_key, max(o_orderkey) as last_key from orders""")
def a2(t: Tables) -> DataFrame:
    o = contracts.require_columns(t("orders"), ["o_orderkey", "o_totalprice"]).select(
        F.col("o_orderkey").cast("long"), "o_totalprice")
    per_key = o.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("_n"), F.count_if(
        F.col("o_orderkey").isNull() | F.col("o_totalprice").isNull()).alias("_null"))
    return per_key.agg(F.sum("_n").alias("rows"), F.sum("_null").alias("nulls"), F.sum(F.col("_n") - 1).alias("repeated_keys"),
                       F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("a3_strict_load", f"""
with {WINDOWS_SQL}, g as (select record_id, count(*) as n, max(window_id) as last, count(*) filter (where not isfinite(x)) as bad,
                                 count(distinct window_id) as positions from w group by 1)
select record_id, n, last, bad, positions = n and last = n - 1 as gapless from g""")
def a3(t: Tables) -> DataFrame:
    """Position index and its checks; positions are unique, so their sum identifies a gapless range."""
    p = F.col("window_id")
    g = windows(t).groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.max(p).alias("last"),
                                            F.count_if(~all_finite(["x"])).alias("bad"), F.sum(p).alias("_s"))
    n = F.col("n")
    return g.withColumn("gapless", (F.col("last") == n - 1) & (F.col("_s") * 2 == n * (n - 1))).drop("_s")


@query("a7_window_iteration", f"""
with {WINDOWS_SQL}, n as (select record_id, count(*) as n from w group by 1),
s as (select w.record_id, w.window_id as i, x, n from w join n using (record_id)),
a as (select record_id, i // 20 as block_id, i // 20 * 4 + i % 20 // 5 as wid, x from s where i // 20 < n // 20)
select record_id, block_id, wid as window_id, count(*) as samples, {r('sqrt(avg(x * x))')} as rms from a group by 1, 2, 3""")
def a7(t: Tables) -> DataFrame:
    return rounded(_strided(t, window=5, stride=5, block=20))


def _strided(t: Tables, **shape: int) -> DataFrame:
    w = windows(t).select("record_id", F.col("window_id").alias("i"), "x")
    n = t("events").groupBy(F.col("user_id").alias("record_id")).agg(F.count(F.lit(1)).alias("n"))
    a = segments.assign_windows(w.join(n, "record_id"), "i", total="n", **shape)
    return a.groupBy("record_id", "block_id", "window_id").agg(
        F.count(F.lit(1)).alias("samples"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))


MACHINE_TEXT = """p_size * 50 || 'W_' || p_partkey % 7 || '_' || p_partkey % 100 || '_' ||
  case when p_partkey % 2 = 0 then 'current' else 'Vibration' end || '_' ||
  case p_partkey % 4 when 0 then 'interturn' when 1 then 'intercoil' when 2 then 'coil' else 'shaft' end || '.tdms'"""


def machine_names(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "interturn").when(k % 4 == 1, "intercoil").when(k % 4 == 2, "coil").otherwise("shaft")
    return t("part").select("p_partkey", F.concat(
        (F.col("p_size") * 50).cast("string"), F.lit("W_"), (k % 7).cast("string"), F.lit("_"), (k % 100).cast("string"), F.lit("_"),
        F.when(k % 2 == 0, "current").otherwise("Vibration"), F.lit("_"), kind, F.lit(".tdms")).alias("name"))


@query("a8_machine_labels", f"""
with n as (select p_partkey, {MACHINE_TEXT} as name from part),
g as (select *, regexp_extract(name, '(?i)^(\\d+)W_(\\d+)[_.](\\d+)_(current|vibration)_(interturn|intercoil|coil)\\.tdms$', ['w', 'a', 'b', 'm', 'f']) as g from n),
l as (select p_partkey, name, g.w::int as motor_watts, (g.a || '.' || g.b)::double as severity_percent, lower(g.m) as modality,
             case lower(g.f) when 'coil' then 'intercoil' else lower(g.f) end as fault_family from g where g.w <> ''),
s as (select *, rtrim(rtrim(format('{{:.6f}}', motor_watts / 1000.0::double), '0'), '.') || 'kW' as motor_id,
             replace(rtrim(rtrim(format('{{:.6f}}', severity_percent), '0'), '.'), '.', 'p') as token from l)
select p_partkey, name, motor_watts, motor_id, {r('severity_percent')} as severity_percent, modality, fault_family, severity_percent = 0 as is_healthy,
       motor_id || '_' || replace(fault_family, 'inter', '') || '_' || modality || '_' || token || 'pct' as record_id from s""")
def a8(t: Tables) -> DataFrame:
    good, _ = labels.parsed(machine_names(t), "name", labels.machine_labels)
    return rounded(good)


@query("a8_rejected_names", f"""
with n as (select p_partkey, {MACHINE_TEXT} as name from part)
select p_partkey, name from n where not regexp_matches(name, '(?i)^(\\d+)W_(\\d+)[_.](\\d+)_(current|vibration)_(interturn|intercoil|coil)\\.tdms$')""")
def a8b(t: Tables) -> DataFrame:
    _, bad = labels.parsed(machine_names(t), "name", labels.machine_labels)
    return bad


BENCH_TEXT = """case when c_custkey % 3 = 0 then 'HEALTHY_S' || [1200, 1500, 1800][c_custkey % 3 + 1] || '_T' || [52, 64, 80][c_custkey % 2 + 1]
  else 'FAULT_' || case when c_custkey % 2 = 0 then 'TURNS' else 'WINDINGS' end || '_D' || lpad((c_custkey % 26)::varchar, 2, '0') || '_D' ||
       lpad((c_nationkey % 25)::varchar, 2, '0') || '_R' || lpad((c_custkey % 1000)::varchar, 3, '0') || '_S1500_T64' end || '.mat'"""


def bench_names(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    healthy = F.concat(F.lit("HEALTHY_S"), F.array(*[F.lit(v) for v in (1200, 1500, 1800)])[(k % 3).cast("int")].cast("string"),
                       F.lit("_T"), F.array(*[F.lit(v) for v in (52, 64, 80)])[(k % 2).cast("int")].cast("string"))
    fault = F.concat(F.lit("FAULT_"), F.when(k % 2 == 0, "TURNS").otherwise("WINDINGS"),
                     F.lit("_D"), F.lpad((k % 26).cast("string"), 2, "0"), F.lit("_D"),
                     F.lpad((F.col("c_nationkey") % 25).cast("string"), 2, "0"), F.lit("_R"),
                     F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("_S1500_T64"))
    return t("customer").select("c_custkey", F.concat(F.when(k % 3 == 0, healthy).otherwise(fault), F.lit(".mat")).alias("name"))


POSITIONS_SQL = "pos as (select * from (values " + ", ".join(
    f"('{k}', {v}::double)" for k, v in labels.TERMINAL_POSITION.items()) + ") v(terminal, position))"
BENCH_SQL = f"""
n as (select c_custkey, {BENCH_TEXT} as name from customer),
h as (select c_custkey, name, true as is_healthy, substr(name, 10, 4)::int as speed_rpm, substr(name, 16, 2)::int as torque_code,
             null as fault_family, null as terminal_a, null as terminal_b from n
      where regexp_matches(name, '^HEALTHY_S(1200|1500|1800)_T(52|64|80)\\.mat$')),
x as (select *, regexp_extract(name, '^FAULT_(TURNS|WINDINGS)_(D(?:0[1-9]|1[0-9]|2[0-4]))_(D(?:0[1-9]|1[0-9]|2[0-4]))_R(\\d{{3}})_S(1200|1500|1800)_T(52|64|80)\\.mat$',
             ['f', 'a', 'b', 'r', 's', 't']) as g from n),
fa as (select c_custkey, name, false as is_healthy, g.s::int as speed_rpm, g.t::int as torque_code, lower(g.f) as fault_family, g.a as terminal_a, g.b as terminal_b
      from x where g.f <> '' and g.a <> g.b),
bench as (select * from h union all select * from fa)"""


@query("a8_bench_labels", f"with {BENCH_SQL} select * from bench")
def a8c(t: Tables) -> DataFrame:
    good, _ = labels.parsed(bench_names(t), "name", labels.bench_labels)
    return good.drop("resistance_code")


TRANSIENT_TEXT = """case when s_suppkey % 2 = 0 then '200WMotor/' else '20kWmotor/' end ||
  ['load_transient', 'Steady_State', 'velocity_transient', 'idle'][s_suppkey % 4 + 1] || '_' ||
  case when s_suppkey % 3 = 0 then 1200 else 1000 end || '_' || s_suppkey % 7 || case when s_suppkey % 7 = 1 then 'turn' else 'turns' end || '.mat'"""


@query("a8_transient_labels", f"""
with n as (select s_suppkey, {TRANSIENT_TEXT} as path from supplier),
g as (select *, lower(split_part(path, '/', 1)) as folder, regexp_extract(split_part(path, '/', 2), '(?i)^(load_transient|steady_state|velocity_transient)_(1000|1200)_(\\d+)turns?\\.mat$', ['c', 's', 't']) as g from n),
l as (select s_suppkey, path, case folder when '200wmotor' then '200W' else '20kW' end as motor_id, lower(g.c) as condition, g.s::int as setpoint, g.t::int as fault_turns,
             case folder when '200wmotor' then 'a' else 'b' end as fault_phase, g.t::int / case folder when '200wmotor' then 25.0::double else 7.0::double end as sev
      from g where g.c <> '' and case when folder = '200wmotor' then (g.s = '1000' and g.t = '4') or (g.s = '1200' and g.t in ('2', '4', '6'))
                                      else g.s = '1000' and g.t in ('1', '2', '3') end)
select s_suppkey, path, motor_id, condition, setpoint, fault_turns, fault_phase, {r('sev')} as nominal_severity,
       motor_id || '_' || condition || '_' || setpoint || '_' || fault_turns || 'turn' as record_id from l""")
def a8d(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    kinds = F.array(*[F.lit(v) for v in ("load_transient", "Steady_State", "velocity_transient", "idle")])
    path = F.concat(F.when(k % 2 == 0, "200WMotor/").otherwise("20kWmotor/"), kinds[(k % 4).cast("int")], F.lit("_"),
                    F.when(k % 3 == 0, "1200").otherwise("1000"), F.lit("_"), (k % 7).cast("string"),
                    F.when(k % 7 == 1, "turn").otherwise("turns"), F.lit(".mat"))
    good, _ = labels.parsed(t("supplier").select("s_suppkey", path.alias("path")), "path", labels.transient_labels)
    return rounded(good)


DUAL_TEXT = """'spd10-5000rpm_flt' || case when p_partkey % 3 = 0 then '0z' else (p_size % 8) || 'z' || ['u', 'v', 'w'][p_partkey % 3 + 1] end || '_' ||
  case when p_partkey % 5 = 0 then (p_size / 4.0::double)::varchar else p_size::varchar end || 'NM.mat'"""


@query("a8_dual_labels", f"""
with n as (select p_partkey, {DUAL_TEXT} as name from part),
g as (select *, regexp_extract(name, '^spd10-5000rpm_flt(?:(0)z|([1-6])z([uv]))_(\\d+(?:\\.\\d+)?)NM\\.mat$', ['h', 't', 'p', 'l']) as g from n),
l as (select p_partkey, name, g.l::double as load_nm, case when g.h = '0' then 0 else try_cast(g.t as int) end as fault_turns, case when g.h = '0' then null else g.p end as fault_phase, g.h = '0' as is_healthy from g where g.l <> '')
select *, 'external_dual_three_phase_flt' || fault_turns || 'z' || coalesce(fault_phase, '') || '_load_' || replace(rtrim(rtrim(format('{{:.6f}}', load_nm), '0'), '.'), '.', 'p') || 'nm' as record_id from l""")
def a8e(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(k % 3 == 0, "0z").otherwise(F.concat((size % 8).cast("string"), F.lit("z"), F.array(
        F.lit("u"), F.lit("v"), F.lit("w"))[(k % 3).cast("int")]))
    load = F.when(k % 5 == 0, (size / 4.0).cast("string")).otherwise(size.cast("string"))
    named = t("part").select("p_partkey", F.concat(F.lit("spd10-5000rpm_flt"), kind, F.lit("_"), load, F.lit("NM.mat")).alias("name"))
    good, _ = labels.parsed(named, "name", labels.dual_labels)
    return rounded(good)


@query("a10_record_discovery", f"""
with n as (select p_partkey, {DUAL_TEXT} as name from part),
g as (select *, regexp_extract(name, '^spd10-5000rpm_flt(?:(0)z|([1-6])z([uv]))_(\\d+(?:\\.\\d+)?)NM\\.mat$', ['h', 't', 'p', 'l']) as g from n),
l as (select p_partkey, g.l::double as load_nm, case when g.h = '0' then 0 else try_cast(g.t as int) end as fault_turns, case when g.h = '0' then null else g.p end as fault_phase from g where g.l <> '')
select load_nm, fault_turns, fault_phase, min(p_partkey) as p_partkey from l group by 1, 2, 3""")
def a10(t: Tables) -> DataFrame:
    """Records among mixed names, one per condition, in canonical order; names outside the grammar are skipped."""
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(k % 3 == 0, "0z").otherwise(F.concat((size % 8).cast("string"), F.lit("z"), F.array(F.lit("u"), F.lit("v"), F.lit("w"))[(k % 3).cast("int")]))
    load = F.when(k % 5 == 0, (size / 4.0).cast("string")).otherwise(size.cast("string"))
    named = t("part").select("p_partkey", F.concat(F.lit("spd10-5000rpm_flt"), kind, F.lit("_"), load, F.lit("NM.mat")).alias("name"))
    # names repeat in this table, and discovery rejects a repeated condition: the first part of each stands for it
    condition = ["load_nm", "fault_turns", "fault_phase"]
    good, bad = labels.parsed(named, "name", labels.dual_labels)
    first = good.groupBy(*condition).agg(F.min(F.struct("p_partkey", "name")).alias("_f")).select("_f.*")
    found = inventory.discover_records(first.unionByName(bad), "name", labels.dual_labels, condition, condition)
    return found.select("load_nm", "fault_turns", "fault_phase", "p_partkey")


@query("b10_variable_role", """
with n as (select c_custkey, ['Currents_SubSys1_A', 'Currents_SubSys2_D', 'Voltage_SubSys1_Q', 'Time', 'Speed_rpm', 'SinCos_Electrical_1', 'Torque'][c_custkey % 7 + 1] as name from customer)
select name, case when name = 'Currents_SubSys1_A' then 'primary_abc_current' when name like 'Currents%' then 'dq_current_not_scored' when name like 'Voltage%' then 'dq_control_voltage_not_scored'
  when name = 'Time' then 'timebase' when name like 'Speed%' then 'speed_qc_not_scored' when name like 'SinCos%' then 'electrical_position_not_scored' else 'other' end as role, count(*) as n from n group by 1, 2""")
def b10b(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(v) for v in ("Currents_SubSys1_A", "Currents_SubSys2_D", "Voltage_SubSys1_Q", "Time", "Speed_rpm",
                                         "SinCos_Electrical_1", "Torque")])
    n = t("customer").select(names[(F.col("c_custkey") % 7).cast("int")].alias("name"))
    return n.groupBy("name", labels.variable_role("name").alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("a9_content_inventory", """
select doc_id, strlen(text) as bytes, md5(text) as md5, sha256(text) as sha256 from documents""")
def a9(t: Tables) -> DataFrame:
    body = F.col("text").cast("binary")
    return t("documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.md5(body).alias("md5"),
                                 F.sha2(body, 256).alias("sha256"))


@query("a15_compatibility_ledger", """
with l as (select s_suppkey, case when s_acctbal < 0 then 'negative balance' when s_nationkey % 5 = 0 then 'unsupported nation' end as reason from supplier)
select s_suppkey, reason, case when reason is null then 'accepted' else 'rejected' end as status from l""")
def a15(t: Tables) -> DataFrame:
    s = t("supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    return ledger(s, [("negative balance", F.col("s_acctbal") < 0), ("unsupported nation", F.col("s_nationkey") % 5 == 0)]).select(
        "s_suppkey", "reason", "status")


# ---------------------------------------------------------------- projections


@query("b1_physics_proxies", f"""
select l_orderkey, l_linenumber, {r('sqrt(l_discount * l_discount + l_tax * l_tax)')} as current_magnitude,
       {r('l_discount * l_discount + l_tax * l_tax')} as copper_loss, {r('abs(l_discount * l_quantity + l_tax * l_extendedprice)')} as electrical_power,
       {r('abs(l_quantity * l_linenumber)')} as mechanical_power from lineitem""")
def b1(t: Tables) -> DataFrame:
    from tracewell.functions.physics import add_physics_features

    named = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("i_d"), F.col("l_tax").alias("i_q"),
                                 F.col("l_quantity").alias("u_d"), F.col("l_extendedprice").alias("u_q"),
                                 F.col("l_quantity").alias("torque"), F.col("l_linenumber").cast("double").alias("motor_speed"))
    return rounded(add_physics_features(named).select(
        "l_orderkey", "l_linenumber", "current_magnitude", F.col("copper_loss_proxy").alias("copper_loss"),
        F.col("electrical_power_proxy").alias("electrical_power"), F.col("mechanical_power_proxy").alias("mechanical_power")))


@query("b3_harmonize", f"""
select 'line' as dataset, l_orderkey as profile_id, {r('(l_discount + l_tax) / 2')} as temp_winding, {r('l_quantity')} as torque_nm, cast(null as double) as ambient from lineitem
union all select 'order', o_orderkey, {r('o_totalprice')}, cast(null as double), 25.0::double from orders""")
def b3(t: Tables) -> DataFrame:
    line = t("lineitem").select(F.lit("line").alias("dataset"), F.col("l_orderkey").alias("profile_id"),
                                r6((F.col("l_discount") + F.col("l_tax")) / 2).alias("temp_winding"), r6("l_quantity").alias("torque_nm"))
    order = t("orders").select(F.lit("order").alias("dataset"), F.col("o_orderkey").alias("profile_id"),
                               r6("o_totalprice").alias("temp_winding"), F.lit(25.0).alias("ambient"))
    return line.unionByName(order, allowMissingColumns=True)


@query("b4_condition_roles", f"""
with {WINDOWS_SQL}
select case when load = 15 and block_id in (0, 1) then 'adaptation' when load in (0, 10, 20, 30) and block_id <= 7 then 'calibration'
            when load in (5, 25, 35) and block_id <= 7 then 'health_test' else 'unused' end as role, load, count(*) as windows
from w where is_healthy group by 1, 2""")
def b4(t: Tables) -> DataFrame:
    load, block = F.col("load"), F.col("block_id")
    role = (F.when((load == 15) & block.isin(0, 1), "adaptation").when(load.isin(0, 10, 20, 30) & (block <= 7), "calibration")
            .when(load.isin(5, 25, 35) & (block <= 7), "health_test").otherwise("unused"))
    return windows(t).filter("is_healthy").groupBy(role.alias("role"), "load").agg(F.count(F.lit(1)).alias("windows"))


@query("b5_every_kth", f"with {WINDOWS_SQL} select record_id, event_id, {r('x')} as x from w where window_id % 4 = 0")
def b5(t: Tables) -> DataFrame:
    e = t("events").select(F.col("user_id").alias("record_id"), "event_id", F.col("value").alias("x"),
                           F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"))
    return rounded(ordered.every_kth(e, ["record_id"], ["_us", "event_id"], 4, rows=t.rows("events")).drop("_us"))


@query("b6_time_slice", f"""
select user_id, count(*) as samples, {r('avg(value)')} as mean_value, {r("min(abs(epoch_us(ts) - epoch_us(timestamp '2024-01-08'))) / 1e6::double")} as start_gap_s
from events where ts >= timestamp '2024-01-08' and ts < timestamp '2024-01-15' group by 1""")
def b6(t: Tables) -> DataFrame:
    """The half-open slice reaches the scan as a pushed filter."""
    e = t("events").filter("ts >= timestamp_ntz '2024-01-08' and ts < timestamp_ntz '2024-01-15'")
    start = F.lit(1704672000000000)
    gap = F.min(F.abs(F.unix_micros(F.col("ts").cast("timestamp")) - start)) / 1e6
    return rounded(e.groupBy("user_id").agg(F.count(F.lit(1)).alias("samples"), F.avg("value").alias("mean_value"), gap.alias("start_gap_s")))


@query("b7_strict_boolean", """
with s as (select doc_id, case when quality = 1 then ' True' when toxic = 1 then 'yes' else 'FALSE ' end as text from labels)
select doc_id, case lower(trim(text)) when 'true' then true when 'false' then false end as flag from s""")
def b7(t: Tables) -> DataFrame:
    text = F.when(F.col("quality") == 1, " True").when(F.col("toxic") == 1, "yes").otherwise("FALSE ")
    return t("labels").select("doc_id", strict_boolean(text).alias("flag"))


@query("b8_terminal_span", f"""
with {BENCH_SQL}, {POSITIONS_SQL}
select c_custkey, {r('abs(a.position - b.position)')} as span_percent from bench join pos a on a.terminal = terminal_a join pos b on b.terminal = terminal_b""")
def b8(t: Tables) -> DataFrame:
    good, _ = labels.parsed(bench_names(t), "name", labels.bench_labels)
    fault = good.filter("not is_healthy")
    return fault.select("c_custkey", r6(labels.terminal_span("terminal_a", "terminal_b")).alias("span_percent"))


@query("b9_identifiers", """
with p as (select p_partkey, p_brand, rtrim(rtrim(format('{:.6f}', p_size / 4.0::double), '0'), '.') as n from part)
select p_partkey, replace(p_brand, '#', '_') || '_load_' || replace(n, '.', 'p') || 'nm' as record_id, n as trimmed from p""")
def b9(t: Tables) -> DataFrame:
    load = F.col("p_size") / 4.0
    return t("part").select("p_partkey", F.concat(F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("_load_"), number_token(load), F.lit("nm"))
                            .alias("record_id"), trimmed_number(load).alias("trimmed"))


@query("b10_feature_family", """
with n as (select p_partkey, ['fundamental_hz', 'spectral_entropy', 'harmonic_3_ratio_max', 'thd_2_to_5_mean', 'zero_sequence_ratio', 'crest_a', 'clarke_radius_cv', 'unknown'][p_partkey % 8 + 1] as feature from part)
select feature, case when feature = 'fundamental_hz' then 'speed_proxy' when feature = 'spectral_entropy' then 'spectral_entropy'
    when feature like 'harmonic\\_%' escape '\\' or feature = 'thd_2_to_5_mean' then 'harmonic_sideband' when feature = 'zero_sequence_ratio' then 'sequence_imbalance'
    when feature like 'crest\\_%' escape '\\' or feature = 'clarke_radius_cv' then 'current_shape' end as family, count(*) as parts from n group by 1, 2""")
def b10(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(v) for v in ("fundamental_hz", "spectral_entropy", "harmonic_3_ratio_max", "thd_2_to_5_mean",
                                         "zero_sequence_ratio", "crest_a", "clarke_radius_cv", "unknown")])
    n = t("part").select(names[(F.col("p_partkey") % 8).cast("int")].alias("feature"))
    return n.groupBy("feature", labels.feature_family("feature").alias("family")).agg(F.count(F.lit(1)).alias("parts"))


@query("b11_finite_rows", """
with d as (select doc_id, case when n_chars % 5 = 0 then 'NaN'::double when n_chars % 7 = 0 then 'Infinity'::double when n_chars % 11 = 0 then null else n_chars::double end as v from documents)
select doc_id, v is not null and isfinite(v) as finite from d""")
def b11(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    v = F.when(n % 5 == 0, float("nan")).when(n % 7 == 0, float("inf")).when(n % 11 != 0, n.cast("double"))
    return t("documents").select("doc_id", v.alias("v")).select("doc_id", all_finite(["v"]).alias("finite"))


BOUNDS_SQL = """
b as (select min(p_retailprice) as lo1, max(p_retailprice) as hi1, min(p_size) as lo2, max(p_size) as hi2 from part where p_type = 'ECONOMY')"""


@query("b12_reference_normalization", f"""
with {BOUNDS_SQL} select p_partkey, {r('(p_retailprice - lo1) / (hi1 - lo1)')} as price, {r('(p_size - lo2)::double / (hi2 - lo2)')} as size from part, b""")
def b12(t: Tables) -> DataFrame:
    from tracewell.operators.scaling import range_bounds, range_normalize

    p = t("part")
    lo_hi = range_bounds(p.filter("p_type = 'ECONOMY'"), ["p_retailprice", "p_size"])
    n = range_normalize(p, lo_hi, ["p_retailprice", "p_size"])
    return rounded(n.select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").alias("size")))


@query("b13_out_of_range", f"""
with {BOUNDS_SQL} select p_partkey, p_retailprice < lo1 or p_retailprice > hi1 or p_size < lo2 or p_size > hi2 as outside from part, b""")
def b13(t: Tables) -> DataFrame:
    from tracewell.operators.scaling import outside_range, range_bounds

    p = t("part")
    lo_hi = range_bounds(p.filter("p_type = 'ECONOMY'"), ["p_retailprice", "p_size"])
    return p.select("p_partkey", outside_range(lo_hi, ["p_retailprice", "p_size"]).alias("outside"))


@query("b15_severity_and_censoring", f"""
with {BLOCKS_SQL}, f as (select record_id, any_value(load) as load, min(block_id) filter (where alarm) as fb from blk group by 1)
select record_id, {r('load / 25.0::double')} as severity, fb is null as censored, {r('[0.2, 0.4, 0.6, 0.8][fb + 1]::double')} as delay_seconds from f""")
def b15(t: Tables) -> DataFrame:
    f = blocks(t).groupBy("record_id").agg(F.first("load").alias("load"), F.min(F.when(F.col("alarm"), F.col("block_id"))).alias("fb"))
    delays = F.create_map(*[x for i, d in enumerate((0.2, 0.4, 0.6, 0.8)) for x in (F.lit(i).cast("long"), F.lit(d))])
    return f.select("record_id", r6(F.col("load") / 25.0).alias("severity"), F.col("fb").isNull().alias("censored"),
                    r6(F.try_element_at(delays, F.col("fb"))).alias("delay_seconds"))


@query("b17_whole_units", """
select p_partkey, case when p_size % 3 = 0 then (p_size // 3)::bigint end as blocks from part""")
def b17(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", whole_units("p_size", 3.0).alias("blocks"))


# ---------------------------------------------------------------- joins


@query("d1_paired_methods", f"""
with a as (select l_suppkey, avg(l_discount) as a from lineitem where l_returnflag = 'A' group by 1),
b as (select l_suppkey, avg(l_discount) as b from lineitem where l_returnflag = 'R' group by 1)
select l_suppkey, {r('a')} as rate_a, {r('b')} as rate_b, {r('a - b')} as difference from a join b using (l_suppkey)""")
def d1(t: Tables) -> DataFrame:
    """Two methods of one table pair by conditional aggregation: one scan, one shuffle, no join."""
    flag, x = F.col("l_returnflag"), F.col("l_discount")
    p = t("lineitem").groupBy("l_suppkey").agg(F.avg(F.when(flag == "A", x)).alias("rate_a"), F.avg(F.when(flag == "R", x)).alias("rate_b"))
    return rounded(p.filter("rate_a is not null and rate_b is not null").withColumn("difference", F.col("rate_a") - F.col("rate_b")))


@query("d2_left_enrichment", """
select o_orderkey, o_custkey, c_mktsegment, n_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey""")
def d2(t: Tables) -> DataFrame:
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    n = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t("orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").join(n, "c_nationkey", "left").drop("c_nationkey")


@query("d3_full_outer", """
with a as (select l_suppkey as k, count(*) as n from lineitem where l_returnflag = 'A' group by 1),
b as (select l_suppkey as k, count(*) as n from lineitem where l_returnflag = 'R' group by 1)
select coalesce(a.k, b.k) as l_suppkey, case when a.k is null then 'right_only' when b.k is null then 'left_only' else 'both' end as found,
       a.n as n_a, b.n as n_b from a full join b on a.k = b.k""")
def d3(t: Tables) -> DataFrame:
    def side(flag: str, name: str) -> DataFrame:
        return t("lineitem").filter(F.col("l_returnflag") == flag).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias(name))

    j = side("A", "n_a").join(side("R", "n_b"), "l_suppkey", "full")
    found = F.when(F.col("n_a").isNull(), "right_only").when(F.col("n_b").isNull(), "left_only").otherwise("both")
    return j.withColumn("found", found)


@query("d4_semi_anti", """
select c_custkey, c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT') as has_urgent from customer
where c_custkey in (select o_custkey from orders) and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')""")
def d4(t: Tables) -> DataFrame:
    o = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    c = t("customer").select("c_custkey").join(o, "c_custkey", "left_semi").join(o.filter("o_orderstatus = 'P'"), "c_custkey", "left_anti")
    urgent = o.filter("o_orderpriority = '1-URGENT'").select("c_custkey").distinct().withColumn("_u", F.lit(True))
    return c.join(urgent, "c_custkey", "left").select("c_custkey", F.coalesce("_u", F.lit(False)).alias("has_urgent"))


@query("d5_conformal_p_values", f"""
with {BLOCKS_SQL} select record_id, block_id, role, {r('score')} as score, {r('p_value')} as p_value from blk""")
def d5(t: Tables) -> DataFrame:
    return rounded(blocks(t).select("record_id", "block_id", "role", "score", "p_value"))


@query("d6_interval_means", f"""
with {WINDOWS_SQL}, n as (select record_id, count(*) as n from w group by 1),
i as (select record_id, s as id, s * 3 as start, s * 3 + 7 + record_id % 5 as stop from n, unnest(range((n // 4)::bigint)) u(s))
select i.record_id, id, count(*) as samples, {r('avg(x)')} as mean from i join w on w.record_id = i.record_id and window_id >= start and window_id < stop group by 1, 2""")
def d6(t: Tables) -> DataFrame:
    w = windows(t).select("record_id", "window_id", "x")
    n = t("events").groupBy(F.col("user_id").alias("record_id")).agg(F.floor(F.count(F.lit(1)) / 4).alias("m"))
    i = ordered.explode_range(n, F.col("m"), "id").drop("m")
    i = i.withColumn("start", F.col("id") * 3).withColumn("stop", F.col("id") * 3 + 7 + F.col("record_id") % 5)
    return rounded(segments.interval_means(w, i, ["record_id"], index="window_id", value="x", width=4, id_cols=["id"]))


@query("d7_asof", f"""
with p as (select user_id, ts, max(value) as value from events where event_type = 'purchase' group by 1, 2),
q as (select event_id, user_id, ts from events where event_type = 'click')
select q.event_id, q.user_id, {r('p.value')} as last_purchase from q asof left join p on q.user_id = p.user_id and q.ts >= p.ts""")
def d7(t: Tables) -> DataFrame:
    e = t("events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    out = ordered.asof(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), ["user_id"], at="at", value="value",
                       name="last_purchase", id_cols=["event_id"], rows=t.rows("events"))
    return rounded(out.drop("at"))


@query("d10_run_grid", """
with m as (select unnest(['a', 'b', 'c']) as method), s as (select unnest([711, 712]) as seed)
select o_orderstatus as fold, method, seed, count(*) as rows from orders, m, s group by all""")
def d10(t: Tables) -> DataFrame:
    """Settings cross a reduced table: the fan-out is the grid, never the data."""
    cells = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(s).alias("seed")) for m in "abc" for s in (711, 712)])
    folds = t("orders").groupBy(F.col("o_orderstatus").alias("fold")).agg(F.count(F.lit(1)).alias("rows"))
    return folds.select("fold", "rows", F.inline(cells))


@query("d11_delta_columns", f"""
with a as (select l_suppkey, avg(l_quantity) as q, avg(l_tax) as x from lineitem group by 1), b as (select l_suppkey, avg(l_quantity) as q, avg(l_tax) as x from lineitem where l_linestatus = 'O' group by 1)
select l_suppkey, {r('a.q')} as quantity_native, {r('b.q')} as quantity_reduced, {r('b.q - a.q')} as quantity_delta, {r('a.x')} as tax_native,
       {r('b.x')} as tax_reduced, {r('b.x - a.x')} as tax_delta from a join b using (l_suppkey)""")
def d11(t: Tables) -> DataFrame:
    li = t("lineitem")

    def means(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("l_suppkey").agg(F.avg("l_quantity").alias(f"quantity_{tag}"), F.avg("l_tax").alias(f"tax_{tag}"))

    j = means(li, "native").join(means(li.filter("l_linestatus = 'O'"), "reduced"), "l_suppkey")
    return rounded(j.withColumns({f"{c}_delta": F.col(f"{c}_reduced") - F.col(f"{c}_native") for c in ("quantity", "tax")}))


MATCH_SQL = BLOCKS_SQL + """,
hb as (select load, block_id, avg(score) as h from blk where is_healthy group by 1, 2)"""


@query("d12_matched_pairs", f"""
with {MATCH_SQL}
select record_id, blk.load, blk.block_id, {r('score')} as score, {r('h')} as matched_health, {r('score - h')} as difference
from blk join hb using (load, block_id) where not is_healthy""")
def d12(t: Tables) -> DataFrame:
    b = block_scores(t)
    healthy = b.filter("is_healthy").groupBy("load", "block_id").agg(F.avg("score").alias("matched_health"))
    j = b.filter("not is_healthy").select("record_id", "load", "block_id", "score").join(healthy, ["load", "block_id"])
    return rounded(j.withColumn("difference", F.col("score") - F.col("matched_health")))


@query("d13_row_overlap", """
with h as (select l_returnflag as d, md5(concat_ws('|', l_partkey, l_suppkey, l_linenumber)) as h from lineitem group by all)
select a.d as left_set, b.d as right_set, count(*) as shared from h a join h b on a.h = b.h and a.d < b.d group by 1, 2""")
def d13(t: Tables) -> DataFrame:
    """Row hashes grouped once: each hash carries the short list of sets it occurs in."""
    h = t("lineitem").select(F.col("l_returnflag").alias("d"), F.md5(F.concat_ws("|", "l_partkey", "l_suppkey", "l_linenumber")).alias("h"))
    sets = h.groupBy("h").agg(F.array_sort(F.collect_set("d")).alias("s")).filter(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("left_set"), b.alias("right_set")))))
    return sets.select(F.inline(pairs)).groupBy("left_set", "right_set").agg(F.count(F.lit(1)).alias("shared"))


@query("d14_segment_merge", f"""
with {SCORES_SQL}
select record_id, any_value(load) as load, {r('avg(z) filter (where window_id < 5)')} as pre_mean, {r('max(z) filter (where window_id between 5 and 24)')} as active_max,
       {r('avg(z) filter (where window_id > 24)')} as recovery_mean, count(*) filter (where window_id between 5 and 24 and z > 2) as active_alarms from sw group by 1""")
def d14(t: Tables) -> DataFrame:
    i, z = F.col("window_id"), F.col("z")
    active = i.between(5, 24)
    return rounded(scored_windows(t).groupBy("record_id").agg(
        F.first("load").alias("load"), F.avg(F.when(i < 5, z)).alias("pre_mean"), F.max(F.when(active, z)).alias("active_max"),
        F.avg(F.when(i > 24, z)).alias("recovery_mean"), F.count_if(active & (z > 2)).alias("active_alarms")))


# ---------------------------------------------------------------- ordered operators


@query("f1_prefix", f"with {WINDOWS_SQL} select record_id, window_id, event_id, {r('x')} as x from w where window_id < 12")
def f1(t: Tables) -> DataFrame:
    return rounded(windows(t).filter("window_id < 12").select("record_id", "window_id", "event_id", "x"))


@query("f2_lag_lead", f"""
with {WINDOWS_SQL} select record_id, window_id, {r('x - lag(x) over (partition by record_id order by window_id)')} as step,
     {r('lead(x) over (partition by record_id order by window_id)')} as next_x from w""")
def f2(t: Tables) -> DataFrame:
    w = windows(t).select("record_id", "window_id", "x").withColumn("_back", -F.col("window_id"))
    w = ordered.running(w, ["record_id"], ["window_id"], lags={"_before": "x"}, rows=t.rows("events"))
    w = ordered.running(w, ["record_id"], ["_back"], lags={"next_x": "x"}, rows=t.rows("events"))
    return rounded(w.select("record_id", "window_id", (F.col("x") - F.col("_before")).alias("step"), "next_x"))


@query("f3_first_k", f"""
with k as (select l_suppkey, l_quantity, l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_suppkey order by l_quantity, l_orderkey, l_linenumber, l_partkey) as rn from lineitem)
select l_suppkey, l_orderkey, l_linenumber, {r('l_quantity')} as l_quantity from k where rn <= 2""")
def f3(t: Tables) -> DataFrame:
    li = t("lineitem").select("l_suppkey", "l_quantity", "l_orderkey", "l_linenumber", "l_partkey")
    out = ordered.prefix(li, ["l_suppkey"], ["l_quantity", "l_orderkey", "l_linenumber", "l_partkey"], 2, rows=t.rows("lineitem"))
    return rounded(out.drop("l_partkey"))


@query("f4_trailing_rms", f"""
with {WINDOWS_SQL} select record_id, window_id, {r('case when window_id >= 4 then sqrt(avg(x * x) over (partition by record_id order by window_id rows between 4 preceding and current row)) end')} as rms from w""")
def f4(t: Tables) -> DataFrame:
    w = windows(t).select("record_id", "window_id", "x")
    out = ordered.trailing_mean(w, ["record_id"], "window_id", F.col("x") * F.col("x"), 5, "_ms")
    return rounded(out.select("record_id", "window_id", F.sqrt("_ms").alias("rms")))


ONSET_SQL = WINDOWS_SQL + """,
n as (select record_id, count(*) as total from w group by 1),
lv as (select record_id, window_id, sqrt(avg(x * x) over (partition by record_id order by window_id rows between 2 preceding and current row)) as rms from w),
le as (select lv.*, least(floor(0.2::double * total), 12) as stop from lv join n using (record_id) where window_id >= 2),
bm as (select record_id, median(rms) as m from le where window_id < stop group by 1),
bs as (select record_id, any_value(m) as m, 1.4826::double * median(abs(rms - m)) as s from le join bm using (record_id) where window_id < stop group by 1),
pk as (select record_id, max(rms) as peak, max(stop)::bigint as baseline_stop from le group by 1),
th as (select record_id, m, s, peak, baseline_stop, greatest(m + 1.0::double * s, 0.02::double * peak) as threshold from bs join pk using (record_id)),
fl as (select le.record_id, window_id, rms >= threshold as hot, sum((rms < threshold)::int) over (partition by le.record_id order by window_id) as run from le join th using (record_id)),
rn as (select record_id, run, min(window_id) as first, count(*) as len from fl where hot group by 1, 2),
st as (select record_id, min(first) as start_index from rn where len >= 3 group by 1),
onset as (select th.*, case when start_index >= baseline_stop then start_index end as onset_index from th left join st using (record_id))"""


def onsets(t: Tables) -> DataFrame:
    w = windows(t).select("record_id", "window_id", "x")
    return segments.onset(w, ["record_id"], "window_id", "x", rms=3, persistence=3, baseline_cap=12, sigmas=1.0, rows=t.rows("events"))


@query("f5_onset", f"""
with {ONSET_SQL} select record_id, {r('m')} as baseline_median, {r('s')} as baseline_sigma, {r('peak')} as peak_rms, baseline_stop, {r('threshold')} as threshold, onset_index from onset""")
def f5(t: Tables) -> DataFrame:
    return rounded(onsets(t))


@query("f6_sustained_runs", f"""
with {WINDOWS_SQL}, k as (select record_id, window_id, x > 20 as hot, sum((x <= 20)::int) over (partition by record_id order by window_id) as run from w),
rn as (select record_id, run, min(window_id) as first_index, max(window_id) as last_index, count(*) as length from k where hot group by 1, 2)
select record_id, min(first_index) as start_index from rn where length >= 4 group by 1""")
def f6(t: Tables) -> DataFrame:
    w = windows(t).select("record_id", "window_id", "x")
    return ordered.first_sustained(w, ["record_id"], "window_id", F.col("x") > 20, 4, rows=t.rows("events"))


@query("f7_transitions", f"""
with {WINDOWS_SQL}, p as (select record_id, window_id, x, load, lag(x) over (partition by record_id order by window_id) as p from w)
select record_id, window_id, {r('p')} as previous, {r('x - p')} as delta, {r('load - p')} as boundary, {r('25.0::double - p')} as ambient from p where p is not null""")
def f7(t: Tables) -> DataFrame:
    w = windows(t).select("record_id", "window_id", "x", "load")
    p = ordered.running(w, ["record_id"], ["window_id"], lags={"previous": "x"}, rows=t.rows("events")).filter("previous is not null")
    return rounded(p.select("record_id", "window_id", "previous", (F.col("x") - F.col("previous")).alias("delta"),
                            (F.col("load") - F.col("previous")).alias("boundary"), (F.lit(25.0) - F.col("previous")).alias("ambient")))


@query("f8_average_ranks", """
select l_returnflag, l_quantity, any_value(rk) as average_rank from (select l_returnflag, l_quantity, rank() over (partition by l_returnflag order by l_quantity)
       + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0::double as rk from lineitem) group by 1, 2""")
def f8(t: Tables) -> DataFrame:
    return ranks.average_ranks(t("lineitem"), ["l_returnflag"], "l_quantity", "average_rank", rows=t.rows("lineitem"))


@query("f9_cumulative_mass", f"""
with g as (select l_returnflag, l_quantity, sum(l_tax) as w from lineitem group by 1, 2)
select l_returnflag, l_quantity, {r('w')} as mass, {r('sum(w) over (partition by l_returnflag order by l_quantity)')} as cumulative from g""")
def f9(t: Tables) -> DataFrame:
    g = t("lineitem").groupBy("l_returnflag", "l_quantity").agg(F.sum("l_tax").alias("mass"))
    return rounded(ordered.running(g, ["l_returnflag"], ["l_quantity"], sums={"cumulative": F.col("mass")}, rows=t.rows("lineitem")),
                   keep=["l_quantity"])


@query("f10_holm", f"""
with p as (select s_nationkey % 5 as family, s_suppkey as test, (s_acctbal - floor(s_acctbal / 100) * 100) / 2000.0::double as p from supplier),
o as (select *, row_number() over (partition by family order by p, test) as rn, count(*) over (partition by family) as m from p)
select family, test, {r('p')} as p_value, {r('least(1, max((m - rn + 1) * p) over (partition by family order by p, test rows unbounded preceding))')} as holm_p from o""")
def f10(t: Tables) -> DataFrame:
    from tracewell.operators.compare import holm

    bal = F.col("s_acctbal")
    p = t("supplier").select((F.col("s_nationkey") % 5).alias("family"), F.col("s_suppkey").alias("test"),
                             ((bal - F.floor(bal / 100) * 100) / 2000.0).alias("p_value"))
    return rounded(holm(p, ["family"], "p_value", "test", rows=t.rows("supplier")))


SPACED = """with b as (select distinct record_id, block_id from w where window_id % 5 = 4),
p as (select record_id, block_id, row_number() over (partition by record_id order by block_id) - 1 as p, count(*) over (partition by record_id) as n from b)"""


@query("f11_evenly_spaced", f"""
with {WINDOWS_SQL}, {SPACED[5:]},
i as (select unnest(range(4)) as i),
a as (select distinct record_id, round_even(i * (n - 1)::double / 3, 0) as p from p, i), c as (select distinct record_id, floor(i * n::double / 4) as p from p, i)
select 'rint' as rule, record_id, block_id from p join a using (record_id, p) union all select 'floor', record_id, block_id from p join c using (record_id, p)""")
def f11(t: Tables) -> DataFrame:
    b = windows(t).filter("window_id % 5 = 4").select("record_id", "block_id")
    out = [roles.evenly_spaced(b, ["record_id"], "block_id", k=F.lit(4), rule=rule, rows=t.rows("events")).select(
        F.lit(rule).alias("rule"), "record_id", "block_id") for rule in ("rint", "floor")]
    return out[0].unionByName(out[1])


@query("f12_family_buckets", """
with c as (select distinct p_type, p_brand from part)
select p_type, p_brand, row_number() over (partition by p_type order by p_brand) - 1 as case_index, (row_number() over (partition by p_type order by p_brand) - 1) % 3 as bucket from c""")
def f12(t: Tables) -> DataFrame:
    return roles.bucket_in_family(t("part").select("p_type", "p_brand").distinct(), "p_type", ["p_brand"], 3)


@query("f13_session_residuals", f"""
with {WINDOWS_SQL}, a as (select record_id, median(x) as ax, median(x * x) as ay, count(*) as n from w where window_id < 2 group by 1)
select w.record_id, window_id, 0 as anchor_first, 1 as anchor_last, {r('x - ax')} as residual_x, {r('x * x - ay')} as residual_y from w join a using (record_id) where window_id >= 2 and n = 2""")
def f13(t: Tables) -> DataFrame:
    w = windows(t).select("record_id", "window_id", "x", (F.col("x") * F.col("x")).alias("y"))
    out = segments.session_residuals(w, ["record_id"], "window_id", ["x", "y"])
    return rounded(out.select("record_id", "window_id", "anchor_first", "anchor_last", "residual_x", "residual_y"))


@query("f14_onset_windows", f"""
with {ONSET_SQL}, o as (select onset.record_id, onset_index as o_at, n.total from onset join n using (record_id) where onset_index is not null),
pre as (select record_id, 'pre' as segment, i as position, i * 4 as start, i * 4 + 4 as stop from o, unnest(range(greatest((o_at - 2) // 4, 0)::bigint)) u(i)),
post as (select record_id, 'post', i, o_at + i * 4, o_at + i * 4 + 4 from o, unnest(range(greatest((least(total, o_at + 20) - o_at) // 4, 0)::bigint)) u(i))
select * from pre union all select * from post""")
def f14(t: Tables) -> DataFrame:
    n = t("events").groupBy(F.col("user_id").alias("record_id")).agg(F.count(F.lit(1)).alias("total"))
    o = onsets(t).select("record_id", "onset_index").join(n, "record_id")
    return segments.onset_windows(o, ["record_id"], total="total", onset_index="onset_index", window=4, guard=2, horizon=20)


# ---------------------------------------------------------------- selection, sets, reshape


@query("g1_ordered_records", "select s_nationkey, s_suppkey, row_number() over (order by s_nationkey, s_suppkey) as position from supplier")
def g1(t: Tables) -> DataFrame:
    s = t("supplier").select("s_nationkey", "s_suppkey").withColumn("_g", F.lit(0))
    out = ordered.with_position(s, ["_g"], ["s_nationkey", "s_suppkey"], "position", rows=t.rows("supplier"))
    return out.select("s_nationkey", "s_suppkey", F.col("position") + 1).withColumnsRenamed({"(position + 1)": "position"}).orderBy("s_nationkey", "s_suppkey")


@query("g2_constrained_argmax", f"""
with c as (select l_suppkey, l_linenumber, avg(l_discount) as rate, count(*) as n from lineitem group by 1, 2),
k as (select *, row_number() over (partition by l_suppkey order by round(rate, 4) desc, n desc, l_linenumber) as rn from c where n >= 3)
select l_suppkey, l_linenumber, {r('rate')} as rate, n from k where rn = 1""")
def g2(t: Tables) -> DataFrame:
    """Best eligible candidate with a full tie-break, as an aggregate instead of a sort."""
    c = t("lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_discount").alias("rate"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    best = F.max(F.struct(F.round("rate", 4).alias("r"), "n", (-F.col("l_linenumber")).alias("first"), "l_linenumber", "rate"))
    return rounded(c.groupBy("l_suppkey").agg(best.alias("b")).select("l_suppkey", "b.l_linenumber", "b.rate", "b.n"))


def _rank_sql(rank: str) -> str:
    return f"list_sort(list(l_extendedprice))[least({rank}, count(*))]"


@query("g3_conformal_thresholds", f"""
with g as (select l_suppkey, list_sort(list(l_extendedprice)) as s, count(*) as n from lineitem group by 1),
k as (select *, ceil((n + 1) * (1 - 0.001::double))::bigint as tight, ceil((n + 1) * (1 - 0.05::double))::bigint as usual, ceil((n + 1) * 0.9::double)::bigint as cover from g)
select l_suppkey, n, tight > n as infinite, {r('case when tight <= n then s[tight] end')} as finite_threshold, {r('s[least(tight, n)]')} as clamped,
       {r('s[least(usual, n)]')} as usual, cover as cover_rank, {r('s[least(cover, n)]')} as half_width from k""")
def g3(t: Tables) -> DataFrame:
    li, rows = t("lineitem").select("l_suppkey", "l_extendedprice"), t.rows("lineitem")
    key, x = ["l_suppkey"], "l_extendedprice"
    a = conformal.threshold(li, key, x, 0.001, name="_inf", rows=rows).drop("rank")
    b = conformal.threshold(li, key, x, 0.001, overflow="clamp", name="clamped", rows=rows).select("l_suppkey", "clamped")
    c = conformal.threshold(li, key, x, 0.05, overflow="clamp", name="usual", rows=rows).select("l_suppkey", "usual")
    d = conformal.coverage_quantile(li, key, x, 0.9, rows=rows).select("l_suppkey", F.col("rank").alias("cover_rank"), "half_width")
    infinite = F.col("_inf") == float("inf")
    out = a.join(b, key).join(c, key).join(d, key)
    return rounded(out.withColumn("infinite", infinite).withColumn("finite_threshold", F.when(~infinite, F.col("_inf"))).drop("_inf"))


@query("g4_minimum_calibration", f"""
with a as (select distinct l_discount as alpha from lineitem where l_discount > 0), n as (select count(distinct user_id) as records from events)
select {r('alpha')} as alpha, greatest(1, ceil(1.0::double / alpha - 1 - 1e-12))::bigint as needed, records >= greatest(1, ceil(1.0::double / alpha - 1 - 1e-12)) as feasible from a, n""")
def g4(t: Tables) -> DataFrame:
    records = t("events").agg(F.countDistinct("user_id").alias("records"), F.lit(1).alias("_g"))
    a = t("lineitem").filter("l_discount > 0").select(F.col("l_discount").alias("alpha")).distinct().withColumn("_g", F.lit(1))
    j = a.join(F.broadcast(records), "_g").withColumn("needed", minimum_calibration(F.col("alpha")))  # one row
    return rounded(j.withColumn("feasible", F.col("records") >= F.col("needed")).drop("_g", "records"))


@query("h1_union_all", """
select 'customer' as source, c_nationkey as nation, count(*) as n from customer group by 2 union all select 'supplier', s_nationkey, count(*) from supplier group by 2""")
def h1(t: Tables) -> DataFrame:
    a = t("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    b = t("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    return a.select(F.lit("customer").alias("source"), "nation", "n").unionByName(b.select(F.lit("supplier").alias("source"), "nation", "n"))


@query("h2_intersect", "select l_partkey, l_suppkey from lineitem where l_returnflag = 'A' intersect select l_partkey, l_suppkey from lineitem where l_returnflag = 'R'")
def h2(t: Tables) -> DataFrame:
    li = t("lineitem")
    return li.filter("l_returnflag = 'A'").select("l_partkey", "l_suppkey").intersect(li.filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey"))


@query("h3_except", "select c_custkey as custkey from customer except select o_custkey from orders where o_orderpriority = '1-URGENT'")
def h3(t: Tables) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("custkey")).join(
        t("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("custkey")), "custkey", "left_anti")


@query("h4_distinct", "select distinct p_brand, p_type from part")
def h4(t: Tables) -> DataFrame:
    return t("part").select("p_brand", "p_type").distinct()


@query("i1_pivot", f"""
select l_suppkey, {r("avg(l_quantity) filter (where l_returnflag = 'A')")} as flag_a, {r("avg(l_quantity) filter (where l_returnflag = 'N')")} as flag_n,
       {r("avg(l_quantity) filter (where l_returnflag = 'R')")} as flag_r from lineitem group by 1""")
def i1(t: Tables) -> DataFrame:
    wide = t("lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity"))
    return rounded(wide.withColumnsRenamed({"A": "flag_a", "N": "flag_n", "R": "flag_r"}))


@query("i2_double_melt", "with " + FEATURES_SQL + " select * from (" + " union all ".join(
    f"select vec_id, 'x{i}' as feature, {r(f'x{i}')} as raw_value, {r(f'x{i} * 2 + 1')} as z_value from f" for i in range(len(XS))) + ")")
def i2(t: Tables) -> DataFrame:
    """Two melts that would be rejoined on key and feature come from one pass of paired structs."""
    cells = [F.struct(F.lit(f"x{i}").alias("feature"), r6(f"x{i}").alias("raw_value"), r6(F.col(f"x{i}") * 2 + 1).alias("z_value")) for i in range(len(XS))]
    return features(t).select("vec_id", F.inline(F.array(*cells)))


@query("i3_explode_matrix", f"""
select vec_id, 'd' || (i - 1) as feature, {r('embedding[i]')} as value from embeddings, unnest(range(1, 65)) u(i)""")
def i3(t: Tables) -> DataFrame:
    return t("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select(
        "vec_id", F.concat(F.lit("d"), F.col("i").cast("string")).alias("feature"), r6("v").alias("value"))


@query("i4_trajectory_rows", f"""
select vec_id, i - 1 as second, {r('embedding[i]::double')} as truth, {r('embedding[greatest(i - 1, 1)]::double')} as prediction from embeddings, unnest(range(1, 65)) u(i)""")
def i4(t: Tables) -> DataFrame:
    e = F.col("embedding")
    shifted = F.transform(F.sequence(F.lit(0), F.size(e) - 1), lambda i: F.get(e, F.greatest(i - 1, F.lit(0))).cast("double"))
    rows = F.posexplode(F.arrays_zip(e.alias("truth"), shifted.alias("prediction"))).alias("second", "p")
    return t("embeddings").select("vec_id", rows).select("vec_id", "second", r6("p.truth").alias("truth"), r6("p.prediction").alias("prediction"))


@query("i6_curve_arrays", f"with {FEATURES_SQL} select vec_id, {len(XS)} as positions, {r(' + '.join(XS))} as total, {r('greatest(' + ', '.join(XS) + ')')} as peak from f")
def i6(t: Tables) -> DataFrame:
    curve = features(t).select("vec_id", F.array(*XS).alias("curve"))
    return curve.select("vec_id", F.size("curve").alias("positions"), r6(F.aggregate("curve", F.lit(0.0), lambda a, v: a + v)).alias("total"),
                        r6(F.array_max("curve")).alias("peak"))


@query("k1_strided_windows", f"""
with {WINDOWS_SQL}, n as (select record_id, count(*) as n from w group by 1),
g as (select record_id, b as block_id, b * 3 + k as window_id, b * 20 + k * 4 as start, b * 20 + k * 4 + 10 as stop from n, unnest(range((n // 20)::bigint)) u(b), unnest(range(3)) v(k))
select g.record_id, g.block_id, g.window_id, count(*) as samples, {r('sqrt(avg(x * x))')} as rms from g join w on w.record_id = g.record_id and w.window_id >= start and w.window_id < stop group by 1, 2, 3""")
def k1(t: Tables) -> DataFrame:
    return rounded(_strided(t, window=10, stride=4, block=20))


@query("k1_window_bounds", """
with n as (select user_id as record_id, count(*) as n from events group by 1)
select record_id, b as block_id, b * 3 + k as window_id, b * 20 + k * 4 as start, b * 20 + k * 4 + 10 as stop from n, unnest(range((n // 20)::bigint)) u(b), unnest(range(3)) v(k)""")
def k1b(t: Tables) -> DataFrame:
    n = t("events").groupBy(F.col("user_id").alias("record_id")).agg(F.count(F.lit(1)).alias("n"))
    return segments.window_starts(n, ["record_id"], "n", window=10, stride=4, block=20)


@query("k2_macroblocks", f"""
with {SCORES_SQL}, n as (select record_id, count(*) as n from w group by 1)
select sw.record_id, k.k as windows_per_block, window_id // k.k as macroblock, {r('max(z)')} as score from sw join n using (record_id), (select unnest([3, 6, 10]) as k) k
where window_id // k.k < n // k.k group by 1, 2, 3""")
def k2(t: Tables) -> DataFrame:
    s = scored_windows(t).select("record_id", "window_id", "z", F.explode(F.array(*[F.lit(k) for k in (3, 6, 10)])).alias("windows_per_block"))
    g = s.groupBy("record_id", "windows_per_block", F.floor(F.col("window_id") / F.col("windows_per_block")).alias("macroblock")).agg(
        F.max("z").alias("score"), F.count(F.lit(1)).alias("_n"))
    return rounded(g.filter("_n = windows_per_block").drop("_n"))
