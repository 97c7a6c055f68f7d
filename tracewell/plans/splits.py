"""Role and fold queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import roles
from tracewell.operators.ordered import explode_range
from tracewell.plans.registry import Tables, query
from tracewell.plans.views import WINDOWS_SQL, windows

HASH = "('0x' || substr(md5(concat_ws('|', {a}, {b})), 1, 8))::bigint"


@query("m1_grouped_split", f"""
with g as (select distinct user_id from events),
h as (select user_id, row_number() over (order by {HASH.format(a="'42'", b='user_id::varchar')}, user_id) - 1 as i, count(*) over () as n from g),
c as (select *, ceil(n * 0.2::double) as nt from h),
s as (select user_id, case when i < nt then 'test' when i < nt + ceil((n - nt) * 0.2::double) then 'validation' else 'train' end as split from c)
select split, user_id, count(*) as n_rows from s join events using (user_id) group by 1, 2""")
def m1(t: Tables) -> DataFrame:
    """Split and manifest of whole groups."""
    e = t("events")
    split = roles.grouped_split(e.select("user_id"), "user_id", seed=42, rows=t.rows("events"))
    counts = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(split, "user_id")


@query("m2_leave_one_out", """
with e as (select distinct user_id % 3 as entity from events),
f as (select t.entity as target, s.entity, case when t.entity = s.entity then 'target' else 'source' end as role from e t, e s)
select target, f.entity, role, (select count(*) from events where user_id % 3 = f.entity) as rows from f""")
def m2(t: Tables) -> DataFrame:
    n = t("events").groupBy((F.col("user_id") % 3).alias("entity")).agg(F.count(F.lit(1)).alias("rows"))
    folds = F.inline(F.array(*[F.struct(F.lit(f).cast("long").alias("target"), F.when(F.col("entity") == f, "target")
                                        .otherwise("source").alias("role")) for f in range(3)]))
    return n.select("entity", "rows", folds)


BLOCK_SQL = WINDOWS_SQL + """,
bl as (select distinct record_id, block_id from w where window_id < 5 * ((select max(window_id) from w w2 where w2.record_id = w.record_id) // 5)),
bn as (select record_id, block_id, count(*) over (partition by record_id) as n from bl)"""


def record_blocks(t: Tables) -> DataFrame:
    """Complete blocks of each record with the number of blocks."""
    per = t("events").groupBy(F.col("user_id").alias("record_id")).agg(F.floor((F.count(F.lit(1)) - 1) / 5).alias("n"))
    return explode_range(per, F.col("n"), "block_id")


@query("m3_contiguous_partition", f"""
with {BLOCK_SQL}, p as (select *, greatest(1, floor((n - 2) * 0.25::double)) as a, greatest(1, floor((n - 2) * 0.25::double)) as c from bn)
select record_id, block_id, case when n >= 5 and n - 2 - a - c >= 1 then case when block_id < a then 'adaptation' when block_id < a + 1 then 'guard'
       when block_id < a + 1 + c then 'calibration' when block_id < a + c + 2 then 'guard' else 'test' end end as role from p""")
def m3(t: Tables) -> DataFrame:
    return record_blocks(t).select("record_id", "block_id", roles.contiguous_role("block_id", "n").alias("role"))


@query("m4_budget_partition", f"""
with {BLOCK_SQL}
select record_id, block_id,
  case when block_id < 2 then 'adaptation' when block_id < 4 then 'unused' when block_id < 5 then 'guard' when block_id < 9 then 'calibration'
       when block_id < 10 then 'guard' else 'test' end as fixed_horizon,
  case when block_id < 2 then 'adaptation' when block_id < 3 then 'guard' when block_id < 7 then 'calibration' when block_id < 8 then 'guard'
       else 'test' end as sequential from bn""")
def m4(t: Tables) -> DataFrame:
    return record_blocks(t).select("record_id", "block_id",
                                   roles.budget_role("block_id", adaptation=2, calibration=4, horizon=4).alias("fixed_horizon"),
                                   roles.budget_role("block_id", adaptation=2, calibration=4).alias("sequential"))


@query("m5_alternating_split", """
with k as (select c_nationkey as heldout, c_custkey as candidate, sha256('20260821|' || c_nationkey || '|' || c_custkey) as d from customer)
select heldout, candidate, case when (row_number() over (partition by heldout order by d) - 1) % 2 = 0 then 'fit' else 'calibration' end as split from k""")
def m5(t: Tables) -> DataFrame:
    pairs = t("customer").select(F.col("c_nationkey").alias("heldout"), F.col("c_custkey").alias("candidate"))
    return roles.alternating_split(pairs, "heldout", "candidate", salt="20260821", rows=t.rows("customer"))


@query("m6_grid_roles", "with fit as (select * from (values " + ", ".join(
    f"({k}::double, {list(v)}::double[])" for k, v in roles.FIT_LOADS.items()) + """) v(test_load, loads)),
e as (select distinct user_id % 8 * 5.0::double as load from events)
select load, test_load, case when load = test_load then 'test' when list_contains(loads, load) then 'fit' else 'calibration' end as role from e, fit""")
def m6(t: Tables) -> DataFrame:
    loads = t("events").select((F.col("user_id") % 8 * F.lit(5.0)).alias("load")).distinct()
    return loads.select("load", F.inline(roles.grid_role("load", roles.FIT_LOADS)))


@query("m7_late_block_roles", f"""
with {WINDOWS_SQL}
select role, count(*) as rows from (select case when not is_healthy or block_id <= 5 then 'train' when block_id >= 8 then 'calibration' else 'unused' end as role from w)
group by 1""")
def m7(t: Tables) -> DataFrame:
    role = roles.late_block_role("is_healthy", "block_id", train_last=5, calibration_first=8)
    return windows(t).groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("rows"))


@query("m8_entity_balanced_blocks", f"""
with {BLOCK_SQL}, p as (select record_id, block_id, block_id as p, n from bn), k as (select min(n) as k from bn),
c as (select record_id, round_even(i * (n - 1)::double / (k - 1), 0) as p from (select distinct record_id, n from bn), k, unnest(range(k)) u(i))
select distinct record_id, block_id from p join c using (record_id, p)""")
def m8(t: Tables) -> DataFrame:
    return roles.evenly_spaced(record_blocks(t), ["record_id"], "block_id", rows=t.rows("events"))


@query("m9_permuted_split", f"""
with h as (select vec_id, vec_id < (select 3 * count(*) // 4 from embeddings) as dev, {HASH.format(a="'20260821'", b='vec_id::varchar')} as h from embeddings),
i as (select *, row_number() over (partition by dev order by h, vec_id) - 1 as i from h)
select vec_id, case when not dev then 'test' when i < (select count(*) // 2 from embeddings) then 'fit' else 'calibration' end as role from i""")
def m9(t: Tables) -> DataFrame:
    n = t.rows("embeddings")
    return roles.permuted_split(t("embeddings"), "vec_id", development=3 * n // 4, fit=n // 2, seed=20260821, rows=n)


@query("m10_rotating_crossfit", """
with b as (select p_brand, p_partkey, p_partkey % 3 as bucket from part), f as (select unnest([0, 1, 2]) as fold)
select fold, p_brand, case (bucket - fold + 3) % 3 when 0 then 'test' when 1 then 'calibration' else 'fit' end as role, count(*) as cases
from b, f group by all""")
def m10(t: Tables) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("fold"), roles.rotating_role(F.col("p_partkey") % 3, F.lit(f)).alias("role")) for f in range(3)])
    fanned = t("part").select("p_brand", F.inline(cells))
    return fanned.groupBy("fold", "p_brand", "role").agg(F.count(F.lit(1)).alias("cases"))


@query("m11_group_folds", """
with g as (select l_suppkey, count(*) as c from lineitem group by 1)
select l_suppkey, ((row_number() over (order by c desc, l_suppkey) - 1) % 5)::int as fold from g""")
def m11(t: Tables) -> DataFrame:
    return roles.group_folds(t("lineitem"), "l_suppkey", 5, rows=t.rows("lineitem"))
