"""Contract queries: each check as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import is_finite, r6
from tracewell.operators import contracts
from tracewell.operators.report import rounded
from tracewell.plans.registry import Tables, query, r
from tracewell.plans.views import BLOCKS_SQL, WINDOWS_SQL, blocks, windows


@query("c2_nonfinite_counts", "with l as (" + " union all ".join(
    f"select '{c}' as \"column\", try_cast({c} as double) as v from events" for c in ("value", "user_id", "props")) + """)
select "column", count(*) filter (where v is null or not isfinite(v)) as bad from l group by 1""")
def c2(t: Tables) -> DataFrame:
    e = t("events").select("value", "user_id", F.col("props").try_cast("double").alias("props"))
    return contracts.nonfinite_counts(e, ["value", "user_id", "props"])


@query("c3_duplicate_rows", """
select l_orderkey, l_linenumber, l_quantity, count(*) as copies from lineitem group by 1, 2, 3 having count(*) > 1""")
def c3(t: Tables) -> DataFrame:
    return contracts.duplicate_rows(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))


@query("c4_key_violations", """
select l_orderkey, l_linenumber, count(*) as copies from lineitem group by 1, 2 having count(*) > 1""")
def c4(t: Tables) -> DataFrame:
    return contracts.key_violations(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("c5_count_mismatches", """
with e as (select * from (values ('A', 20000), ('N', 20001), ('Z', 5)) v(l_returnflag, expected)),
s as (select l_returnflag, count(*) as observed from lineitem group by 1)
select l_returnflag, coalesce(expected, 0)::bigint as expected, coalesce(observed, 0) as observed
from e full join s using (l_returnflag) where coalesce(expected, 0) <> coalesce(observed, 0)""")
def c5(t: Tables) -> DataFrame:
    return contracts.count_mismatches(t("lineitem"), "l_returnflag", {"A": 20000, "N": 20001, "Z": 5})


@query("c6_missing_cells", """
select distinct c_custkey, p.o_orderpriority from customer, (select unnest(['1-URGENT', '2-HIGH', '5-LOW']) as o_orderpriority) p
where c_custkey in (select o_custkey from orders)
  and not exists (select 1 from orders o where o.o_custkey = c_custkey and o.o_orderpriority = p.o_orderpriority)""")
def c6(t: Tables) -> DataFrame:
    out = contracts.missing_cells(t("orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"])
    return out.withColumnRenamed("o_custkey", "c_custkey")


@query("c7_broken_runs", """
with k as (select o_orderkey, year(o_orderdate) as y, lag(year(o_orderdate)) over (order by o_orderkey) as p from orders)
select y as order_year, count(*) filter (where p is null or p <> y) as runs from k group by 1 having runs > 1""")
def c7(t: Tables) -> DataFrame:
    o = t("orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("order_year"))
    return contracts.broken_runs(o, ["o_orderkey"], "order_year", rows=t.rows("orders"))


@query("c8_time_steps", f"""
with {WINDOWS_SQL}, d as (select record_id, epoch_us(ts) / 1e6::double - lag(epoch_us(ts) / 1e6::double) over (partition by record_id order by window_id) as d from w),
a as (select record_id, min(d) as lo, avg(d) as mid, max(d) as hi from d group by 1)
select record_id, round(lo, 3) + 0.0 as min_step, round(mid, 3) + 0.0 as mean_step, round(hi, 3) + 0.0 as max_step, lo > 0 as increasing,
       {r('greatest(abs(hi - mid), abs(mid - lo)) / mid')} as jitter from a""")
def c8(t: Tables) -> DataFrame:
    w = windows(t).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    s = contracts.step_report(w, ["record_id"], ["window_id"], "t", rows=t.rows("events"))
    return s.select("record_id", *[(F.round(c, 3) + 0.0).alias(c) for c in ("min_step", "mean_step", "max_step")],
                    "increasing", r6("jitter").alias("jitter"))


@query("c9_reconcile", f"""
with a as (select l_suppkey as k, sum(l_quantity) as q, count(*) as n from lineitem group by 1),
b as (select l_suppkey as k, sum(l_quantity) + case when l_suppkey % 50 = 0 then 0.5 else 0 end as q, count(*) as n from lineitem
      where l_suppkey % 33 <> 1 group by 1),
j as (select a.k as ka, b.k as kb, abs(a.q - b.q) as gq, abs(a.n - b.n) as gn from a full join b on a.k = b.k)
select 'q' as value, count(*) filter (where ka is null) as only_right, count(*) filter (where kb is null) as only_left,
       {r('max(gq)')} as max_gap, count(*) filter (where gq > 0.25) as beyond from j
union all select 'n', count(*) filter (where ka is null), count(*) filter (where kb is null), {r('max(gn)')}, count(*) filter (where gn > 0.25) from j""")
def c9(t: Tables) -> DataFrame:
    li, k = t("lineitem"), F.col("l_suppkey")
    total = [F.sum("l_quantity").alias("q"), F.count(F.lit(1)).cast("double").alias("n")]
    a = li.groupBy(k.alias("k")).agg(*total)
    b = li.filter(k % 33 != 1).groupBy(k.alias("k")).agg(*total)
    b = b.withColumn("q", F.col("q") + F.when(F.col("k") % 50 == 0, 0.5).otherwise(0.0))
    return rounded(contracts.reconcile(a, b, ["k"], ["q", "n"], 0.25))


@query("c9_exact_differences", """
with a as (select n_nationkey, n_regionkey from nation), b as (select s_nationkey, n_regionkey from supplier join nation on s_nationkey = n_nationkey)
select 'left' as side, * from (select * from a except all select * from b)
union all select 'right', * from (select * from b except all select * from a)""")
def c9b(t: Tables) -> DataFrame:
    a = t("nation").select("n_nationkey", "n_regionkey")
    b = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_nationkey").alias("n_nationkey"), "n_regionkey")
    left, right = a.exceptAll(b), b.exceptAll(a)
    return left.select(F.lit("left").alias("side"), "*").unionByName(right.select(F.lit("right").alias("side"), "*"))


@query("c10_inventory_rules", """
select p_type, count(*) as records, count(*) filter (where p_size % 2 = 0) as even_state, count(*) filter (where p_size % 2 = 1) as odd_state,
       list_sort(list(distinct p_size) filter (where p_size % 2 = 0))::varchar = list_sort(list(distinct p_size - 1) filter (where p_size % 2 = 1))::varchar as paired
from part group by 1""")
def c10(t: Tables) -> DataFrame:
    """Sizes come from a fixed range of fifty values, so the collected sets are bounded."""
    even, size = F.col("p_size") % 2 == 0, F.col("p_size")
    return t("part").groupBy("p_type").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(even).alias("even_state"), F.count_if(~even).alias("odd_state"),
        F.array_sort(F.collect_set(F.when(even, size))).eqNullSafe(
            F.array_sort(F.collect_set(F.when(~even, size - 1)))).alias("paired"))


@query("c11_join_cardinality", """
select 'orders.o_orderkey' as side, count(*) as rows, count(*) - count(distinct o_orderkey) as extra_keys,
       (select count(*) from lineitem l where not exists (select 1 from orders o where o.o_orderkey = l.l_orderkey)) as lost_rows from orders
union all select 'supplier.s_suppkey', count(*), count(*) - count(distinct s_suppkey),
       (select count(*) from lineitem l where not exists (select 1 from supplier o where o.s_suppkey = l.l_suppkey)) from supplier""")
def c11(t: Tables) -> DataFrame:
    li, out = t("lineitem"), []
    for name, key, fk in (("orders", "o_orderkey", "l_orderkey"), ("supplier", "s_suppkey", "l_suppkey")):
        dim = t(name)
        per_key = dim.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        keys = per_key.agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("extra_keys"))
        lost = li.join(dim, F.col(fk) == F.col(key), "left_anti").agg(F.count(F.lit(1)).alias("lost_rows"))
        one = F.lit(f"{name}.{key}").alias("side")
        out.append(keys.select(one, "rows", "extra_keys").join(lost.select(one, "lost_rows"), "side"))
    return out[0].unionByName(out[1])


@query("c12_leaking_groups", """
with r as (select l_orderkey, case when l_linenumber <= 3 then 'fit' else 'test' end as role from lineitem)
select l_orderkey from r group by 1 having count(distinct role) > 1""")
def c12(t: Tables) -> DataFrame:
    rolled = t("lineitem").select("l_orderkey", F.when(F.col("l_linenumber") <= 3, "fit").otherwise("test").alias("role"))
    return contracts.leaking_groups(rolled, "l_orderkey", "role")


@query("c13_population_gaps", """
with m as (select user_id, event_type, event_id % 20 as slot from events group by all)
select user_id, slot from m where event_type in ('click', 'view') group by 1, 2
having count(*) filter (where event_type = 'click') <> 1 or count(*) filter (where event_type = 'view') <> 1""")
def c13(t: Tables) -> DataFrame:
    m = t("events").filter(F.col("event_type").isin("click", "view")).select(
        "user_id", "event_type", (F.col("event_id") % 20).alias("slot")).distinct()
    return contracts.population_gaps(m, ["user_id", "slot"], "event_type", ["click", "view"])


@query("c14_compatible_fraction", f"""
select s_nationkey, {r('avg((s_acctbal > 1000)::int)')} as fraction, avg((s_acctbal > 1000)::int) >= 0.9::double as passed from supplier group by 1""")
def c14(t: Tables) -> DataFrame:
    share = F.avg((F.col("s_acctbal") > 1000).cast("double"))
    return t("supplier").groupBy("s_nationkey").agg(r6(share).alias("fraction"), (share >= F.lit(0.9)).alias("passed"))


@query("c15_protocol_equality", f"""
with a as (select count(*) as rows, count(distinct user_id) as records, max(value) as peak from events),
b as (select count(*) as rows, count(distinct user_id) as records, max(value) as peak from events where event_type <> 'error')
select 'rows' as field, a.rows::varchar as "left", b.rows::varchar as "right", a.rows = b.rows as equal from a, b
union all select 'records', a.records::varchar, b.records::varchar, a.records = b.records from a, b
union all select 'peak', a.peak::varchar, b.peak::varchar, a.peak = b.peak from a, b""")
def c15(t: Tables) -> DataFrame:
    fields = [F.count(F.lit(1)).alias("rows"), F.countDistinct("user_id").alias("records"), F.max("value").alias("peak")]
    e = t("events")
    return contracts.protocol_differences(e.agg(*fields), e.filter("event_type <> 'error'").agg(*fields), ["rows", "records", "peak"])


@query("c16_check_log", """
select 'finite_price' as rule, count(*) as checked, count(*) filter (where not isfinite(l_extendedprice)) as failed,
       count(*) filter (where not isfinite(l_extendedprice)) = 0 as passed from lineitem
union all select 'small_discount', count(*), count(*) filter (where l_discount > 0.09), count(*) filter (where l_discount > 0.09) = 0 from lineitem
union all select 'known_status', count(*), count(*) filter (where o_orderstatus not in ('F', 'O', 'P')),
       count(*) filter (where o_orderstatus not in ('F', 'O', 'P')) = 0 from orders""")
def c16(t: Tables) -> DataFrame:
    li = t("lineitem")
    return contracts.check_log([
        contracts.check_row("finite_price", li, ~is_finite("l_extendedprice")),
        contracts.check_row("small_discount", li, F.col("l_discount") > 0.09),
        contracts.check_row("known_status", t("orders"), ~F.col("o_orderstatus").isin("F", "O", "P"))])


@query("c17_schema_census", """
with s as (select conv_id, array_to_string(list_sort(list(distinct role)), ',') as roles from conversations group by 1)
select sha256(roles) as signature, count(*) as records from s group by 1""")
def c17(t: Tables) -> DataFrame:
    """Records per identical variable set; the set of variable names is small whatever the record size."""
    s = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("v"))
    return s.groupBy(F.sha2(F.array_join("v", ","), 256).alias("signature")).agg(F.count(F.lit(1)).alias("records"))


@query("c18_frozen_inputs", """
with now as (select doc_id, sha256(text) as digest from documents),
frozen as (select doc_id, case when doc_id % 97 = 0 then sha256(lang) else digest end as digest from now join documents using (doc_id))
select now.doc_id from now where not exists (select 1 from frozen f where f.doc_id = now.doc_id and f.digest = now.digest)""")
def c18(t: Tables) -> DataFrame:
    from tracewell.sources.inventory import changed_inputs

    d = t("documents")
    now = d.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    frozen = d.select("doc_id", F.when(F.col("doc_id") % 97 == 0, F.sha2("lang", 256)).otherwise(
        F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    return changed_inputs(now, frozen, ["doc_id"], "digest").select("doc_id")


@query("b16_gates", f"""
with {BLOCKS_SQL}, s as (select role, avg(alarm::int) as rate, count(*) as n from blk group by 1)
select role, n, {r('rate')} as rate, rate <= 0.1::double as far_gate, n >= 100 as size_gate, rate <= 0.1::double and n >= 100 as passed from s""")
def b16(t: Tables) -> DataFrame:
    s = blocks(t).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("alarm").cast("int")).alias("rate"))
    far, size = F.col("rate") <= F.lit(0.1), F.col("n") >= 100
    return s.select("role", "n", r6("rate").alias("rate"), far.alias("far_gate"), size.alias("size_gate"), (far & size).alias("passed"))
