"""Write-and-read-back queries over the source and sink layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import r6
from tracewell.operators import covariance
from tracewell.operators.report import rounded
from tracewell.plans.detectors import reference
from tracewell.plans.registry import Tables, query, r
from tracewell.plans.rollups import LONG_SQL, XS
from tracewell.sources import readers, sinks
from tracewell.streaming.replay import landing_folder

CURVE = 64


def _write_pair(t: Tables, place: str, name: str, odd: int) -> tuple[str, str]:
    e = F.col("embedding")
    half = t("embeddings").filter(F.col("label") % 2 == odd)
    names = f"{place}/{name}_parameters", f"{place}/{name}_curves"
    sinks.export_csv(half.select(F.col("vec_id").alias("row_id"), F.col("vec_id").cast("double").alias("a"), e[0].cast("double").alias("b")), names[0])
    sinks.export_csv(half.select(F.col("vec_id").alias("row_id"), *[e[i].cast("double").alias(f"{i * 0.5}") for i in range(CURVE)]), names[1])
    return names


@query("a1_header_discovery", f"select 'supplier' as found, count(*) as rows, {r('sum(s_acctbal)')} as balance from supplier")
def a1(t: Tables) -> DataFrame:
    """Four tables as CSV under one tree; the one whose header has the wanted columns is found and read."""
    place = landing_folder(t.spark)
    for name in ("region", "nation", "customer", "supplier"):
        sinks.export_csv(t(name), f"{place}/tree/{name}.csv")
    path = readers.discover_table(t.spark, f"{place}/tree", ["s_suppkey", "s_acctbal"])
    table = readers.read_table(t.spark, path, t("supplier").schema, "s_suppkey")
    return rounded(table.groupBy(F.lit(path.rsplit("/", 1)[1].removesuffix(".csv")).alias("found")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("s_acctbal").alias("balance")))


@query("a4_profile_folder", f"""
with p as (select user_id % 4 as profile_id, event_id, value, row_number() over (partition by user_id % 4 order by event_id) - 1 as i from events)
select profile_id, count(*) as rows, max(i) as last_index, {r('sum(value * i)')} as weighted from p group by 1""")
def a4(t: Tables) -> DataFrame:
    """Events written as one CSV per profile, read back as one table with ids from the names."""
    place = landing_folder(t.spark)
    for k in range(4):
        sinks.export_csv(t("events").filter(F.col("user_id") % 4 == k).select("event_id", "value"), f"{place}/profiles/measured_{k}.csv")
    rows = readers.read_profile_folder(t.spark, f"{place}/profiles", "event_id long, value double", line="event_id")
    return rounded(rows.groupBy("profile_id").agg(F.count(F.lit(1)).alias("rows"), F.max("sample_idx").alias("last_index"),
                                                  F.sum(F.col("value") * F.col("sample_idx")).alias("weighted")))


CONTRACT = {"events": (["event_id", "ts", "value", "load"], ["props"]), "lineitem": (["l_orderkey", "l_quantity"], ["l_comment", "score"])}


@query("c1_required_columns", " union all ".join(
    f"select '{name}' as table_name, '{c}' as column_name, {'true' if c in required else 'false'} as required, (select count(*) from information_schema.columns where table_name = '{name}' and column_name = '{c}') > 0 as present, "
    f"(select count(*) from {name}) as rows" for name, (required, forbidden) in CONTRACT.items() for c in [*required, *forbidden]))
def c1(t: Tables) -> DataFrame:
    """Which required and forbidden columns two tables have."""
    out = None
    for name, (required, forbidden) in CONTRACT.items():
        table = t(name)
        cells = [F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.lit(c in required).alias("required"), F.lit(c in table.columns).alias("present"))
                 for c in [*required, *forbidden]]
        part = table.agg(F.count(F.lit(1)).alias("rows")).select(F.inline(F.array(*cells)), "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("a5_curve_pair", f"""
select vec_id as row_id, 2 as parameters, {r('vec_id + embedding[1]::double')} as total, {r('list_sum(embedding::double[])')} as curve_sum from embeddings where label % 2 = 0""")
def a5(t: Tables) -> DataFrame:
    pair = readers.read_curve_pair(t.spark, *_write_pair(t, landing_folder(t.spark), "even", 0), positions=CURVE)
    return pair.select("row_id", F.size("params").alias("parameters"), r6(F.col("params")[0] + F.col("params")[1]).alias("total"),
                       r6(F.aggregate("curve", F.lit(0.0), lambda a, v: a + v)).alias("curve_sum")).withColumn("row_id", F.col("row_id").cast("long"))


@query("a6_curve_registry", f"""
select case when label % 2 = 0 then 'even' else 'odd' end as dataset, count(*) as designs, {r('avg(list_max(embedding::double[]))')} as mean_peak from embeddings group by 1""")
def a6(t: Tables) -> DataFrame:
    place = landing_folder(t.spark)
    pairs = {name: _write_pair(t, place, name, odd) for odd, name in enumerate(("even", "odd"))}
    both = readers.read_curve_registry(t.spark, pairs, positions=CURVE)
    return rounded(both.groupBy("dataset").agg(F.count(F.lit(1)).alias("designs"), F.avg(F.array_max("curve")).alias("mean_peak")))


@query("a11_csv_export", f"select l_suppkey, count(*) as rows, {r('sum(l_quantity)')} as quantity from lineitem group by 1")
def a11(t: Tables) -> DataFrame:
    place = landing_folder(t.spark)
    table = t("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity"))
    sinks.export_csv(table, f"{place}/csv", compress=True)
    return rounded(readers.read_table(t.spark, f"{place}/csv", table.schema, "l_suppkey"))


@query("a12_json_documents", """
select o_orderstatus as status, count(*) as orders, max(o_orderpriority) as last_priority from orders group by 1""")
def a12(t: Tables) -> DataFrame:
    table = t("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("orders"), F.max("o_orderpriority").alias("last_priority"))
    place = landing_folder(t.spark)
    sinks.write_document(sinks.as_document(table), f"{place}/json")
    back = t.spark.read.schema("document string").json(f"{place}/json")
    return back.select(F.from_json("document", table.schema).alias("d")).select("d.*")


@query("a13_results_tree", f"""
select l_returnflag as target, l_linestatus as method, l_suppkey, {r('avg(l_discount)')} as rate from lineitem where l_returnflag = 'R' group by 1, 2, 3""")
def a13(t: Tables) -> DataFrame:
    """Results per target and method as folders; reading one target prunes the others."""
    table = t("lineitem").groupBy(F.col("l_returnflag").alias("target"), F.col("l_linestatus").alias("method"), "l_suppkey").agg(
        F.avg("l_discount").alias("rate"))
    place = landing_folder(t.spark)
    sinks.write_results(table, place)
    return rounded(readers.read_results(t.spark, place).filter("target = 'R'").select("target", "method", "l_suppkey", "rate"))


@query("a14_parameter_tables", f"""
with {LONG_SQL}, lx as (select * from lf where feature <> 'one' and is_reference)
select substr(a.feature, 2)::int as i, substr(b.feature, 2)::int as j, {r('covar_samp(a.value, b.value)')} as value from lx a join lx b using (vec_id) group by 1, 2""")
def a14(t: Tables) -> DataFrame:
    """A fitted matrix saved as rows, loaded as a matrix and shown again as rows."""
    place = landing_folder(t.spark)
    fitted = covariance.matrices(covariance.sample_covariance(reference(t), [], XS), [], len(XS))[()]
    sinks.save_matrix(t.spark, place, "reference", fitted)
    back = sinks.load_matrix(t.spark, place, "reference")
    cells = [(i, j, float(back[i, j])) for i in range(len(XS)) for j in range(len(XS))]
    return rounded(t.spark.createDataFrame(cells, "i int, j int, value double"))


@query("b2_feature_arms", f"""
select 'p_size' as feature, count(*) as rows, {r('avg(p_size)')} as mean from part union all select 'p_retailprice', count(*), {r('avg(p_retailprice)')} from part""")
def b2(t: Tables) -> DataFrame:
    """Numeric columns that are not labels, chosen from the schema."""
    p = t("part")
    chosen = readers.feature_columns(p, ["p_partkey"])
    long = p.select(F.lit(0).alias("_k"), *[F.col(c).cast("double").alias(c) for c in chosen]).unpivot(["_k"], chosen, "feature", "value")
    return rounded(long.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.avg("value").alias("mean")))


@query("b14_hidden_columns", "select count(*) as rows, 9 as columns_left from lineitem")
def b14(t: Tables) -> DataFrame:
    """Columns a deployed method may not see are dropped and checked."""
    seen = readers.without_columns(t("lineitem"), ["l_returnflag", "l_linestatus"])
    return seen.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns_left", F.lit(len(seen.columns)))
