"""Working views over the provided tables, each as a DataFrame and as equal SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import conformal, scaling
from tracewell.operators.ordered import with_position
from tracewell.plans.registry import Tables

WINDOWS_PER_BLOCK = 5
ALPHA = 0.05

WINDOWS_SQL = """
w0 as (
  select event_id, user_id as record_id, user_id % 3 as entity_id, (user_id % 8) * 5 as load,
         user_id % 5 <> 0 as is_healthy, value as x, event_type, ts,
         cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as window_id
  from events),
w as (
  select *, window_id // 5 as block_id,
         case when not is_healthy then 'fault_test' when record_id % 4 = 0 then 'adaptation'
              when record_id % 4 in (1, 2) then 'calibration' else 'health_test' end as role
  from w0)"""

SCORES_SQL = WINDOWS_SQL + """,
mid as (select median(x) as center from w where role = 'adaptation'),
dev as (select 1.4826::double * median(abs(x - center)) as mad, stddev_pop(x) as sd
        from w, mid where role = 'adaptation'),
fit as (select center, case when mad > 1e-8 * greatest(abs(center), 1) then mad
               when sd > 1e-8 * greatest(abs(center), 1) then sd else 1 end as scale from mid, dev),
sw as (select w.*, abs((x - center) / scale) as z from w, fit)"""

BLOCKS_SQL = SCORES_SQL + """,
b as (
  select record_id, any_value(entity_id) as entity_id, any_value(load) as load,
         any_value(is_healthy) as is_healthy, any_value(role) as role, block_id, max(z) as score
  from sw group by record_id, block_id having count(*) = 5),
cal as (select count(*) as n from b where role = 'calibration'),
pv as (
  select b.*, (1 + (select count(*) from b c where c.role = 'calibration' and c.score >= b.score))::double
              / (1 + (select n from cal)) as p_value
  from b),
blk as (select *, p_value <= 0.05::double as alarm from pv)"""


def with_record_labels(df: DataFrame) -> DataFrame:
    """Entity, load, health and role follow from the record id, so they are projected where needed."""
    rec = F.col("record_id")
    return df.withColumns({
        "entity_id": rec % 3, "load": rec % 8 * 5, "is_healthy": rec % 5 != 0,
        "role": F.when(rec % 5 == 0, "fault_test").when(rec % 4 == 0, "adaptation")
        .when((rec % 4).isin(1, 2), "calibration").otherwise("health_test")})


def windows(t: Tables) -> DataFrame:
    """Events as ordered windows of records with a block and a role."""
    e = t("events").select("event_id", "user_id", "value", "event_type", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"))
    placed = with_position(e, ["user_id"], ["_us", "event_id"], "window_id", rows=t.rows("events"), largest=t.largest("events", "user_id"))
    return with_record_labels(placed.select(
        "event_id", F.col("user_id").alias("record_id"), F.col("value").alias("x"), "event_type", "ts",
        F.col("window_id").cast("long"), F.floor(F.col("window_id") / WINDOWS_PER_BLOCK).alias("block_id")))


def scored_windows(t: Tables) -> DataFrame:
    """Windows with |x - center| / scale, fitted on adaptation rows."""
    w = windows(t)
    center, scale = scaling.fit_one(w.filter("role = 'adaptation'"), "x", rule="relative", rows=t.rows("events"))
    return w.withColumn("z", F.abs((F.col("x") - F.lit(center)) / F.lit(scale)))


def block_scores(t: Tables) -> DataFrame:
    """Largest window score of each complete block."""
    per = (scored_windows(t).groupBy("record_id", "block_id").agg(F.max("z").alias("score"), F.count(F.lit(1)).alias("_n"))
           .filter(F.col("_n") == WINDOWS_PER_BLOCK).drop("_n"))
    return with_record_labels(per)


def blocks(t: Tables) -> DataFrame:
    """Block scores with conformal p-values and alarms."""
    p = conformal.p_values(block_scores(t), [], "score", F.col("role") == "calibration", rows=t.rows("events"))
    return p.withColumn("alarm", F.col("p_value") <= F.lit(ALPHA))
