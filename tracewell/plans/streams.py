"""Streaming queries: the events table replayed as a stream gives the result of the batch rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import conformal
from tracewell.operators.report import rounded
from tracewell.plans.registry import Tables, query, r
from tracewell.streaming import monitor
from tracewell.streaming.lateness import split_late
from tracewell.streaming.replay import landing_folder, read_stream, run_to_table

LATE = "1 day"


def event_stream(t: Tables) -> DataFrame:
    e = read_stream(t.spark, t.folder, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


def landed(df: DataFrame) -> DataFrame:
    """Run the stream and return times as epoch seconds."""
    out = run_to_table(df)
    times = [c for c, k in out.dtypes if k == "timestamp"]
    return rounded(out.withColumns({c: F.unix_micros(c).cast("double") / 1e6 for c in times}))


CLOSED = "(select max(ts) - interval '1 day' from events)"


@query("n1_tumbling_windows", f"""
with g as (select user_id, date_trunc('day', ts) as s, count(*) as samples, avg(value) as m, sqrt(avg(value * value)) as q, max(value) as p from events group by 1, 2)
select user_id, {r('epoch(s)')} as start, {r("epoch(s + interval '1 day')")} as stop, samples, {r('m')} as mean, {r('q')} as rms, {r('p')} as peak from g where s + interval '1 day' <= {CLOSED}""")
def n1(t: Tables) -> DataFrame:
    return landed(monitor.tumbling_windows(event_stream(t), "ts", ["user_id"], "1 day", LATE, "value"))


@query("n2_sliding_windows", f"""
with e as (select user_id, value, unnest([date_trunc('day', ts), date_trunc('day', ts) - interval '1 day']) as s from events),
g as (select user_id, s, count(*) as samples, sqrt(avg(value * value)) as q from e group by 1, 2)
select user_id, {r('epoch(s)')} as start, {r("epoch(s + interval '2 days')")} as stop, samples, {r('q')} as rms from g where s + interval '2 days' <= {CLOSED}""")
def n2(t: Tables) -> DataFrame:
    return landed(monitor.sliding_windows(event_stream(t), "ts", ["user_id"], "2 days", "1 day", LATE, "value"))


@query("n3_sessions", f"""
with g as (select user_id, ts, value, case when ts - lag(ts) over (partition by user_id order by ts) < interval '12 hours' then 0 else 1 end as new from events),
k as (select *, sum(new) over (partition by user_id order by ts) as sid from g),
s as (select user_id, sid, min(ts) as a, max(ts) + interval '12 hours' as b, count(*) as samples, arg_min(value, ts) as f, max(value) as p from k group by 1, 2)
select user_id, {r('epoch_us(a) / 1e6::double')} as start, {r('epoch_us(b) / 1e6::double')} as stop, samples, {r('f')} as first_value, {r('p')} as peak from s where b <= {CLOSED}""")
def n3(t: Tables) -> DataFrame:
    return landed(monitor.sessions(event_stream(t), "ts", ["user_id"], "12 hours", LATE, "value"))


@query("n3_anchored_residuals", f"""
with k as (select user_id, ts, value, row_number() over (partition by user_id order by ts, value) as rn from events), a as (select user_id, median(value) as m from k where rn <= 2 group by 1)
select user_id, {r('epoch_us(ts) / 1e6::double')} as at, {r('value - m')} as residual from k join a using (user_id) where rn > 2""")
def n3b(t: Tables) -> DataFrame:
    return landed(monitor.anchored_residuals(event_stream(t), "user_id", "ts", "value"))


@query("n4_sustained_alarms", f"""
with k as (select user_id, ts, value > 20 as hot, sum((value <= 20)::int) over (partition by user_id order by ts) as run, row_number() over (partition by user_id order by ts) as rn from events),
h as (select *, row_number() over (partition by user_id, run order by ts) as inrun from k where hot),
f as (select user_id, run, min(ts) as a, min(ts) filter (where inrun = 4) as b from h group by 1, 2 having count(*) >= 4),
o as (select *, row_number() over (partition by user_id order by a) as first from f)
select user_id, {r('epoch_us(a) / 1e6::double')} as start, {r('epoch_us(b) / 1e6::double')} as confirmed from o where first = 1""")
def n4(t: Tables) -> DataFrame:
    return landed(monitor.sustained_alarms(event_stream(t), "user_id", "ts", F.col("value") > 20, 4, LATE))


@query("n5_frozen_threshold_alarms", f"""
with c as (select event_type, list_sort(list(value)) as s, count(*) as n from events where user_id % 4 = 0 group by 1),
h as (select event_type, s[ceil((n + 1) * (1 - 0.05::double))::int] as threshold from c)
select event_type, user_id, count(*) as events, count(*) filter (where value > threshold) as alarms, {r('any_value(threshold)')} as threshold from events join h using (event_type) group by 1, 2""")
def n5(t: Tables) -> DataFrame:
    frozen = conformal.threshold(t("events").filter("user_id % 4 = 0"), ["event_type"], "value", 0.05, rows=t.rows("events"))
    flagged = run_to_table(monitor.with_alarm(event_stream(t), frozen, ["event_type"], "value"))
    return rounded(flagged.groupBy("event_type", "user_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("alarm").alias("alarms"), F.max("threshold").alias("threshold")))


ARRIVALS = 4


@query("n6_late_rows", f"""
with n as (select max(event_id) + 1 as n from events),
a as (select event_type, ts, least({ARRIVALS - 1}, (event_id + case when event_id % 13 = 0 then n // {ARRIVALS} else 0 end) * {ARRIVALS} // n) as part from events, n),
w as (select part, max(max(ts)) over (order by part rows between unbounded preceding and 1 preceding) - interval '{LATE}' as mark from a group by 1)
select event_type, count(*) filter (where mark is null or ts >= mark) as in_time, count(*) filter (where ts < mark) as late, {r("coalesce(max(epoch_us(mark) - epoch_us(ts)) filter (where ts < mark), 0) / 1e6::double")} as latest_seconds
from a join w using (part) group by 1""")
def n6(t: Tables) -> DataFrame:
    """Events in arrivals of which every thirteenth comes one arrival too late; the late ones are kept and counted."""
    e = t("events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    n = e.agg(F.max("event_id")).first()[0] + 1
    behind = F.when(F.col("event_id") % 13 == 0, n // ARRIVALS).otherwise(0)
    part = F.least(F.lit(ARRIVALS - 1), F.floor((F.col("event_id") + behind) * ARRIVALS / n))
    place = landing_folder(t.spark)
    for k in range(ARRIVALS):
        e.filter(part == k).write.parquet(f"{place}/in/{k}")
        stream = t.spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(f"{place}/in")
        in_time, late = split_late(stream, "ts", LATE, f"{place}/split")
    gap = (F.unix_micros("watermark") - F.unix_micros("ts")) / 1e6
    both = in_time.select("event_type", F.lit(None).cast("double").alias("gap")).unionByName(late.select("event_type", gap.alias("gap")))
    return rounded(both.groupBy("event_type").agg(F.count_if(F.col("gap").isNull()).alias("in_time"), F.count("gap").alias("late"),
                                                  F.coalesce(F.max("gap"), F.lit(0.0)).alias("latest_seconds")))
