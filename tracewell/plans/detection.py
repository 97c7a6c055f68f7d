"""Calibrated detection: the end-to-end slice and the roll-ups that report it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import r6, ratio, wilson
from tracewell.plans.registry import Tables, bounds, query, r
from tracewell.plans.views import BLOCKS_SQL, blocks


def record_table(b: DataFrame) -> DataFrame:
    """Blocks, alarms, alarm rate and scores per record."""
    return (b.groupBy("record_id", "role")
            .agg(F.count(F.lit(1)).alias("blocks"), F.count_if("alarm").alias("alarms"),
                 F.avg("score").alias("mean_score"), F.max("score").alias("max_score"))
            .withColumn("block_alarm_rate", ratio("alarms", "blocks")))


_lo, _hi = bounds("alarms", "blocks")


@query("detected_records", f"""
with {BLOCKS_SQL},
rec as (select record_id, role, count(*) as blocks, count(*) filter (where alarm) as alarms,
               avg(score) as mean_score, max(score) as max_score from blk group by 1, 2)
select record_id, role, blocks, alarms, {r('mean_score')} as mean_score, {r('max_score')} as max_score,
       {r('alarms::double / blocks')} as block_alarm_rate, {r(_lo)} as wilson_low, {r(_hi)} as wilson_high
from rec""")
def detected_records(t: Tables) -> DataFrame:
    """Which records raise a calibrated alarm, and how often."""
    low, high = wilson("alarms", "blocks")
    return record_table(blocks(t)).select(
        "record_id", "role", "blocks", "alarms", r6("mean_score").alias("mean_score"),
        r6("max_score").alias("max_score"), r6("block_alarm_rate").alias("block_alarm_rate"),
        r6(low).alias("wilson_low"), r6(high).alias("wilson_high"))
