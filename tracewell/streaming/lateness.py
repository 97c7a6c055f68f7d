"""Rows that arrive behind the watermark, kept in a table of their own instead of being dropped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell import session


def split_late(stream: DataFrame, ts: str, late: str, place: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Process everything available and return (rows in time, late rows) of all runs over the folder ``place``.

    A row is late when its time lies more than ``late`` before the newest time of all earlier
    micro-batches, which is Spark's own watermark rule. Late rows carry their ``watermark`` and
    the ``batch`` they came in. Rows without a time are in time. Every batch writes its rows and its newest
    time to folders named by its number, so a repeated batch overwrites itself.
    """
    spark = stream.sparkSession
    place = place or f"{session.shared_folder(spark)}/late-{uuid.uuid4().hex}"
    clock_shape = "newest timestamp, batch long"
    shape = stream.select("*", F.lit(None).cast("timestamp").alias("watermark"), F.lit(0).cast("long").alias("batch")).schema
    spark.createDataFrame([], clock_shape).write.mode("overwrite").parquet(f"{place}/clock/part=none")
    spark.createDataFrame([], shape).write.mode("overwrite").parquet(f"{place}/rows/part=none")

    def place_batch(batch: DataFrame, number: int) -> None:
        seen = spark.read.schema(clock_shape).parquet(f"{place}/clock/part=*").filter(F.col("batch") < number)
        newest = seen.agg(F.max("newest")).first()[0]  # one time from one row per batch
        mark = F.lit(newest).cast("timestamp") - F.expr(f"interval {late}")
        behind = batch.select("*", mark.alias("watermark"), F.lit(number).cast("long").alias("batch"))
        behind.withColumn("watermark", F.when(F.col(ts) < F.col("watermark"), F.col("watermark"))).write.mode("overwrite").parquet(f"{place}/rows/part={number}")
        (spark.read.schema(shape).parquet(f"{place}/rows/part={number}").agg(F.max(ts).cast("timestamp").alias("newest"))
         .select("newest", F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{place}/clock/part={number}"))

    query = (stream.writeStream.foreachBatch(place_batch).option("checkpointLocation", f"{place}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.schema(shape).parquet(f"{place}/rows/part=*")
    return rows.filter("watermark is null").drop("watermark", "batch"), rows.filter("watermark is not null")
