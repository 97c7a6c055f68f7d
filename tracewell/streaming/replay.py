"""Replay a stored table as a stream and land the result in a table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tracewell import session


def landing_folder(spark: SparkSession) -> str:
    """A fresh folder under the shared one."""
    return f"{session.shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, folder: str, table: str, *, files_per_batch: int = 1000) -> DataFrame:
    """Files of one stored table in arrival order, with the stored schema."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
               "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
               "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State on disk with bounded memory for streams that start inside; timers need it."""
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def run_to_table(stream: DataFrame) -> DataFrame:
    """Process everything that is available, commit it exactly once to Parquet and return the table."""
    spark = stream.sparkSession
    place = landing_folder(spark)
    with rocksdb(spark):
        query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/checkpoint")
                 .option("path", f"{place}/data").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/data")
