"""Session helpers: a local builder for tests and the two settings the operators read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_CHUNK = "spark.tracewell.rowsPerChunk"
BROADCAST_ROWS = "spark.tracewell.broadcastRows"
DEFAULT_ROWS_PER_CHUNK = 2_000_000
DEFAULT_BROADCAST_ROWS = 20_000


def local_session(cores: str = "8", app: str = "tracewell") -> SparkSession:
    """Build a single-JVM session; on a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def rows_per_chunk(spark: SparkSession) -> int:
    """Largest number of rows one ordered task should hold."""
    return int(spark.conf.get(ROWS_PER_CHUNK, str(DEFAULT_ROWS_PER_CHUNK)))


def broadcast_rows(spark: SparkSession) -> int:
    """Largest reference set that is shipped whole to every task."""
    return int(spark.conf.get(BROADCAST_ROWS, str(DEFAULT_BROADCAST_ROWS)))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a fresh local folder only where it is unset and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later passes read the file, not the sources."""
    place = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys in which null meets null; the keys appear once, from the left."""
    if not keys:
        return left.join(right, keys, how)
    there = {k: f"_right_{k}" for k in keys}
    renamed = right.withColumnsRenamed(there)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(there[k]))
    return left.join(renamed, same, how).drop(*there.values())
