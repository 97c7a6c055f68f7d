"""Helpers of the training-data operators: shared tables, prefix sums, components, word splitting."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell import session

#: Rows of one ordered task in a prefix sum, and the largest number of such tasks before they grow.
ROWS_PER_BUCKET = 20_000
MAX_BUCKETS = 8_192


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one."""
    return f"{session.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write to a Parquet table in the shared folder and read it back: the lineage ends at replicated files."""
    spark = df.sparkSession
    place = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes; null is the empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z: bytes.lower and bytes.split do exactly that."""
    return text.lower().split()


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows of the same keys.

    ``bucket`` is a non-decreasing function of the order inside a key, so that no key is ordered in one task: rows are
    ordered inside (key, bucket), and a table with one row per (key, bucket) carries the earlier buckets' sums.
    """
    part = [F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select("*", *part, bucket.alias("_b"))
    sizes = rows.groupBy(*names, "_b").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*names, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*names, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (placed.join(starts, [*names, "_b"]).withColumn(out, F.col("_before") + F.col("_in"))
            .drop("_before", "_in", "_b", *names))


def fingerprint_of(df: DataFrame) -> tuple:
    """Row count and order-free hash sum, to see whether a round changed anything."""
    found = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return tuple(found)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node of every connected component, as (node, root), for edges (a, b) of one orderable type.

    Alternating large and small stars: every step is a grouped minimum and a join, so no component meets in one task,
    and the number of rounds grows with the logarithm of its diameter. Nodes without an edge do not appear.
    """
    pairs = landed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = fingerprint_of(pairs)
    for _ in range(rounds):
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
                 .select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct())
        pairs = landed(small, "stars")
        now = fingerprint_of(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
