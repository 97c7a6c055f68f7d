"""File inventories, record discovery and frozen-input verification."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.contracts import ContractError, duplicate_rows, enforce


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, name, bytes, MD5 and SHA-256 of every file; each file must fit one row (2 GB)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "true").load(path))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"),
                        F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def changed_inputs(current: DataFrame, frozen: DataFrame, key: Sequence[str], digest: str) -> DataFrame:
    """Current inputs whose digest is not the frozen one, including inputs that were never frozen."""
    return current.join(frozen.select(*key, digest), [*key, digest], "left_anti")


def verify_frozen(current: DataFrame, frozen: DataFrame, key: Sequence[str], digest: str) -> None:
    """Raise when an input changed, appeared or vanished since the manifest was frozen."""
    enforce(changed_inputs(current, frozen, key, digest), "input differs from the frozen manifest")
    enforce(changed_inputs(frozen, current, key, digest), "frozen input is missing")


def discover_records(files: DataFrame, name: str, grammar: Callable[[str], Column], condition: Sequence[str],
                     order: Sequence[str]) -> DataFrame:
    """Parsed records in canonical order; names outside the grammar are skipped, repeated conditions raise."""
    found = files.withColumn("_label", grammar(name)).filter(F.col("_label").isNotNull()).select(*files.columns, "_label.*")
    if not found.take(1):
        raise ContractError("no file matches the record grammar")
    enforce(duplicate_rows(found, condition), "two files describe one condition")
    return found.orderBy(*[F.col(c).asc_nulls_first() for c in order])


def ledger(records: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """Keep every record with a status and the first failing reason."""
    reason = F.lit(None).cast("string")
    for text, failed in reversed(list(checks)):
        reason = F.when(F.coalesce(failed, F.lit(True)), F.lit(text)).otherwise(reason)
    return records.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected"))


def canonical_aliases(files: DataFrame, digest: str, order: Sequence[str]) -> DataFrame:
    """The first file of each content hash in the given order, with the number of copies."""
    first = F.min(F.struct(*order, *[c for c in files.columns if c not in order]))
    return files.groupBy(digest).agg(first.alias("_f"), F.count(F.lit(1)).alias("copies")).select("_f.*", "copies")
