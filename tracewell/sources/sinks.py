"""Table, document and parameter sinks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> None:
    """Parquet, the main format; partition columns become folders."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_results(df: DataFrame, root: str, keys: Sequence[str] = ("target", "method")) -> None:
    """Add or replace the folders of the given keys only, so folds can be written one after another."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(root)


def export_csv(df: DataFrame, path: str, *, compress: bool = False) -> None:
    """CSV export; arrays become space-separated text because CSV has no nested values."""
    named = [(F.col(f"`{c}`"), c, t) for c, t in df.dtypes]  # names may hold points
    flat = df.select(*[F.array_join(x.cast("array<string>"), " ").alias(c) if t.startswith("array") else x for x, c, t in named])
    flat.write.mode("overwrite").option("header", "true").option("compression", "gzip" if compress else "none").csv(path)


def write_document(df: DataFrame, path: str) -> None:
    """One JSON object per row, for summaries and run metadata."""
    df.write.mode("overwrite").json(path)


def as_document(df: DataFrame, name: str = "document") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def save_matrix(spark: SparkSession, path: str, name: str, matrix: np.ndarray) -> None:
    """A small fitted matrix as (name, i, j, value) rows."""
    cells = [(name, i, j, float(matrix[i, j])) for i in range(matrix.shape[0]) for j in range(matrix.shape[1])]
    write_table(spark.createDataFrame(cells, "name string, i int, j int, value double"), path)


def load_matrix(spark: SparkSession, path: str, name: str) -> np.ndarray:
    cells = spark.read.parquet(path).filter(F.col("name") == name).collect()
    out = np.zeros((max(c["i"] for c in cells) + 1, max(c["j"] for c in cells) + 1))
    for c in cells:
        out[c["i"], c["j"]] = c["value"]
    return out
