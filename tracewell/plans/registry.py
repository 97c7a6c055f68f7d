"""Registry of the queries the repository exposes and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to one folder of parquet tables and their proven row counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._counts: dict[str, int] = {}
        self._largest: dict[tuple[str, str], int] = {}

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def rows(self, name: str, times: int = 1) -> int:
        """Row count of a table, read from the file footers once per query, times a growth factor."""
        if name not in self._counts:
            self._counts[name] = self(name).count()
        return self._counts[name] * times

    def largest(self, name: str, key: str) -> int:
        """Rows of the largest group of a table, counted once per query."""
        if (name, key) not in self._largest:
            self._largest[name, key] = self(name).groupBy(key).count().agg({"count": "max"}).first()[0] or 0
        return self._largest[name, key]


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its optional DuckDB check."""

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query name: {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def r(expr: str) -> str:
    """SQL text that rounds as ``functions.scalars.r6`` does."""
    return f"(round(cast({expr} as double) + 1e-9::double, 6) + 0.0)"


def bounds(k: str, n: str, z: float = 1.959963984540054, clamp: bool = True) -> tuple[str, str]:
    """SQL text of the two Wilson bounds."""
    p = f"({k}::double / nullif({n}, 0))"
    mid = f"({p} + {z * z}::double / (2 * {n}))"
    half = f"({z}::double * sqrt({p} * (1 - {p}) / {n} + {z * z}::double / (4.0::double * {n} * {n})))"
    den = f"(1 + {z * z}::double / {n})"
    low, high = f"({mid} - {half}) / {den}", f"({mid} + {half}) / {den}"
    return (f"greatest({low}, 0)", f"least({high}, 1)") if clamp else (low, high)
