"""Typed readers: tables, profile folders, paired curves and registries of both."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.functions.scalars import all_finite
from tracewell.operators.contracts import ContractError, broken_runs, duplicate_rows, enforce, require_columns
from tracewell.operators.ordered import with_position


def discover_table(spark: SparkSession, folder: str, required: Sequence[str], *, prefer: str = "temperature") -> str:
    """Path of the first CSV under a tree whose header holds the required columns, preferred names first.

    Files are read by lines and only the first line of a file's first block is kept, so no file is held
    whole; the headers are compared on Spark and one path returns. A table that was written as a folder
    of part files goes by the folder's name.
    """
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(folder)
             .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"), "value")
             .filter("_start = 0").groupBy("path").agg(F.min_by("value", "_line").alias("header")))
    names = F.transform(F.split("header", ","), lambda c: F.trim(F.regexp_replace(c, '"', "")))
    fits = lines.filter(F.size(F.array_except(F.array(*[F.lit(c) for c in required]), names)) == 0)
    whole = F.regexp_replace("path", r"/part-[^/]*$", "")
    first = fits.select(whole.alias("path")).orderBy(~F.lower(F.element_at(F.split("path", "/"), -1)).contains(prefer), "path").take(1)
    if not first:
        raise ContractError(f"no CSV under {folder} has the columns {list(required)}")
    return first[0]["path"]


def read_table(spark: SparkSession, path: str, schema: StructType | str, key: str) -> DataFrame:
    """CSV with an explicit schema, no nulls in its columns and a long key."""
    df = spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path)
    missing = df.columns
    bad = df.filter(~F.forall(F.array(*[F.col(c).isNotNull() for c in missing]), lambda v: v))
    enforce(bad, "null values in a required column")
    return df.withColumn(key, F.col(key).cast("long"))


def read_profiles_strict(df: DataFrame, *, required: Sequence[str], profile: str, order: str, rows: int | None = None) -> DataFrame:
    """Finite, duplicate-free rows with a position index; each profile must be one contiguous run of ``order``."""
    require_columns(df, [*required, profile, order])
    enforce(df.filter(~all_finite(required)), "non-finite values")
    enforce(duplicate_rows(df, [*required, profile]), "duplicate rows")
    enforce(broken_runs(df, [order], profile, rows=rows), "a profile is not one contiguous run")
    return with_position(df, [profile], [order], "sample_idx", rows=rows)


def read_profile_folder(spark: SparkSession, folder: str, schema: StructType | str, *, line: str, pattern: str = "*.csv") -> DataFrame:
    """One CSV per profile, a file or a folder of part files: the id comes from the digits of its name, the order from a stored line column.

    All columns must be finite and no row of a profile may repeat; positions count from 0 in each profile.
    """
    raw = (spark.read.schema(schema).option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).csv(folder))
    own = F.regexp_extract(F.regexp_replace(F.col("_metadata.file_path"), r"/part-[^/]*$", ""), r"([^/]*)$", 1)
    named = raw.withColumn("profile_id", F.regexp_extract(own, r"(\d+)", 1).try_cast("long"))
    enforce(named.filter(F.col("profile_id").isNull()).select("profile_id"), "a file name holds no profile id")
    numbers = [n for n, kind in raw.dtypes if kind in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    enforce(named.filter(~all_finite(numbers)), "non-finite values")
    enforce(duplicate_rows(named, [*raw.columns, "profile_id"]), "duplicate rows")
    return with_position(named, ["profile_id"], [line], "sample_idx")


def read_curve_pair(spark: SparkSession, parameters: str, curves: str, *, row_id: str = "row_id", positions: int, tolerance: float = 1e-9) -> DataFrame:
    """Join a parameter table with a wide curve table whose headers are equally spaced positions.

    Both files carry the row id; Spark keeps no implicit row order.
    """
    p = spark.read.option("header", "true").option("inferSchema", "true").csv(parameters)
    c = spark.read.option("header", "true").option("inferSchema", "true").csv(curves)
    names = [n for n in c.columns if n != row_id]
    try:
        grid = [float(n) for n in names]
    except ValueError as error:
        raise ContractError("curve headers must be numbers") from error
    steps = [b - a for a, b in zip(grid, grid[1:])]
    if len(grid) != positions or any(s <= 0 or abs(s - steps[0]) > tolerance for s in steps):
        raise ContractError("curve headers are not an equally spaced grid of the expected length")
    params = [n for n in p.columns if n != row_id]
    arrays = c.select(row_id, F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("curve"))
    enforce(duplicate_rows(p, [row_id]).unionByName(duplicate_rows(arrays, [row_id])), "repeated row id")
    enforce(duplicate_rows(p, params), "repeated design")
    lost = p.select(row_id).join(arrays, row_id, "left_anti").unionByName(arrays.select(row_id).join(p, row_id, "left_anti"))
    enforce(lost, "a row has no partner")
    return p.select(row_id, F.array(*[F.col(n).cast("double") for n in params]).alias("params")).join(arrays, row_id)


def read_curve_registry(spark: SparkSession, pairs: Mapping[str, tuple[str, str]], *, positions: int) -> DataFrame:
    """Several curve data sets with equal schemas and grids, tagged by name."""
    out, shape = None, None
    for name, (parameters, curves) in pairs.items():
        df = read_curve_pair(spark, parameters, curves, positions=positions).withColumn("dataset", F.lit(name))
        header = spark.read.option("header", "true").csv(curves).columns, spark.read.option("header", "true").csv(parameters).columns
        if shape is not None and header != shape:
            raise ContractError(f"{name} has another grid or other parameters")
        shape = header
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ContractError("the registry is empty")
    return out


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """Results tree read back with its path parts as columns; filters on them prune folders."""
    return spark.read.parquet(root)


def feature_columns(df: DataFrame, metadata: Sequence[str], *, drop: Sequence[str] = ()) -> list[str]:
    """Numeric columns that are neither labels nor dropped, in table order."""
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    chosen = [c for c, t in df.dtypes if (t in kinds or t.startswith("decimal")) and c not in metadata and c not in drop]
    if not chosen:
        raise ContractError("no feature column is left")
    return chosen


def common_features(left: DataFrame, right: DataFrame, metadata: Sequence[str]) -> list[str]:
    both = set(feature_columns(right, metadata))
    return [c for c in feature_columns(left, metadata) if c in both]


def without_columns(df: DataFrame, hidden: Sequence[str]) -> DataFrame:
    """Drop unobservable columns and make sure none is left."""
    return require_columns(df.drop(*hidden), [], hidden)
