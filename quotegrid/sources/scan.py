"""Scans: parquet prefixes, role loaders with declared contracts, snapshots, CSV.

The URI decides where the data lives (local path, s3a, hdfs); filters and column
selection stay in the plan so that Catalyst pushes them into the file scan.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotegrid.functions.exprs import normalise_missing


def scan_parquet(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    merge_schema: bool = False,
    require_rows: bool = False,
) -> DataFrame:
    """One distributed scan of every parquet part below ``path``."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if merge_schema:
        reader = reader.option("mergeSchema", "true")
    paths = [path] if isinstance(path, str) else list(path)
    df = reader.parquet(*paths)
    if require_rows and df.isEmpty():
        raise ValueError(f"no rows below {paths}")
    return df


def scan_with_filter(df: DataFrame, column: str, value: object) -> DataFrame:
    """Equality filter applied at the scan; skipped when the column is absent."""
    return df.where(F.col(column) == value) if column in df.columns else df


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def load_sales(df: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """Select the contract columns; ``roles`` maps the engine's name to the source's name."""
    require_columns(df, list(roles.values()))
    return normalise_missing(df.select(*[F.col(src).alias(name) for name, src in roles.items()]))


def load_quotes(
    df: DataFrame,
    date_col: str = "date",
    rate_marker: str = "rate",
    min_rate_columns: int = 5,
    start: str | None = None,
    start_col: str = "effective_date",
) -> DataFrame:
    """Rate quotes: a date column and enough rate columns; optional lower date bound."""
    require_columns(df, [date_col])
    found = [c for c in df.columns if rate_marker in c.lower()]
    if len(found) < min_rate_columns:
        raise ValueError(f"expected {min_rate_columns} columns containing {rate_marker!r}, found {found}")
    if start is not None and start_col in df.columns:
        df = df.where(F.col(start_col) >= F.lit(start).cast("date"))
    return normalise_missing(df)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_snapshot(spark: SparkSession, path: str, snapshot_date: str | None = None) -> DataFrame:
    """One snapshot of a table partitioned by ``snapshot_date``; the newest by default.

    The newest date comes from the folder names, so no file of an older snapshot is opened.
    """
    df = spark.read.parquet(path)
    if snapshot_date is None:
        dates = {m[1] for f in df.inputFiles() if (m := re.search(r"/snapshot_date=([^/]+)/", f))}
        if not dates:
            raise ValueError(f"no snapshot below {path}")
        snapshot_date = max(dates)
    return df.where(F.col("snapshot_date") == F.lit(snapshot_date).cast("date"))


def cast_or_count(df: DataFrame, column: str, to: str) -> tuple[DataFrame, Column]:
    """Cast with NULL on failure, plus the aggregate that counts the failures."""
    cast = F.col(column).try_cast(to)
    failures = F.count(F.when(F.col(column).isNotNull() & cast.isNull(), 1))
    return df.withColumn(column, cast), failures
