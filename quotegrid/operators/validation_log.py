"""A log of validation runs: one partition per (name, version), written again when a run is repeated.

Entries are kept as a table in the folder that the caller names. Each version has its own partition, so a repeated
run replaces its entry and no other, and readers prune to the versions they ask for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotegrid.operators import quality as dq

KEPT = 50
PARTS = ["name", "version"]


def append(entries: DataFrame, path: str, name: str, version: int) -> None:
    """Writes the entry of one version; what a failed or repeated run left there is replaced."""
    (
        entries.withColumns({"name": F.lit(name), "version": F.lit(version).cast("bigint")})
        .coalesce(1)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTS)
        .parquet(path)
    )


def read(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """All entries of a name, None while nothing was ever written."""
    try:
        log = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return log.where(F.col("name") == name).withColumn("version", F.col("version").cast("bigint"))


def before(spark: SparkSession, path: str, name: str, version: int) -> DataFrame | None:
    """The entry of the latest version before ``version``; None if there is none."""
    log = read(spark, path, name)
    latest = log.where(F.col("version") < version).agg(F.max("version")).first()[0] if log is not None else None
    return None if latest is None else log.where(F.col("version") == latest).drop(*PARTS)


def history(spark: SparkSession, path: str, name: str, last: int = KEPT) -> DataFrame | None:
    """Entries of the last versions."""
    log = read(spark, path, name)
    if log is None:
        return None
    versions = log.select("version").distinct().orderBy(F.desc("version")).limit(last)
    return log.join(F.broadcast(versions), "version")  # at most ``last`` rows


def checkpoint(
    df: DataFrame, date_col: str, rules: Sequence[tuple[str, Column, int, bool]], path: str, name: str, version: int, **limits: float
) -> DataFrame:
    """Validates a table against its rules and the run before this version, and logs metrics and verdict."""
    spark = df.sparkSession
    now = dq.table_metrics(df, date_col)
    previous = before(spark, path, name, version)
    drift = None if previous is None else dq.metric_drift(now, previous.select(*now.columns), **limits)
    verdict = dq.checkpoint_status(drift, dq.row_rules(df, rules))
    growth = F.lit(None).cast("double").alias("growth_pct") if drift is None else F.col("growth_pct")
    entry = now.crossJoin(verdict)  # one row each
    entry = entry.select("*", growth) if drift is None else entry.crossJoin(drift.select("growth_pct"))
    append(entry, path, name, version)
    return read(spark, path, name).where(F.col("version") == version)


def schema_version(df: DataFrame, path: str, name: str, version: int, date_col: str | None = None) -> DataFrame:
    """Logs the fingerprint of a table and returns its changes against the version before (none for the first)."""
    spark = df.sparkSession
    previous = before(spark, path, name, version)
    append(dq.fingerprint(df, date_col), path, name, version)
    now = read(spark, path, name).where(F.col("version") == version).drop(*PARTS)
    return dq.evolution(now if previous is None else previous, now)


def schema_history(spark: SparkSession, path: str, name: str, last: int = KEPT) -> DataFrame | None:
    """Per logged version: columns, rows, hashes, and the share of columns that it and the version before have in common."""
    log = history(spark, path, name, last)
    if log is None:
        return None
    tables = log.groupBy("version").agg(
        F.count(F.lit(1)).alias("n_columns"), F.max("n_rows").alias("n_rows"), F.max("n_duplicates").alias("n_duplicates"),
        F.max("schema_hash").alias("schema_hash"), F.max("content_hash").alias("content_hash"), F.collect_set("column_name").alias("__cols"),
    )
    earlier = Window.partitionBy(F.lit(0)).orderBy("version")  # at most ``last`` rows
    was = F.lag("__cols").over(earlier)
    common = F.size(F.array_intersect("__cols", was)) / F.size(F.array_union("__cols", was))
    return tables.withColumn("compatibility", common).drop("__cols")
