"""Sinks: snapshots, date partitions, named stage outputs, CSV bundles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, path: str, snapshot_date: str) -> None:
    (
        df.withColumn("snapshot_date", F.lit(snapshot_date).cast("date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date")
        .parquet(path)
    )


def with_date_parts(df: DataFrame, date_col: str) -> DataFrame:
    d = F.col(date_col)
    return df.withColumns({"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d)})


def write_by_day(df: DataFrame, path: str, date_col: str) -> None:
    """Overwrites only the days present in ``df``."""
    (
        with_date_parts(df, date_col)
        .repartition("year", "month", "day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "month", "day")
        .parquet(path)
    )


def stage_path(base: str, name: str, subdirectory: str = "") -> str:
    return "/".join(p.strip("/") if i else p.rstrip("/") for i, p in enumerate([base, subdirectory, name]) if p)


def save_stage(df: DataFrame, base: str, name: str, subdirectory: str = "") -> DataFrame:
    """Write a named stage and hand back the table read from storage (lineage ends here)."""
    target = stage_path(base, name, subdirectory)
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.parquet(target)


def load_stage(spark: SparkSession, base: str, name: str, subdirectory: str = "") -> DataFrame:
    return spark.read.parquet(stage_path(base, name, subdirectory))


def save_stages(frames: Mapping[str, DataFrame], base: str, stage: str) -> dict[str, DataFrame]:
    return {name: save_stage(df, base, name, stage) for name, df in frames.items()}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_bundle(tables: Mapping[str, DataFrame], base: str) -> list[str]:
    """One CSV folder per table."""
    out = []
    for name, df in tables.items():
        path = stage_path(base, name)
        write_csv(df, path)
        out.append(path)
    return out
