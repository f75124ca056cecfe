"""Unpivots and explodes at the edges of the engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegrid.operators.joins import scenario_grid
from quotegrid.functions.exprs import half_even


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "range", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def melt_with_context(
    ci: DataFrame,
    context: DataFrame,
    ids: Sequence[str],
    ranges: Sequence[str],
    on: Sequence[str] = (),
    output_type: str = "output_type",
    dollar_power: int = 7,
    pct_decimals: int = 2,
) -> DataFrame:
    """Long intervals joined to the latest context row per series, rounded by output type."""
    long = melt(ci, ids, ranges)
    joined = long.join(context, list(on)) if on else scenario_grid(long, context)
    return joined.withColumn(
        "value",
        F.when(F.col(output_type) == "dollars", half_even("value", -dollar_power)).otherwise(
            half_even("value", pct_decimals)
        ),
    )


def forecast_export(df: DataFrame, keys: Sequence[str], date_col: str, metrics: Sequence[str]) -> DataFrame:
    return melt(df, [*keys, date_col], metrics, "metric_type", "value")


def explode_replicates(df: DataFrame, ids: Sequence[str], lists: Sequence[str], position: str = "replicate") -> DataFrame:
    """Parallel arrays to one row per element, with its one-based position."""
    return df.select(
        *ids, F.posexplode(F.arrays_zip(*[F.col(c).alias(c) for c in lists])).alias("__pos", "__z")
    ).select(*ids, (F.col("__pos") + 1).alias(position), *[F.col(f"__z.{c}").alias(c) for c in lists])
