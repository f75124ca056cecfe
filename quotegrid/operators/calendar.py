"""Gap-free daily and weekly series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotegrid.functions.exprs import col, week_ending_sunday
from quotegrid.operators.windows import series_window, trailing_mean, trailing_mean_strict


def date_spine(spark: SparkSession, start: str, end: str, step_days: int = 1) -> DataFrame:
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    return spark.range(1).select(
        F.explode(F.sequence(s, e, F.make_dt_interval(F.lit(step_days)))).alias("date")
    )


def spine_of(df: DataFrame, date_col: str, keys: Sequence[str] = (), step_days: int = 1) -> DataFrame:
    """Every date between the first and last one of each series, built on the executors."""
    bounds = df.groupBy(*keys).agg(F.min(date_col).alias("__lo"), F.max(date_col).alias("__hi"))
    days = F.sequence("__lo", "__hi", F.make_dt_interval(F.lit(step_days)))
    return bounds.select(*keys, F.explode(days).alias(date_col))


def fill_gaps(df: DataFrame, date_col: str, keys: Sequence[str] = (), step_days: int = 1, end: Column | None = None) -> DataFrame:
    """Repeat each row of a dated series up to the day before the next one.

    ``df`` has one row per key and date. ``__first`` marks the original rows; the last
    row of a series runs to ``end`` when given. The window that finds the next date uses
    the partitioning later windows need, so filling costs no join and no extra shuffle.
    """
    following = F.lead(date_col).over(series_window(keys, date_col))
    last = F.coalesce(F.date_sub(following, step_days), F.col(date_col) if end is None else end)
    days = F.sequence(F.col(date_col), F.greatest(last, F.col(date_col)), F.make_dt_interval(F.lit(step_days)))
    cols = [c for c in df.columns if c != date_col]
    return (
        df.withColumn("__days", days)
        .select(*cols, F.col(date_col).alias("__from"), F.explode("__days").alias(date_col))
        .withColumn("__first", F.col(date_col) == F.col("__from"))
        .drop("__from")
    )


def daily_total(df: DataFrame, date: str | Column, value: str | Column, keys: Sequence[str], out: str) -> DataFrame:
    return df.groupBy(*keys, col(date).cast("date").alias("date")).agg(F.sum(value).alias(out))


def gap_filled_daily(
    df: DataFrame, date: str | Column, value: str | Column, keys: Sequence[str], out: str = "sales", smooth: int = 14
) -> DataFrame:
    """Daily sums with absent days as 0, and the trailing mean of the filled series."""
    grid = fill_gaps(daily_total(df, date, value, keys, "__raw"), "date", keys)
    grid = grid.select(*keys, "date", F.when(F.col("__first"), F.coalesce("__raw", F.lit(0.0))).otherwise(0.0).alias(out))
    return grid.withColumn(f"{out}_smooth", trailing_mean(out, keys, "date", smooth))


def last_by(c: str | Column, order: str | Column) -> Column:
    """Last non-null value in date order."""
    c = col(c)
    return F.max_by(c, F.when(c.isNotNull(), col(order)))


def weekly(
    df: DataFrame, how: Mapping[str, str], keys: Sequence[str] = (), date_col: str = "date", fill_weeks: bool = True
) -> DataFrame:
    """Weeks ending on Sunday; ``how`` maps column -> mean | sum | last | count.

    Empty weeks appear with sum and count 0 and everything else NULL.
    """
    build = {
        "mean": lambda c: F.avg(c),
        "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
        "last": lambda c: last_by(c, date_col),
        "count": lambda c: F.count(c),
    }
    agg = (
        df.withColumn("__week", week_ending_sunday(date_col))
        .groupBy(*keys, "__week")
        .agg(*[build[h](c).alias(c) for c, h in how.items()])
        .withColumnRenamed("__week", date_col)
    )
    if not fill_weeks:
        return agg
    first = F.col("__first")
    empty = {"sum": lambda c: F.when(first, F.col(c)).otherwise(0), "count": lambda c: F.when(first, F.col(c)).otherwise(0)}
    keep = lambda c: F.when(first, F.col(c))
    return fill_gaps(agg, date_col, keys, 7).select(
        *keys, date_col, *[empty.get(h, keep)(c).alias(c) for c, h in how.items()]
    )


def weekly_smoothed(
    df: DataFrame,
    how: Mapping[str, str],
    smooth: Sequence[str],
    window: int,
    keys: Sequence[str] = (),
    date_col: str = "date",
) -> DataFrame:
    """Weekly table plus strict trailing means and seasonal dummies."""
    out = weekly(df, how, keys, date_col)
    out = out.withColumns({f"{c}_smooth": trailing_mean_strict(c, keys, date_col, window) for c in smooth})
    return out.select(
        "*",
        *[(F.quarter(date_col) == q).cast("int").alias(f"q{q}") for q in range(1, 5)],
        *[(F.month(date_col) == m).cast("int").alias(f"month_{m}") for m in range(1, 13)],
    )


def missing_periods(df: DataFrame, date_col: str, keys: Sequence[str], step_days: int) -> DataFrame:
    """Expected grid dates that were not observed."""
    seen = df.select(*keys, date_col).distinct()
    return spine_of(df, date_col, keys, step_days).join(seen, [*keys, date_col], "left_anti")
