"""Sorts, limits, deduplication, arg-min, skyline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotegrid.functions.exprs import half_even


def sort_nulls_last(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(F.col(column).asc_nulls_last())


def full_row_distinct(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def smallest(df: DataFrame, column: str, k: int, tie_break: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(column).asc_nulls_last(), *tie_break).limit(k)


def best_model(df: DataFrame, keys: Sequence[str], score: str, valid: str, converged: str, tie_break: str) -> DataFrame:
    """Lowest score among valid rows, else among converged ones with a note."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(~F.col(valid), F.col(score), F.col(tie_break)))
    out = df.where(F.col(valid) | F.col(converged)).groupBy(*keys).agg(pick.alias("__p"))
    return out.select(
        *keys,
        *[F.col(f"__p.{c}").alias(c) for c in rest],
        F.when(~F.col(f"__p.{valid}"), F.lit("no valid model; best converged one taken")).alias("note"),
    )


def latest_row(df: DataFrame, keys: Sequence[str], date_col: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    r = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(date_col)).alias("__r"))
    return r.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def latest_momentum(
    df: DataFrame, keys: Sequence[str], date_col: str, lag_columns: Sequence[str], power: int = 7
) -> DataFrame:
    """Sum of the lag columns in the newest row, rounded half-even to 10**power."""
    last = latest_row(df.select(*keys, date_col, *lag_columns), keys, date_col)
    total = sum((F.col(c) for c in lag_columns[1:]), F.col(lag_columns[0]))
    return last.select(*keys, date_col, half_even(total, -power).alias("momentum"))


def pareto_frontier(df: DataFrame, x: str, y: str, ranges: int = 64) -> DataFrame:
    """Non-dominated rows (small x, large y); equal points all survive.

    Rows collapse to the best y per x first. The best y over strictly smaller x is
    a running maximum built from range maxima plus a window inside each range, so
    no self-join and no single-task sort of all rows.
    """
    best = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x).agg(F.max(y).alias("__y"))
    probs = [i / ranges for i in range(1, ranges)]
    cuts = best.agg(F.percentile_approx(x, probs, F.lit(10 * ranges)).alias("__cuts")).scalar()
    placed = best.withColumn("__cuts", cuts)
    placed = placed.withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(x)))).drop("__cuts")
    tops = placed.groupBy("__range").agg(F.max("__y").alias("__top"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("__range", F.max("__top").over(earlier).alias("__before"))  # at most `ranges` rows
    inside = Window.partitionBy("__range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    keep = (
        placed.join(tops, "__range")
        .withColumn("__run", F.greatest(F.col("__before"), F.max("__y").over(inside)))
        .where(F.col("__run").isNull() | (F.col("__y") > F.col("__run")))
        .select(F.col(x).alias("__kx"), F.col("__y").alias("__ky"))
    )
    return df.join(keep, (df[x] == keep["__kx"]) & (df[y] == keep["__ky"]), "left_semi")


def reduced_search_order(df: DataFrame, priority_count: str, size: str, k: int, tie_break: str) -> DataFrame:
    return df.orderBy(F.desc(priority_count), F.desc(size), tie_break).limit(k)


__all__ = [
    "best_model",
    "full_row_distinct",
    "latest_momentum",
    "latest_row",
    "pareto_frontier",
    "reduced_search_order",
    "smallest",
    "sort_nulls_last",
]
