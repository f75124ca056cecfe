"""Filters, predicates and row-level cleaning. All lazy, all pushed down where the source allows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotegrid.functions.exprs import col, half_even, is_finite
from quotegrid.operators.quantiles import exact_quantiles
from quotegrid.operators.windows import series_window


def require_non_empty(df: DataFrame, what: str = "filter") -> DataFrame:
    """Opt-in action: raise when nothing survived. Not part of the lazy plan."""
    if df.isEmpty():
        raise ValueError(f"no rows left after {what}")
    return df


def equals(df: DataFrame, column: str, value: object) -> DataFrame:
    if column not in df.columns:
        raise ValueError(f"column {column!r} not found")
    return df.where(F.col(column) == F.lit(value))


def member_of(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def only_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def within(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    if not low < high:
        raise ValueError("low must be below high")
    return df.where(F.col(column).between(low, high))


def below_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """Rows strictly below the interpolated q-quantile of all rows (a scalar subquery)."""
    return df.where(F.col(column) < exact_quantiles(df, column, [q]).select("value").scalar())


def after(df: DataFrame, date_col: str, start: str) -> DataFrame:
    return df.where(F.col(date_col) > F.lit(start).cast("date"))


def mature_only(df: DataFrame, date_col: str, as_of: str, days: int = 50) -> DataFrame:
    """Batch guard for late data: drop periods whose contracts may still be settling."""
    return df.where(F.col(date_col) <= F.date_sub(F.lit(as_of).cast("date"), days))


def drop_last_period(df: DataFrame, date_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Drop the final, incomplete period of each series (grid tables)."""
    last = F.max(date_col).over(series_window(keys))
    return df.withColumn("__last", last).where(F.col(date_col) < F.col("__last")).drop("__last")


def business_filter(df: DataFrame, date_col: str, sales_col: str, start: str, keys: Sequence[str] = ()) -> DataFrame:
    kept = df.where((F.col(sales_col) != 0) & (F.col(date_col) > F.lit(start).cast("date")))
    return drop_last_period(kept, date_col, keys)


def training_filter(
    df: DataFrame,
    date_col: str,
    target: str,
    cutoff: int,
    before: str,
    holiday_col: str = "holiday",
    keys: Sequence[str] = (),
) -> DataFrame:
    """First ``cutoff`` rows of each series, then target present, no holiday, date before a bound."""
    w = series_window(keys, date_col)
    return (
        df.withColumn("__rn", F.row_number().over(w))
        .where(F.col("__rn") <= cutoff)
        .where(F.col(target).isNotNull() & (F.col(holiday_col) == 0) & (F.col(date_col) < F.lit(before).cast("date")))
        .drop("__rn")
    )


def temporal_filter(
    df: DataFrame, date_col: str, start: str = "2022-08-01", holiday_col: str | None = None
) -> DataFrame:
    out = after(df, date_col, start)
    return out.where(F.col(holiday_col) == 0) if holiday_col else out


def day_difference(df: DataFrame, start_col: str, end_col: str, result: str) -> DataFrame:
    return df.withColumn(result, F.datediff(F.col(end_col), F.col(start_col)))


def alias_if_absent(df: DataFrame, source: str, target: str) -> DataFrame:
    return df if target in df.columns else df.withColumn(target, F.col(source))


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def normalise_names(df: DataFrame, reverse: bool = False) -> DataFrame:
    """``*_current`` <-> ``*_t0`` and ``competitor_mid`` <-> ``competitor_weighted``."""

    def new_name(c: str) -> str:
        if reverse:
            c = c.replace("competitor_weighted", "competitor_mid")
            return c[: -len("_t0")] + "_current" if c.endswith("_t0") else c
        c = c.replace("competitor_mid", "competitor_weighted")
        return c[: -len("_current")] + "_t0" if c.endswith("_current") else c

    return df.withColumnsRenamed({c: new_name(c) for c in df.columns if new_name(c) != c})


def round_columns(df: DataFrame, columns: Sequence[str], decimals: int = 3) -> DataFrame:
    return df.withColumns({c: half_even(c, decimals) for c in columns if c in df.columns})


def fill_constant(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def cap_at(df: DataFrame, column: str, ceiling: float) -> DataFrame:
    """Ceiling that keeps NULL as NULL."""
    c = F.col(column)
    return df.withColumn(column, F.when(c > ceiling, F.lit(ceiling)).otherwise(c))


def flip_signs(df: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Negate every numeric column whose name contains one of the patterns (any case)."""
    low = [p.lower() for p in patterns]
    hit = {
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and any(p in f.name.lower() for p in low)
    }
    return df.select(*[(-F.col(c)).alias(c) if c in hit else F.col(c) for c in df.columns])


def flip_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per flipped column: mean before and after, sign change, rows. One pass."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.count(c).alias(f"{c}__cnt")]
    one = df.agg(*aggs)
    parts = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"{c}__mean").alias("mean_before"),
                (-F.col(f"{c}__mean")).alias("mean_after"),
                (F.col(f"{c}__mean") != 0).alias("sign_changed"),
                (F.col(f"{c}__cnt") == 0).alias("all_null"),
                F.col("__n").alias("n_rows"),
            )
            for c in columns
        ]
    )
    return one.select(F.inline(parts))


def exclude_value(df: DataFrame, column: str, value: object) -> DataFrame:
    """Drop one value, keep NULL."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cond = None
    for c in columns:
        one = is_finite(c) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(c).isNotNull()
        cond = one if cond is None else cond & one
    return df.where(cond)


def matrix_audit(df: DataFrame, columns: Sequence[str], min_rows: int = 10) -> DataFrame:
    """Counts that decide whether a model matrix is usable."""
    bad = F.lit(0)
    for c in columns:
        bad = bad + F.when(is_finite(c), 0).otherwise(1)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum((bad > 0).cast("int")), F.lit(0)).cast("bigint").alias("n_bad_rows"),
    ).withColumn("usable", (F.col("n_rows") >= min_rows) & (F.col("n_bad_rows") == 0))


def positive_counter(c: str | Column) -> Column:
    return (F.coalesce(col(c), F.lit(0.0)) > 0).cast("int")
