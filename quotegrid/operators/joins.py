"""Joins between grids, dimensions and model tables.

No strategy hints here: small sides are recognised from statistics (static
relations, AQE at run time), and a side that outgrows the threshold falls back to
a shuffled join by itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrid.functions.exprs import nan_to_null, quarter_label
from quotegrid.operators import content
from quotegrid.operators.calendar import fill_gaps
from quotegrid.operators.moments import parallelism
from quotegrid.operators.windows import trailing_mean

#: rows that a task sorts and groups, about
ROWS_A_TASK = 1 << 19


def dealt_by_size(frames: Sequence[DataFrame], keys: Sequence[str]) -> list[DataFrame]:
    """``frames`` dealt out by ``keys`` to as many tasks as their rows ask for, for a join whose rows are grouped in the same tasks.

    Sorting two sides and grouping every joined row holds a whole partition; the session's number of partitions knows nothing of
    the size, and AQE puts partitions together by their bytes on the wire. Counting reads the footers of the files only. Tables
    of one task's rows are left as they are.
    """
    rows = sum(f.count() for f in frames)
    if rows <= ROWS_A_TASK:
        return list(frames)
    tasks = max(parallelism(frames[0]), -(-rows // ROWS_A_TASK))
    return [f.repartition(tasks, *keys) for f in frames]


def left_join_chain(base: DataFrame, others: Sequence[DataFrame], on: Sequence[str], distinct: bool = False) -> DataFrame:
    out = reduce(lambda left, right: left.join(right, list(on), "left"), others, base)
    return out.dropDuplicates() if distinct else out


def inner_join_distinct(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "inner").dropDuplicates()


def with_quarter_weights(df: DataFrame, weights: DataFrame, date_col: str = "date", how: str = "left") -> DataFrame:
    """Attach the row of quarterly weights; days without weights vanish when ``how='inner'``."""
    joined = df.withColumn("current_quarter", quarter_label(date_col)).join(weights, "current_quarter", how)
    return joined.dropDuplicates() if how == "inner" else joined


def as_of_daily(
    df: DataFrame, value: str, keys: Sequence[str], date_col: str = "date", smooth: int | None = None, end: str | None = None
) -> DataFrame:
    """Last known value on every calendar day up to ``end`` (default: the newest date of all series).

    Every row is repeated until the next one: reindex and forward fill in one step, as
    long as the value itself is never NULL.
    """
    if end is None:
        rows, stop = df.withColumn("__end", df.agg(F.max(date_col)).scalar()), F.col("__end")
    else:
        stop = F.lit(end).cast("date")
        rows = df.where(F.col(date_col) <= stop)
    filled = fill_gaps(rows.where(F.col(value).isNotNull()), date_col, keys, end=stop).select(*keys, date_col, value)
    return filled if smooth is None else filled.withColumn(value, trailing_mean(value, keys, date_col, smooth))


def members_of_groups(df: DataFrame, groups: DataFrame, on: str) -> DataFrame:
    """Rows labelled with every group their id belongs to (an id may be in several)."""
    return df.join(groups, on)


def bounded(df: DataFrame, rows: int, what: str) -> DataFrame:
    """``df`` marked for broadcast after its size was checked: more than ``rows`` rows are refused."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"{what} has more than {rows} rows")
    return F.broadcast(df)


def scenario_grid(left: DataFrame, right: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Every row of ``left`` with every scenario; the scenarios are a checked, short list."""
    return left.crossJoin(bounded(right, max_rows, "the scenario list"))


def join_metrics(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(on)), frames)


def compare_tables(left: DataFrame, right: DataFrame, on: Sequence[str], columns: Sequence[str], tol: float) -> DataFrame:
    """Per column: rows on one side only, largest absolute and relative difference, verdict. Missing keys meet missing keys.

    Both tables are hashed by range of keys, and only ranges whose hashes differ are joined: equal tables cost two scans.
    """
    ids = [f"__k{i}" for i in range(len(on))]

    def side(df: DataFrame) -> DataFrame:
        values = [nan_to_null(F.col(c).cast("double")).alias(f"__v_{c}") for c in columns]
        return df.select(*[F.col(k).alias(i) for k, i in zip(on, ids)], *values)

    a, b = content.differing_rows(side(left), side(right), ids, [f"__v_{c}" for c in columns])
    a = a.select(*ids, *[F.col(f"__v_{c}").alias(f"__a_{c}") for c in columns], F.lit(1).alias("__a"))
    b = b.select(*[F.col(i).alias(f"{i}_") for i in ids], *[F.col(f"__v_{c}").alias(f"__b_{c}") for c in columns], F.lit(1).alias("__b"))
    both = a.join(b, [F.col(i).eqNullSafe(F.col(f"{i}_")) for i in ids], "full_outer")
    aggs: list[Column] = [
        F.count(F.when(F.col("__b").isNull(), 1)).alias("only_left"),
        F.count(F.when(F.col("__a").isNull(), 1)).alias("only_right"),
    ]
    for c in columns:
        x, y = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        diff = F.abs(x - y)
        aggs += [
            F.max(diff).alias(f"__d_{c}"),
            F.max(diff / F.nullif(F.abs(x), F.lit(0.0))).alias(f"__r_{c}"),
            F.count(F.when(x.isNull() != y.isNull(), 1)).alias(f"__m_{c}"),
        ]
    one = both.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col("only_left"),
                F.col("only_right"),
                F.coalesce(F.col(f"__d_{c}"), F.lit(0.0)).alias("max_abs_diff"),
                F.coalesce(F.col(f"__r_{c}"), F.lit(0.0)).alias("max_rel_diff"),
                F.col(f"__m_{c}").alias("null_mismatches"),
            )
            for c in columns
        ]
    )
    return one.select(F.inline(rows)).withColumn(
        "equal",
        (F.col("only_left") + F.col("only_right") + F.col("null_mismatches") == 0) & (F.col("max_abs_diff") <= tol),
    )
