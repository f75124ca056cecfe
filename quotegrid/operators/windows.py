"""Window operators over series grids.

A grid (daily or weekly table per series) is bounded by the calendar, so a window
per series is bounded too. Nothing here is meant for raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quotegrid.functions.exprs import col, half_even


def series_window(keys: Sequence[str] = (), order: str | Column | None = None) -> WindowSpec:
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return w.orderBy(order) if order is not None else w


def trailing(keys: Sequence[str], order: str, size: int) -> WindowSpec:
    return series_window(keys, order).rowsBetween(-(size - 1), 0)


def trailing_mean(c: str | Column, keys: Sequence[str], order: str, size: int) -> Column:
    """Mean of the last rows, NULLs skipped, one value is enough."""
    return F.avg(col(c)).over(trailing(keys, order, size))


def trailing_mean_strict(c: str | Column, keys: Sequence[str], order: str, size: int) -> Column:
    w = trailing(keys, order, size)
    return F.when(F.count(col(c)).over(w) == size, F.avg(col(c)).over(w))


def trailing_std(c: str | Column, keys: Sequence[str], order: str, size: int) -> Column:
    return F.stddev_samp(col(c)).over(trailing(keys, order, size))


def trailing_std_strict(c: str | Column, keys: Sequence[str], order: str, size: int) -> Column:
    w = trailing(keys, order, size)
    return F.when(F.count(col(c)).over(w) == size, F.stddev_samp(col(c)).over(w))


def volatility_weights(
    df: DataFrame, c: str, keys: Sequence[str], order: str, size: int = 13, out: str = "weight"
) -> DataFrame:
    """Trailing sample deviation, floored, normalised to sum 1 per series."""
    std = trailing_std(c, keys, order, size)
    floored = df.withColumn(
        "__vol", F.when(F.coalesce(std, F.lit(0.0)) == 0, F.lit(1e-10)).otherwise(std)
    )
    return floored.withColumn(out, F.col("__vol") / F.sum("__vol").over(series_window(keys))).drop("__vol")


def centred_mean(
    c: str | Column, keys: Sequence[str], order: str, size: int, min_count: int = 1
) -> Column:
    """Centred mean; an even window reaches one row further back than forward."""
    w = series_window(keys, order).rowsBetween(-(size // 2), (size - 1) // 2)
    return F.when(F.count(col(c)).over(w) >= min_count, F.avg(col(c)).over(w))


def expanding_mean(c: str | Column, keys: Sequence[str], order: str) -> Column:
    return F.avg(col(c)).over(series_window(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def error_profile(df: DataFrame, ape: str, keys: Sequence[str], order: str) -> DataFrame:
    """Cumulative, 13-row and 26-row percentage errors (x100)."""
    short = centred_mean(ape, keys, order, 13)
    long = centred_mean(ape, keys, order, 26, 13)
    n = F.count(F.lit(1)).over(series_window(keys))
    return df.withColumns(
        {
            "cumulative_mape": expanding_mean(ape, keys, order) * 100,
            "rolling_13_mape": short * 100,
            "rolling_26_mape": F.when(n >= 26, long).otherwise(short) * 100,
        }
    )


def forward_fill(c: str | Column, keys: Sequence[str], order: str) -> Column:
    w = series_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(col(c), ignorenulls=True).over(w)


def lag_bank(
    df: DataFrame,
    configs: Sequence[tuple[str, str, str]],
    max_lag: int,
    keys: Sequence[str],
    order: str,
    extra_partition: Sequence[Column] = (),
    missing: str = "skip",
) -> DataFrame:
    """``<prefix>_current``, ``_t1.._tL`` (backward) and ``_lead1.._leadL`` (forward).

    ``configs`` holds (source column, prefix, "backward" | "forward" | "both"). All
    columns come out of one projection over one window specification, so the plan
    has one WindowExec; a later ``select`` prunes the lags nobody reads.
    """
    w = Window.partitionBy(*(list(keys) or [F.lit(0)]), *extra_partition).orderBy(order)
    new: list[Column] = []
    for source, prefix, direction in configs:
        if source not in df.columns:
            if missing == "skip":
                continue
            raise ValueError(f"lag source {source!r} not found")
        c = F.col(source)
        new.append(c.alias(f"{prefix}_current"))
        if direction in ("backward", "both"):
            new += [F.lag(c, k).over(w).alias(f"{prefix}_t{k}") for k in range(1, max_lag + 1)]
        if direction in ("forward", "both"):
            new += [F.lead(c, k).over(w).alias(f"{prefix}_lead{k}") for k in range(1, max_lag + 1)]
    return df.select("*", *new)


def split_lag_bank(
    df: DataFrame,
    configs: Sequence[tuple[str, str, str]],
    max_lag: int,
    keys: Sequence[str],
    order: str,
    cutoff: str,
) -> DataFrame:
    """Lags that never cross the training cutoff."""
    after = F.col(order) >= F.lit(cutoff).cast("date")
    return lag_bank(df, configs, max_lag, keys, order, extra_partition=[after])


def momentum(c: str | Column, m: int, keys: Sequence[str], order: str, step: int = 2) -> Column:
    w = series_window(keys, order)
    return F.lag(col(c), m).over(w) - F.lag(col(c), m + step).over(w)


def change_in_bps(c: str | Column, keys: Sequence[str], order: str) -> Column:
    w = series_window(keys, order)
    return half_even((col(c) - F.lag(col(c), 1).over(w)) * 100, 0)


def decay_weight(rate: float, keys: Sequence[str], order: str, offset: int = 1) -> Column:
    """``rate ** (n - k - offset)`` for the zero-based position k. ``offset`` 1 or 0."""
    k = F.row_number().over(series_window(keys, order)) - 1
    n = F.count(F.lit(1)).over(series_window(keys))
    return F.pow(F.lit(rate), (n - k - offset).cast("double"))


def numbered(df: DataFrame, keys: Sequence[str], order: str, out: str = "rn") -> DataFrame:
    """One-based position in the series and series length."""
    return df.withColumns(
        {
            out: F.row_number().over(series_window(keys, order)),
            "n": F.count(F.lit(1)).over(series_window(keys)).cast("int"),
        }
    )


def split_at_cutoff(df: DataFrame, cutoff: int, keys: Sequence[str], order: str) -> DataFrame:
    """Rows [0, cutoff) labelled train, row ``cutoff`` labelled test."""
    pos = F.row_number().over(series_window(keys, order)) - 1
    return (
        df.withColumn("__pos", pos)
        .where(F.col("__pos") <= cutoff)
        .withColumn("role", F.when(F.col("__pos") < cutoff, "train").otherwise("test"))
        .drop("__pos")
    )


def history_mean(c: str | Column, keys: Sequence[str], order: str, size: int | None = None) -> Column:
    start = Window.unboundedPreceding if size is None else -size
    return F.avg(col(c)).over(series_window(keys, order).rowsBetween(start, -1))


def persistence(c: str | Column, h: int, keys: Sequence[str], order: str) -> Column:
    return F.lag(col(c), h).over(series_window(keys, order))


def drawdown(c: str | Column, keys: Sequence[str], order: str) -> Column:
    """Running maximum (at least 0) of the earlier rows minus the current value."""
    before = series_window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return F.greatest(F.lit(0.0), F.coalesce(F.max(col(c)).over(before), F.lit(0.0))) - col(c)


def longest_streak(df: DataFrame, flag: str, keys: Sequence[str], order: str) -> DataFrame:
    """Per series: rows, hits, hit share in percent, longest run of hits."""
    w = series_window(keys, order)
    by_flag = Window.partitionBy(*keys, flag).orderBy(order)
    runs = (
        df.withColumn("__island", F.row_number().over(w) - F.row_number().over(by_flag))
        .groupBy(*keys, flag, "__island")
        .agg(F.count(F.lit(1)).alias("__len"))
    )
    hit = F.col(flag)
    return runs.groupBy(*keys).agg(
        F.sum("__len").alias("n_rows"),
        F.coalesce(F.sum(F.when(hit, F.col("__len"))), F.lit(0)).alias("n_hits"),
        F.coalesce(F.max(F.when(hit, F.col("__len"))), F.lit(0)).alias("longest_streak"),
    ).withColumn("hit_pct", F.col("n_hits") / F.col("n_rows") * 100)


def average_rank(c: str | Column, keys: Sequence[str] = (), descending: bool = False) -> Column:
    """Rank with ties sharing the mean of their positions."""
    c = col(c)
    base = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ordered = base.orderBy(c.desc() if descending else c.asc())
    ties = Window.partitionBy(*(list(keys) or [F.lit(0)]), c)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2


def directional_accuracy(df: DataFrame, actual: str, predicted: str, keys: Sequence[str], order: str) -> DataFrame:
    w = series_window(keys, order)
    da = F.signum(F.col(actual) - F.lag(actual).over(w))
    dp = F.signum(F.col(predicted) - F.lag(predicted).over(w))
    return (
        df.select(*keys, (da == dp).cast("double").alias("__same"))
        .groupBy(*keys)
        .agg((F.avg("__same") * 100).alias("directional_accuracy"), F.count("__same").alias("n_steps"))
    )


def rolling_weighted_error(
    df: DataFrame, ape: str, weight: str, keys: Sequence[str], order: str, size: int = 13, out: str = "weighted_mape"
) -> DataFrame:
    """Weighted mean of a full window; plain mean where the weights sum to zero."""
    w = trailing(keys, order, size)
    sw = F.sum(weight).over(w)
    swa = F.sum(F.col(weight) * F.col(ape)).over(w)
    value = F.when(sw == 0, F.avg(ape).over(w)).otherwise(swa / F.nullif(sw, F.lit(0.0)))
    return df.withColumn(out, F.when(F.count(ape).over(w) == size, value))


def anomaly_score(
    df: DataFrame, c: str, keys: Sequence[str], order: str, size: int = 13, limit: float = 2.0
) -> DataFrame:
    z = (F.col(c) - trailing_mean_strict(c, keys, order, size)) / F.nullif(
        trailing_std_strict(c, keys, order, size), F.lit(0.0)
    )
    return df.withColumn("z", z).withColumn("is_anomaly", F.coalesce(F.abs(F.col("z")) > limit, F.lit(False)))


def modal_step(df: DataFrame, date_col: str, keys: Sequence[str], min_share: float = 0.8) -> DataFrame:
    """Most frequent day step (smallest on ties) and whether it dominates."""
    step = F.datediff(F.col(date_col), F.lag(date_col).over(series_window(keys, date_col)))
    counts = (
        df.select(*keys, step.alias("step"))
        .where(F.col("step").isNotNull())
        .groupBy(*keys, "step")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.max(F.struct(F.col("n"), (-F.col("step")).alias("neg")))
    return counts.groupBy(*keys).agg(
        (-best["neg"]).alias("modal_step"), (best["n"] / F.sum("n")).alias("share")
    ).withColumn("consistent", F.col("share") > min_share)


def order_violations(df: DataFrame, date_col: str, arrival: str, keys: Sequence[str]) -> DataFrame:
    """Rows whose date lies before the date of the row that arrived just earlier."""
    prev = F.lag(date_col).over(series_window(keys, arrival))
    return (
        df.select(*keys, (F.col(date_col) < prev).cast("int").alias("__bad"))
        .groupBy(*keys)
        .agg(F.coalesce(F.sum("__bad"), F.lit(0)).alias("n_violations"))
        .withColumn("is_sorted", F.col("n_violations") == 0)
    )
