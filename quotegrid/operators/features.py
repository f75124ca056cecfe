"""Derived feature columns on weekly tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrid.functions import exprs as X
from quotegrid.operators.windows import forward_fill, trailing_mean


def spread(df: DataFrame, own: str, competitor: str, out: str = "Spread") -> DataFrame:
    return df.withColumn(out, F.col(own) - F.col(competitor))


def scale_by_index(
    df: DataFrame, index: str, columns: Sequence[str], keys: Sequence[str], order: str
) -> DataFrame:
    """Columns times the forward-filled index."""
    filled = df.withColumn(index, forward_fill(index, keys, order))
    return filled.withColumns({c: F.col(c) * F.col(index) for c in columns})


def smooth_columns(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: str, size: int = 7) -> DataFrame:
    return df.withColumns({c: trailing_mean(c, keys, order, size) for c in columns})


def _suffixes(max_lag: int) -> list[str]:
    return ["current", *[f"t{k}" for k in range(1, max_lag + 1)]]


def polynomial_bank(df: DataFrame, bases: Sequence[str], max_lag: int, missing: str = "skip") -> DataFrame:
    """Squares of every base and products of every pair, per lag."""
    have = set(df.columns)
    new: list[str] = []

    def add(name: str, a: str, b: str) -> None:
        absent = sorted({a, b} - have)
        if not absent:
            new.append(f"{X.quoted(a)} * {X.quoted(b)} AS {X.quoted(name)}")
        elif missing != "skip":
            raise ValueError(f"columns {absent} needed for {name}")

    for s in _suffixes(max_lag):
        for i, a in enumerate(bases):
            add(f"derived_{a}_squared_{s}", f"{a}_{s}", f"{a}_{s}")
            for b in bases[i + 1 :]:
                add(f"derived_{a}_{b}_interaction_{s}", f"{a}_{s}", f"{b}_{s}")
    return df.selectExpr("*", *new)


def cubes_and_pair_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    new = [(F.col(c) * F.col(c) * F.col(c)).alias(f"{c}_cubed") for c in columns]
    new += [
        ((F.col(a) + F.col(b)) / 2).alias(f"{a}_{b}_avg") for i, a in enumerate(columns) for b in columns[i + 1 :]
    ]
    return df.select("*", *new)


def kink_features(
    df: DataFrame, own_prefix: str, competitor_prefix: str, lags: int, gap: int = 2
) -> DataFrame:
    """Zero while own rate is below the competitor rate of ``gap`` periods earlier, else twice the excess.

    ``d = competitor[k + gap] - own[k]``; the kink is ``|d| - d``.
    """
    new: list[Column] = []
    for k in range(lags):
        own = F.col(f"{own_prefix}_t{k}") if k else F.col(f"{own_prefix}_current")
        d = F.col(f"{competitor_prefix}_t{k + gap}") - own
        kink = F.abs(d) - d
        new += [
            kink.alias(f"pos_lag_{k}"),
            (kink * own).alias(f"pos_lag_scale_{k}"),
            (kink * kink).alias(f"pos_lag_sq_{k}"),
        ]
    return df.select("*", *new)


def log_targets(df: DataFrame, prefix: str = "sales_target") -> DataFrame:
    """log(1 + x) of every column with the prefix, in place."""
    hit = [c for c in df.columns if c.startswith(prefix)]
    return df.withColumns({c: X.transformed(c, "log1p") for c in hit})
