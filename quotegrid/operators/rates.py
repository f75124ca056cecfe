"""Competitor rates: deduplicated quotes, daily company rates, market aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrid.functions import exprs as X
from quotegrid.operators.joins import as_of_daily


def keep_highest(df: DataFrame, keys: Sequence[str], value: str, tie_break: str | None = None) -> DataFrame:
    """One row per key: the highest value, lowest tie-break id first.

    A partial aggregate, so a hot key is reduced before the shuffle; a row_number
    window would sort the whole group in one task. Without further columns to carry
    it is a plain hashed maximum.
    """
    rest = [c for c in df.columns if c not in keys]
    if rest == [value]:
        return df.groupBy(*keys).agg(F.max(value).alias(value))
    order = [F.col(value).isNotNull(), F.col(value)] + ([-F.col(tie_break)] if tie_break else [])
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in rest])


def daily_company_mean(df: DataFrame, company: str, date_col: str, rate: str) -> DataFrame:
    return df.groupBy(company, date_col).agg(F.avg(rate).alias(rate))


def latest_record(df: DataFrame, keys: Sequence[str], date_col: str, tie_break: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(date_col), -F.col(tie_break)))
    return df.groupBy(*keys).agg(best.alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def company_rate_grid(
    quotes: DataFrame, company: str, date_col: str, rate: str, smooth: int, end: str | None = None
) -> DataFrame:
    """Long form: last known, smoothed rate of every company on every day."""
    daily = daily_company_mean(quotes, company, date_col, rate)
    return as_of_daily(daily, rate, [company], date_col, smooth, end)


def pivot_companies(grid: DataFrame, company: str, date_col: str, rate: str, names: Sequence[str]) -> DataFrame:
    """One column per company; the list is given, so no extra job looks for it."""
    return grid.groupBy(date_col).pivot(company, list(names)).agg(F.first(rate))


# ---------------------------------------------------------------- market aggregates (wide)
def _weighted_sum(names: Sequence[str], suffix: str) -> str:
    return " + ".join(f"{r} * {w}" for r, w in zip(X.zero_if_null(names), X.zero_if_null(names, suffix)))


def market_weighted_mean(names: Sequence[str], weight_suffix: str = "_weight", eps: float = 1e-8) -> Column:
    """Sum of rate x weight over the sum of weights; missing rates and weights count as 0."""
    weights = " + ".join(X.zero_if_null(names, weight_suffix))
    return F.expr(f"({_weighted_sum(names, weight_suffix)}) / ({weights} + {eps!r}D)")


def market_core_mean(names: Sequence[str]) -> Column:
    return F.expr(f"({' + '.join(X.zero_if_null(names))}) / {len(names)}")


def weighted_mean_excluding(
    names: Sequence[str], excluded: Sequence[str], weight_suffix: str = "_weight"
) -> Column:
    """Weighted sum over the kept companies divided by one minus the excluded weights."""
    kept = [n for n in names if n not in set(excluded)]
    rest = " - ".join(["1D", *[X.quoted(n + weight_suffix) for n in excluded]])
    return F.expr(f"({_weighted_sum(kept, weight_suffix)}) / nullif({rest}, 0D)")


def weighted_strategy(names: Sequence[str], weights: dict[str, float]) -> Column:
    """Static weights re-normalised over the available companies; equal when they sum to 0."""
    have = {n: float(weights.get(n, 0.0)) for n in names}
    total = sum(have.values())
    share = [w / total if total > 0 else 1.0 / len(names) for w in have.values()]
    return F.expr(" + ".join(f"{r} * {w!r}D" for r, w in zip(X.zero_if_null(names), share)))


def weighted_strategy_long(rates: DataFrame, weights: DataFrame, company: str, keys: Sequence[str], rate: str) -> DataFrame:
    """The same over long tables: weights live in a table keyed by company."""
    joined = rates.join(weights, company, "left").withColumns(
        {rate: F.coalesce(rate, F.lit(0.0)), "weight": F.coalesce("weight", F.lit(0.0))}
    )
    sw, n = F.sum("weight"), F.count(F.lit(1))
    return joined.groupBy(*keys).agg(
        F.when(sw > 0, F.sum(F.col(rate) * F.col("weight")) / F.nullif(sw, F.lit(0.0)))
        .otherwise(F.sum(rate) / n)
        .alias("weighted_rate")
    )


def top_n_strategy(names: Sequence[str], n: int = 5, null_policy: str = "zero") -> Column:
    return X.top_n_mean(names, n, null_policy)


def firm_level_strategy(names: Sequence[str], kind: str = "mean", null_policy: str = "zero") -> Column:
    arr = X.rates_descending(names, null_policy)
    return {
        "mean": lambda: X.array_mean(arr),
        "median": lambda: X.array_median(arr),
        "max": lambda: F.get(arr, F.lit(0)),
        "min": lambda: F.get(arr, F.size(arr) - 1),
    }[kind]()


# product type -> strategy name (fixed values)
PRODUCT_STRATEGY = {"rila": "weighted", "fia": "top_n", "myga": "firm_level"}

_STRATEGIES: dict[str, Callable[..., Column]] = {
    "weighted": weighted_strategy,
    "top_n": top_n_strategy,
    "firm_level": firm_level_strategy,
}


def register_strategy(name: str, builder: Callable[..., Column]) -> None:
    _STRATEGIES[name] = builder


def strategy_for(product_type: str) -> tuple[str, Callable[..., Column]]:
    name = PRODUCT_STRATEGY.get(product_type.lower())
    if name is None:
        raise ValueError(f"no aggregation strategy for product type {product_type!r}")
    return name, _STRATEGIES[name]


def competitor_ranks(names: Sequence[str], min_companies: int = 3, null_policy: str = "zero") -> dict[str, Column]:
    """Median, top means and positional ranks of a row of company rates."""
    return ranks_of_sorted(_checked(names, min_companies), X.rates_descending(names, null_policy))


def with_competitor_ranks(
    df: DataFrame, names: Sequence[str], min_companies: int = 3, null_policy: str = "zero"
) -> DataFrame:
    """The same as columns of ``df``; the row is sorted once."""
    n = _checked(names, min_companies)
    sorted_rates = df.withColumn("__rates", X.rates_descending(names, null_policy))
    return sorted_rates.withColumns(ranks_of_sorted(n, F.col("__rates"))).drop("__rates")


def _checked(names: Sequence[str], min_companies: int) -> int:
    if len(names) < min_companies:
        raise ValueError(f"{len(names)} company columns, {min_companies} needed")
    return len(names)


def ranks_of_sorted(n: int, arr: Column) -> dict[str, Column]:
    out = {"raw_median": X.array_median(arr)}
    if n >= 3:
        out["top_5"] = X.array_mean(F.slice(arr, 1, min(n, 5)))
        out["top_3"] = X.array_mean(F.slice(arr, 1, 3))
    else:
        out["top_5"] = out["top_3"] = X.array_mean(arr)
    for k, label in enumerate(["first", "second", "third"]):
        out[f"{label}_highest_benefit"] = F.coalesce(F.get(arr, F.lit(k)), F.get(arr, F.lit(0)))
    return out


# rank column -> semantic name (fixed values)
RANK_ALIASES = {
    "raw_median": "C_median",
    "top_3": "C_top_3",
    "top_5": "C_top_5",
    "first_highest_benefit": "C_first",
    "second_highest_benefit": "C_second",
    "third_highest_benefit": "C_third",
}


def with_rank_aliases(df: DataFrame) -> DataFrame:
    return df.withColumns({new: F.col(old) for old, new in RANK_ALIASES.items() if old in df.columns})
