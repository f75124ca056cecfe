"""Raw contracts, quotes, weights and macro series to a weekly feature table, keyed by series.

Raw tables are touched by filters and partial aggregations only; everything after
the daily reduction is bounded by series x days.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegrid.functions import exprs as X
from quotegrid.operators import calendar as cal
from quotegrid.operators import features as ft
from quotegrid.operators import filters as flt
from quotegrid.operators import joins as jon
from quotegrid.operators import rates as rt
from quotegrid.operators import windows as win


@dataclass(frozen=True)
class WeeklyConfig:
    keys: tuple[str, ...] = ("product",)
    own: str = "own"
    competitors: tuple[str, ...] = ()
    premium_range: tuple[float, float] = (1000.0, 1000000.0)
    premium_quantile: float = 0.99
    series_smooth: int = 14
    default_rate: float = 9.99
    rate_ceiling: float = 4.5
    rate_smooth: int = 14
    macro: tuple[str, ...] = ()
    macro_smooth: int = 7
    index: str | None = None
    max_lag: int = 18
    polynomial_bases: tuple[str, ...] = (
        "own_rate",
        "competitor_weighted",
        "competitor_core",
        "econ_rate",
        "market_volatility",
    )
    start: str = "1900-01-01"
    as_of: str = "2100-01-01"
    mature_days: int = 50
    holiday: tuple[int, int] = (13, 359)
    extra_lags: tuple[tuple[str, str, str], ...] = field(default=())

    def lag_configs(self) -> list[tuple[str, str, str]]:
        base = [
            ("sales", "sales_target"),
            ("sales_by_contract_date", "sales_target_contract"),
            (self.own, "own_rate"),
            ("C_weighted_mean", "competitor_weighted"),
            ("C_core", "competitor_core"),
            ("C_median", "competitor_median"),
            ("C_first", "competitor_1st"),
            ("C_second", "competitor_2nd"),
            ("C_third", "competitor_3rd"),
            ("C_top_3", "competitor_top3"),
            ("C_top_5", "competitor_top5"),
        ]
        base += list(zip(self.macro, ("econ_rate", "market_volatility")))
        return [(s, p, "backward") for s, p in base] + list(self.extra_lags)


def clean_contracts(sales: DataFrame, cfg: WeeklyConfig) -> DataFrame:
    """Premium present, inside its range, below the quantile of the kept rows; processing days added."""
    out = flt.within(flt.not_null(sales, "premium"), "premium", *cfg.premium_range)
    out = flt.below_quantile(out, "premium", cfg.premium_quantile)
    return flt.day_difference(out, "date", "contract_date", "processing_days") if "contract_date" in out.columns else out


def daily_series(contracts: DataFrame, date_col: str, value: str, out: str, cfg: WeeklyConfig) -> DataFrame:
    keys = list(cfg.keys)
    d = cal.gap_filled_daily(contracts, date_col, value, keys, out, cfg.series_smooth)
    return d.select(*keys, "date", F.col(f"{out}_smooth").alias(out))


def daily_rates(quotes: DataFrame, cfg: WeeklyConfig) -> DataFrame:
    """Best quote per company, product and day, cleaned; then one smoothed column per company."""
    quotes = quotes.where(F.col("date") <= F.lit(cfg.as_of).cast("date"))
    keys = ["company", "date", "product_id"]
    best = rt.keep_highest(quotes.select(*keys, "rate"), keys, "rate")
    best = flt.cap_at(flt.fill_constant(best, "rate", cfg.default_rate), "rate", cfg.rate_ceiling)
    grid = rt.company_rate_grid(best, "company", "date", "rate", cfg.rate_smooth, end=cfg.as_of)
    return rt.pivot_companies(grid, "company", "date", "rate", [cfg.own, *cfg.competitors])


def market_columns(rates: DataFrame, weights: DataFrame, cfg: WeeklyConfig) -> DataFrame:
    names = list(cfg.competitors)
    j = rt.with_competitor_ranks(jon.with_quarter_weights(rates, weights), names)
    wide = j.select(
        "date",
        cfg.own,
        *names,
        rt.market_weighted_mean(names).alias("C_weighted_mean"),
        rt.market_core_mean(names).alias("C_core"),
        *[F.col(old).alias(new) for old, new in rt.RANK_ALIASES.items()],
    )
    return wide


def integrate(series: Sequence[DataFrame], macro: DataFrame, market: DataFrame, cfg: WeeklyConfig) -> DataFrame:
    """Spine with all daily sources, fills and scaling; only days with rates survive."""
    keys = list(cfg.keys)
    base = jon.left_join_chain(series[0], list(series[1:]), [*keys, "date"])
    base = jon.left_join_chain(base, [macro], ["date"])
    fills = [c for c in (*cfg.macro, cfg.index) if c]
    base = base.withColumns({c: win.forward_fill(c, keys, "date") for c in fills})
    sales_cols = ["sales", "sales_by_contract_date"]
    if cfg.index:
        base = base.withColumns({c: F.col(c) * F.col(cfg.index) for c in sales_cols})
    if cfg.macro:
        base = ft.smooth_columns(base, list(cfg.macro), keys, "date", cfg.macro_smooth)
    base = base.withColumn("counter", flt.positive_counter("sales"))
    # dates are unique per key on the spine and in the market table: no duplicates can arise
    return base.join(market, "date", "inner")


def weekly_table(daily: DataFrame, cfg: WeeklyConfig) -> DataFrame:
    mean = ["C_weighted_mean", "C_core", *rt.RANK_ALIASES.values(), cfg.own, *cfg.competitors]
    how = {c: "mean" for c in mean}
    how |= {"sales": "sum", "sales_by_contract_date": "sum", "counter": "sum"}
    how |= {c: "last" for c in cfg.macro}
    return cal.weekly(daily, how, list(cfg.keys))


def final_table(weekly: DataFrame, cfg: WeeklyConfig) -> DataFrame:
    keys = list(cfg.keys)
    out = win.lag_bank(weekly, cfg.lag_configs(), cfg.max_lag, keys, "date")
    out = ft.polynomial_bank(out, list(cfg.polynomial_bases), cfg.max_lag)
    out = ft.spread(out, cfg.own, "C_weighted_mean")
    out = out.withColumns(
        {
            "sales_log": X.transformed("sales", "log1p"),
            "day_of_year": F.dayofyear("date"),
            "holiday": X.holiday_flag(F.dayofyear("date"), *cfg.holiday),
        }
    )
    out = flt.mature_only(flt.after(out, "date", cfg.start), "date", cfg.as_of, cfg.mature_days)
    return flt.drop_last_period(out, "date", keys)


def build_weekly_features(
    sales: DataFrame, issued: DataFrame, quotes: DataFrame, weights: DataFrame, macro: DataFrame, cfg: WeeklyConfig
) -> DataFrame:
    """All stages. ``sales``: keys, date, premium; ``issued``: keys, date, premium by contract date."""
    applied = daily_series(clean_contracts(sales, cfg), "date", "premium", "sales", cfg)
    contract = daily_series(issued, "date", "premium", "sales_by_contract_date", cfg)
    market = market_columns(daily_rates(quotes, cfg), weights, cfg)
    return final_table(weekly_table(integrate([applied, contract], macro, market, cfg), cfg), cfg)
