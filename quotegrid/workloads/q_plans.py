"""Whole plans on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotegrid.plans.backtest import backtest_report, weighted_error_path
from quotegrid.plans.pricing import price_table
from quotegrid.plans.selection import select_models
from quotegrid.plans.weekly_features import WeeklyConfig, build_weekly_features
from quotegrid.workloads import tables as t
from quotegrid.workloads.q_forecast import ENSEMBLE_B, ROLL, SCEN, origins_sql, rolling
from quotegrid.workloads.q_models import BCOLS, BLOCK_SCORE, BOOT_MODELS, RULES, Z95, block_sql, r6
from quotegrid.workloads.q_scan_filter import WEIGHTS, weights_wide
from quotegrid.workloads.registry import ORACLE, query
from quotegrid.workloads.sqltext import Fit, moments_sql, rnd
from quotegrid.workloads.tables import xavg, xsum

K = ["product"]
OVER = "partition by product order by date"
LAGS = 4
CFG = WeeklyConfig(
    own=t.OWN,
    competitors=tuple(t.COMPETITORS),
    rate_ceiling=9.5,
    rate_smooth=7,
    macro=("tax", "qty"),
    max_lag=LAGS,
    start="1995-06-01",
    as_of="2001-08-01",
)


def weekly_features(spark, sf):
    """The full feature table on the given tables."""
    orders = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("product"))
    issued = t.table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").alias("premium")
    )
    q = t.quotes(spark, sf).select("company", "date", "product_id", "rate")
    return build_weekly_features(
        t.sales(spark, sf).select("product", "date", "premium"),
        issued.join(orders, "l_orderkey").select("product", "date", "premium"),
        q,
        weights_wide(spark, sf),
        t.macro(spark, sf),
        CFG,
    )


C = t.COMPETITORS
CZ = f"[{', '.join(f'coalesce({c},0)' for c in C)}]"
FEATURE_SQL = f"""{t.SALES}, kept0 as (select * from sales where premium between 1000 and 1000000), th as (select quantile_cont(premium, 0.99) as q from kept0),
 kept as (select kept0.* from kept0, th where premium < q),
 apt as (select product, date, {xsum('premium')} as raw from kept group by 1,2), asp as (select product, min(date) lo, max(date) hi from apt group by 1),
 ag as (select product, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date from asp),
 ad as (select g.product, g.date, avg(coalesce(raw, 0)) over (partition by g.product order by g.date rows between 13 preceding and current row) as sales from ag g left join apt using (product, date)),
 ct as (select o_orderpriority as product, cast(l_shipdate as date) as date, {xsum('l_extendedprice')} as raw from lineitem join orders on l_orderkey = o_orderkey group by 1,2),
 csp as (select product, min(date) lo, max(date) hi from ct group by 1), cg as (select product, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date from csp),
 cd as (select g.product, g.date, avg(coalesce(raw, 0)) over (partition by g.product order by g.date rows between 13 preceding and current row) as sales_by_contract_date from cg g left join ct using (product, date)),
 {WEIGHTS}, wwide as (select current_quarter, {', '.join(f"max(case when company='{c}' then weight end) as {c}_weight" for c in t.COMPANIES)} from weights group by 1),
 best as (select company, date, product_id, least(max(rate), 9.5) as rate from quotes where date <= date '2001-08-01' group by 1,2,3),
 rd as (select company, date, {xavg('rate')} as rate from best group by 1,2),
 rs as (select company, cast(unnest(generate_series(min(date), (select max(date) from rd), interval 1 day)) as date) as date from rd group by company),
 rf as (select s.company, s.date, last_value(r.rate ignore nulls) over (partition by s.company order by s.date rows between unbounded preceding and current row) as rate from rs s left join rd r using (company, date)),
 rm as (select company, date, avg(rate) over (partition by company order by date rows between 6 preceding and current row) as rate from rf),
 rw as (select date, {', '.join(f"max(case when company='{c}' then rate end) as {c}" for c in t.COMPANIES)} from rm group by 1),
 mk as (select date, {t.OWN}, ({'+'.join(f'coalesce({c},0)*coalesce({c}_weight,0)' for c in C)})/({'+'.join(f'coalesce({c}_weight,0)' for c in C)}+1e-8) as cw,
   ({'+'.join(f'coalesce({c},0)' for c in C)})/{len(C)} as cc, list_median({CZ}) as cm, list_sum(list_sort({CZ},'DESC')[1:5])/5 as c5
   from rw left join wwide on year(date)::varchar || '_Q' || quarter(date)::varchar = current_quarter),
 {t.MACRO}, jd as (select ad.product, ad.date, sales, sales_by_contract_date, tax, qty from ad left join cd on ad.product = cd.product and ad.date = cd.date left join macro on macro.date = ad.date),
 jf as (select product, date, sales, sales_by_contract_date, last_value(tax ignore nulls) over ({OVER} rows between unbounded preceding and current row) as tax,
   last_value(qty ignore nulls) over ({OVER} rows between unbounded preceding and current row) as qty from jd),
 js as (select product, date, sales, sales_by_contract_date, (sales > 0)::integer as counter, avg(tax) over ({OVER} rows between 6 preceding and current row) as tax,
   avg(qty) over ({OVER} rows between 6 preceding and current row) as qty from jf),
 da as (select js.*, {t.OWN}, cw, cc, cm, c5 from js join mk using (date)),
 wk as (select product, {t.week_sql('date')} as date, sum(sales) as sales, coalesce(sum(sales_by_contract_date), 0) as sbc, sum(counter)::bigint as counter, avg({t.OWN}) as own, avg(cw) as cw, avg(cc) as cc, avg(cm) as cm, avg(c5) as c5,
   arg_max(tax, date) as tax, arg_max(qty, date) as qty from da group by 1,2),
 fe as (select *, lag(sales, 4) over ({OVER}) as s4, lag(sbc, 2) over ({OVER}) as b2, lag(own, 1) over ({OVER}) as o1, lag(cw, 2) over ({OVER}) as w2, lag(c5, 3) over ({OVER}) as f3,
   lag(tax, 1) over ({OVER}) as t1, lag(own, 2) over ({OVER}) * lag(cc, 2) over ({OVER}) as oc2, max(case when date > date '1995-06-01' and date <= date '2001-08-01' - interval 50 day then date end) over (partition by product) as lastd from wk)"""


@query(
    "plan_weekly_features",
    f"""with {FEATURE_SQL} select product, date, round(sales, 4) as sales, round(sbc, 4) as sales_by_contract_date, counter, round(own, 6) as own_rate_current, round(cw, 6) as competitor_weighted_current,
  round(cm, 6) as competitor_median_current, round(tax, 6) as econ_rate_current, round(qty, 6) as market_volatility_current, round(s4, 4) as sales_target_t4, round(b2, 4) as sales_target_contract_t2,
  round(o1, 6) as own_rate_t1, round(w2, 6) as competitor_weighted_t2, round(f3, 6) as competitor_top5_t3, round(t1, 6) as econ_rate_t1, round(oc2, 5) as derived_own_rate_competitor_core_interaction_t2,
  round(own - cw, 6) as "Spread", round(ln(1 + sales), 6) as sales_log, dayofyear(date)::integer as day_of_year, (case when dayofyear(date) < 13 or dayofyear(date) > 359 then 1 else 0 end)::integer as holiday
  from fe where date > date '1995-06-01' and date < lastd""",
)
def plan_weekly_features(spark, sf):
    out = weekly_features(spark, sf)
    r = lambda c, n=6: F.round(c, n).alias(c)
    return out.select(
        "product", "date", r("sales", 4), r("sales_by_contract_date", 4), "counter", r("own_rate_current"), r("competitor_weighted_current"),
        r("competitor_median_current"), r("econ_rate_current"), r("market_volatility_current"), r("sales_target_t4", 4), r("sales_target_contract_t2", 4),
        r("own_rate_t1"), r("competitor_weighted_t2"), r("competitor_top5_t3"), r("econ_rate_t1"), r("derived_own_rate_competitor_core_interaction_t2", 5),
        r("Spread"), r("sales_log"), "day_of_year", "holiday",
    )


def _orig_sql() -> str:
    out = []
    for name, feats in BOOT_MODELS:
        f = Fit(feats, BCOLS)
        bad = [f"({f.b[feats.index('own')]} - {Z95}*{f.se[feats.index('own')]} <= 0)"] if "own" in feats else []
        bad += [f"({f.b[feats.index('comp')]} + {Z95}*{f.se[feats.index('comp')]} >= 0)"] if "comp" in feats else []
        out.append(f"select product, '{name}' as model_id, {f.aic} as aic, not ({' or '.join(bad)}) as valid from om")
    return " union all ".join(out)


@query(
    "plan_model_selection",
    f"""with {block_sql([4], 1000)}, om as (select product, {moments_sql(BCOLS)} from rows_ group by 1), og as ({_orig_sql()}),
  pk as (select *, row_number() over (partition by product order by not valid, aic, model_id) as k from og),
  cv as (select product, model_id, stddev_pop(aic)/abs(avg(aic)) as aic_cv, stddev_pop(r2)/abs(avg(r2)) as r2_cv from bfact group by 1,2)
  select pk.product, pk.model_id, {rnd('aic', 'aic')}, valid, case when not valid then 'no valid model; best converged one taken' end as note, {rnd('aic_cv', 'aic_cv')}, {BLOCK_SCORE} as stability_score
  from pk join cv on pk.product = cv.product and pk.model_id = cv.model_id where k = 1""",
)
def plan_model_selection(spark, sf):
    wm = t.weekly_model(spark, sf).select("product", "date", *BCOLS)
    out = select_models(wm, RULES, K, "date", "y", ["own", "comp", "tax"], BOOT_MODELS, replicates=1000, block_size=4)
    return r6(out.select("product", "model_id", "aic", "valid", "note", "aic_cv", "stability_score"), "aic", "aic_cv")


@query(
    "plan_price_table",
    f"""with {SCEN}, q as (select product, scenario, quantile_cont(dollars, [0.025, 0.5, 0.975]) as d, quantile_cont(pct_change, [0.025, 0.5, 0.975]) as p from facts group by 1,2)
  select product, cast(scenario*100 as integer) as rate_change_in_basis_points, range, cast(round_even(d[i], 3) as double) as dollar, cast(round_even(p[i], 3) as double) as pct_change
  from q, (select 'bottom' as range, 1 as i union all select 'median', 2 union all select 'top', 3)""",
)
def plan_price_table(spark, sf):
    scenarios = spark.range(9).select((F.col("id") * 1.25).alias("scenario"))
    wm = t.weekly_model(spark, sf)
    return price_table(wm, scenarios, K, "date", "y", ["own"], "own", ["comp"], replicates=ENSEMBLE_B)


@query(
    "plan_backtest_report",
    f"""with {origins_sql('ln(sales)')}, q as (select product, date, any_value(actual) as actual, quantile_cont(pred, [0.025, 0.975]) as q from p group by 1,2),
  held as (select product, count(*) as n_forecasts, avg((actual between q[1] and q[2])::int) as coverage, avg((q[2] - q[1])/actual) as relative_width from q group by 1)
  select m.*, n_forecasts, round(coverage, 6) as coverage, round(relative_width, 6) as relative_width, abs(coverage - 0.95) <= 3*sqrt(0.95*0.05/n_forecasts) as calibrated
  from ({ORACLE['mod21_model_vs_benchmark']}) m join held on m.product = held.product""",
)
def plan_backtest_report(spark, sf):
    out = backtest_report(t.weekly_model(spark, sf), K, "date", "sales", ["own"])
    cols = ["model_mape", "benchmark_mape", "mape_improvement_pct"]
    out = r6(r6(out, *cols, "coverage", "relative_width"), "r2_improvement_pct", decimals=4)
    return out.select("product", *cols, "r2_improvement_pct", "model_outperforms", "n_forecasts", "coverage", "relative_width", "calibrated")


@query(
    "plan_backtest_error_path",
    f"""with {ROLL}, e as (select product, date, y_true, abs(y_true - y_predict)/y_true as ape from fr),
  v as (select *, stddev_samp(y_true) over ({OVER} rows between 12 preceding and current row) as sd from e),
  u as (select *, case when coalesce(sd, 0) = 0 then 1e-10 else sd end as vol from v), w as (select *, vol/sum(vol) over (partition by product) as w from u),
  r as (select product, date, count(ape) over o as n, sum(w*ape) over o as a, sum(w) over o as b from w window o as ({OVER} rows between 12 preceding and current row))
  select product, date, round(case when n = 13 then a/b*100 end, 6) as weighted_mape from r""",
)
def plan_backtest_error_path(spark, sf):
    return r6(weighted_error_path(rolling(spark, sf), K, "date"), "weighted_mape")
