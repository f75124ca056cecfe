"""Queries: windows, sorts and top-k, sets, scalar functions, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotegrid.functions import exprs as X
from quotegrid.operators import calendar as cal
from quotegrid.operators import features as ft
from quotegrid.operators import ranged
from quotegrid.operators import rates as rt
from quotegrid.operators import reshape as rsh
from quotegrid.operators import setops as st
from quotegrid.operators import topk as top
from quotegrid.operators import windows as win
from quotegrid.workloads import tables as t
from quotegrid.workloads.q_join_agg import ASOF, WEEKLY_CI, weekly_ci
from quotegrid.workloads.q_scan_filter import WSALES, weekly_sales
from quotegrid.workloads.registry import query
from quotegrid.workloads.tables import xsum

K = ["product"]
WM = f"with {t.WEEKLY_MODEL}"
OVER = "partition by product order by date"


def rounded(df, decimals=6, *cols):
    return df.withColumns({c: F.round(c, decimals) for c in cols})


# ---------------------------------------------------------------- windows
@query(
    "win01_trailing_mean",
    f"{WM} select product, date, round(avg(own) over ({OVER} rows between 13 preceding and current row), 6) as own_smooth from wm",
)
def win01(spark, sf):
    return t.weekly_model(spark, sf).select(
        "product", "date", F.round(win.trailing_mean("own", K, "date", 14), 6).alias("own_smooth")
    )


@query(
    "win02_trailing_mean_strict",
    f"""{WM}, x as (select *, nullif(own, round(own)) as v from wm), s as (select product, date, count(v) over r as n, avg(v) over r as a
  from x window r as ({OVER} rows between 3 preceding and current row)) select product, date, round(case when n = 4 then a end, 6) as smooth from s""",
)
def win02(spark, sf):
    wm = t.weekly_model(spark, sf).withColumn("v", F.nullif("own", F.round("own")))
    return wm.select("product", "date", F.round(win.trailing_mean_strict("v", K, "date", 4), 6).alias("smooth"))


@query(
    "win03_volatility_weights",
    f"""{WM}, s as (select product, date, stddev_samp(y) over ({OVER} rows between 12 preceding and current row) as sd from wm),
  f as (select product, date, case when coalesce(sd, 0) = 0 then 1e-10 else sd end as v from s)
  select product, date, round(v / sum(v) over (partition by product), 9) as weight from f""",
)
def win03(spark, sf):
    wm = t.weekly_model(spark, sf).select("product", "date", "y")
    return win.volatility_weights(wm, "y", K, "date").select("product", "date", F.round("weight", 9).alias("weight"))


APE = f"""{t.WEEKLY_MODEL}, pr as (select product, date, sales, y, avg(sales) over ({OVER} rows between 4 preceding and 1 preceding) as pred from wm),
ape as (select product, date, sales, y, pred, abs(sales - pred) / sales as ape from pr where pred is not null)"""


def ape_frame(spark, sf):
    wm = t.weekly_model(spark, sf).select("product", "date", "sales", "y")
    pred = wm.withColumn("pred", win.history_mean("sales", K, "date", 4)).where(F.col("pred").isNotNull())
    return pred.withColumn("ape", F.abs(F.col("sales") - F.col("pred")) / F.col("sales"))


@query(
    "win04_error_profile",
    f"""with {APE}, s as (select product, date, avg(ape) over ({OVER} rows between unbounded preceding and current row) * 100 as c,
   avg(ape) over ({OVER} rows between 6 preceding and 6 following) * 100 as r13,
   avg(ape) over ({OVER} rows between 13 preceding and 12 following) * 100 as r26,
   count(ape) over ({OVER} rows between 13 preceding and 12 following) as n26, count(*) over (partition by product) as n from ape)
  select product, date, round(c, 6) as cumulative_mape, round(r13, 6) as rolling_13_mape,
   round(case when n < 26 then r13 when n26 >= 13 then r26 end, 6) as rolling_26_mape from s""",
)
def win04(spark, sf):
    p = win.error_profile(ape_frame(spark, sf), "ape", K, "date")
    cols = ["cumulative_mape", "rolling_13_mape", "rolling_26_mape"]
    return p.select("product", "date", *[F.round(c, 6).alias(c) for c in cols])


@query(
    "win05_forward_fill",
    f"""with {t.DAILY}, x as (select product, date, nullif(sales, 0) as v from daily)
  select product, date, last_value(v ignore nulls) over ({OVER} rows between unbounded preceding and current row) as filled from x""",
)
def win05(spark, sf):
    d = cal.gap_filled_daily(t.sales(spark, sf), "date", "premium", K)
    v = F.nullif("sales", F.lit(0.0))
    return d.select("product", "date", v.alias("v")).select(
        "product", "date", F.round(win.forward_fill("v", K, "date"), 4).alias("filled")
    )


LAGS = 4
LAG_CONFIG = [("sales", "sales_target", "backward"), ("own", "own_rate", "backward"), ("comp", "competitor", "both"),
              ("absent", "skipped", "backward")]


def _lag_sql(over=OVER):
    cols = []
    for src, prefix, direction in LAG_CONFIG[:3]:
        cols.append(f"round({src}, 6) as {prefix}_current")
        cols += [f"round(lag({src}, {k}) over ({over}), 6) as {prefix}_t{k}" for k in range(1, LAGS + 1)]
        if direction == "both":
            cols += [f"round(lead({src}, {k}) over ({over}), 6) as {prefix}_lead{k}" for k in range(1, LAGS + 1)]
    return ", ".join(cols)


def _rounded_lags(df):
    drop = {"sales", "own", "comp", "y", "tax", "qty", "holiday"}
    return df.select(*[c if c in ("product", "date") else F.round(c, 6).alias(c) for c in df.columns if c not in drop])


@query("win06_lag_lead_bank", f"{WM} select product, date, {_lag_sql()} from wm")
def win06(spark, sf):
    return _rounded_lags(win.lag_bank(t.weekly_model(spark, sf), LAG_CONFIG, LAGS, K, "date"))


@query(
    "win07_split_lag_bank",
    f"{WM} select product, date, {_lag_sql('partition by product, date >= date $$1999-01-03$$ order by date')} from wm".replace("$$", "'"),
)
def win07(spark, sf):
    return _rounded_lags(
        win.split_lag_bank(t.weekly_model(spark, sf), LAG_CONFIG, LAGS, K, "date", "1999-01-03")
    )


@query(
    "win08_rates_at_lag",
    f"{WM} select product, date, "
    + ", ".join(f"round(lag({c}, 3) over ({OVER}), 6) as {c}_lag_3" for c in t.FEATURES)
    + " from wm",
)
def win08(spark, sf):
    return t.weekly_model(spark, sf).select(
        "product", "date", *[F.round(win.persistence(c, 3, K, "date"), 6).alias(f"{c}_lag_3") for c in t.FEATURES]
    )


@query(
    "win09_momentum",
    f"{WM} select product, date, round(lag(own, 1) over ({OVER}) - lag(own, 3) over ({OVER}), 6) as momentum from wm",
)
def win09(spark, sf):
    return t.weekly_model(spark, sf).select("product", "date", F.round(win.momentum("own", 1, K, "date"), 6).alias("momentum"))


@query(
    "win10_change_in_bps",
    f"""with {ASOF} select company, date, cast(round_even(round((rate - lag(rate) over (partition by company order by date)) * 100, 6), 0) as double) as change_bps from ff""",
)
def win10(spark, sf):
    from quotegrid.operators.joins import as_of_daily

    daily = rt.daily_company_mean(t.quotes(spark, sf), "company", "date", "rate")
    g = as_of_daily(daily, "rate", ["company"])
    prev = win.persistence("rate", 1, ["company"], "date")
    # rounded to 6 digits first so that half-way values do not depend on floating noise
    return g.select(
        "company", "date", X.half_even(F.round((F.col("rate") - prev) * 100, 6), 0).alias("change_bps")
    )


@query(
    "win11_decay_weights",
    f"""{WM}, k as (select product, date, row_number() over ({OVER}) - 1 as k, count(*) over (partition by product) as n from wm)
  select product, date, round(pow(0.98, n - k - 1), 10) as w_forecast, round(pow(0.99, n - k), 10) as w_training from k""",
)
def win11(spark, sf):
    return t.weekly_model(spark, sf).select(
        "product",
        "date",
        F.round(win.decay_weight(0.98, K, "date", 1), 10).alias("w_forecast"),
        F.round(win.decay_weight(0.99, K, "date", 0), 10).alias("w_training"),
    )


@query(
    "win12_split_at_cutoff",
    f"""{WM}, k as (select product, date, sales, row_number() over ({OVER}) - 1 as k from wm)
  select product, date, sales, case when k < 150 then 'train' else 'test' end as role from k where k <= 150""",
)
def win12(spark, sf):
    wm = t.weekly_model(spark, sf).select("product", "date", "sales")
    return win.split_at_cutoff(wm, 150, K, "date")


@query(
    "win13_history_mean",
    f"""{WM} select product, date, round(avg(y) over ({OVER} rows between unbounded preceding and 1 preceding), 8) as mean_all,
  round(avg(y) over ({OVER} rows between 8 preceding and 1 preceding), 8) as mean_8 from wm""",
)
def win13(spark, sf):
    return t.weekly_model(spark, sf).select(
        "product",
        "date",
        F.round(win.history_mean("y", K, "date"), 8).alias("mean_all"),
        F.round(win.history_mean("y", K, "date", 8), 8).alias("mean_8"),
    )


@query("win14_persistence", f"{WM} select product, date, lag(sales, 2) over ({OVER}) as prediction from wm")
def win14(spark, sf):
    return t.weekly_model(spark, sf).select("product", "date", win.persistence("sales", 2, K, "date").alias("prediction"))


EXCESS = f"""{t.WEEKLY_MODEL}, ex as (select product, date, y - median(y) over (partition by product) as excess from wm)"""


def excess(spark, sf):
    wm = t.weekly_model(spark, sf).select("product", "date", "y")
    med = wm.groupBy("product").agg(F.percentile("y", F.lit(0.5)).alias("m"))
    return wm.join(med, "product").select("product", "date", (F.col("y") - F.col("m")).alias("excess"))


@query(
    "win15_drawdown",
    f"""with {EXCESS}, d as (select product, date, greatest(0, coalesce(max(excess) over ({OVER} rows between unbounded preceding and 1 preceding), 0)) - excess as dd from ex)
  select product, date, round(dd, 8) as drawdown, round(max(dd) over (partition by product), 8) as max_drawdown from d""",
)
def win15(spark, sf):
    e = excess(spark, sf).withColumn("drawdown", win.drawdown("excess", K, "date"))
    return e.select(
        "product",
        "date",
        F.round("drawdown", 8).alias("drawdown"),
        F.round(F.max("drawdown").over(win.series_window(K)), 8).alias("max_drawdown"),
    )


@query(
    "win16_longest_streak",
    f"""with {EXCESS}, a as (select product, date, excess > 0 as hit, row_number() over ({OVER}) as rn,
   row_number() over (partition by product, excess > 0 order by date) as rf from ex),
  r as (select product, hit, rn - rf as isl, count(*) as len from a group by 1,2,3)
  select product, sum(len)::bigint as n_rows, coalesce(sum(len) filter (where hit), 0)::bigint as n_hits, coalesce(max(len) filter (where hit), 0) as longest_streak,
  round(coalesce(sum(len) filter (where hit), 0)::double / sum(len)::double * 100, 6) as hit_pct from r group by 1""",
)
def win16(spark, sf):
    e = excess(spark, sf).select("product", "date", (F.col("excess") > 0).alias("hit"))
    return rounded(win.longest_streak(e, "hit", K, "date"), 6, "hit_pct")


RANKED = f"""{t.WEEKLY_MODEL}, rk as (select product, date, round(tax * 4) as a, round(own * 4) as b from wm),
rr as (select *, rank() over (partition by product order by a desc) + (count(*) over (partition by product, a) - 1) / 2 as rank_a,
  rank() over (partition by product order by b) + (count(*) over (partition by product, b) - 1) / 2 as rank_b from rk)"""


@query("win17_average_rank", f"with {RANKED} select product, date, rank_a, rank_b, (rank_a + rank_b) / 2 as combined from rr")
def win17(spark, sf):
    return _ranks(spark, sf).withColumn("combined", (F.col("rank_a") + F.col("rank_b")) / 2)


def _ranks(spark, sf):
    r = t.weekly_model(spark, sf).select(
        "product", "date", F.round(F.col("tax") * 4).alias("a"), F.round(F.col("own") * 4).alias("b")
    )
    return r.select(
        "product",
        "date",
        win.average_rank("a", K, descending=True).alias("rank_a"),
        win.average_rank("b", K).alias("rank_b"),
    )


# ---------------------------------------------------------------- one long series, without keys
#: All orders as one series; a tenth of the prices is left out.
ORDER_SERIES = """with os as (select o_orderkey, o_orderdate, o_totalprice as price, round(o_totalprice * 100)::bigint as cents,
  case when o_orderkey % 10 <> 3 then round(o_totalprice * 100)::bigint end as holed from orders)"""
LONG = "order by o_orderdate, o_orderkey"
LONG_ORDER = ["o_orderdate", "o_orderkey"]


def order_series(spark, sf):
    price, cents = F.col("o_totalprice"), F.round(F.col("o_totalprice") * 100).cast("bigint")
    return t.table(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate", price.alias("price"), cents.alias("cents"), F.when(F.col("o_orderkey") % 10 != 3, cents).alias("holed")
    )


def _whole_mean(total, n):
    """Mean of whole cents without its fraction, which no order of summing changes."""
    return F.call_function("div", total, n)


@query(
    "win04_long_series_frames",
    f"""{ORDER_SERIES}, f as (select o_orderkey, (sum(holed) over ({LONG} rows between 12 preceding and current row) // count(holed) over ({LONG} rows between 12 preceding and current row))::bigint as m, stddev_samp(price) over ({LONG} rows between 12 preceding and current row) as sd,
   count(price) over ({LONG} rows between 12 preceding and current row) as n, (sum(cents) over ({LONG} rows between 13 preceding and 12 following) // count(cents) over ({LONG} rows between 13 preceding and 12 following))::bigint as c from os)
  select o_orderkey, m as trailing_mean, round(case when n = 13 then sd end, 3) as strict_std, c as centred_mean from f""",
)
def win04_long(spark, sf):
    out = ranged.framed(
        order_series(spark, sf),
        {
            "trailing_mean": lambda w: _whole_mean(F.sum("holed").over(w.rowsBetween(-12, 0)), F.count("holed").over(w.rowsBetween(-12, 0))),
            "strict_std": lambda w: F.when(F.count("price").over(w.rowsBetween(-12, 0)) == 13, F.stddev_samp("price").over(w.rowsBetween(-12, 0))),
            "centred_mean": lambda w: _whole_mean(F.sum("cents").over(w.rowsBetween(-13, 12)), F.count("cents").over(w.rowsBetween(-13, 12))),
        },
        [], LONG_ORDER, 13, 12, block=1000,
    )
    return rounded(out.select("o_orderkey", "trailing_mean", "strict_std", "centred_mean"), 3, "strict_std")


@query(
    "win05_long_series_running",
    f"""{ORDER_SERIES} select o_orderkey, last_value(holed ignore nulls) over (w rows between unbounded preceding and current row) as filled,
   (sum(cents) over (w rows between unbounded preceding and current row) // row_number() over w)::bigint as expanding_mean,
   round(greatest(0.0, coalesce(max(price) over (w rows between unbounded preceding and 1 preceding), 0.0)) - price, 4) + 0.0 as drawdown
  from os window w as ({LONG})""",
)
def win05_long(spark, sf):
    rows = order_series(spark, sf)
    both = ranged.running(rows, {"filled": ("last", "holed"), "__s": ("sum", "cents"), "__n": ("count", "cents")}, [], LONG_ORDER, block=1000)
    out = ranged.drawdown(both, "price", [], LONG_ORDER, "drawdown", block=1000)
    return out.select("o_orderkey", "filled", _whole_mean(F.col("__s"), F.col("__n")).alias("expanding_mean"), F.round("drawdown", 4).alias("drawdown"))


@query(
    "win16_long_series_streak",
    f"""{ORDER_SERIES}, h as (select *, price > 100000 as hit, row_number() over ({LONG}) as rn from os), i as (select *, rn - row_number() over (partition by hit {LONG}) as isl from h),
  r as (select hit, isl, count(*) as len from i group by 1, 2)
  select sum(len)::bigint as n_rows, coalesce(sum(len) filter (where hit), 0)::bigint as n_hits, coalesce(max(len) filter (where hit), 0)::bigint as longest_streak,
   round(coalesce(sum(len) filter (where hit), 0)::double / sum(len)::double * 100, 6) as hit_pct from r""",
)
def win16_long(spark, sf):
    hits = order_series(spark, sf).withColumn("hit", F.col("price") > 100000)
    return rounded(ranged.longest_streak(hits, "hit", [], LONG_ORDER, block=1000), 6, "hit_pct")


@query(
    "win17_long_series_rank",
    f"""{ORDER_SERIES}, v as (select o_orderkey, floor(price / 1000) as level from os)
  select o_orderkey, rank() over (order by level) + (count(*) over (partition by level) - 1) / 2 as ascending,
   rank() over (order by level desc) + (count(*) over (partition by level) - 1) / 2 as descending from v""",
)
def win17_long(spark, sf):
    rows = order_series(spark, sf).select("o_orderkey", F.floor(F.col("price") / 1000).alias("level"))
    up = ranged.average_rank(rows, "level", out="ascending", block=100)
    return ranged.average_rank(up, "level", descending=True, out="descending", block=100).drop("level")


@query(
    "win18_directional_accuracy",
    f"""with {APE}, s as (select product, sign(sales - lag(sales) over ({OVER})) = sign(pred - lag(pred) over ({OVER})) as same from ape)
  select product, round(avg(same::integer) * 100, 6) as directional_accuracy, count(same) as n_steps from s group by 1""",
)
def win18(spark, sf):
    out = win.directional_accuracy(ape_frame(spark, sf), "sales", "pred", K, "date")
    return rounded(out, 6, "directional_accuracy")


@query(
    "win19_rolling_weighted_error",
    f"""with {APE}, s as (select *, sum(y) over r as sw, sum(y * ape) over r as swa, avg(ape) over r as m, count(ape) over r as n from ape
   window r as ({OVER} rows between 12 preceding and current row))
  select product, date, round(case when n = 13 then case when sw = 0 then m else swa / sw end end, 8) as weighted_mape from s""",
)
def win19(spark, sf):
    out = win.rolling_weighted_error(ape_frame(spark, sf), "ape", "y", K, "date")
    return out.select("product", "date", F.round("weighted_mape", 8).alias("weighted_mape"))


@query(
    "win20_anomaly_score",
    f"""{WM}, s as (select product, date, sales, count(sales) over r as n, avg(sales) over r as m, stddev_samp(sales) over r as sd from wm
    window r as ({OVER} rows between 12 preceding and current row)),
  z as (select product, date, case when n = 13 then (sales - m) / nullif(sd, 0) end as z from s)
  select product, date, round(z, 6) as z, coalesce(abs(z) > 2, false) as is_anomaly from z""",
)
def win20(spark, sf):
    out = win.anomaly_score(t.weekly_model(spark, sf), "sales", K, "date")
    return out.select("product", "date", F.round("z", 6).alias("z"), "is_anomaly")


@query(
    "win21_modal_step",
    f"""{WM}, s as (select product, date_diff('day', lag(date) over ({OVER}), date)::integer as step from wm),
  c as (select product, step, count(*) as n from s where step is not null group by 1,2)
  select product, arg_max(step, (n, -step)) as modal_step, round(max(n)::double / sum(n)::double, 8) as share, max(n)::double / sum(n)::double > 0.8 as consistent from c group by 1""",
)
def win21(spark, sf):
    return rounded(win.modal_step(t.weekly_model(spark, sf), "date", K), 8, "share")


@query(
    "win22_monotonic_dates",
    f"""with {WSALES}, x as (select product, date, date < lag(date) over (partition by product order by sales) as bad from ws)
  select product, coalesce(count(*) filter (where bad), 0) as n_violations, coalesce(count(*) filter (where bad), 0) = 0 as is_sorted from x group by 1
  union all select 'by week', 0, true""",
)
def win22(spark, sf):
    ws = weekly_sales(spark, sf)
    by_sales = win.order_violations(ws, "date", "sales", K)
    weeks = ws.groupBy("date").agg(t.total("sales").alias("sales"))
    by_week = win.order_violations(weeks.withColumn("product", F.lit("by week")), "date", "date", K)
    return by_sales.union(by_week)


# ---------------------------------------------------------------- sorts, limits, dedup
@query("top01_sort_nulls_last", f"with {WSALES} select product, date, sales from ws")
def top01(spark, sf):
    return top.sort_nulls_last(weekly_sales(spark, sf), "sales")


@query(
    "top02_keep_first_dedup",
    f"""with {t.QUOTES} select company, date, product_id, round(max(rate), 6) as rate from quotes group by 1,2,3""",
)
def top02(spark, sf):
    q = t.quotes(spark, sf).select("company", "date", "product_id", "rate", "l_orderkey")
    out = rt.keep_highest(q, ["company", "date", "product_id"], "rate", "l_orderkey")
    return out.select("company", "date", "product_id", F.round("rate", 6).alias("rate"))


@query("top03_full_row_distinct", "select distinct l_returnflag, l_linestatus, l_linenumber, l_quantity, l_discount from lineitem")
def top03(spark, sf):
    li = t.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount")
    return top.full_row_distinct(li)


@query(
    "top04_k_smallest",
    "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice, l_orderkey, l_linenumber, l_partkey limit 25",
)
def top04(spark, sf):
    out = top.smallest(
        t.table(spark, sf, "lineitem"), "l_extendedprice", 25, ["l_orderkey", "l_linenumber", "l_partkey"]
    )
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "top05_best_with_fallback",
    """with m as (select l_returnflag as grp, l_suppkey as model, cast(sum(cast(l_extendedprice*100 as bigint)) as bigint) as score,
   l_returnflag <> 'N' and l_suppkey % 3 = 0 as valid, l_suppkey % 2 = 0 as converged from lineitem group by l_returnflag, l_suppkey),
  r as (select *, row_number() over (partition by grp order by not valid, score, model) as rn from m where valid or converged)
  select grp, model, score, case when not valid then 'no valid model; best converged one taken' end as note from r where rn = 1""",
)
def top05(spark, sf):
    m = (
        t.table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("grp"), F.col("l_suppkey").alias("model"))
        .agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("score"))
        .withColumn("valid", (F.col("grp") != "N") & (F.col("model") % 3 == 0))
        .withColumn("converged", F.col("model") % 2 == 0)
    )
    return top.best_model(m, ["grp"], "score", "valid", "converged", "model").select("grp", "model", "score", "note")


@query(
    "top06_latest_row_momentum",
    f"""{WM}, l as (select product, date, lag(sales, 1) over ({OVER}) as a, lag(sales, 2) over ({OVER}) as b, lag(sales, 3) over ({OVER}) as c from wm),
  r as (select *, row_number() over (partition by product order by date desc) as rn from l)
  select product, date, cast(round_even((a + b + c) / 1e5, 0) * 1e5 as double) as momentum from r where rn = 1""",
)
def top06(spark, sf):
    wm = win.lag_bank(t.weekly_model(spark, sf), [("sales", "s", "backward")], 3, K, "date")
    return top.latest_momentum(wm, K, "date", ["s_t1", "s_t2", "s_t3"], power=5)


@query(
    "top07_pareto_frontier",
    """with p as (select o_orderkey, cast(o_orderdate as date) as d, o_totalprice as y from orders),
  b as (select d, max(y) as y from p group by 1),
  k as (select d, y from (select d, y, max(y) over (order by d rows between unbounded preceding and 1 preceding) as m from b) where m is null or y > m)
  select p.o_orderkey, p.d, p.y from p join k on p.d = k.d and p.y = k.y""",
)
def top07(spark, sf):
    p = t.table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderdate").cast("date").alias("d"),
        F.unix_date(F.col("o_orderdate").cast("date")).alias("x"),
        F.col("o_totalprice").alias("y"),
    )
    return top.pareto_frontier(p, "x", "y").drop("x")


@query(
    "top08_reduced_search_order",
    """select o_custkey, count(*) filter (where o_orderpriority = '1-URGENT') as n_priority, count(*) as n_features from orders
  group by 1 order by 2 desc, 3 desc, 1 limit 40""",
)
def top08(spark, sf):
    m = t.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("n_priority"), F.count(F.lit(1)).alias("n_features")
    )
    return top.reduced_search_order(m, "n_priority", "n_features", 40, "o_custkey")


# ---------------------------------------------------------------- sets
@query(
    "set01_union_all",
    """select o_orderkey as id, o_totalprice as amount, o_orderpriority as product, null::integer as line from orders
  union all select l_orderkey, l_extendedprice, null, l_linenumber from lineitem""",
)
def set01(spark, sf):
    o = t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("product")
    )
    li = t.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("amount")
    )
    return st.union_all([o, li])


@query(
    "set02_column_set_changes",
    f"""with {t.SALES}, c(column_name, change, type_before, type_after) as (values ('week', 'added', null, 'date'),
   ('o_custkey', 'removed', 'bigint', null), ('o_orderkey', 'retyped', 'bigint', 'string'))
  select c.*, n.n_rows from c, (select count(*) as n_rows from sales) n""",
)
def set02(spark, sf):
    before = t.sales(spark, sf)
    after = before.drop("o_custkey").withColumn("o_orderkey", F.col("o_orderkey").cast("string")).withColumn(
        "week", X.week_ending_sunday("date")
    )
    changes = st.schema_difference(spark, before.schema, after.schema)
    return changes.crossJoin(after.agg(F.count(F.lit(1)).alias("n_rows")))


@query(
    "set03_missing_dates",
    f"""with {t.SALES}, b as (select product, min(date) lo, max(date) hi from sales group by 1)
  select product, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date from b except select product, date from sales""",
)
def set03(spark, sf):
    s = t.sales(spark, sf).select("product", "date")
    return st.dates_missing_from(cal.spine_of(s, "date", K), s, ["product", "date"])


@query(
    "set04_jaccard",
    """with u as (select l_returnflag as f, list(distinct l_linenumber || '-' || l_quantity::integer || '-' || (l_discount * 100)::integer) as s from lineitem group by 1),
  p as (select a.f as a, b.f as b, a.s as sa, b.s as sb from u a, u b where a.f < b.f)
  select a, b, round(len(list_intersect(sa, sb))::double / len(list_distinct(list_concat(sa, sb))), 8) as jaccard,
  len(list_intersect(sa, sb))::bigint as n_common, (len(sa) - len(list_intersect(sa, sb)))::bigint as n_only_a,
  (len(sb) - len(list_intersect(sa, sb)))::bigint as n_only_b from p""",
)
def set04(spark, sf):
    item = F.concat_ws("-", "l_linenumber", F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int"))
    return st.jaccard_of_sets(t.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("f"), item.alias("item")), "f", "item")


# ---------------------------------------------------------------- scalar functions
@query(
    "sca01_calendar_parts",
    f"with {t.SALES} select o_orderkey, year(date)::integer as year, quarter(date)::integer as quarter, month(date)::integer as month, "
    + ", ".join(f"month(date) = {m} as month_{m}" for m in range(1, 13))
    + ", "
    + ", ".join(f"quarter(date) = {q} as q{q}" for q in range(1, 5))
    + " from sales",
)
def sca01(spark, sf):
    return t.sales(spark, sf).select("o_orderkey", *X.calendar_columns("date"))


@query(
    "sca02_quarter_label",
    f"with {t.SALES} select year(date)::varchar || '_Q' || quarter(date)::varchar as current_quarter, count(*) as n, {xsum('premium')} as total from sales group by 1",
)
def sca02(spark, sf):
    return t.sales(spark, sf).groupBy(X.quarter_label("date").alias("current_quarter")).agg(
        F.count(F.lit(1)).alias("n"), t.total("premium").alias("total")
    )


@query(
    "sca03_day_of_year",
    f"with {t.SALES} select dayofyear(date)::integer as day_of_year, count(*) as n from sales group by 1",
)
def sca03(spark, sf):
    return t.sales(spark, sf).groupBy(F.dayofyear("date").alias("day_of_year")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "sca04_holiday_flag",
    f"""with {t.SALES} select product, cast(case when dayofyear(date) < 13 or dayofyear(date) > 359 then 1 else 0 end as integer) as holiday,
  count(*) as n from sales group by 1,2""",
)
def sca04(spark, sf):
    s = t.sales(spark, sf)
    return s.groupBy("product", X.holiday_flag(F.dayofyear("date")).alias("holiday")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "sca05_transforms",
    """select c_custkey, round(case when c_acctbal > -1 then ln(1 + c_acctbal) end, 8) as log1p, round(case when c_acctbal > 0 then ln(c_acctbal) end, 8) as log,
  round(case when c_acctbal >= 0 then sqrt(c_acctbal) end, 8) as sqrt, round(exp(c_acctbal / 10000), 8) as exp,
  round(exp(c_acctbal / 10000) - 1, 8) as expm1 from customer""",
)
def sca05(spark, sf):
    c = t.table(spark, sf, "customer").withColumn("small", F.col("c_acctbal") / 10000)
    pick = {"log1p": "c_acctbal", "log": "c_acctbal", "sqrt": "c_acctbal", "exp": "small", "expm1": "small"}
    return c.select("c_custkey", *[F.round(X.transformed(src, n), 8).alias(n) for n, src in pick.items()])


@query("sca06_spread", f"{WM} select product, date, round(own - comp, 8) as \"Spread\" from wm")
def sca06(spark, sf):
    wm = ft.spread(t.weekly_model(spark, sf), "own", "comp")
    return wm.select("product", "date", F.round("Spread", 8).alias("Spread"))


@query(
    "sca07_index_scaling",
    f"""with {t.DAILY}, {t.MACRO}, j as (select product, date, sales, case when month(date) % 2 = 0 then 1 + tax end as cpi, qty from daily left join macro using (date)),
  f as (select product, date, sales, last_value(cpi ignore nulls) over ({OVER} rows between unbounded preceding and current row) as cpi,
   avg(qty) over ({OVER} rows between 6 preceding and current row) as qty from j)
  select product, date, sales * cpi as sales, round(qty, 6) as qty from f""",
)
def sca07(spark, sf):
    d = cal.gap_filled_daily(t.sales(spark, sf), "date", "premium", K).drop("sales_smooth").withColumn("sales", F.round("sales", 4))
    m = t.macro(spark, sf).withColumn("cpi", F.when(F.month("date") % 2 == 0, 1 + F.col("tax")))
    j = d.join(m.select("date", "cpi", "qty"), "date", "left")
    out = ft.smooth_columns(ft.scale_by_index(j, "cpi", ["sales"], K, "date"), ["qty"], K, "date", 7)
    return out.select("product", "date", "sales", F.round("qty", 6).alias("qty"))


def _poly_sql():
    b = {"own": "own", "comp": "comp"}
    cols = []
    for s, f in (("current", "{c}"), ("t1", "lag({c}, 1) over (" + OVER + ")"), ("t2", "lag({c}, 2) over (" + OVER + ")")):
        v = {k: f.format(c=c) for k, c in b.items()}
        cols += [f"round({v[k]} * {v[k]}, 6) as derived_{k}_squared_{s}" for k in b]
        cols.append(f"round({v['own']} * {v['comp']}, 6) as derived_own_comp_interaction_{s}")
    return ", ".join(cols)


@query(
    "sca08_polynomials_interactions",
    f"{WM} select product, date, {_poly_sql()}, round(own * own * own, 6) as own_cubed, round(comp * comp * comp, 6) as comp_cubed, "
    "round((own + comp) / 2, 6) as own_comp_avg from wm",
)
def sca08(spark, sf):
    wm = t.weekly_model(spark, sf).select("product", "date", "own", "comp")
    bank = win.lag_bank(wm, [("own", "own", "backward"), ("comp", "comp", "backward")], 2, K, "date")
    out = ft.cubes_and_pair_means(ft.polynomial_bank(bank, ["own", "comp"], 2), ["own", "comp"])
    keep = [c for c in out.columns if c.startswith("derived_") or c.endswith(("_cubed", "_avg"))]
    return out.select("product", "date", *[F.round(c, 6).alias(c) for c in keep])


def _kink_sql():
    cols = []
    for k in range(2):
        own = "own" if k == 0 else f"lag(own, {k}) over ({OVER})"
        d = f"(lag(comp, {k + 2}) over ({OVER}) - {own})"
        kink = f"(abs({d}) - {d})"
        cols += [f"round({kink}, 6) as pos_lag_{k}", f"round({kink} * {own}, 6) as pos_lag_scale_{k}",
                 f"round({kink} * {kink}, 6) as pos_lag_sq_{k}"]
    return ", ".join(cols)


@query("sca09_position_kinks", f"{WM} select product, date, {_kink_sql()} from wm")
def sca09(spark, sf):
    wm = t.weekly_model(spark, sf).select("product", "date", "own", "comp")
    bank = win.lag_bank(wm, [("own", "own", "backward"), ("comp", "comp", "backward")], 3, K, "date")
    out = ft.kink_features(bank, "own", "comp", 2)
    keep = [c for c in out.columns if c.startswith("pos_lag")]
    return out.select("product", "date", *[F.round(c, 6).alias(c) for c in keep])


CLZ = f"[{', '.join(f'coalesce({c},0)' for c in t.COMPETITORS)}]"


@query(
    "sca10_semantic_aliases",
    f"""with {t.RATE_WIDE} select date, round(list_median({CLZ}), 6) as "C_median", round(list_sum(list_sort({CLZ},'DESC')[1:3])/3, 6) as "C_top_3",
  round(list_sum(list_sort({CLZ},'DESC')[1:5])/5, 6) as "C_top_5", round(list_sort({CLZ},'DESC')[1], 6) as "C_first",
  round(list_sort({CLZ},'DESC')[2], 6) as "C_second", round(list_sort({CLZ},'DESC')[3], 6) as "C_third" from rwide""",
)
def sca10(spark, sf):
    r = t.rate_wide(spark, sf)
    ranked = r.select("date", *[c.alias(n) for n, c in rt.competitor_ranks(t.COMPETITORS).items()])
    out = rt.with_rank_aliases(ranked)
    return out.select("date", *[F.round(c, 6).alias(c) for c in rt.RANK_ALIASES.values()])


@query(
    "sca11_basis_points",
    f"{WM} select product, date, cast(trunc(round(own * 1.005, 9) * 100) as integer) as bps, cast(trunc(round(-own * 1.005, 9) * 100) as integer) as neg_bps from wm",
)
def sca11(spark, sf):
    v = F.round(F.col("own") * 1.005, 9)
    n = F.round(-F.col("own") * 1.005, 9)
    return t.weekly_model(spark, sf).select(
        "product", "date", X.basis_points(v).alias("bps"), X.basis_points(n).alias("neg_bps")
    )


@query(
    "sca12_categorical_label",
    "select distinct cast(l_discount * 100 as integer) * 25 as sort_key, (cast(l_discount * 100 as integer) * 25)::varchar || 'bps' as label from lineitem",
)
def sca12(spark, sf):
    b = t.table(spark, sf, "lineitem").select((F.round(F.col("l_discount") * 100).cast("int") * 25).alias("sort_key"))
    return b.distinct().withColumn("label", X.basis_point_label("sort_key"))


@query(
    "sca14_threshold_ladders",
    f"""{WM}, s as (select product, stddev_pop(y) / abs(avg(y)) as aic_cv, stddev_pop(own) / abs(avg(own)) as r2_cv, avg(y) * 30 as score from wm group by 1)
  select product, case when aic_cv < 0.005 and r2_cv < 0.1 then 'STABLE' when aic_cv < 0.01 and r2_cv < 0.2 then 'MODERATE' else 'UNSTABLE' end as stability,
  case when aic_cv < 0.002 and r2_cv < 0.05 then 95 when aic_cv < 0.005 and r2_cv < 0.1 then 85 when aic_cv < 0.01 and r2_cv < 0.2 then 65
   when aic_cv < 0.02 and r2_cv < 0.3 then 40 else 20 end as stability_score,
  case when score <= 5 then 'EXCELLENT' when score <= 10 then 'GOOD' when score <= 20 then 'ACCEPTABLE' when score <= 40 then 'CONCERNING' else 'POOR' end as generalization,
  case when score >= 80 then 'A+ (Excellent)' when score >= 70 then 'A (Very Good)' when score >= 60 then 'B+ (Good)' when score >= 50 then 'B (Average)' else 'C (Below Average)' end as grade,
  round(greatest(0, least(100, (aic_cv + 2) * 25)), 6) as ir_score from s""",
)
def sca14(spark, sf):
    from quotegrid.functions import grades as g

    s = t.weekly_model(spark, sf).groupBy("product").agg(
        (F.stddev_pop("y") / F.abs(F.avg("y"))).alias("aic_cv"),
        (F.stddev_pop("own") / F.abs(F.avg("own"))).alias("r2_cv"),
        (F.avg("y") * 30).alias("score"),
    )
    return s.select(
        "product",
        g.stability("aic_cv", "r2_cv", F.lit(1.0)).alias("stability"),
        g.block_stability("aic_cv", "r2_cv")["stability_score"].alias("stability_score"),
        g.generalization("score")["quality"].alias("generalization"),
        g.composite_grade("score").alias("grade"),
        F.round(g.ir_score("aic_cv"), 6).alias("ir_score"),
    )


# ---------------------------------------------------------------- reshaping
@query(
    "rsh01_pivot_company_rates",
    f"""with {ASOF}, sm as (select company, date, avg(rate) over (partition by company order by date rows between 6 preceding and current row) as rate from ff)
  select date, {', '.join(f"round(max(case when company='{c}' then rate end), 6) as {c}" for c in t.COMPANIES)} from sm group by 1""",
)
def rsh01(spark, sf):
    grid = rt.company_rate_grid(t.quotes(spark, sf), "company", "date", "rate", 7)
    out = rt.pivot_companies(grid, "company", "date", "rate", t.COMPANIES)
    return out.select("date", *[F.round(c, 6).alias(c) for c in t.COMPANIES])


@query(
    "rsh02_melt_intervals",
    f"with {WEEKLY_CI} select product, range, round(value, 6) as value from (unpivot (select product, bottom, median, top from qs) on bottom, median, top into name range value value)",
)
def rsh02(spark, sf):
    out = rsh.melt(weekly_ci(spark, sf), ["product"], ["bottom", "median", "top"])
    return out.withColumn("value", F.round("value", 6))


@query(
    "rsh03_melt_with_context",
    f"""with {WEEKLY_CI}, ob as (select product, 'dollars' as output_type, bottom, median, top from qs
   union all select product, 'pct_change', (bottom / median - 1) * 100, 0, (top / median - 1) * 100 from qs),
  l as (select *, row_number() over (partition by product order by date desc) as rn from wm),
  u as (unpivot ob on bottom, median, top into name range value value)
  select u.product, output_type, range, cast(case when output_type = 'dollars' then round_even(value / 1e5, 0) * 1e5 else round_even(round(value, 6), 2) end as double) as value,
  round(l.own, 6) as own_rate, round(l.comp, 6) as competitor_rate, l.sales as previous_sales, l.date as prediction_date from u join l on u.product = l.product and l.rn = 1""",
)
def rsh03(spark, sf):
    ci = weekly_ci(spark, sf)
    pct = ci.select(
        "product",
        F.lit("pct_change").alias("output_type"),
        # six digits first: half-way values then do not depend on floating noise
        *[F.round((F.col(c) / F.col("median") - 1) * 100, 6).alias(c) for c in ("bottom", "median", "top")],
    )
    both = ci.select("product", F.lit("dollars").alias("output_type"), "bottom", "median", "top").union(pct)
    latest = top.latest_row(t.weekly_model(spark, sf).select("product", "date", "own", "comp", "sales"), K, "date")
    context = latest.select(
        "product",
        F.round("own", 6).alias("own_rate"),
        F.round("comp", 6).alias("competitor_rate"),
        F.col("sales").alias("previous_sales"),
        F.col("date").alias("prediction_date"),
    )
    return rsh.melt_with_context(
        both, context, ["product", "output_type"], ["bottom", "median", "top"], on=["product"], dollar_power=5
    )


@query(
    "rsh04_forecast_export",
    f"""with {APE} select product, date, metric_type, round(value, 6) as value from (unpivot (select product, date, sales as y_true, pred as y_mean, ape as error from ape)
  on y_true, y_mean, error into name metric_type value value)""",
)
def rsh04(spark, sf):
    a = ape_frame(spark, sf).select(
        "product", "date", F.col("sales").alias("y_true"), F.col("pred").alias("y_mean"), F.col("ape").alias("error")
    )
    out = rsh.forecast_export(a, K, "date", ["y_true", "y_mean", "error"])
    return out.withColumn("value", F.round("value", 6))


@query(
    "rsh05_explode_replicates",
    f"{WM} select product, (row_number() over ({OVER}))::integer as replicate, round(y, 8) as aic, round(own, 8) as r2 from wm",
)
def rsh05(spark, sf):
    # one weekly series per list: bounded by the calendar
    lists = t.weekly_model(spark, sf).groupBy("product").agg(
        F.array_sort(F.collect_list(F.struct("date", "y", "own"))).alias("s")
    )
    lists = lists.select("product", F.col("s.y").alias("aic"), F.col("s.own").alias("r2"))
    out = rsh.explode_replicates(lists, K, ["aic", "r2"])
    return rounded(out, 8, "aic", "r2")
