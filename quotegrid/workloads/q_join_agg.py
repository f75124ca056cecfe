"""Queries: joins and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotegrid.functions import exprs as X
from quotegrid.operators import aggregates as agg
from quotegrid.operators import calendar as cal
from quotegrid.operators import gram
from quotegrid.operators import joins as jon
from quotegrid.operators import rates as rt
from quotegrid.operators import windows as win
from quotegrid.workloads import tables as t
from quotegrid.workloads.q_scan_filter import WEIGHTS, WEIGHTS_WIDE, weights_wide
from quotegrid.workloads.registry import query
from quotegrid.workloads.tables import xavg, xsum

# ---------------------------------------------------------------- shared frames

def r4(df, *cols):
    """Sums of doubles, rounded as the SQL rounds them."""
    return df.withColumns({c: F.round(c, 4) for c in cols})


DAY_SALES = f"""{t.SALES}, dsales as (select date, {xsum('premium')} as sales from sales group by 1)"""
CONTRACT = f"""dcontract as (select cast(l_shipdate as date) as date, {xsum('l_extendedprice')} as sales_by_contract_date
  from lineitem group by 1)"""


def day_sales(spark, sf):
    return cal.daily_total(t.sales(spark, sf), "date", "premium", [], "sales")


def day_contract(spark, sf):
    return cal.daily_total(
        t.table(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice", [], "sales_by_contract_date"
    )


@query(
    "jon01_spine_join_chain",
    f"""with {DAY_SALES}, {CONTRACT}, {t.MACRO},
  spine as (select cast(unnest(generate_series(date '1995-01-01', date '2001-12-31', interval 1 day)) as date) as date)
  select distinct date, sales, sales_by_contract_date, round(tax, 8) as tax, round(qty, 8) as qty from spine left join dsales using (date)
  left join dcontract using (date) left join macro using (date)""",
)
def jon01(spark, sf):
    spine = cal.date_spine(spark, "1995-01-01", "2001-12-31")
    out = jon.left_join_chain(
        spine, [day_sales(spark, sf), day_contract(spark, sf), t.macro(spark, sf)], ["date"], distinct=True
    )
    return r4(out, "sales", "sales_by_contract_date").withColumns({"tax": F.round("tax", 8), "qty": F.round("qty", 8)})


@query(
    "jon02_calendar_spine",
    f"""with {t.SALES}, b as (select product, min(date) lo, max(date) hi from sales group by 1)
  select product, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date from b""",
)
def jon02(spark, sf):
    return cal.spine_of(t.sales(spark, sf), "date", ["product"])


@query(
    "jon03_inner_join_distinct",
    f"""with {DAY_SALES}, {t.QUOTES}, r as (select date, {xavg('rate')} as rate from quotes group by 1)
  select distinct date, sales, round(rate, 8) as rate from dsales join r using (date)""",
)
def jon03(spark, sf):
    r = t.quotes(spark, sf).groupBy("date").agg(t.mean("rate").alias("rate"))
    return jon.inner_join_distinct(r4(day_sales(spark, sf), "sales"), r, ["date"]).withColumn("rate", F.round("rate", 8))


def _weights_with_a_gap(spark, sf):
    """All quarters; the earlier ones have no weight."""
    w = weights_wide(spark, sf)
    return w.withColumns({c: F.when(F.col("current_quarter") >= "1997", F.col(c)) for c in w.columns if c != "current_quarter"})


@query(
    "jon04_quarter_weights_left",
    f"""with {t.RATE_WIDE}, {WEIGHTS_WIDE.split(',', 1)[1].split('wq as', 1)[1].join(['wq as', ''])}
  select date, year(date)::varchar || '_Q' || quarter(date)::varchar as current_quarter,
  round(NATION_9, 8) as rate, round(NATION_9_weight, 8) as weight from rwide
  left join (select current_quarter, case when current_quarter >= '1997' then NATION_9_weight end as NATION_9_weight from wwide) w
  on year(date)::varchar || '_Q' || quarter(date)::varchar = w.current_quarter""",
)
def jon04(spark, sf):
    out = jon.with_quarter_weights(t.rate_wide(spark, sf), _weights_with_a_gap(spark, sf))
    return out.select(
        "date", "current_quarter", F.round("NATION_9", 8).alias("rate"), F.round("NATION_9_weight", 8).alias("weight")
    )


@query(
    "jon05_quarter_weights_inner",
    f"""with {t.RATE_WIDE}, {WEIGHTS_WIDE.split(',', 1)[1].split('wq as', 1)[1].join(['wq as', ''])}
  select distinct date, w.current_quarter, round(NATION_9, 8) as rate, round(NATION_9_weight, 8) as weight from rwide
  join (select current_quarter, case when current_quarter >= '1997' then NATION_9_weight end as NATION_9_weight from wwide) w
  on year(date)::varchar || '_Q' || quarter(date)::varchar = w.current_quarter""",
)
def jon05(spark, sf):
    w = _weights_with_a_gap(spark, sf).select("current_quarter", "NATION_9_weight")
    r = t.rate_wide(spark, sf).select("date", "NATION_9")
    return jon.with_quarter_weights(r, w, how="inner").select(
        "date", "current_quarter", F.round("NATION_9", 8).alias("rate"), F.round("NATION_9_weight", 8).alias("weight")
    )


ASOF = f"""{t.QUOTES}, rd as (select company, date, {xavg('rate')} as rate from quotes group by 1,2),
sp as (select company, cast(unnest(generate_series(min(date), (select max(date) from rd), interval 1 day)) as date) as date
  from rd group by company),
ff as (select s.company, s.date, last_value(r.rate ignore nulls) over (partition by s.company order by s.date
  rows between unbounded preceding and current row) as rate from sp s left join rd r using (company, date))"""


@query("jon06_as_of_daily", f"with {ASOF} select company, date, round(rate, 8) as rate from ff")
def jon06(spark, sf):
    daily = rt.daily_company_mean(t.quotes(spark, sf), "company", "date", "rate")
    return jon.as_of_daily(daily, "rate", ["company"]).withColumn("rate", F.round("rate", 8))


WEEKLY_CI = f"""{t.WEEKLY_MODEL}, qs as (select product, quantile_cont(sales, 0.025) as bottom, quantile_cont(sales, 0.5) as median,
  quantile_cont(sales, 0.975) as top from wm group by 1)"""


def weekly_ci(spark, sf):
    q = F.percentile("sales", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    ci = t.weekly_model(spark, sf).groupBy("product").agg(q.alias("q"))
    return ci.select("product", *[F.col("q")[i].alias(n) for i, n in enumerate(["bottom", "median", "top"])])


@query(
    "jon07_interval_join",
    f"""with {WEEKLY_CI}, d as (unpivot (select product, bottom, median, top from qs) on bottom, median, top into name range value dollar)
  select d.product, range, round(dollar, 6) as dollar, round((dollar / median - 1) * 100, 6) as pct_change
  from d join qs using (product)""",
)
def jon07(spark, sf):
    from quotegrid.operators.reshape import melt

    ci = weekly_ci(spark, sf)
    dollars = melt(ci, ["product"], ["bottom", "median", "top"], "range", "dollar")
    pct = ci.select("product", *[((F.col(c) / F.col("median") - 1) * 100).alias(c) for c in ("bottom", "top")],
                    F.lit(0.0).alias("median"))
    pct = melt(pct, ["product"], ["bottom", "median", "top"], "range", "pct_change")
    return dollars.join(pct, ["product", "range"]).select(
        "product", "range", F.round("dollar", 6).alias("dollar"), F.round("pct_change", 6).alias("pct_change")
    )


@query(
    "jon08_group_membership",
    f"""with {t.QUOTES}, g as (select p_partkey as product_id, p_brand as grp from part union all select p_partkey, p_type from part)
  select grp, count(*) as n, round({xavg('rate')}, 8) as rate from quotes join g using (product_id) group by 1""",
)
def jon08(spark, sf):
    p = t.table(spark, sf, "part")
    g = p.select(
        F.col("p_partkey").alias("product_id"), F.explode(F.array("p_brand", "p_type")).alias("grp")
    )
    return (
        jon.members_of_groups(t.quotes(spark, sf).select("product_id", "rate"), g, "product_id")
        .groupBy("grp")
        .agg(F.count(F.lit(1)).alias("n"), F.round(t.mean("rate"), 8).alias("rate"))
    )


@query(
    "jon09_missing_periods",
    f"""with {t.SALES}, b as (select product, min(date) lo, max(date) hi from sales group by 1),
  s as (select product, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date from b)
  select product, date from s where not exists (select 1 from sales x where x.product = s.product and x.date = s.date)""",
)
def jon09(spark, sf):
    return cal.missing_periods(t.sales(spark, sf).select("product", "date").distinct(), "date", ["product"], 1)


SIMPLE_FIT = f"""{t.WEEKLY_MODEL}, fit as (select product, regr_slope(y, own) as slope, regr_intercept(y, own) as intercept,
  max(own) as top_own from wm group by 1)"""


def simple_fit(spark, sf):
    return t.weekly_model(spark, sf).groupBy("product").agg(
        F.regr_slope("y", "own").alias("slope"), F.regr_intercept("y", "own").alias("intercept")
    )


@query(
    "jon10_scenarios_by_models",
    f"""with {SIMPLE_FIT} select product, scenario, round(exp(intercept + slope * scenario) - 1, 6) as prediction
  from fit cross join (select unnest(range(0, 21)) * 0.5::double as scenario)""",
)
def jon10(spark, sf):
    scenarios = spark.range(21).select((F.col("id") * 0.5).alias("scenario"))
    out = jon.scenario_grid(simple_fit(spark, sf), scenarios)
    return out.select(
        "product",
        "scenario",
        F.round(F.exp(F.col("intercept") + F.col("slope") * F.col("scenario")) - 1, 6).alias("prediction"),
    )


@query(
    "jon11_competitor_shift_grid",
    f"""with {t.WEEKLY_MODEL}, last as (select product, max(date) as d from wm group by 1),
  base as (select product, own, comp from wm join last on wm.product = last.product and wm.date = last.d)
  select base.product, round(own + o * 0.25, 6) as own_rate, round(comp + c * 0.25, 6) as comp_rate, c = 0 as is_default
  from base cross join (select unnest(range(-4, 5)) as o) cross join (select unnest(range(-2, 3)) as c)""".replace(
        "select product, own, comp from wm join last", "select wm.product, own, comp from wm join last"
    ),
)
def jon11(spark, sf):
    from quotegrid.operators.topk import latest_row

    base = latest_row(t.weekly_model(spark, sf).select("product", "date", "own", "comp"), ["product"], "date")
    own = spark.range(-4, 5).select(F.col("id").alias("o"))
    comp = spark.range(-2, 3).select(F.col("id").alias("c"))
    return jon.scenario_grid(jon.scenario_grid(base, own), comp).select(
        "product",
        F.round(F.col("own") + F.col("o") * 0.25, 6).alias("own_rate"),
        F.round(F.col("comp") + F.col("c") * 0.25, 6).alias("comp_rate"),
        (F.col("c") == 0).alias("is_default"),
    )


@query(
    "jon12_lookup_with_default",
    f"""with {t.SALES}, w as (select product, count(*) as n from sales group by 1),
  ir as (select product, round({xavg('premium')}, 4) as ir from sales where status = 'P' and product < '3' group by 1)
  select product, n, coalesce(ir, 0.0) as ir from w left join ir using (product)""",
)
def jon12(spark, sf):
    s = t.sales(spark, sf)
    w = s.groupBy("product").agg(F.count(F.lit(1)).alias("n"))
    ir = s.where((F.col("status") == "P") & (F.col("product") < "3")).groupBy("product").agg(
        F.round(t.mean("premium"), 4).alias("ir")
    )
    return jon.left_join_chain(w, [ir], ["product"]).withColumn("ir", F.coalesce("ir", F.lit(0.0)))


@query(
    "jon13_metric_join_on_date",
    f"""with {t.WEEKLY_MODEL}, p as (select product, date, sales, lag(sales) over (partition by product order by date) as pred from wm)
  select product, date, sales as y_true, pred as y_predict, round(abs(sales - pred) / sales, 8) as abs_pct_error
  from p where pred is not null""",
)
def jon13(spark, sf):
    from quotegrid.operators.windows import persistence

    wm = t.weekly_model(spark, sf).select("product", "date", F.col("sales").alias("y_true"))
    pred = wm.select("product", "date", persistence("y_true", 1, ["product"], "date").alias("y_predict"))
    pred = pred.where(F.col("y_predict").isNotNull())
    err = wm.join(pred, ["product", "date"]).select(
        "product", "date", F.round(F.abs(F.col("y_true") - F.col("y_predict")) / F.col("y_true"), 8).alias("abs_pct_error")
    )
    return jon.join_metrics([err, wm, pred], ["product", "date"])


@query(
    "jon14_table_comparison",
    f"""with {t.WEEKLY_MODEL}, b as (select product, date, sales, own + case when product = '5-LOW' then 0.5 else 0 end as own
  from wm where date < date '2001-01-01'),
  j as (select a.product as ap, b.product as bp, a.sales as s1, b.sales as s2, a.own as o1, b.own as o2
    from wm a full outer join b on a.product = b.product and a.date = b.date),
  k as (select count(*) filter (where bp is null) as only_left, count(*) filter (where ap is null) as only_right,
    max(abs(s1 - s2)) as ds, max(abs(s1 - s2) / nullif(abs(s1), 0)) as rs, max(abs(o1 - o2)) as dw,
    max(abs(o1 - o2) / nullif(abs(o1), 0)) as rw, count(*) filter (where (s1 is null) <> (s2 is null)) as ms,
    count(*) filter (where (o1 is null) <> (o2 is null)) as mo from j)
  select 'sales' as column_name, only_left, only_right, round(ds, 6) as max_abs_diff, round(rs, 6) as max_rel_diff, ms as null_mismatches,
    false as equal from k
  union all select 'own', only_left, only_right, round(dw, 6), round(rw, 6), mo, false from k""",
)
def jon14(spark, sf):
    a = t.weekly_model(spark, sf).select("product", "date", "sales", "own")
    b = a.where(F.col("date") < "2001-01-01").withColumn(
        "own", F.col("own") + F.when(F.col("product") == "5-LOW", 0.5).otherwise(0.0)
    )
    out = jon.compare_tables(a, b, ["product", "date"], ["sales", "own"], 1e-12)
    return out.withColumns({c: F.round(c, 6) for c in ("max_abs_diff", "max_rel_diff")})


# ---------------------------------------------------------------- aggregations
@query(
    "agg01_daily_gap_filled",
    f"""with {t.DAILY},
  ctot as (select l_returnflag as product, cast(l_shipdate as date) as date, {xsum('l_extendedprice')} as raw from lineitem group by 1,2),
  cspan as (select product, min(date) lo, max(date) hi from ctot group by 1),
  cgrid as (select product, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date from cspan),
  contract as (select g.product, g.date, coalesce(c.raw, 0.0) as sales from cgrid g left join ctot c using (product, date)),
  u as (select 'application' as series, * from daily union all select 'contract', * from contract)
  select series, product, date, sales, round(avg(sales) over (partition by series, product order by date
    rows between 13 preceding and current row), 6) as sales_smooth from u""",
)
def agg01(spark, sf):
    a = cal.gap_filled_daily(t.sales(spark, sf), "date", "premium", ["product"])
    li = t.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "product")
    c = cal.gap_filled_daily(li, "l_shipdate", "l_extendedprice", ["product"])
    both = a.select(F.lit("application").alias("series"), "*").union(c.select(F.lit("contract").alias("series"), "*"))
    return r4(both, "sales").withColumn("sales_smooth", F.round("sales_smooth", 6))


@query(
    "agg02_weekly_by_dict",
    f"""with {t.DAILY}, x as (select *, nullif(sales, 0) as seen from daily),
  w as (select product, {t.week_sql('date')} as date, avg(seen) as mean_sales, coalesce(sum(sales), 0) as sales,
    arg_max(seen, date) filter (where seen is not null) as last_sales, count(seen) as counter from x group by 1,2)
  select product, date, round(mean_sales, 4) as mean_sales, round(sales, 2) as sales, round(last_sales, 4) as last_sales, counter from w""",
)
def agg02(spark, sf):
    d = cal.gap_filled_daily(t.sales(spark, sf), "date", "premium", ["product"])
    seen = F.nullif("sales", F.lit(0.0))
    d = d.select("product", "date", "sales", seen.alias("mean_sales"), seen.alias("last_sales"), seen.alias("counter"))
    w = cal.weekly(d, {"mean_sales": "mean", "sales": "sum", "last_sales": "last", "counter": "count"}, ["product"])
    return r4(w, "last_sales").withColumns({"mean_sales": F.round("mean_sales", 4), "sales": F.round("sales", 2)})


@query(
    "agg03_weekly_last_smoothed",
    f"""with {DAY_SALES}, {t.MACRO}, j as (select date, sales, tax, qty from macro left join dsales using (date)),
  w0 as (select {t.week_sql('date')} as date, coalesce(sum(sales), 0) as sales, arg_max(tax, date) as tax, arg_max(qty, date) as qty
    from j group by 1),
  sp as (select cast(unnest(generate_series(min(date), max(date), interval 7 day)) as date) as date from w0),
  w as (select sp.date, coalesce(sales, 0.0) as sales, tax, qty from sp left join w0 using (date)),
  s as (select *, count(tax) over r as nt, avg(tax) over r as atx, count(qty) over r as nq, avg(qty) over r as aq from w
    window r as (order by date rows between 3 preceding and current row))
  select date, round(sales, 2) as sales, round(tax, 8) as tax, round(qty, 8) as qty,
   round(case when nt = 4 then atx end, 6) as tax_smooth, round(case when nq = 4 then aq end, 6) as qty_smooth,
   {', '.join(f"cast(quarter(date) = {q} as integer) as q{q}" for q in range(1, 5))},
   {', '.join(f"cast(month(date) = {m} as integer) as month_{m}" for m in range(1, 13))} from s""",
)
def agg03(spark, sf):
    j = jon.left_join_chain(t.macro(spark, sf), [day_sales(spark, sf)], ["date"])
    w = cal.weekly_smoothed(j, {"sales": "sum", "tax": "last", "qty": "last"}, ["tax", "qty"], 4)
    return w.withColumns(
        {"sales": F.round("sales", 2), "tax": F.round("tax", 8), "qty": F.round("qty", 8),
         "tax_smooth": F.round("tax_smooth", 6), "qty_smooth": F.round("qty_smooth", 6)}
    )


@query(
    "agg04_company_day_mean",
    f"with {t.QUOTES} select company, date, round({xavg('rate')}, 8) as rate from quotes group by 1,2",
)
def agg04(spark, sf):
    return rt.daily_company_mean(t.quotes(spark, sf), "company", "date", "rate").withColumn("rate", F.round("rate", 8))


@query(
    "agg05_latest_record",
    f"""with {t.QUOTES} select company, arg_max(date, (date, -l_orderkey, -l_linenumber, -product_id, -price)) as date,
  arg_max(product_id, (date, -l_orderkey, -l_linenumber, -product_id, -price)) as product_id,
  arg_max(round(rate, 6), (date, -l_orderkey, -l_linenumber, -product_id, -price)) as rate from quotes group by 1""",
)
def agg05(spark, sf):
    q = t.quotes(spark, sf)
    r = q.groupBy("company").agg(
        F.max_by(
            F.struct("date", "product_id", F.round("rate", 6).alias("rate")),
            F.struct("date", -F.col("l_orderkey"), -F.col("l_linenumber"), -F.col("product_id"), -F.col("price")),
        ).alias("r")
    )
    return r.select("company", "r.date", "r.product_id", "r.rate")


@query(
    "agg06_share_of_total",
    f"""select c_mktsegment as segment, {xsum('o_totalprice')} as total, cast(round_even({xsum('o_totalprice')} /
  sum({xsum('o_totalprice')}) over () * 100, 2) as double) as share_pct from orders join customer on o_custkey = c_custkey group by 1""",
)
def agg06(spark, sf):
    o = t.table(spark, sf, "orders").select("o_custkey", "o_totalprice")
    c = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return r4(agg.share_of_total(o.join(c, "o_custkey"), ["segment"], "o_totalprice"), "total")


@query(
    "agg07_mean_and_quantiles",
    """select c_mktsegment as segment, round(avg(d), 6) as mean, round(quantile_cont(d, 0.025), 6) as q_low, round(quantile_cont(d, 0.95), 6) as q_high
  from (select c_mktsegment, date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date))::double as d
   from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey) group by 1""",
)
def agg07(spark, sf):
    c = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    o = t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderdate").cast("date").alias("a")
    )
    li = t.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("b"))
    d = li.join(o.join(c, "o_custkey"), "l_orderkey").select("segment", F.datediff("b", "a").cast("double").alias("d"))
    # day differences are few, so rows collapse to value counts before the quantiles
    out = agg.mean_and_quantiles(d, ["segment"], "d", {"q_low": 0.025, "q_high": 0.95})
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "q_low", "q_high")})


@query(
    "agg08_marketing_weekly_mean",
    f"""with {t.RATE_WIDE}, a as (select date, {t.OWN} as own_rate, list_sort([{', '.join(f'coalesce({c},0)' for c in t.COMPETITORS)}],'DESC') as l from rwide),
  b as (select date, own_rate, list_sum(l[1:7]) / 7 as top7 from a)
  select {t.week_sql('date')} as date, round(avg(own_rate), 6) as own_rate, round(avg(top7), 6) as competitor_mean from b group by 1""",
)
def agg08(spark, sf):
    r = t.rate_wide(spark, sf)
    r = r.select("date", F.col(t.OWN).alias("own_rate"), X.top_n_mean(t.COMPETITORS, 7).alias("competitor_mean"))
    w = cal.weekly(r, {"own_rate": "mean", "competitor_mean": "mean"})
    return w.withColumns({c: F.round(c, 6) for c in ("own_rate", "competitor_mean")})


@query(
    "agg09_distribution_stats",
    f"""with {t.WEEKLY_MODEL} select product, count(*) as n, {', '.join(
        f"round(avg({v}),6) as {v}_mean, round(stddev_samp({v}),6) as {v}_std, round(min({v}),6) as {v}_min, round(max({v}),6) as {v}_max,"
        f"round(quantile_cont({v},0.25),6) as {v}_q25, round(quantile_cont({v},0.5),6) as {v}_median, round(quantile_cont({v},0.75),6) as {v}_q75"
        for v in ('y', 'own'))} from wm group by 1""",
)
def agg09(spark, sf):
    out = agg.distribution_stats(t.weekly_model(spark, sf), ["product"], ["y", "own"])
    return out.select(*[F.round(c, 6).alias(c) if c not in ("product", "n") else c for c in out.columns])


@query(
    "agg10_min_per_group",
    "select l_linenumber, min(l_extendedprice) as min_l_extendedprice from lineitem where l_returnflag <> 'N' group by 1",
)
def agg10(spark, sf):
    return agg.min_per_group(t.table(spark, sf, "lineitem"), ["l_linenumber"], "l_extendedprice", "l_returnflag <> 'N'")


@query(
    "agg11_value_and_token_counts",
    """select 'value' as kind, p_type as feature, count(*) as n from part group by 2 union all
  select 'token', f, count(*) from (select unnest(string_split(p_name || ' + ' || p_brand, ' + ')) as f from part) group by 2""",
)
def agg11(spark, sf):
    p = t.table(spark, sf, "part")
    values = agg.counts_by(p, ["p_type"]).select(F.lit("value").alias("kind"), F.col("p_type").alias("feature"), "n")
    joined = p.select(F.concat_ws(" + ", "p_name", "p_brand").alias("features"))
    return values.union(agg.token_counts(joined, "features").select(F.lit("token").alias("kind"), "feature", "n"))


@query(
    "agg12_correlation_matrix",
    f"with {t.WEEKLY_MODEL} "
    + " union all ".join(
        f"select product, '{a}' as a, '{b}' as b, "
        + (f"1.0::double as corr, round(var_samp({a}), 6) as variance" if a == b else f"round(corr({a}, {b}), 6) as corr, null::double as variance")
        + " from wm group by product"
        for i, a in enumerate(["y", *t.FEATURES])
        for b in ["y", *t.FEATURES][i:]
    ),
)
def agg12(spark, sf):
    out = agg.pairwise_correlation(t.weekly_model(spark, sf), ["y", *t.FEATURES], ["product"])
    return out.withColumns({"corr": F.round("corr", 6), "variance": F.round("variance", 6)})


WIDE_LAGS = 60
WIDE_SOURCES = ["y", *t.FEATURES]
_NAMED = "case s " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(WIDE_SOURCES, 1)) + " end || case when k = 0 then '_current' else '_t' || k end"


@query(
    "agg12_wide_correlation_profile",
    f"""with {t.WEEKLY_MODEL}, pos as (select product, row_number() over (partition by product order by date) as t, count(*) over (partition by product) as len,
   [{', '.join(WIDE_SOURCES)}] as v from wm),
  lagged as (select *, unnest(range(0, {WIDE_LAGS + 1})) as k from pos),
  cell as (select product, (t + k)::smallint as t, ((s - 1) * {WIDE_LAGS + 1} + k)::smallint as c, s, k, v[s] as x
   from lagged, (select unnest(range(1, {len(WIDE_SOURCES) + 1})) as s) where t + k <= len and v[s] is not null),
  pair as (select a.product, a.c as c1, b.c as c2, abs(corr(a.x, b.x)) as r from cell a join cell b on a.product = b.product and a.t = b.t and a.c < b.c
   group by 1, 2, 3 having count(*) > 1),
  either as (select product, c1 as c, r from pair where isfinite(r) union all select product, c2, r from pair where isfinite(r)),
  own as (select product, c, any_value({_NAMED}) as feature, count(*) as n from cell group by 1, 2)
  select own.product, feature, any_value(n)::bigint as n, count(r)::bigint as partners, round(avg(r), 6) as mean_abs_corr, round(max(r), 6) as max_abs_corr
  from own left join either on own.product = either.product and own.c = either.c group by own.product, feature""",
)
def agg12_wide(spark, sf):
    """All pairs of 305 lag-bank columns of every product, reduced to a line a column."""
    bank = win.lag_bank(t.weekly_model(spark, sf), [(c, c, "backward") for c in WIDE_SOURCES], WIDE_LAGS, ["product"], "date")
    cols = [f"{c}_{k}" for c in WIDE_SOURCES for k in ["current", *(f"t{i}" for i in range(1, WIDE_LAGS + 1))]]
    out = gram.correlation_profile(gram.gram_tiles(bank, ["product"], cols), ["product"], cols)
    return out.withColumns({"mean_abs_corr": F.round("mean_abs_corr", 6), "max_abs_corr": F.round("max_abs_corr", 6)})


CL = f"[{', '.join(f'coalesce({c},0)' for c in t.COMPETITORS)}]"


@query("agg13_row_median", f"with {t.RATE_WIDE} select date, round(list_median({CL}), 6) as c_median from rwide")
def agg13(spark, sf):
    return t.rate_wide(spark, sf).select("date", F.round(X.row_median(t.COMPETITORS), 6).alias("c_median"))


@query(
    "agg14_row_top_means",
    f"""with {t.RATE_WIDE} select date, round(list_sum(list_sort({CL},'DESC')[1:3])/3, 8) as top_3,
  round(list_sum(list_sort({CL},'DESC')[1:5])/5, 8) as top_5 from rwide""",
)
def agg14(spark, sf):
    ranks = rt.competitor_ranks(t.COMPETITORS)
    return t.rate_wide(spark, sf).select("date", *[F.round(ranks[c], 8).alias(c) for c in ("top_3", "top_5")])


@query(
    "agg15_row_nth_highest",
    f"with {t.RATE_WIDE} select date, "
    + ", ".join(f"round(list_sort({CL},'DESC')[{i}], 8) as {n}_highest_benefit" for i, n in ((1, "first"), (2, "second"), (3, "third")))
    + " from rwide",
)
def agg15(spark, sf):
    ranks = rt.competitor_ranks(t.COMPETITORS)
    return t.rate_wide(spark, sf).select(
        "date", *[F.round(ranks[f"{n}_highest_benefit"], 8).alias(f"{n}_highest_benefit") for n in ("first", "second", "third")]
    )


@query(
    "agg16_top_n_strategy",
    f"""with {t.RATE_WIDE}, l as (select date, list_sort({CL},'DESC') as z, list_sort(list_filter([{', '.join(t.COMPETITORS)}], lambda x: x is not null),'DESC') as s from rwide)
  select date, round(list_sum(z[1:5])/5, 8) as top5_zero, round(list_sum(s[1:5])/len(s[1:5]), 8) as top5_skip from l""",
)
def agg16(spark, sf):
    return t.rate_wide(spark, sf).select(
        "date",
        F.round(rt.top_n_strategy(t.COMPETITORS, 5), 8).alias("top5_zero"),
        F.round(rt.top_n_strategy(t.COMPETITORS, 5, "skip"), 8).alias("top5_skip"),
    )


MARKET = f"""{t.RATE_WIDE}, {WEIGHTS[len(t.QUOTES) + 2:]}, wwide as (select current_quarter, {', '.join(
    f"max(case when company='{c}' then weight end) as {c}_weight" for c in t.COMPANIES)} from weights group by 1),
jw as (select rwide.*, wwide.* from rwide left join wwide on year(date)::varchar || '_Q' || quarter(date)::varchar = current_quarter)"""


@query(
    "agg17_market_weighted_mean",
    f"with {MARKET} select date, round(("
    + "+".join(f"coalesce({c},0)*coalesce({c}_weight,0)" for c in t.COMPETITORS)
    + ")/("
    + "+".join(f"coalesce({c}_weight,0)" for c in t.COMPETITORS)
    + "+1e-8), 7) as c_weighted_mean, round(("
    + "+".join(f"coalesce({c},0)" for c in t.COMPETITORS)
    + f")/{len(t.COMPETITORS)}, 7) as c_core from jw",
)
def agg17(spark, sf):
    j = jon.with_quarter_weights(t.rate_wide(spark, sf), weights_wide(spark, sf))
    return j.select(
        "date",
        F.round(rt.market_weighted_mean(t.COMPETITORS), 7).alias("c_weighted_mean"),
        F.round(rt.market_core_mean(t.COMPETITORS), 7).alias("c_core"),
    )


EXCLUDED = ["NATION_1", "NATION_23"]


@query(
    "agg18_weighted_mean_excluding",
    f"with {MARKET} select distinct date, round(("
    + "+".join(f"coalesce({c},0)*coalesce({c}_weight,0)" for c in t.COMPETITORS if c not in EXCLUDED)
    + ")/nullif(1-"
    + "-".join(f"{c}_weight" for c in EXCLUDED)
    + ",0), 7) as c_weighted_mean, round(("
    + "+".join(f"coalesce({c},0)" for c in t.CORE)
    + ")/3, 7) as c_core from jw where current_quarter is not null",
)
def agg18(spark, sf):
    j = jon.with_quarter_weights(t.rate_wide(spark, sf), weights_wide(spark, sf), how="inner")
    return j.select(
        "date",
        F.round(rt.weighted_mean_excluding(t.COMPETITORS, EXCLUDED), 7).alias("c_weighted_mean"),
        F.round(rt.market_core_mean(t.CORE), 7).alias("c_core"),
    )


STATIC_W = {"NATION_1": 0.2, "NATION_2": 0.4, "NATION_3": 0.3}


@query(
    "agg19_weighted_strategy",
    f"""with {t.RATE_WIDE}, w as (select company, {xsum('price')} as weight from quotes where company < 'NATION_3' group by 1),
  lg as (select date, round(sum(rate * coalesce(weight, 0)) / sum(coalesce(weight, 0)), 5) as v, sum(coalesce(weight, 0)) as sw, round(avg(rate), 5) as m
    from rdaily left join w using (company) group by 1)
  select date, round(coalesce(NATION_1,0)*(0.2/0.9)+coalesce(NATION_2,0)*(0.4/0.9)+coalesce(NATION_3,0)*(0.3/0.9), 7) as static_rate,
   round((coalesce(NATION_4,0)+coalesce(NATION_5,0))/2, 7) as equal_rate, case when sw > 0 then v else m end as weighted_rate
  from rwide join lg using (date)""",
)
def agg19(spark, sf):
    wide = t.rate_wide(spark, sf).select(
        "date",
        F.round(rt.weighted_strategy(list(STATIC_W), STATIC_W), 7).alias("static_rate"),
        F.round(rt.weighted_strategy(["NATION_4", "NATION_5"], {}), 7).alias("equal_rate"),
    )
    q = t.quotes(spark, sf)
    w = q.where(F.col("company") < "NATION_3").groupBy("company").agg(t.total("price").alias("weight"))
    daily = rt.daily_company_mean(q, "company", "date", "rate")
    long = rt.weighted_strategy_long(daily, w, "company", ["date"], "rate")
    return wide.join(long.withColumn("weighted_rate", F.round("weighted_rate", 5)), "date")


@query(
    "agg20_firm_level_strategy",
    f"""with {t.RATE_WIDE} select date, round(list_avg({CL}), 6) as f_mean, round(list_median({CL}), 6) as f_median,
  round(list_max({CL}), 6) as f_max, round(list_min({CL}), 6) as f_min from rwide""",
)
def agg20(spark, sf):
    return t.rate_wide(spark, sf).select(
        "date",
        *[F.round(rt.firm_level_strategy(t.COMPETITORS, k), 6).alias(f"f_{k}") for k in ("mean", "median", "max", "min")],
    )


@query(
    "agg21_strategy_dispatch",
    f"""with {t.RATE_WIDE} select date, 'rila' as product_type, 'weighted' as strategy,
    round({' + '.join(f'coalesce({c},0)/{len(t.COMPETITORS)}' for c in t.COMPETITORS)}, 7) as rate from rwide
  union all select date, 'fia', 'top_n', round(list_sum(list_sort({CL},'DESC')[1:5])/5, 7) from rwide
  union all select date, 'myga', 'firm_level', round(list_avg({CL}), 7) from rwide""",
)
def agg21(spark, sf):
    wide = t.rate_wide(spark, sf)
    rows = []
    for product_type in rt.PRODUCT_STRATEGY:
        name, builder = rt.strategy_for(product_type)
        rate = builder(t.COMPETITORS, {}) if name == "weighted" else builder(t.COMPETITORS)
        rows.append(
            F.struct(
                F.lit(product_type).alias("product_type"), F.lit(name).alias("strategy"), F.round(rate, 7).alias("rate")
            )
        )
    return wide.select("date", F.inline(F.array(*rows)))


@query(
    "agg22_usage_consistency",
    """with m as (select p_partkey, p_type || ' + ' || p_brand || ' + ' || case when p_size > 10 then 'large' else 'small' end as f from part),
  n as (select count(*) as n_models from m), u as (select unnest(string_split(f, ' + ')) as feature from m)
  select feature, count(*) as n, any_value(n_models) as n_models, round(count(*)::double / any_value(n_models) * 100, 6) as usage_pct,
  case when count(*)::double / any_value(n_models) * 100 >= 70 then 'High' when count(*)::double / any_value(n_models) * 100 >= 30 then 'Moderate' else 'Low' end as consistency
  from u, n group by 1""",
)
def agg22(spark, sf):
    p = t.table(spark, sf, "part")
    f = F.concat_ws(" + ", "p_type", "p_brand", F.when(F.col("p_size") > 10, "large").otherwise("small"))
    out = agg.usage_consistency(p.select(f.alias("features")))
    return out.withColumn("usage_pct", F.round("usage_pct", 6))
