"""Queries: scans, sinks, filters, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotegrid.functions import exprs as X
from quotegrid.operators import filters as flt
from quotegrid.operators import joins as jon
from quotegrid.sources import scan, sinks
from quotegrid.workloads import tables as t
from quotegrid.workloads.registry import query, scratch
from quotegrid.workloads.tables import xavg, xsum


@query(
    "src01_parquet_prefix_scan",
    f"select o_orderstatus as status, count(*) as n, {xsum('o_totalprice')} as total from orders group by 1",
)
def src01(spark, sf):
    df = scan.scan_parquet(spark, [f"{sf}/orders.parquet"], require_rows=True)
    return df.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), t.total("o_totalprice").alias("total")
    )


@query(
    "src02_scan_with_filter",
    "select o_orderkey, o_custkey, o_totalprice from orders where o_orderpriority='1-URGENT'",
)
def src02(spark, sf):
    df = scan.scan_with_filter(t.table(spark, sf, "orders"), "o_orderpriority", "1-URGENT")
    df = scan.scan_with_filter(df, "product_name", "absent column: no filter")
    return df.select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "src03_sales_loader",
    f"""select o_orderpriority as product, count(*) as n, min(cast(o_orderdate as date)) as first_day,
  max(cast(o_orderdate as date)) as last_day, {xsum('o_totalprice')} as premium from orders group by 1""",
)
def src03(spark, sf):
    df = scan.load_sales(
        t.table(spark, sf, "orders"),
        {"product": "o_orderpriority", "signed": "o_orderdate", "premium": "o_totalprice"},
    )
    d = F.col("signed").cast("date")
    return df.groupBy("product").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(d).alias("first_day"),
        F.max(d).alias("last_day"),
        t.total("premium").alias("premium"),
    )


@query(
    "src04_rate_loader",
    f"""select l_returnflag as actuarial_view, count(*) as n, {xavg('l_discount')} as mean_cap
  from lineitem where cast(l_shipdate as date) >= date '1998-01-01' group by 1""",
)
def src04(spark, sf):
    raw = t.table(spark, sf, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_shipdate").cast("date").alias("effective_date"),
        F.col("l_discount").alias("cap_rate"),
        F.col("l_tax").alias("fee_rate"),
        F.col("l_quantity").alias("participation_rate"),
        F.col("l_extendedprice").alias("spread_rate"),
        F.col("l_linenumber").alias("trigger_rate"),
        F.col("l_returnflag").alias("actuarial_view"),
    )
    df = scan.load_quotes(raw, start="1998-01-01")
    return df.groupBy("actuarial_view").agg(
        F.count(F.lit(1)).alias("n"), t.mean("cap_rate").alias("mean_cap")
    )


WEIGHTS = f"""{t.QUOTES},
wq as (select year(date)::varchar || '_Q' || quarter(date)::varchar as current_quarter, company,
  {xsum('price')} as amount from quotes group by 1,2),
weights as (select current_quarter, company, amount / sum(amount) over (partition by current_quarter) as weight from wq)"""


def weights_long(spark, sf):
    from quotegrid.operators.windows import series_window

    amounts = (
        t.quotes(spark, sf)
        .groupBy(X.quarter_label("date").alias("current_quarter"), "company")
        .agg(t.total("price").alias("amount"))
    )
    share = F.col("amount") / F.sum("amount").over(series_window(["current_quarter"]))
    return amounts.select("current_quarter", "company", share.alias("weight"))


def weights_wide(spark, sf):
    long = weights_long(spark, sf)
    wide = long.groupBy("current_quarter").pivot("company", t.COMPANIES).agg(F.first("weight"))
    return wide.select("current_quarter", *[F.col(c).alias(f"{c}_weight") for c in t.COMPANIES])


WEIGHTS_WIDE = (
    WEIGHTS
    + ", wwide as (select current_quarter, "
    + ", ".join(f"max(case when company='{c}' then weight end) as {c}_weight" for c in t.COMPANIES)
    + " from weights group by 1)"
)


@query(
    "src05_quarter_weights_and_macro",
    f"""with {WEIGHTS}, {t.MACRO}, mq as (select year(date)::varchar || '_Q' || quarter(date)::varchar as current_quarter,
  round(avg(tax), 6) as mean_tax from macro group by 1)
  select current_quarter, company, round(weight, 8) as weight, mean_tax from weights join mq using (current_quarter)""",
)
def src05(spark, sf):
    m = (
        t.macro(spark, sf)
        .groupBy(X.quarter_label("date").alias("current_quarter"))
        .agg(F.round(F.avg("tax"), 6).alias("mean_tax"))
    )
    w = weights_long(spark, sf).withColumn("weight", F.round("weight", 8))
    return w.join(m, "current_quarter")


@query(
    "src06_snapshot_roundtrip",
    f"""with {t.SALES} select product, count(*) as n, {xsum('premium')} as total, date '2001-08-08' as snapshot_date
  from sales group by 1""",
)
def src06(spark, sf):
    path = scratch(spark, "snapshot")
    s = t.sales(spark, sf)
    summary = lambda df: df.groupBy("product").agg(
        F.count(F.lit(1)).alias("n"), t.total("premium").alias("total")
    )
    sinks.write_snapshot(summary(s.where(F.col("date") <= "2001-08-01")), path, "2001-08-01")
    sinks.write_snapshot(summary(s), path, "2001-08-08")
    return scan.read_snapshot(spark, path).select("product", "n", "total", "snapshot_date")


@query(
    "src07_date_partitioned_sink",
    """select year(ts)::integer as year, month(ts)::integer as month, day(ts)::integer as day, event_type,
  count(*) as n from events group by 1,2,3,4""",
)
def src07(spark, sf):
    path = scratch(spark, "by-day")
    daily = (
        t.table(spark, sf, "events")
        .groupBy(F.col("ts").cast("date").alias("date"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    sinks.write_by_day(daily, path, "date")
    return spark.read.parquet(path).select("year", "month", "day", "event_type", "n")


@query(
    "src08_stage_save_load",
    f"with {t.SALES} select product, status, count(*) as n, {xsum('premium')} as total from sales group by 1,2",
)
def src08(spark, sf):
    base = scratch(spark, "stages")
    by_status = t.sales(spark, sf).groupBy("product", "status").agg(
        F.count(F.lit(1)).alias("n"), t.total("premium").alias("total")
    )
    sinks.save_stages({"by_status": by_status}, base, "sales")
    return sinks.load_stage(spark, base, "by_status", "sales")


@query(
    "src09_csv_export_bundle",
    f"""with {t.SALES} select product, year(date)::integer as year, count(*) as n, {xsum('premium')} as total
  from sales group by 1,2""",
)
def src09(spark, sf):
    base = scratch(spark, "bundle")
    yearly = t.sales(spark, sf).groupBy("product", F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), t.total("premium").alias("total")
    )
    wide = yearly.groupBy("product").pivot("year", list(range(1995, 2002))).agg(F.first("total"))
    paths = sinks.export_bundle({"long": yearly, "wide": wide}, base)
    return scan.scan_csv(spark, paths[0], "product string, year int, n bigint, total double")


@query(
    "src10_csv_scan",
    f"""with {t.SALES} select date, {xsum('premium')} as total from sales where product='2-HIGH' group by 1""",
)
def src10(spark, sf):
    path = sinks.stage_path(scratch(spark, "csv"), "daily")
    daily = t.sales(spark, sf).groupBy("product", "date").agg(t.total("premium").alias("total"))
    sinks.write_csv(daily, path)
    df = scan.scan_csv(spark, path, "product string, date date, total double")
    return df.where(F.col("product") == "2-HIGH").select("date", "total")


# ---------------------------------------------------------------- filters
@query("flt01_equality_non_empty", f"with {t.SALES} select * from sales where product='3-MEDIUM'")
def flt01(spark, sf):
    return flt.require_non_empty(flt.equals(t.sales(spark, sf), "product", "3-MEDIUM"))


@query(
    "flt02_null_safe_equality",
    "select event_id, event_type, value from events where nullif(event_type, 'view') = 'error'",
)
def flt02(spark, sf):
    ev = t.table(spark, sf, "events").withColumn("event_type", F.nullif("event_type", F.lit("view")))
    return flt.equals(ev, "event_type", "error").select("event_id", "event_type", "value")


@query(
    "flt03_in_list",
    f"with {t.SALES} select product, count(*) as n from sales where product in ('1-URGENT','5-LOW') group by 1",
)
def flt03(spark, sf):
    df = flt.member_of(t.sales(spark, sf), "product", ["1-URGENT", "5-LOW"])
    return df.groupBy("product").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt04_null_filters",
    """select event_type, count(*) filter (where nullif(value, round(value)) is not null) as n_present,
  count(*) filter (where nullif(value, round(value)) is null) as n_null from events group by 1""",
)
def flt04(spark, sf):
    ev = t.table(spark, sf, "events").withColumn("value", F.nullif("value", F.round("value")))
    present = flt.not_null(ev, "value").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_present"))
    null = flt.only_null(ev, "value").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_null"))
    return present.join(null, "event_type", "full_outer").select(
        "event_type", F.coalesce("n_present", F.lit(0)).alias("n_present"), F.coalesce("n_null", F.lit(0)).alias("n_null")
    )


@query(
    "flt05_closed_range",
    f"with {t.SALES} select o_orderkey, premium from sales where premium between 1000 and 100000",
)
def flt05(spark, sf):
    return flt.within(t.sales(spark, sf), "premium", 1000, 100000).select("o_orderkey", "premium")


@query(
    "flt06_quantile_threshold",
    f"""with {t.SALES}, kept as (select * from sales where premium between 1000 and 1000000),
  th as (select quantile_cont(premium, 0.99) as q from kept)
  select product, count(*) as n, {xsum('premium')} as total from kept, th where premium < q group by 1""",
)
def flt06(spark, sf):
    kept = flt.within(t.sales(spark, sf), "premium", 1000, 1000000)
    return flt.below_quantile(kept, "premium", 0.99).groupBy("product").agg(
        F.count(F.lit(1)).alias("n"), t.total("premium").alias("total")
    )


@query("flt07_strict_date_bound", f"with {t.SALES} select o_orderkey, date from sales where date > date '1999-06-30'")
def flt07(spark, sf):
    return flt.after(t.sales(spark, sf), "date", "1999-06-30").select("o_orderkey", "date")


@query(
    "flt08_mature_cutoff",
    f"with {t.SALES} select product, count(*) as n, max(date) as last_day from sales "
    "where date <= date '2001-08-01' - interval 50 day group by 1",
)
def flt08(spark, sf):
    return flt.mature_only(t.sales(spark, sf), "date", "2001-08-01").groupBy("product").agg(
        F.count(F.lit(1)).alias("n"), F.max("date").alias("last_day")
    )


WSALES = f"""{t.SALES}, ws as (select product, {t.week_sql('date')} as date, {xsum('premium')} as sales from sales group by 1,2)"""


def weekly_sales(spark, sf):
    return (
        t.sales(spark, sf)
        .groupBy("product", X.week_ending_sunday("date").alias("date"))
        .agg(t.total("premium").alias("sales"))
    )


@query(
    "flt09_drop_last_period",
    f"""with {WSALES} select product, date, sales from ws w
  where date < (select max(date) from ws v where v.product = w.product)""",
)
def flt09(spark, sf):
    return flt.drop_last_period(weekly_sales(spark, sf), "date", ["product"])


@query(
    "flt10_business_filters",
    f"""with {t.WEEKLY_MODEL}, r as (select *, row_number() over (partition by product order by date) as rn from wm),
  tr as (select product, date, sales from r where rn <= 200 and y is not null and holiday = 0 and date < date '1999-01-01'),
  b as (select product, date, sales from wm where sales <> 0 and date > date '1996-01-01'),
  bl as (select * from b where date < (select max(date) from b b2 where b2.product = b.product))
  select 'training' as variant, * from tr union all select 'business' as variant, * from bl""",
)
def flt10(spark, sf):
    wm = t.weekly_model(spark, sf)
    tr = flt.training_filter(wm, "date", "y", 200, "1999-01-01", "holiday", ["product"])
    bl = flt.business_filter(wm, "date", "sales", "1996-01-01", ["product"])
    cols = ["product", "date", "sales"]
    return tr.select(F.lit("training").alias("variant"), *cols).union(
        bl.select(F.lit("business").alias("variant"), *cols)
    )


@query(
    "flt11_temporal_filter",
    f"with {t.WEEKLY_MODEL} select product, date, sales from wm where date > date '1997-08-01' and holiday = 0",
)
def flt11(spark, sf):
    return flt.temporal_filter(t.weekly_model(spark, sf), "date", "1997-08-01", "holiday").select(
        "product", "date", "sales"
    )


@query(
    "flt12_cast_with_failures",
    """select event_type, count(*) as n, count(*) filter (where try_cast(case when value < 20 then 'bad' else
  strftime(ts, '%Y-%m-%d') end as date) is null) as n_failed from events group by 1""",
)
def flt12(spark, sf):
    raw = t.table(spark, sf, "events").withColumn(
        "day", F.when(F.col("value") < 20, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    )
    cast, failures = scan.cast_or_count(raw, "day", "date")
    # failures are counted on the uncast column, in the same pass as the row count
    del cast
    return raw.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), failures.alias("n_failed"))


@query(
    "flt13_day_difference",
    """select l_orderkey, l_linenumber, date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date))::integer
  as processing_days, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by 1,2,3""",
)
def flt13(spark, sf):
    o = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("a"))
    li = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("b"))
    li, o = jon.dealt_by_size([li, o], ["l_orderkey"])
    return (
        flt.day_difference(li.join(o, "l_orderkey"), "a", "b", "processing_days")
        .groupBy("l_orderkey", "l_linenumber", "processing_days")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "flt14_alias_and_rename",
    f"with {t.SALES} select o_orderkey, premium as sales_amount, premium as amount, product as product_name from sales",
)
def flt14(spark, sf):
    df = t.sales(spark, sf).select("o_orderkey", "premium", "product")
    df = flt.alias_if_absent(df, "premium", "sales_amount")
    df = flt.alias_if_absent(df, "product", "sales_amount")
    return flt.rename(df, {"premium": "amount", "product": "product_name", "absent": "ignored"})


@query(
    "flt15_column_name_normaliser",
    f"with {t.WEEKLY_MODEL} select product, date, own as own_rate_t0, comp as competitor_weighted_t0 from wm",
)
def flt15(spark, sf):
    wm = t.weekly_model(spark, sf).select(
        "product", "date", F.col("own").alias("own_rate_current"), F.col("comp").alias("competitor_mid_current")
    )
    there = flt.normalise_names(wm)
    return flt.normalise_names(flt.normalise_names(there, reverse=True))


NAME_MAP = {"nation_0": "Own Firm", "nation_1": "First Rival", "nation_2": "Second Rival", "nation_3": "First Rival"}


@query(
    "flt16_canonical_names",
    f"""with {t.QUOTES} select case lower(company) {' '.join(f"when '{k}' then '{v}'" for k, v in NAME_MAP.items())}
  else lower(company) end as firm, count(*) as n from quotes group by 1""",
)
def flt16(spark, sf):
    q = t.quotes(spark, sf)
    return q.groupBy(X.canonical_name("company", NAME_MAP).alias("firm")).agg(F.count(F.lit(1)).alias("n"))


@query("flt17_trim_lower", "select p_partkey, lower(trim('  ' || p_name || ' ')) as name, lower(p_type) as kind from part")
def flt17(spark, sf):
    p = t.table(spark, sf, "part")
    return p.select(
        "p_partkey",
        F.lower(F.trim(F.concat(F.lit("  "), "p_name", F.lit(" ")))).alias("name"),
        F.lower("p_type").alias("kind"),
    )


@query(
    "flt18_round_half_even",
    f"""with {t.QUOTES} select company, date, round(cast(round_even({xavg('rate')} * 8, 0) as double) / 8, 6) as rate8,
  cast(round_even({xavg('rate')}, 3) as double) as rate from quotes group by 1,2""",
)
def flt18(spark, sf):
    d = t.quotes(spark, sf).groupBy("company", "date").agg(t.mean("rate").alias("rate"))
    d = d.withColumn("rate8", F.round(X.half_even(F.col("rate") * 8, 0) / 8, 6))
    return flt.round_columns(d, ["rate", "absent"], 3)


RAW_RATE = "case when l_linenumber = 7 then null else l_discount * 100 end"


def raw_rate(spark, sf):
    return t.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") != 7, F.col("l_discount") * 100).alias("rate"),
    )


@query(
    "flt19_fill_constant",
    f"select l_linenumber, count(*) as n, {xsum(f'coalesce({RAW_RATE}, 9.99)')} as total from lineitem group by 1",
)
def flt19(spark, sf):
    df = flt.fill_constant(raw_rate(spark, sf), "rate", 9.99)
    return df.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), t.total("rate").alias("total"))


@query(
    "flt20_cap_ceiling",
    f"""select l_linenumber, count(*) as n, {xsum(f'(case when ({RAW_RATE}) > 4.5 then 4.5 else ({RAW_RATE}) end)')} as total,
  count({RAW_RATE}) as n_present from lineitem group by 1""",
)
def flt20(spark, sf):
    df = flt.cap_at(raw_rate(spark, sf), "rate", 4.5)
    return df.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), t.total("rate").alias("total"), F.count("rate").alias("n_present")
    )


@query(
    "flt21_sign_flip",
    f"with {t.WEEKLY_MODEL} select product, date, own, -comp as competitor_rate, -tax as Competitor_fee from wm",
)
def flt21(spark, sf):
    wm = t.weekly_model(spark, sf).select(
        "product", "date", "own", F.col("comp").alias("competitor_rate"), F.col("tax").alias("Competitor_fee")
    )
    return flt.flip_signs(wm, ["competitor"])


@query(
    "flt22_sign_flip_audit",
    f"""with {t.WEEKLY_MODEL}, a as (select count(*) as n, avg(comp) as c, avg(tax) as x from wm)
  select 'comp' as column_name, round(c, 6) as mean_before, round(-c, 6) as mean_after, c <> 0 as sign_changed,
  false as all_null, n as n_rows from a union all
  select 'tax', round(x, 6), round(-x, 6), x <> 0, false, n from a""",
)
def flt22(spark, sf):
    out = flt.flip_audit(t.weekly_model(spark, sf), ["comp", "tax"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_before", "mean_after")})


@query(
    "flt23_exclude_value",
    """select c_custkey, nullif(c_mktsegment, 'BUILDING') as segment from customer
  where nullif(c_mktsegment, 'BUILDING') is distinct from 'MACHINERY'""",
)
def flt23(spark, sf):
    c = t.table(spark, sf, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return flt.exclude_value(c, "segment", "MACHINERY")


@query(
    "flt24_finite_rows",
    """with e as (select event_type, case when value < 10 then null when value < 12 then 'NaN'::double
  when value < 14 then 'Infinity'::double else value end as v from events)
  select event_type, count(*) as n_rows, count(*) filter (where v is null or isnan(v) or isinf(v)) as n_bad_rows,
  count(*) filter (where not (v is null or isnan(v) or isinf(v))) as n_kept from e group by 1""",
)
def flt24(spark, sf):
    v = (
        F.when(F.col("value") < 10, None)
        .when(F.col("value") < 12, F.lit(float("nan")))
        .when(F.col("value") < 14, F.lit(float("inf")))
        .otherwise(F.col("value"))
    )
    e = t.table(spark, sf, "events").select("event_type", v.alias("v"))
    kept = flt.complete_rows(e, ["v"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_kept"))
    ok = X.is_finite("v")
    return (
        e.groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(~ok, 1)).alias("n_bad_rows"))
        .join(kept, "event_type", "left")
        .withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))
    )


@query(
    "flt25_positive_counter",
    f"with {t.DAILY} select product, date, sales, cast(sales > 0 as integer) as counter from daily",
)
def flt25(spark, sf):
    from quotegrid.operators.calendar import gap_filled_daily

    d = gap_filled_daily(t.sales(spark, sf), "date", "premium", ["product"])
    return d.select("product", "date", F.round("sales", 4).alias("sales"), flt.positive_counter("sales").alias("counter"))
