"""Roles of the given tables, as Spark frames and as the matching SQL text.

Role -> table: sales contracts = orders; contract-date sales and competitor
quotes = lineitem; company = nation of the supplier; macro series = daily means
of tax and quantity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotegrid.functions import exprs as X

# Standing company dimension (fixed values): NATION_8 is the own firm.
COMPANIES = [f"NATION_{i}" for i in range(25)]
OWN = "NATION_8"
COMPETITORS = [c for c in COMPANIES if c != OWN]
CORE = ["NATION_3", "NATION_9", "NATION_14"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def check_companies(spark: SparkSession, sf: str) -> None:
    """Wide tables have one column for each standing company: refuse a company that has none."""
    unknown = table(spark, sf, "nation").where(~F.col("n_name").isin(COMPANIES)).limit(1).collect()
    if unknown:
        raise ValueError(f"company {unknown[0]['n_name']} is not in the standing list")


# ---------------------------------------------------------------- sales
def sales(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.col("o_orderpriority").alias("product"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_totalprice").alias("premium"),
    )


SALES = """sales as (select o_orderkey, o_custkey, o_orderpriority as product, o_orderstatus as status,
  cast(o_orderdate as date) as date, o_totalprice as premium from orders)"""


# ---------------------------------------------------------------- quotes
def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """One competitor quote per line: company, product id, date, rate in percent points."""
    line = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        F.col("l_partkey").alias("product_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_discount") * 100).alias("rate"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_tax").alias("tax"),
        F.col("l_quantity").alias("qty"),
    )
    firms = (
        table(spark, sf, "supplier")
        .select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
        .join(table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("company")), "n_nationkey")
        .select(F.col("s_suppkey").alias("l_suppkey"), "company")
    )
    return line.join(firms, "l_suppkey").drop("l_suppkey")


QUOTES = """quotes as (select l_orderkey, l_linenumber, l_partkey as product_id,
  cast(l_shipdate as date) as date, l_discount * 100 as rate, l_extendedprice as price, l_tax as tax, l_quantity as qty, n_name as company
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)"""


# sums and means are rounded after the sum, because the order of partial sums shows in the last digits
def total(c: str | Column) -> Column:
    return F.round(F.sum(c), 4)


def mean(c: str | Column) -> Column:
    return F.round(F.avg(c), 8)


def xsum(column: str) -> str:
    return f"round(sum({column}), 4)"


def xavg(column: str) -> str:
    return f"round(avg({column}), 8)"


def week_sql(d: str) -> str:
    return f"cast(date_trunc('week', {d}) + interval 6 day as date)"


DAILY = f"""{SALES},
dtot as (select product, date, {xsum('premium')} as raw from sales group by 1,2),
dspan as (select product, min(date) as lo, max(date) as hi from dtot group by 1),
dgrid as (select product, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date from dspan),
daily as (select g.product, g.date, coalesce(d.raw, 0.0) as sales from dgrid g left join dtot d using (product, date))"""


def macro(spark: SparkSession, sf: str) -> DataFrame:
    """Daily macro stand-ins, exact means, missing days left out."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_shipdate").cast("date").alias("date"))
        .agg(mean("l_tax").alias("tax"), mean("l_quantity").alias("qty"))
    )


MACRO = f"""macro as (select cast(l_shipdate as date) as date, {xavg('l_tax')} as tax, {xavg('l_quantity')} as qty
  from lineitem group by 1)"""


# ---------------------------------------------------------------- company rates by day, wide
def rate_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Day x company mean rates (NULL where a company has no quote that day)."""
    check_companies(spark, sf)
    q = quotes(spark, sf)
    daily = q.groupBy("company", "date").agg(mean("rate").alias("rate"))
    return daily.groupBy("date").pivot("company", COMPANIES).agg(F.first("rate"))


RATE_WIDE = f"""{QUOTES},
rdaily as (select company, date, {xavg('rate')} as rate from quotes group by 1,2),
rwide as (select date, {', '.join(f"max(case when company='{c}' then rate end) as {c}" for c in COMPANIES)}
  from rdaily group by 1)"""


# ---------------------------------------------------------------- weekly model table
FEATURES = ["own", "comp", "tax", "qty"]


def weekly_model(spark: SparkSession, sf: str) -> DataFrame:
    """Per product and week: log sales and four market regressors, plus position and holiday flag.

    Everything is reduced to weeks before any window or join, so the table is
    bounded by products x weeks whatever the size of the raw tables.
    """
    s = (
        sales(spark, sf)
        .groupBy("product", X.week_ending_sunday("date").alias("week"))
        .agg(total("premium").alias("sales"))
    )
    q = (
        quotes(spark, sf)
        .groupBy(X.week_ending_sunday("date").alias("week"))
        .agg(
            mean(F.when(F.col("company") == OWN, F.col("rate"))).alias("own"),
            mean(F.when(F.col("company") != OWN, F.col("rate"))).alias("comp"),
            (mean("tax") * 100).alias("tax"),
            mean("qty").alias("qty"),
        )
    )
    joined = s.join(q, "week")
    doy = F.dayofyear("week")
    return joined.where(F.col("own").isNotNull() & F.col("comp").isNotNull()).select(
        "product",
        F.col("week").alias("date"),
        "sales",
        F.log(F.col("sales") / 1e6 + 1).alias("y"),
        "own",
        "comp",
        "tax",
        "qty",
        X.holiday_flag(doy).alias("holiday"),
    )


WEEKLY_MODEL = f"""{SALES}, {QUOTES},
wsales as (select product, {week_sql('date')} as week, {xsum('premium')} as sales from sales group by 1,2),
wquotes as (select {week_sql('date')} as week,
  {xavg(f"(case when company='{OWN}' then rate end)")} as own,
  {xavg(f"(case when company<>'{OWN}' then rate end)")} as comp,
  {xavg('tax')}*100 as tax, {xavg('qty')} as qty from quotes group by 1),
wm as materialized (select product, week as date, sales, ln(sales/1e6+1) as y, own, comp, tax, qty,
  cast(case when dayofyear(week) < 13 or dayofyear(week) > 359 then 1 else 0 end as integer) as holiday
  from wsales join wquotes using (week) where own is not null and comp is not null)"""
