"""Queries: data quality, schema tracking, leakage gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quotegrid.operators import calendar as cal
from quotegrid.operators import forecast as fc
from quotegrid.operators import joins as jon
from quotegrid.operators import leakage as lk
from quotegrid.operators import quality as dq
from quotegrid.operators import schemas
from quotegrid.operators import validation_log as vlog
from quotegrid.operators import windows as win
from quotegrid.workloads import tables as t
from quotegrid.workloads.q_forecast import CI_B, ORIGINS, SPLIT, rolling_replicates, split
from quotegrid.workloads.q_models import FITS, LONG, NAMED, RN, fits, named_coefficients, r6
from quotegrid.workloads.q_scan_filter import WSALES, weekly_sales
from quotegrid.workloads.registry import query, scratch
from quotegrid.workloads.sqltext import content_sql, draw_sql, schema_hash_sql
from quotegrid.workloads.tables import xsum

K = ["product"]
OVER = "partition by product order by date"

# events with made holes and repeats, as in raw feeds
DIRTY = """dirty as (select cast(ts as date) as date, event_type, case when value < 15 then null else round(value) end as value, user_id % 7 as user_group,
  case when value > 60 then 'n/a' else cast(round(value) as integer)::varchar end as note from events)"""


def dirty(spark, sf):
    v = F.col("value")
    return t.table(spark, sf, "events").select(
        F.col("ts").cast("date").alias("date"),
        "event_type",
        F.when(v >= 15, F.round(v)).alias("value"),
        (F.col("user_id") % 7).alias("user_group"),
        F.when(v > 60, "n/a").otherwise(F.round(v).cast("int").cast("string")).alias("note"),
    )


@query(
    "dq01_null_duplicate_type",
    f"""with {DIRTY}, g as (select *, count(*) as n from dirty group by all), d as (select sum(n)::bigint as n_rows, sum(n - 1)::bigint as n_duplicates from g),
  u as (select count(value) as nv, count(*) as nr, count(*) filter (where note is not null and try_cast(note as integer) is null) as bad from dirty)
  select n_rows, n_duplicates, round(n_duplicates::double/n_rows*100, 6) as duplicate_pct, round((nr - nv)::double/(nr*5)*100, 6) as null_pct,
   case when bad = 0 then 100.0 else 50.0 end::double as type_consistency_pct, bad as n_uncastable from d, u""",
)
def dq01(spark, sf):
    d = dirty(spark, sf)
    out = (
        dq.duplicate_percentage(d)
        .crossJoin(dq.null_percentage(d))
        .crossJoin(dq.type_consistency(d, {"note": "int", "user_group": "bigint"}))
    )
    return r6(out, "duplicate_pct", "null_pct")


OUT_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
OUT_SQL = "select sum(n)::bigint as n_values, sum(o)::bigint as n_outliers from (" + " union all ".join(
    f"select count({c}) as n, count(*) filter (where {c} < a - 1.5*(b-a) or {c} > b + 1.5*(b-a)) as o from {{src}}, (select quantile_cont({c}, 0.25) as a, quantile_cont({c}, 0.75) as b from {{src}})"
    for c in OUT_COLS
) + ")"


@query(
    "dq02_iqr_outliers",
    f"""with li as (select l_quantity, power(l_extendedprice/10000, 3) as l_extendedprice, l_discount, l_tax from lineitem), o as ({OUT_SQL.replace('{src}', 'li')})
  select *, round(n_outliers::double/n_values*100, 6) as outlier_pct from o""",
)
def dq02(spark, sf):
    li = t.table(spark, sf, "lineitem").select(
        "l_quantity", F.pow(F.col("l_extendedprice") / 10000, F.lit(3.0)).alias("l_extendedprice"), "l_discount", "l_tax"
    )
    return r6(dq.outlier_percentage(li, OUT_COLS), "outlier_pct")


@query(
    "dq03_quality_score_gate",
    f"""with {DIRTY}, g as (select *, count(*) as n from dirty group by all), d as (select sum(n - 1)::double/sum(n)*100 as dup from g),
  u as (select (count(*) - count(value))::double/(count(*)*5)*100 as nul, count(*) filter (where try_cast(note as integer) is null) as bad,
    (count(*) > 0)::integer + (count(date) = count(*))::integer + coalesce(bool_and(value > 0), true)::integer + (count(distinct date) >= 100)::integer as ok from dirty),
  qt as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b, quantile_cont(user_group, 0.25) as c, quantile_cont(user_group, 0.75) as e from dirty),
  o as (select (count(*) filter (where value < a-1.5*(b-a) or value > b+1.5*(b-a)) + count(*) filter (where user_group < c-1.5*(e-c) or user_group > e+1.5*(e-c)))::double
   / (count(value) + count(user_group)) * 100 as outl from dirty, qt),
  r as (select nul as null_pct, dup as duplicate_pct, case when bad = 0 then 100.0 else 50.0 end::double as type_consistency_pct, ok*25.0::double as rules_pct, outl as outlier_pct from d, u, o),
  s as (select *, least(100, greatest(0, 0.35*rules_pct + 0.25*greatest(0, 100-2*null_pct) + 0.2*type_consistency_pct + 0.15*greatest(0, 100-1.5*duplicate_pct) + 0.05*greatest(0, 100-0.5*outlier_pct))) as score from r)
  select round(null_pct, 6) as null_pct, round(duplicate_pct, 6) as duplicate_pct, type_consistency_pct, rules_pct, round(outlier_pct, 6) as outlier_pct, round(score, 6) as score, score >= 85 as passed from s""",
)
def dq03(spark, sf):
    rules = [dq.non_empty(), dq.no_nulls("date"), *dq.positive(["value"]), dq.enough_dates("date", 100)]
    out = dq.quality_report(dirty(spark, sf), {"note": "int", "user_group": "bigint"}, rules, ["value", "user_group"])
    return r6(out, "null_pct", "duplicate_pct", "outlier_pct", "score")


@query(
    "dq04_stage_rules",
    f"""with {t.WEEKLY_MODEL}, w as (select product, week as date, sales from wsales)
  select 'sales' as stage, 'non_empty' as rule, (select count(*) > 0 from sales) as passed union all select 'sales', 'required_columns', true union all
  select 'sales', 'date_not_null', (select count(date) = count(*) from sales) union all select 'sales', 'positive_premium', (select bool_and(premium > 0) from sales) union all
  select 'rates', 'non_empty', (select count(*) > 0 from quotes) union all select 'rates', 'required_columns', true union all
  select 'rates', 'date_coverage', (select count(distinct date) >= 30 from quotes) union all select 'rates', 'rate_between', (select bool_and(rate between 0 and 50) from quotes) union all
  select 'rates', 'date_not_null', (select count(date) = count(*) from quotes) union all
  select 'weekly', 'non_empty', (select count(*) > 0 from w) union all select 'weekly', 'required_columns', true union all select 'weekly', 'date_coverage', (select count(distinct date) >= 52 from w) union all
  select 'weekly', 'sundays_only', (select bool_and(dayofweek(date) = 0) from w) union all
  select 'model', 'non_empty', (select count(*) > 0 from wm) union all select 'model', 'required_columns', true union all select 'model', 'y_not_null', (select count(y) = count(*) from wm) union all
  select 'model', 'date_coverage', (select count(distinct date) >= 52 from wm) union all select 'model', 'positive_sales', (select bool_and(sales > 0) from wm)""",
)
def dq04(spark, sf):
    stages = {
        "sales": t.sales(spark, sf),
        "rates": t.quotes(spark, sf),
        "weekly": weekly_sales(spark, sf),
        "model": t.weekly_model(spark, sf),
    }
    out = None
    for stage, df in stages.items():
        one = dq.evaluate_rules(df, dq.stage_rules(df, stage)).select(F.lit(stage).alias("stage"), "rule", "passed")
        out = one if out is None else out.union(one)
    return out


@query(
    "dq05_rule_templates",
    """select 'non_empty' as rule, count(*) > 0 as passed from orders union all select 'required_columns', false union all
  select 'positive_o_totalprice', bool_and(o_totalprice > 0) from orders union all select 'positive_o_orderkey', bool_and(o_orderkey > 0) from orders union all
  select 'o_orderdate_range', bool_and(cast(o_orderdate as date) between date '1995-01-01' and date '2000-12-31') from orders""",
)
def dq05(spark, sf):
    o = t.table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    rules = [
        dq.non_empty(), dq.required(o, ["o_orderkey", "absent"]), *dq.positive(["o_totalprice", "o_orderkey"]),
        dq.dates_between("o_orderdate", "1995-01-01", "2000-12-31"),
    ]
    return dq.evaluate_rules(o, rules)


@query(
    "dq06_named_schema",
    """select 'row_count' as "check", null as column_name, (count(*) < 1000)::bigint as n_violations, 'error' as severity from lineitem union all
  select 'present', 'l_quantity', 0, 'error' union all select 'type', 'l_quantity', 0, 'warning' union all select 'present', 'l_partkey', 0, 'error' union all
  select 'type', 'l_partkey', 1, 'warning' union all select 'present', 'l_missing', 1, 'error' union all
  select 'range', 'l_quantity', count(*) filter (where l_quantity not between 1 and 45), 'error' from lineitem union all
  select 'range', 'l_discount', count(*) filter (where l_discount not between 0 and 1), 'error' from lineitem""",
)
def dq06(spark, sf):
    return dq.validate_schema(
        t.table(spark, sf, "lineitem"),
        {"l_quantity": "double", "l_partkey": "int", "l_missing": "string"},
        {"l_quantity": (1, 45), "l_discount": (0, 1)},
        min_rows=1000,
    )


DATASETS = schemas.named_schemas(t.OWN)
_WEEKS = """weeks as (select date, sum(sales) as sales from ws group by 1),
  final as (select date, sales, case when sales > 50000000 then 900.0 else 10.0 end as "Spread", sales::varchar as sales_log from weeks)"""


def _named_frames(spark, sf):
    """The five datasets from the given tables; the last one breaks several rules."""
    o = t.table(spark, sf, "orders")
    signed = F.col("o_orderdate").cast("date")
    days = o.groupBy(signed.alias("date")).agg(F.sum("o_totalprice").alias("sales"))
    weeks = weekly_sales(spark, sf).groupBy("date").agg(F.sum("sales").alias("sales"))
    spread = F.when(F.col("sales") > 50_000_000, 900.0).otherwise(10.0)
    return {
        "sales_data": o.select(
            signed.alias("application_signed_date"), F.date_add(signed, 30).alias("contract_issue_date"),
            F.col("o_orderpriority").alias("product_name"), (F.col("o_totalprice") - 1000).alias("sales_amount"),
        ),
        "time_series_data": days.where(F.dayofmonth("date") < 20),
        "competitive_rates": t.rate_wide(spark, sf),
        "weekly_aggregated": weeks,
        "final_dataset": weeks.select("date", "sales", spread.alias("Spread"), F.col("sales").cast("string").alias("sales_log")),
    }


def _check_sql(dataset: str, rows: list[tuple[str, str | None, str, str]], source: str) -> str:
    return " union all ".join(
        f"select '{dataset}' as dataset, '{check}' as \"check\", {'null' if c is None else repr(c)} as column_name, ({n})::bigint as n_violations, '{level}' as severity" + ("" if n.isdigit() else f" from {source}")
        for check, c, n, level in rows
    )


def _schema_sql() -> str:
    size = lambda low, high: [("not_empty", None, "(count(*) = 0)::int", "error")] + [
        (name, None, f"(count(*) {op} {bound})::int", "error") for name, op, bound in (("min_rows", "<", low), ("max_rows", ">", high)) if bound
    ]
    there = lambda cols: [("required", c, "0", "error") for c in cols]
    kind = lambda cols, wrong=(): [("kind", c, "1" if c in wrong else "0", "warning") for c in cols]
    out = lambda c, low, high=None: ("range", c, f"count(*) filter (where \"{c}\" < {low}" + (f" or \"{c}\" > {high})" if high else ")"), "error")
    sets = [
        ("sales_data", size(1000, None) + there(["application_signed_date", "contract_issue_date", "product_name", "sales_amount"])
         + kind(["application_signed_date", "contract_issue_date", "sales_amount"]) + [out("sales_amount", 0, 100000000)], "sd"),
        ("time_series_data", size(100, 3000) + there(["date", "sales"]) + kind(["date", "sales"]) + [out("sales", 0), ("date_continuity", "date", "count(*) filter (where gap > 10)", "warning")], "ts"),
        ("competitive_rates", size(1000, None) + there(["date", t.OWN]) + kind(["date", t.OWN]) + [out(t.OWN, 0.001, 0.2)], "rwide"),
        ("weekly_aggregated", size(50, 500) + there(["date", "sales"]) + kind(["date", "sales"]) + [out("sales", 0)], "weeks"),
        ("final_dataset", size(150, 180) + there(["date", "sales", "Spread", "sales_log"]) + kind(["date", "sales", "Spread", "sales_log"], ["sales_log"])
         + [out("sales", 0), out("Spread", -500, 500), ("min_features", None, "1", "error")], "final"),
    ]
    return " union all ".join(_check_sql(*s) for s in sets)


@query(
    "dq06_named_schemas",
    f"""with {t.RATE_WIDE}, {WSALES}, {_WEEKS},
  sd as (select cast(o_orderdate as date) as application_signed_date, cast(o_orderdate as date) + 30 as contract_issue_date, o_orderpriority as product_name, o_totalprice - 1000 as sales_amount from orders),
  td as (select cast(o_orderdate as date) as date, sum(o_totalprice) as sales from orders group by 1),
  ts as (select *, date_diff('day', lag(date) over (order by date), date) as gap from td where day(date) < 20)
  {_schema_sql()}""",
)
def dq06_named(spark, sf):
    found = [
        schemas.check_schema(df, DATASETS[name]).withColumn("dataset", F.lit(name)) for name, df in _named_frames(spark, sf).items()
    ]
    return reduce(lambda a, b: a.unionByName(b), found).select("dataset", "check", "column_name", "n_violations", "severity")


CHECKS = {
    "date": dq.ColumnCheck("date", nullable=False),
    "value": dq.ColumnCheck("double", nullable=False, ge=0, le=80),
    "note": dq.ColumnCheck("int", ge=0, le=58),
}


@query(
    "dq07_column_checks",
    f"""with {DIRTY}, n as (select count(*) as n_rows from dirty), f as (select (date is null) as a, (value is null or value < 0 or value > 80) as b,
   (try_cast(note as integer) is null or try_cast(note as integer) not between 0 and 58) as c from dirty),
  s as (select count(*) filter (where a) as a, count(*) filter (where b) as b, count(*) filter (where c) as c, count(*) filter (where not (a or b or c)) as good, count(*) filter (where a or b or c) as bad from f)
  select n_rows, 'date' as column_name, a as n_failed from n, s union all select n_rows, 'value', b from n, s union all select n_rows, 'note', c from n, s
  union all select n_rows, '(good rows)', good from n, s union all select n_rows, '(rejected rows)', bad from n, s""",
)
def dq07(spark, sf):
    d = dirty(spark, sf)
    counts = dq.check_counts(d, CHECKS)
    good, bad = dq.coerce_and_split(d, CHECKS)
    total = d.agg(F.count(F.lit(1)).alias("n_rows"))
    for name, part in (("(good rows)", good), ("(rejected rows)", bad)):
        n = part.agg(F.count(F.lit(1)).alias("n_failed"))
        counts = counts.union(total.crossJoin(n).select("n_rows", F.lit(name).alias("column_name"), "n_failed"))  # one row each
    return counts


FINGER = {"o_custkey": "bigint", "date": "date", "o_totalprice": "double"}


@query(
    "dq08_schema_fingerprint",
    f"""with o as (select o_custkey, cast(o_orderdate as date) as date, case when o_orderkey % 10 <> 3 then o_totalprice end as o_totalprice from orders
   union all select o_custkey, cast(o_orderdate as date), null from orders where o_orderpriority = '1-URGENT'),
  {content_sql('h', 'o', FINGER)},
  s as (select date_diff('day', min(date), max(date))::integer as date_range_days, count(*) filter (where o_totalprice is null) as nulls, count(*) as n,
   min(o_totalprice) as lo, max(o_totalprice) as hi, min(o_custkey)::double as lc, max(o_custkey)::double as hc from o),
  c as (select 'o_custkey' as column_name, 'bigint' as type, 0::bigint as n_null, lc as min_value, hc as max_value from s union all
   select 'date', 'date', 0, null, null from s union all select 'o_totalprice', 'double', nulls, lo, hi from s)
  select n_rows, n_duplicates, date_range_days, content_hash, column_name, type, n_null, round(n_null::double / n, 9) + 0.0 as null_share, n_null = 0 as required, min_value, max_value,
   {schema_hash_sql(FINGER)} as schema_hash from c, s, h""",
)
def dq08(spark, sf):
    """Orders with holes in their prices, the urgent ones once more without any: as a feed that was sent twice."""
    o = t.table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", "o_custkey", F.col("o_orderdate").cast("date").alias("date"), "o_totalprice"
    )
    holed = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 != 3, F.col("o_totalprice")))
    again = o.where("o_orderpriority = '1-URGENT'").withColumn("o_totalprice", F.lit(None).cast("double"))
    return r6(dq.fingerprint(holed.union(again).drop("o_orderkey", "o_orderpriority"), "date"), "null_share", decimals=9)


@query(
    "dq09_schema_evolution",
    """with r as (select max(o_totalprice) > max(o_totalprice) filter (where o_orderstatus = 'F') or min(o_totalprice) < min(o_totalprice) filter (where o_orderstatus = 'F') as wider from orders)
  select 'o_orderkey' as column_name, 'removed' as change, 'bigint' as type_before, null as type_after, true as breaking, 0.6::double as compatibility union all
  select 'product', 'added', null, 'string', false, 0.6 union all select 'o_custkey', 'retyped', 'bigint', 'double', false, 0.6
  union all select 'o_totalprice', 'range_changed', 'double', 'double', false, 0.6 from r where wider""",
)
def dq09(spark, sf):
    o = t.table(spark, sf, "orders")
    before = dq.fingerprint(o.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"))
    after = dq.fingerprint(
        o.select(F.col("o_custkey").cast("double").alias("o_custkey"), "o_totalprice", "o_orderstatus", F.col("o_orderpriority").alias("product"))
    )
    return dq.evolution(before, after).crossJoin(dq.compatibility(before, after))


SCHEMAS = [
    {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double", "o_orderstatus": "string"},
    {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double", "o_orderstatus": "string"},
    {"o_custkey": "double", "o_totalprice": "double", "o_orderstatus": "string", "product": "string"},
]


def _schema_log(spark, sf):
    """Logs three versions of a table, the second one twice; the folder and the changes that each run found."""
    o = t.table(spark, sf, "orders")
    one = o.where("o_orderstatus = 'F'").select(*SCHEMAS[0])
    two = o.select(*SCHEMAS[1]).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 != 3, F.col("o_totalprice")))
    three = o.select(F.col("o_custkey").cast("double").alias("o_custkey"), "o_totalprice", "o_orderstatus", F.col("o_orderpriority").alias("product"))
    path = scratch(spark, "schema-log")
    found = {v: vlog.schema_version(df, path, "orders", v) for v, df in ((1, one), (2, three), (2, two), (3, three))}
    return path, found


@query(
    "dq09_schema_history",
    f"""with v1 as (select o_orderkey, o_custkey, o_totalprice, o_orderstatus from orders where o_orderstatus = 'F'),
  v2 as (select o_orderkey, o_custkey, case when o_orderkey % 10 <> 3 then o_totalprice end as o_totalprice, o_orderstatus from orders),
  v3 as (select o_custkey::double as o_custkey, o_totalprice, o_orderstatus, o_orderpriority as product from orders),
  {content_sql('h1', 'v1', SCHEMAS[0])}, {content_sql('h2', 'v2', SCHEMAS[1])}, {content_sql('h3', 'v3', SCHEMAS[2])}
  select 1::bigint as version, 4::bigint as n_columns, n_rows, n_duplicates, {schema_hash_sql(SCHEMAS[0])} as schema_hash, content_hash, null::double as compatibility from h1 union all
  select 2, 4, n_rows, n_duplicates, {schema_hash_sql(SCHEMAS[1])}, content_hash, 1.0 from h2 union all
  select 3, 4, n_rows, n_duplicates, {schema_hash_sql(SCHEMAS[2])}, content_hash, 0.6 from h3""",
)
def dq09_history(spark, sf):
    path, _ = _schema_log(spark, sf)
    return vlog.schema_history(spark, path, "orders")


@query(
    "dq09_schema_changes_by_version",
    """with f as (select max(o_totalprice) as h1, min(o_totalprice) as l1, max(o_orderkey) as hk, min(o_orderkey) as lk, max(o_custkey) as hc, min(o_custkey) as lc from orders where o_orderstatus = 'F'),
  a as (select max(o_orderkey) as hk, min(o_orderkey) as lk, max(o_custkey) as hc, min(o_custkey) as lc from orders)
  select 2::bigint as version, 'o_totalprice' as column_name, 'became_nullable' as change, 'double' as type_before, 'double' as type_after, true as breaking
  union all select 2, 'o_orderkey', 'range_changed', 'bigint', 'bigint', false from f, a where a.hk > f.hk or a.lk < f.lk
  union all select 2, 'o_custkey', 'range_changed', 'bigint', 'bigint', false from f, a where a.hc > f.hc or a.lc < f.lc
  union all select 3, 'o_orderkey', 'removed', 'bigint', null, true union all select 3, 'o_custkey', 'retyped', 'bigint', 'double', false
  union all select 3, 'o_totalprice', 'became_required', 'double', 'double', false union all select 3, 'product', 'added', null, 'string', false""",
)
def dq09_changes(spark, sf):
    _, found = _schema_log(spark, sf)
    return found[2].withColumn("version", F.lit(2).cast("bigint")).unionByName(found[3].withColumn("version", F.lit(3).cast("bigint")))


@query(
    "dq10_lineage_record",
    f"""with i as (select o_orderkey, o_custkey, cast(o_orderdate as date) as date from orders), d as (select o_custkey, date, count(*) as n from i group by 1,2),
  {content_sql('hi', 'i', {'o_orderkey': 'bigint', 'o_custkey': 'bigint', 'date': 'date'})}, {content_sql('ho', 'd', {'o_custkey': 'bigint', 'date': 'date', 'n': 'bigint'})}
  select 'daily' as step, hi.n_rows as rows_in, ho.n_rows as rows_out, 3 as columns_in, 3 as columns_out, 1::bigint as n_added, 1::bigint as n_removed, 0::bigint as n_retyped,
   {schema_hash_sql({'o_orderkey': 'bigint', 'o_custkey': 'bigint', 'date': 'date'})} as hash_in, {schema_hash_sql({'o_custkey': 'bigint', 'date': 'date', 'n': 'bigint'})} as hash_out,
   hi.content_hash as content_in, ho.content_hash as content_out from hi, ho""",
)
def dq10(spark, sf):
    o = t.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("date"))
    return dq.lineage_step("daily", o, o.groupBy("o_custkey", "date").agg(F.count(F.lit(1)).alias("n")))


def _metric_frames(spark, sf):
    s = t.sales(spark, sf)
    old = s.where(F.col("date").between("1995-03-01", "2000-06-30")).drop("status")
    return dq.table_metrics(s, "date"), dq.table_metrics(old, "date")


DRIFT = f"""{t.SALES}, a as (select count(*) as n, min(date) as lo, max(date) as hi from sales), b as (select count(*) as n, min(date) as lo, max(date) as hi from sales
   where date between date '1995-03-01' and date '2000-06-30'), dr as (select (a.n - b.n)::double/b.n*100 as growth_pct, (a.n - b.n)::double/b.n*100 < -5 as shrinkage,
   (a.n - b.n)::double/b.n*100 > 20 as high_growth, abs(date_diff('day', b.lo, a.lo)) > 30 as start_shifted, a.hi < b.hi as end_regressed, 1 as n_columns_added, 0 as n_columns_removed from a, b)"""


@query("dq11_metric_drift", f"with {DRIFT} select * replace (round(growth_pct, 6) as growth_pct) from dr")
def dq11(spark, sf):
    now, old = _metric_frames(spark, sf)
    return r6(dq.metric_drift(now, old), "growth_pct")


@query(
    "dq12_validation_checkpoint",
    f"""with {DRIFT}, r as (select count(*) filter (where premium < 0) as a, count(*) filter (where status not in ('F', 'O')) as b from sales),
  k as (select (r.a > 0)::bigint as n_errors, (r.b > 0)::bigint + shrinkage::bigint + high_growth::bigint + start_shifted::bigint + end_regressed::bigint as n_warnings from r, dr)
  select case when n_errors > 0 then 'FAILED' when n_warnings > 0 then 'WARNINGS' else 'PASSED' end as status, n_errors, n_warnings, 'with history' as run from k
  union all select case when r.a > 0 then 'FAILED' else 'BASELINE' end, (r.a > 0)::bigint, (r.b > 0)::bigint, 'first' from r""",
)
def dq12(spark, sf):
    rules = dq.row_rules(t.sales(spark, sf), [dq.negative_values("premium"), dq.member("status", ["F", "O"])])
    now, old = _metric_frames(spark, sf)
    later = dq.checkpoint_status(dq.metric_drift(now, old), rules).withColumn("run", F.lit("with history"))
    return later.union(dq.checkpoint_status(None, rules).withColumn("run", F.lit("first")))


LOG_ENDS = ["1996-12-31", "1998-12-31", "2003-12-31"]


@query(
    "dq12_validation_log",
    f"""with {t.SALES}, e as (select unnest(range(1, 4)) as version, unnest([{', '.join(f"date '{d}'" for d in LOG_ENDS)}]) as until),
  m as (select version, count(*) as n_rows, min(date) as lo, max(date) as hi, count(*) filter (where premium < 0) as a, count(*) filter (where status not in ('F', 'O')) as b
   from e join sales on date <= until group by 1),
  p as (select *, lag(n_rows) over (order by version) as pn, lag(lo) over (order by version) as plo, lag(hi) over (order by version) as phi from m),
  g as (select *, (n_rows - pn)::double / pn * 100 as growth from p)
  select version::bigint as version, n_rows, round(growth, 6) as growth_pct, (a > 0)::bigint as n_errors,
   (b > 0)::bigint + case when pn is null then 0 else (growth < -5)::bigint + (growth > 20)::bigint + (abs(date_diff('day', plo, lo)) > 30)::bigint + (hi < phi)::bigint end as n_warnings,
   case when a > 0 then 'FAILED' when pn is null then 'BASELINE' when (b > 0) or growth < -5 or growth > 20 or abs(date_diff('day', plo, lo)) > 30 or hi < phi then 'WARNINGS' else 'PASSED' end as status from g""",
)
def dq12_log(spark, sf):
    """Three runs of a checkpoint over a growing table; the second failed first and is run again."""
    s = t.sales(spark, sf)
    rules = [dq.negative_values("premium"), dq.member("status", ["F", "O"])]
    path = scratch(spark, "checkpoint-log")
    vlog.checkpoint(s.where(F.col("date") <= LOG_ENDS[0]), "date", rules, path, "sales", 1)
    vlog.checkpoint(s.where("false"), "date", rules, path, "sales", 2)
    for version in (2, 3):
        vlog.checkpoint(s.where(F.col("date") <= LOG_ENDS[version - 1]), "date", rules, path, "sales", version)
    out = vlog.history(spark, path, "sales").select("version", "n_rows", "growth_pct", "n_errors", "n_warnings", "status")
    return r6(out, "growth_pct")


@query(
    "dq13_row_rules",
    """with j as (select o_totalprice, cast(o_orderdate as date) as a, cast(l_shipdate as date) as b, l_returnflag from lineitem join orders on l_orderkey = o_orderkey)
  select 'non_negative_o_totalprice' as rule, count(*) filter (where o_totalprice < 0) as n_violations, count(*) filter (where o_totalprice < 0) = 0 as passed, true as critical from j union all
  select 'signed_not_after_issued', count(*) filter (where a > b), count(*) filter (where a > b) = 0, true from j union all
  select 'l_returnflag_in_set', count(*) filter (where l_returnflag not in ('A', 'R')), count(*) filter (where l_returnflag not in ('A', 'R')) <= 100, false from j""",
)
def dq13(spark, sf):
    o = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice", F.col("o_orderdate").cast("date").alias("signed"))
    li = t.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("issued"), "l_returnflag")
    return dq.row_rules(
        li.join(o, "l_orderkey"),
        [dq.negative_values("o_totalprice"), dq.start_not_after_end("signed", "issued"), dq.member("l_returnflag", ["A", "R"], 100)],
    )


@query(
    "dq14_aggregate_reconciliation",
    f"""with {t.DAILY}, w as (select product, {t.week_sql('date')} as date, sum(sales) as sales from daily group by 1,2),
  a as (select product, count(*) as rows_in, sum(sales) as ti from daily group by 1), b as (select product, count(*) as rows_out, sum(sales) as t_out from w group by 1)
  select product, rows_in, rows_out, round(rows_in/rows_out, 6) as row_ratio, rows_in/rows_out between 6 and 8 as ratio_ok, abs(ti - t_out)/ti <= 1e-6 as total_preserved from a join b using (product)""",
)
def dq14(spark, sf):
    d = cal.gap_filled_daily(t.sales(spark, sf), "date", "premium", K).select("product", "date", "sales")
    w = cal.weekly(d, {"sales": "sum"}, K)
    out = dq.reconcile(d, w, K, "sales", 1e-6, (6, 8))
    return r6(out.select("product", "rows_in", "rows_out", "row_ratio", "ratio_ok", "total_preserved"), "row_ratio")


@query(
    "dq15_temporal_structure",
    f"""with {SPLIT}, s as (select product, date_diff('day', lag(date) over ({OVER}), date)::integer as step from wm),
  c as (select product, step, count(*) as n from s where step is not null group by 1,2), ms as (select product, arg_max(step, (n, -step)) as modal_step, max(n)::double/sum(n)::double as share from c group by 1),
  b as (select product, min(date) lo, max(date) hi, count(*) as n from wm group by 1),
  g as (select product, max(date) filter (where role='train') < min(date) filter (where role='test') as no_overlap,
   date_diff('day', max(date) filter (where role='train'), min(date) filter (where role='test')) <= 7 as gap_ok, count(*) filter (where role='train')/count(*) between 0.6 and 0.9 as ratio_ok from split group by 1)
  select product, modal_step, round(share, 8) as share, share > 0.8 as consistent, date_diff('day', lo, hi)//7 + 1 - n as n_missing, no_overlap, gap_ok, ratio_ok from ms join b using (product) join g using (product)""",
)
def dq15(spark, sf):
    wm = t.weekly_model(spark, sf)
    missing = cal.missing_periods(wm.select("product", "date"), "date", K, 7).groupBy("product").agg(F.count(F.lit(1)).alias("n_missing"))
    flags = fc.split_integrity(split(spark, sf), K, "date").select("product", "no_overlap", "gap_ok", "ratio_ok")
    out = jon.left_join_chain(win.modal_step(wm, "date", K), [missing, flags], K)
    return r6(out.withColumn("n_missing", F.coalesce("n_missing", F.lit(0))), "share", decimals=8)


@query(
    "dq16_temporal_boundary",
    f"""with {SPLIT}, g as (select product, max(date) filter (where role='train') as a, min(date) filter (where role='test') as b from split group by 1)
  select product, 'temporal_boundary' as gate, case when a >= b then 'HALT' else 'PASS' end as status, date_diff('day', a, b)::double as value from g""",
)
def dq16(spark, sf):
    return lk.temporal_boundary(split(spark, sf), K, "date")


SHUF = f"""sh as (select product, rn, y, r, row_number() over (partition by product, r order by {draw_sql('rn', 'r')}, rn) as nr from rows_, (select unnest(range(1, 6)) as r)),
 sj as (select x.product, r, sh.y, x.own from rows_ x join sh on x.product = sh.product and x.rn = sh.nr), sr as (select product, avg(r2) as v from (select product, r, power(corr(y, own), 2) as r2 from sj group by 1,2) group by 1)"""


@query(
    "dq17_shuffled_target",
    f"with {RN}, {SHUF} select product, 'shuffled_target' as gate, case when v > 0.1 then 'HALT' else 'PASS' end as status, round(v, 6) as value from sr",
)
def dq17(spark, sf):
    return r6(lk.shuffled_target(t.weekly_model(spark, sf), K, "date", "y", ["own"]), "value")


GAIN = """gn as (select a.product, a.model_id, a.r2 as base, b.r2 as new, (b.r2 - a.r2)/abs(a.r2) as rel from fits a join fits b on a.product = b.product and a.model_id = 'own' and b.model_id = 'own + tax')"""


def _gains(spark, sf):
    f = fits(spark, sf)
    a = f.where("model_id = 'own'").select("product", F.col("r2").alias("base"))
    b = f.where("model_id = 'own + tax'").select("product", F.col("r2").alias("new"))
    return a.join(b, "product")


def _ladder(v: str, halt: str, warn: str) -> str:
    return f"case when {v} > {halt} then 'HALT' when {v} > {warn} then 'WARN' else 'PASS' end"


@query(
    "dq18_fit_thresholds",
    f"""with {FITS}, {GAIN} select product, 'r_squared' as gate, {_ladder('r2', '0.3', '0.2')} as status, round(r2, 6) as value from fits where model_id = 'own + tax'
  union all select product, 'improvement', {_ladder('rel', '0.2', '0.1')}, round(rel, 4) from gn""",
)
def dq18(spark, sf):
    r2 = fits(spark, sf).where("model_id = 'own + tax'").select("product", "r2")
    a = r6(lk.r2_gate(r2, K, "r2"), "value")
    return a.union(r6(lk.improvement_gate(_gains(spark, sf), K, "base", "new"), "value", decimals=4))


@query(
    "dq19_gate_report",
    f"""with {FITS}, {LONG}, {NAMED} select product, 'lag_zero_features' as gate, case when count(*) filter (where lag_zero) > 0 then 'HALT' else 'PASS' end as status,
   count(*) filter (where lag_zero)::double as value from ny group by 1 union all
  select product, 'coefficient_signs', case when count(*) filter (where status = 'violated') > 0 then 'HALT' else 'PASS' end, count(*) filter (where status = 'violated')::double from ny group by 1 union all
  select product, 'r_squared', {_ladder('r2', '0.3', '0.2')}, round(r2, 6) from fits where model_id = 'own'""",
)
def dq19(spark, sf):
    co = named_coefficients(spark, sf)
    r2 = fits(spark, sf).where("model_id = 'own'").select("product", "r2")
    return lk.gate_report(
        [lk.lag_zero_gate(co, K, "feature"), lk.sign_gate(co, K, "feature", "coef"), r6(lk.r2_gate(r2, K, "r2"), "value")]
    )


@query(
    "dq20_forecast_validity",
    f"""with {ORIGINS}
  select product, date, count(*) = {CI_B} as correct_size, bool_and(isfinite(pred)) as finite_predictions, bool_and(pred >= 0) as positive_predictions,
   bool_and(pred between actual/10 and actual*10) as reasonable_range, stddev_pop(pred)/abs(avg(pred)) >= 0.001 as sufficient_variance from p group by 1,2""",
)
def dq20(spark, sf):
    actual = t.weekly_model(spark, sf).select("product", "date", F.exp("y").alias("actual"))
    preds = rolling_replicates(spark, sf).join(actual, ["product", "date"])
    return dq.forecast_flags(preds, ["product", "date"], "prediction", "actual", CI_B)


@query(
    "dq21_table_equivalence",
    f"""with {t.DAILY}, w1 as (select product, {t.week_sql('date')} as date, sum(sales) as sales from daily group by 1,2),
  w2 as (select product, {t.week_sql('date')} as date, {xsum('premium')} as sales from sales group by 1,2),
  j as (select a.product as ap, b.product as bp, a.sales as s1, b.sales as s2 from w1 a full outer join w2 b on a.product = b.product and a.date = b.date)
  select 'sales' as column_name, count(*) filter (where bp is null) as only_left, count(*) filter (where ap is null) as only_right, max(abs(s1 - s2)) <= 1e-6 as within_tolerance,
   count(*) filter (where (s1 is null) <> (s2 is null)) as null_mismatches from j""",
)
def dq21(spark, sf):
    d = cal.gap_filled_daily(t.sales(spark, sf), "date", "premium", K).select("product", "date", "sales")
    out = jon.compare_tables(cal.weekly(d, {"sales": "sum"}, K), weekly_sales(spark, sf), ["product", "date"], ["sales"], 1e-6)
    return out.select(
        "column_name", "only_left", "only_right", (F.col("max_abs_diff") <= 1e-6).alias("within_tolerance"), "null_mismatches"
    )


@query(
    "dq22_monitors",
    f"""with {t.QUOTES}, {DIRTY}, fr as (select company, date_diff('day', max(date), date '2001-11-10') as n from quotes group by 1),
  cv as (select n_name as company, count(q.date) as n from nation left join (select * from quotes where date >= date '2001-10-11') q on q.company = n_name group by 1),
  cp as (select 'value' as c, (count(*) - count(value))::double/count(*)*100 as p from dirty union all select 'note', (count(*) - count(note))::double/count(*)*100 from dirty),
  du as (select coalesce(sum(n) filter (where n > 1), 0) as n from (select count(*) as n from orders group by o_custkey, cast(o_orderdate as date))),
  rg as (select count(*) filter (where l_quantity < 2 or l_quantity > 49) as a, count(*) filter (where l_tax < 0 or l_tax > 1) as b from lineitem)
  select 'freshness' as monitor, company as item, n::double as value, case when n <= 7 then 'OK' when n <= 14 then 'WARNING' else 'CRITICAL' end as status from fr union all
  select 'coverage', company, n::double, case when n = 0 then 'CRITICAL' when n < 5 then 'WARNING' else 'OK' end from cv union all
  select 'completeness', c, round(p, 6), case when p < 1 then 'OK' when p < 5 then 'WARNING' else 'CRITICAL' end from cp union all
  select 'duplicates', 'orders', n::double, case when n = 0 then 'OK' when n < 10 then 'WARNING' else 'CRITICAL' end from du union all
  select 'range', 'l_quantity', a::double, case when a = 0 then 'OK' else 'WARNING' end from rg union all select 'range', 'l_tax', b::double, case when b = 0 then 'OK' else 'CRITICAL' end from rg""",
)
def dq22(spark, sf):
    q = t.quotes(spark, sf)
    members = t.table(spark, sf, "nation").select(F.col("n_name").alias("company"))
    o = t.table(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    li = t.table(spark, sf, "lineitem")

    def row(df, monitor, item, value):
        return df.select(F.lit(monitor).alias("monitor"), item.alias("item"), value.cast("double").alias("value"), "status")

    fresh = row(dq.freshness(q, ["company"], "date", "2001-11-10"), "freshness", F.col("company"), F.col("days_old"))
    cover = row(dq.coverage(q, members, "company", "date", "2001-11-10"), "coverage", F.col("company"), F.col("n_recent"))
    full = row(dq.completeness_status(dirty(spark, sf).select("value", "note")), "completeness", F.col("column_name"), F.round("null_pct", 6))
    dup = row(dq.duplicate_monitor(o, ["o_custkey", "day"]), "duplicates", F.lit("orders"), F.col("n_duplicates"))
    rng = row(
        dq.range_monitor(li, {"l_quantity": (2, 49, "WARNING"), "l_tax": (0, 1, "CRITICAL")}), "range", F.col("column_name"), F.col("n_out_of_range")
    )
    return fresh.union(cover).union(full).union(dup).union(rng)


DRIFT_FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "dq23_feature_drift",
    "with "
    + "lt as (select cast(l_shipdate as date) >= date '2001-01-01' as recent, l_quantity, l_extendedprice + case when cast(l_shipdate as date) >= date '2001-01-01' then 90000 else 0 end as l_extendedprice, l_discount from lineitem), "
    + "lg as (unpivot lt on "
    + ", ".join(DRIFT_FEATURES)
    + """ into name feature value value), cv as (select feature, value, count(*) filter (where recent) as a, count(*) filter (where not recent) as b from lg group by 1,2),
  cc as (select feature, sum(a) over (partition by feature order by value)/sum(a) over (partition by feature) as fa, sum(b) over (partition by feature order by value)/sum(b) over (partition by feature) as fb from cv),
  ks as (select feature, max(abs(fa - fb)) as d from cc group by 1),
  sh as (select feature, (avg(value) filter (where recent) - avg(value) filter (where not recent))/stddev_samp(value) filter (where not recent) as s from lg group by 1)
  select ks.feature, round(d, 8) as ks_distance, round(s, 6) + 0.0 as mean_shift_sigma, case when abs(s) > 2 then 'CRITICAL' when abs(s) > 1.5 then 'WARNING' else 'OK' end as status from ks join sh using (feature)""",
)
def dq23(spark, sf):
    d = F.col("l_shipdate").cast("date")
    li = t.table(spark, sf, "lineitem").select(
        d.alias("date"),
        "l_quantity",
        (F.col("l_extendedprice") + F.when(d >= "2001-01-01", 90000).otherwise(0)).alias("l_extendedprice"),
        "l_discount",
    )
    out = dq.feature_drift(li, "date", "2001-01-01", DRIFT_FEATURES)
    return out.select(
        "feature", F.round("ks_distance", 8).alias("ks_distance"), F.round("mean_shift_sigma", 6).alias("mean_shift_sigma"), "status"
    )
