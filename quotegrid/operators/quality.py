"""Data quality: profiles, rules, schema checks, fingerprints, drift, monitors.

Every check is an aggregate over the whole table; several checks share one pass.
Rule conditions are SQL aggregate expressions, never evaluated Python.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotegrid.functions.exprs import is_finite, ladder
from quotegrid.operators import content
from quotegrid.operators.quantiles import exact_quantiles
from quotegrid.operators.setops import schema_difference

Rule = tuple[str, str]


def is_numeric(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.NumericType)


def missing(df: DataFrame, c: str) -> Column:
    floating = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
    return F.col(c).isNull() | F.isnan(c) if floating else F.col(c).isNull()


def inline_rows(one: DataFrame, rows: Sequence[Column], keep: Sequence[str] = ()) -> DataFrame:
    """One wide row to one row per struct."""
    return one.select(*keep, F.inline(F.array(*rows)))


# ---------------------------------------------------------------- profile
def completeness(df: DataFrame) -> DataFrame:
    """Null share per column. One pass."""
    one = df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count(F.when(missing(df, c), 1)).alias(f"__{c}") for c in df.columns]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"__{c}").alias("n_null"),
            (F.col(f"__{c}") / F.nullif(F.col("n_rows"), F.lit(0)) * 100).alias("null_pct"),
        )
        for c in df.columns
    ]
    return inline_rows(one, rows, ["n_rows"])


def null_percentage(df: DataFrame) -> DataFrame:
    cells = F.sum("n_null") / F.nullif(F.max("n_rows") * F.count(F.lit(1)), F.lit(0)) * 100
    return completeness(df).agg(F.coalesce(cells, F.lit(0.0)).alias("null_pct"))


def duplicate_percentage(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier one. Equal rows are combined map-side before the shuffle."""
    groups = df.groupBy(*(keys or df.columns)).agg(F.count(F.lit(1)).alias("__n"))
    n, extra = F.sum("__n"), F.sum(F.col("__n") - 1)
    return groups.agg(
        F.coalesce(n, F.lit(0)).alias("n_rows"),
        F.coalesce(extra, F.lit(0)).alias("n_duplicates"),
        F.coalesce(extra / F.nullif(n, F.lit(0)) * 100, F.lit(0.0)).alias("duplicate_pct"),
    )


def type_consistency(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Percent of columns whose non-null values all cast to the expected type."""
    bad = {c: F.count(F.when(F.col(c).isNotNull() & F.col(c).try_cast(ty).isNull(), 1)) for c, ty in expected.items()}
    one = df.agg(*[b.alias(f"__{c}") for c, b in bad.items()])
    good = sum(((F.col(f"__{c}") == 0).cast("int") for c in expected), F.lit(0))
    return one.select(
        (good / len(expected) * 100).alias("type_consistency_pct"),
        sum((F.col(f"__{c}") for c in expected), F.lit(0)).alias("n_uncastable"),
    )


def outlier_percentage(df: DataFrame, columns: Sequence[str] | None = None, fence: float = 1.5) -> DataFrame:
    """Share of values outside the interquartile fences, pooled over numeric columns with 4+ values.

    First pass: exact quartiles of all columns at once, whose names are the keys. Second pass: conditional counts.
    """
    cols = list(columns or [f.name for f in df.schema.fields if is_numeric(f)])
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "__col", "__val")
    q = exact_quantiles(long, "__val", [0.25, 0.75], ["__col"], few_keys=True)
    pick = lambda c, p: F.max(F.when((F.col("__col") == c) & (F.col("q") == p), F.col("value")))
    fences = q.agg(*[pick(c, p).alias(f"__{i}_{s}") for i, c in enumerate(cols) for s, p in (("a", 0.25), ("b", 0.75))])
    counted = df.crossJoin(F.broadcast(fences))  # one row
    n, out = F.lit(0), F.lit(0)
    aggs = []
    for i, c in enumerate(cols):
        iqr = F.col(f"__{i}_b") - F.col(f"__{i}_a")
        far = (F.col(c) < F.col(f"__{i}_a") - fence * iqr) | (F.col(c) > F.col(f"__{i}_b") + fence * iqr)
        aggs += [F.count(c).alias(f"__n{i}"), F.count(F.when(far, 1)).alias(f"__o{i}")]
        enough = F.col(f"__n{i}") >= 4
        n = n + F.when(enough, F.col(f"__n{i}")).otherwise(0)
        out = out + F.when(enough, F.col(f"__o{i}")).otherwise(0)
    return counted.agg(*aggs).select(
        n.alias("n_values"),
        out.alias("n_outliers"),
        F.coalesce(out / F.nullif(n, F.lit(0)) * 100, F.lit(0.0)).alias("outlier_pct"),
    )


# Weights of the composite score and penalties per percent.
SCORE_WEIGHTS = {"rules": 0.35, "null": 0.25, "type": 0.20, "duplicate": 0.15, "outlier": 0.05}
SCORE_PENALTY = {"null": 2.0, "duplicate": 1.5, "outlier": 0.5}
PASS_MARK = 85.0


def quality_score(null: Column, duplicate: Column, types: Column, rules: Column, outlier: Column) -> Column:
    part = lambda name, pct: F.greatest(F.lit(0.0), 100 - pct * SCORE_PENALTY[name])
    w = SCORE_WEIGHTS
    total = (
        w["rules"] * rules
        + w["null"] * part("null", null)
        + w["type"] * types
        + w["duplicate"] * part("duplicate", duplicate)
        + w["outlier"] * part("outlier", outlier)
    )
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))


def quality_report(df: DataFrame, expected: Mapping[str, str], rules: Sequence[Rule], numeric: Sequence[str] | None = None) -> DataFrame:
    parts = [
        null_percentage(df),
        duplicate_percentage(df).select("duplicate_pct"),
        type_consistency(df, expected).select("type_consistency_pct"),
        evaluate_rules(df, rules).agg((F.avg(F.col("passed").cast("double")) * 100).alias("rules_pct")),
        outlier_percentage(df, numeric).select("outlier_pct"),
    ]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(p)  # one row each
    score = quality_score(*[F.col(c) for c in ("null_pct", "duplicate_pct", "type_consistency_pct", "rules_pct", "outlier_pct")])
    return one.withColumn("score", score).withColumn("passed", F.col("score") >= PASS_MARK)


# ---------------------------------------------------------------- rules
def non_empty() -> Rule:
    return ("non_empty", "count(*) > 0")


def required(df: DataFrame, columns: Sequence[str]) -> Rule:
    """Decided from the schema; a constant in the query."""
    return ("required_columns", "true" if set(columns) <= set(df.columns) else "false")


def positive(columns: Sequence[str]) -> list[Rule]:
    return [(f"positive_{c}", f"coalesce(bool_and({c} > 0), true)") for c in columns]


def dates_between(column: str, low: str, high: str) -> Rule:
    return (f"{column}_range", f"coalesce(bool_and({column} between date'{low}' and date'{high}'), true)")


def values_between(column: str, low: float, high: float) -> Rule:
    return (f"{column}_between", f"coalesce(bool_and({column} between {low} and {high}), true)")


def enough_dates(column: str, n: int) -> Rule:
    return (f"{column}_coverage", f"count(distinct {column}) >= {n}")


def no_nulls(column: str) -> Rule:
    return (f"{column}_not_null", f"count({column}) = count(*)")


def stage_rules(df: DataFrame, stage: str) -> list[Rule]:
    """Rule set of a stage: sales, rates, integrated, weekly, model."""
    rules: list[Rule] = [non_empty()]
    if stage == "sales":
        rules += [required(df, ["date", "premium"]), no_nulls("date"), *positive(["premium"])]
    elif stage == "rates":
        rules += [required(df, ["date", "rate"]), enough_dates("date", 30), values_between("rate", 0, 50), no_nulls("date")]
    elif stage == "integrated":
        rules += [required(df, ["date", "sales"]), no_nulls("date"), enough_dates("date", 100)]
    elif stage == "weekly":
        rules += [required(df, ["date", "sales"]), enough_dates("date", 52), ("sundays_only", "bool_and(dayofweek(date) = 1)")]
    elif stage == "model":
        rules += [required(df, ["date", "sales", "y"]), no_nulls("y"), enough_dates("date", 52), *positive(["sales"])]
    else:
        raise ValueError(f"unknown stage {stage!r}")
    return rules


def evaluate_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One aggregate for all rules, one row per rule."""
    one = df.agg(*[F.expr(cond).alias(f"__{i}") for i, (_, cond) in enumerate(rules)])
    rows = [
        F.struct(F.lit(name).alias("rule"), F.coalesce(F.col(f"__{i}"), F.lit(False)).alias("passed"))
        for i, (name, _) in enumerate(rules)
    ]
    return inline_rows(one, rows)


# ---------------------------------------------------------------- schemas
def validate_schema(
    df: DataFrame,
    types: Mapping[str, str],
    ranges: Mapping[str, tuple[float, float]] | None = None,
    min_rows: int = 1,
) -> DataFrame:
    """Missing columns and types from the schema, row count and value ranges from one aggregate."""
    have = dict(df.dtypes)
    ranges = {c: r for c, r in (ranges or {}).items() if c in have}
    one = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count(F.when(~F.col(c).between(lo, hi), 1)).alias(f"__r_{c}") for c, (lo, hi) in ranges.items()],
    )
    row = lambda check, name, n, sev: F.struct(
        F.lit(check).alias("check"), F.lit(name).alias("column_name"), n.cast("bigint").alias("n_violations"), F.lit(sev).alias("severity")
    )
    rows = [row("row_count", None, F.when(F.col("__rows") < min_rows, 1).otherwise(0), "error")]
    for c, ty in types.items():
        rows.append(row("present", c, F.lit(0 if c in have else 1), "error"))
        if c in have:
            rows.append(row("type", c, F.lit(0 if have[c] == ty else 1), "warning"))
    rows += [row("range", c, F.col(f"__r_{c}"), "error") for c in ranges]
    return inline_rows(one, rows)


class ColumnCheck:
    """Type, nullability and bounds of one column."""

    def __init__(self, dtype: str, nullable: bool = True, ge: float | None = None, le: float | None = None):
        self.dtype, self.nullable, self.ge, self.le = dtype, nullable, ge, le

    def failure(self, source: Column, value: Column) -> Column:
        bad = source.isNotNull() & value.isNull()
        if not self.nullable:
            bad = bad | source.isNull()
        if self.ge is not None:
            bad = bad | F.coalesce(value < self.ge, F.lit(False))
        if self.le is not None:
            bad = bad | F.coalesce(value > self.le, F.lit(False))
        return bad


def coerce_and_split(df: DataFrame, checks: Mapping[str, ColumnCheck]) -> tuple[DataFrame, DataFrame]:
    """Checked columns only, cast; rows that pass, and rejected rows with the names of failed columns."""
    failed = F.array_compact(
        F.array(*[F.when(k.failure(F.col(c), F.col(c).try_cast(k.dtype)), F.lit(c)) for c, k in checks.items()])
    )
    cast = df.withColumn("failed_columns", failed)
    good = cast.where(F.size("failed_columns") == 0).select(*[F.col(c).try_cast(k.dtype).alias(c) for c, k in checks.items()])
    bad = cast.where(F.size("failed_columns") > 0).select(*checks, "failed_columns")
    return good, bad


def check_counts(df: DataFrame, checks: Mapping[str, ColumnCheck]) -> DataFrame:
    one = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(F.when(k.failure(F.col(c), F.col(c).try_cast(k.dtype)), 1)).alias(f"__{c}") for c, k in checks.items()],
    )
    return inline_rows(
        one, [F.struct(F.lit(c).alias("column_name"), F.col(f"__{c}").alias("n_failed")) for c in checks], ["n_rows"]
    )


# ---------------------------------------------------------------- fingerprints and evolution
def schema_hash(schema: T.StructType, n_rows: int | None = None) -> str:
    body = {"columns": sorted(schema.names), "types": {f.name: f.dataType.simpleString() for f in schema.fields}, "rows": n_rows}
    return hashlib.md5(json.dumps(body, sort_keys=True).encode()).hexdigest()[:12]


def fingerprint(df: DataFrame, date_col: str | None = None) -> DataFrame:
    """One row per column: type, nulls and their share, nullability and bounds (inferred rules), beside the table's size, date
    span, repeated rows, schema hash and content hash.

    A column without a missing value is inferred to be required, a numeric one to stay within its bounds.
    """
    nums = {f.name for f in df.schema.fields if is_numeric(f)}
    aggs = [F.count(F.lit(1)).alias("__rows")]
    span = F.datediff(F.max(date_col), F.min(date_col)) if date_col else F.lit(None).cast("int")
    aggs.append(span.alias("date_range_days"))
    for c in df.columns:
        aggs.append(F.count(F.when(missing(df, c), 1)).alias(f"__n_{c}"))
        if c in nums:
            aggs += [F.min(c).cast("double").alias(f"__lo_{c}"), F.max(c).cast("double").alias(f"__hi_{c}")]
    one = df.agg(*aggs).crossJoin(content.content_hash(df))  # one row each
    null = F.lit(None).cast("double")
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(ty).alias("type"),
            F.col(f"__n_{c}").alias("n_null"),
            F.when(F.col("__rows") > 0, F.col(f"__n_{c}") / F.col("__rows")).alias("null_share"),
            ((F.col("__rows") > 0) & (F.col(f"__n_{c}") == 0)).alias("required"),
            (F.col(f"__lo_{c}") if c in nums else null).alias("min_value"),
            (F.col(f"__hi_{c}") if c in nums else null).alias("max_value"),
        )
        for c, ty in df.dtypes
    ]
    out = inline_rows(one, rows, ["n_rows", "n_duplicates", "date_range_days", "content_hash"])
    return out.withColumn("schema_hash", F.lit(schema_hash(df.schema)))


# Type changes that keep old readers working.
COMPATIBLE_TYPES = {("int", "bigint"), ("float", "double"), ("int", "double"), ("bigint", "double")}


def evolution(before: DataFrame, after: DataFrame) -> DataFrame:
    """Column, type, nullability and range changes between two fingerprints, with a breaking flag.

    A required column that may now be missing breaks readers, the opposite does not.
    """
    side = lambda df, n: df.select(
        "column_name", *[F.col(c).alias(f"{short}{n}") for c, short in (("type", "t"), ("min_value", "lo"), ("max_value", "hi"), ("required", "r"))]
    )
    j = side(before, 0).join(side(after, 1), "column_name", "full_outer")
    ok = F.lit(False)
    for x, y in sorted(COMPATIBLE_TYPES):
        ok = ok | ((F.col("t0") == x) & (F.col("t1") == y))
    wider = (F.col("lo1") < F.col("lo0")) | (F.col("hi1") > F.col("hi0"))
    loosened, tightened = F.col("r0") & ~F.col("r1"), ~F.col("r0") & F.col("r1")
    change = (
        F.when(F.col("t0").isNull(), "added")
        .when(F.col("t1").isNull(), "removed")
        .when(F.col("t0") != F.col("t1"), "retyped")
        .when(loosened, "became_nullable")
        .when(tightened, "became_required")
        .when(wider, "range_changed")
    )
    breaking = F.when(F.col("t1").isNull(), True).when(F.col("t0") != F.col("t1"), ~ok).otherwise(F.coalesce(loosened, F.lit(False)))
    return j.withColumn("change", change).withColumn("breaking", breaking).where(F.col("change").isNotNull()).select(
        "column_name", "change", F.col("t0").alias("type_before"), F.col("t1").alias("type_after"), "breaking"
    )


def compatibility(before: DataFrame, after: DataFrame) -> DataFrame:
    """Common over all columns."""
    a, b = before.select("column_name", F.lit(1).alias("a")), after.select("column_name", F.lit(1).alias("b"))
    j = a.join(b, "column_name", "full_outer")
    common = F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1))
    return j.agg((common / F.count(F.lit(1))).alias("compatibility"))


def lineage_step(step: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """Record of one transformation: sizes, column changes, hashes of schema and content. Append it to a lineage table."""
    changes = schema_difference(before.sparkSession, before.schema, after.schema)
    kinds = changes.agg(
        *[F.count(F.when(F.col("change") == k, 1)).alias(f"n_{k}") for k in ("added", "removed", "retyped")]
    )
    rows_in = content.content_hash(before).select(F.col("n_rows").alias("rows_in"), F.col("content_hash").alias("content_in"))
    rows_out = content.content_hash(after).select(F.col("n_rows").alias("rows_out"), F.col("content_hash").alias("content_out"))
    return (
        rows_in.crossJoin(rows_out)
        .crossJoin(kinds)  # one row each
        .select(
            F.lit(step).alias("step"),
            "rows_in",
            "rows_out",
            F.lit(len(before.columns)).alias("columns_in"),
            F.lit(len(after.columns)).alias("columns_out"),
            "n_added",
            "n_removed",
            "n_retyped",
            F.lit(schema_hash(before.schema)).alias("hash_in"),
            F.lit(schema_hash(after.schema)).alias("hash_out"),
            "content_in",
            "content_out",
        )
    )


# ---------------------------------------------------------------- metrics, drift, checkpoints
def table_metrics(df: DataFrame, date_col: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date")
    ).withColumn("columns", F.array(*[F.lit(c) for c in sorted(df.columns)]))


def metric_drift(
    current: DataFrame, previous: DataFrame, min_growth: float = -5.0, max_growth: float = 20.0, max_shift: int = 30
) -> DataFrame:
    """Growth in percent, start shift, end regression, changed columns: one row."""
    p = previous.select(*[F.col(c).alias(f"previous_{c}") for c in previous.columns])
    j = current.crossJoin(p)  # one row each
    growth = (F.col("n_rows") - F.col("previous_n_rows")) / F.nullif(F.col("previous_n_rows"), F.lit(0)) * 100
    return j.select(
        growth.alias("growth_pct"),
        (growth < min_growth).alias("shrinkage"),
        (growth > max_growth).alias("high_growth"),
        (F.abs(F.datediff("min_date", "previous_min_date")) > max_shift).alias("start_shifted"),
        (F.col("max_date") < F.col("previous_max_date")).alias("end_regressed"),
        F.size(F.array_except("columns", "previous_columns")).alias("n_columns_added"),
        F.size(F.array_except("previous_columns", "columns")).alias("n_columns_removed"),
    )


def negative_values(c: str, allowed: int = 0) -> tuple[str, Column, int, bool]:
    return (f"non_negative_{c}", F.count(F.when(F.col(c) < 0, 1)), allowed, True)


def start_not_after_end(start: str, end: str, allowed: int = 0) -> tuple[str, Column, int, bool]:
    return (f"{start}_not_after_{end}", F.count(F.when(F.col(start) > F.col(end), 1)), allowed, True)


def member(c: str, values: Sequence[object], allowed: int = 0, critical: bool = False) -> tuple[str, Column, int, bool]:
    return (f"{c}_in_set", F.count(F.when(~F.col(c).isin(list(values)), 1)), allowed, critical)


def row_rules(df: DataFrame, rules: Sequence[tuple[str, Column, int, bool]]) -> DataFrame:
    one = df.agg(*[agg.alias(f"__{i}") for i, (_, agg, _, _) in enumerate(rules)])
    rows = [
        F.struct(
            F.lit(name).alias("rule"),
            F.col(f"__{i}").alias("n_violations"),
            (F.col(f"__{i}") <= allowed).alias("passed"),
            F.lit(critical).alias("critical"),
        )
        for i, (name, _, allowed, critical) in enumerate(rules)
    ]
    return inline_rows(one, rows)


def checkpoint_status(drift: DataFrame | None, rules: DataFrame) -> DataFrame:
    """BASELINE without history, FAILED on a critical rule or a lost column, WARNINGS, else PASSED."""
    r = rules.agg(
        F.count(F.when(~F.col("passed") & F.col("critical"), 1)).alias("n_errors"),
        F.count(F.when(~F.col("passed") & ~F.col("critical"), 1)).alias("n_rule_warnings"),
    )
    if drift is None:
        return r.select(
            F.when(F.col("n_errors") > 0, "FAILED").otherwise("BASELINE").alias("status"),
            "n_errors",
            F.col("n_rule_warnings").cast("bigint").alias("n_warnings"),
        )
    flags = sum((F.col(c).cast("bigint") for c in ("shrinkage", "high_growth", "start_shifted", "end_regressed")), F.lit(0))
    j = r.crossJoin(drift)  # one row each
    errors = F.col("n_errors") + F.when(F.col("n_columns_removed") > 0, 1).otherwise(0)
    return j.withColumn("n_errors", errors).withColumn("n_warnings", (F.col("n_rule_warnings") + flags).cast("bigint")).select(
        F.when(F.col("n_errors") > 0, "FAILED").when(F.col("n_warnings") > 0, "WARNINGS").otherwise("PASSED").alias("status"),
        F.col("n_errors").cast("bigint").alias("n_errors"),
        "n_warnings",
    )


def reconcile(fine: DataFrame, coarse: DataFrame, keys: Sequence[str], value: str, tolerance: float, ratio: tuple[float, float]) -> DataFrame:
    """Row ratio and preserved total between an aggregation's input and output."""
    a = fine.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_in"), F.sum(value).alias("total_in"))
    b = coarse.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_out"), F.sum(value).alias("total_out"))
    r = F.col("rows_in") / F.col("rows_out")
    d = F.abs(F.col("total_in") - F.col("total_out")) / F.nullif(F.abs(F.col("total_in")), F.lit(0.0))
    return a.join(b, list(keys)).withColumns(
        {"row_ratio": r, "ratio_ok": r.between(*ratio), "relative_difference": d, "total_preserved": d <= tolerance}
    )


def freshness(df: DataFrame, keys: Sequence[str], date_col: str, as_of: str) -> DataFrame:
    last = F.max(date_col)
    return (
        df.groupBy(*keys)
        .agg(last.alias("latest_date"), F.datediff(F.lit(as_of).cast("date"), last).alias("days_old"), F.count(F.lit(1)).alias("n_rows"))
        .withColumn("status", ladder("days_old", [(7, "OK"), (14, "WARNING")], "CRITICAL"))
    )


def completeness_status(df: DataFrame) -> DataFrame:
    return completeness(df).withColumn("status", ladder("null_pct", [(1, "OK"), (5, "WARNING")], "CRITICAL", "<"))


def coverage(df: DataFrame, members: DataFrame, key: str, date_col: str, as_of: str, days: int = 30, few: int = 5) -> DataFrame:
    """Recent rows of every expected member, absent members included."""
    recent = df.where(F.col(date_col) >= F.date_sub(F.lit(as_of).cast("date"), days)).groupBy(key).agg(F.count(F.lit(1)).alias("n_recent"))
    return (
        members.join(recent, key, "left")
        .withColumn("n_recent", F.coalesce("n_recent", F.lit(0)))
        .withColumn("status", ladder("n_recent", [(0, "CRITICAL"), (few - 1, "WARNING")], "OK"))
    )


def range_monitor(df: DataFrame, ranges: Mapping[str, tuple[float, float, str]]) -> DataFrame:
    """Counts outside [low, high]; the third entry is the status when there are any."""
    one = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(F.when((F.col(c) < lo) | (F.col(c) > hi), 1)).alias(f"__o_{c}") for c, (lo, hi, _) in ranges.items()],
        *[F.min(c).alias(f"__lo_{c}") for c in ranges],
        *[F.max(c).alias(f"__hi_{c}") for c in ranges],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"__o_{c}").alias("n_out_of_range"),
            F.col(f"__lo_{c}").alias("min_value"),
            F.col(f"__hi_{c}").alias("max_value"),
            F.when(F.col(f"__o_{c}") == 0, "OK").otherwise(sev).alias("status"),
        )
        for c, (_, _, sev) in ranges.items()
    ]
    return inline_rows(one, rows)


def duplicate_monitor(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that share their key with another row."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    dup = F.coalesce(F.sum(F.when(F.col("__n") > 1, F.col("__n"))), F.lit(0))
    return g.agg(dup.alias("n_duplicates"), F.sum("__n").alias("n_rows")).withColumn(
        "status", ladder("n_duplicates", [(0, "OK"), (9, "WARNING")], "CRITICAL")
    )


def feature_drift(df: DataFrame, date_col: str, split: str, features: Sequence[str]) -> DataFrame:
    """KS distance and mean shift (in historical deviations) of recent rows against history."""
    from quotegrid.operators.diagnostics import ks_two_sample

    long = df.select(
        (F.col(date_col) >= F.lit(split).cast("date")).alias("recent"), *[F.col(f).cast("double").alias(f) for f in features]
    ).unpivot(["recent"], list(features), "feature", "value")
    ks = ks_two_sample(long, ["feature"], "value", "recent")
    r, h = F.when(F.col("recent"), F.col("value")), F.when(~F.col("recent"), F.col("value"))
    shift = long.groupBy("feature").agg(((F.avg(r) - F.avg(h)) / F.stddev_samp(h)).alias("mean_shift_sigma"))
    status = ladder(F.abs("mean_shift_sigma"), [(2.0, "CRITICAL"), (1.5, "WARNING")], "OK", ">")
    return ks.join(shift, "feature").withColumn("status", status)


# ---------------------------------------------------------------- forecasts
def forecast_flags(
    preds: DataFrame, keys: Sequence[str], value: str, actual: str, size: int, multiple: float = 10.0, min_cv: float = 0.001
) -> DataFrame:
    """Validity of the replicate predictions of each origin."""
    v, y = F.col(value), F.col(actual)
    finite = is_finite(value)
    return preds.groupBy(*keys).agg(
        (F.count(F.lit(1)) == size).alias("correct_size"),
        F.bool_and(finite).alias("finite_predictions"),
        F.bool_and(v >= 0).alias("positive_predictions"),
        F.bool_and(v.between(y / multiple, y * multiple)).alias("reasonable_range"),
        (F.stddev_pop(v) / F.abs(F.avg(v)) >= min_cv).alias("sufficient_variance"),
    )


def interval_order(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Percentile columns must not decrease."""
    ok = F.lit(True)
    for a, b in zip(columns, columns[1:]):
        ok = ok & (F.col(a) <= F.col(b))
    return df.groupBy(*keys).agg(F.count(F.when(~ok, 1)).alias("n_disordered"), F.count(F.lit(1)).alias("n_intervals"))


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    one = df.agg(*[(F.min(c) == F.max(c)).alias(f"__{c}") for c in columns])
    return inline_rows(one, [F.struct(F.lit(c).alias("column_name"), F.col(f"__{c}").alias("is_constant")) for c in columns])
