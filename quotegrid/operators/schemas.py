"""Named dataset schemas: required columns, kinds, value ranges, sizes and date continuity, checked in one pass."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quotegrid.operators.quality import inline_rows

KINDS = {"date": (T.DateType, T.TimestampType, T.TimestampNTZType), "number": (T.NumericType,)}


@dataclass(frozen=True)
class Schema:
    """What a dataset must look like; ``None`` bounds are open."""

    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    kinds: Mapping[str, str] = field(default_factory=dict)
    ranges: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)
    rows: tuple[int | None, int | None] = (None, None)
    max_gap_days: int | None = None
    min_features: int | None = None


def named_schemas(own: str) -> dict[str, Schema]:
    """The five datasets of the pipeline; ``own`` is the column of the own company's rate."""
    # Names, columns and limits.
    series = {"date": "date", "sales": "number"}
    return {
        "sales_data": Schema(
            ("application_signed_date", "contract_issue_date", "product_name", "sales_amount"),
            ("term_filter", "buffer_rate_filter"),
            {"application_signed_date": "date", "contract_issue_date": "date", "sales_amount": "number"},
            {"sales_amount": (0, 100_000_000)},
            rows=(1000, None),
        ),
        "time_series_data": Schema(("date", "sales"), kinds=series, ranges={"sales": (0, None)}, rows=(100, 3000), max_gap_days=10),
        "competitive_rates": Schema(("date", own), kinds={"date": "date", own: "number"}, ranges={own: (0.001, 0.20)}, rows=(1000, None)),
        "weekly_aggregated": Schema(
            ("date", "sales"), ("C_weighted_mean", "DGS5", "VIX"), series, {"sales": (0, None)}, rows=(50, 500)
        ),
        "final_dataset": Schema(
            ("date", "sales", "Spread", "sales_log"),
            kinds={**series, "Spread": "number", "sales_log": "number"},
            ranges={"sales": (0, None), "Spread": (-500, 500)},
            rows=(150, 180),
            min_features=590,
        ),
    }


def check_schema(df: DataFrame, schema: Schema, date_col: str = "date") -> DataFrame:
    """One row per check: check, column_name, n_violations, severity. Missing values break no range.

    Counts and ranges are one aggregate; the longest gap between dates comes from the distinct dates, which the
    calendar bounds.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    ranges = {c: r for c, r in schema.ranges.items() if c in have}

    def outside(c: str, low: float | None, high: float | None):
        v = F.col(c).cast("double")
        bad = F.lit(False)
        for wrong in ([v < low] if low is not None else []) + ([v > high] if high is not None else []):
            bad = bad | wrong
        return F.count(F.when(bad, 1))

    one = df.agg(F.count(F.lit(1)).alias("__rows"), *[outside(c, *r).alias(f"__r_{c}") for c, r in ranges.items()])
    row = lambda check, name, n, severity: F.struct(
        F.lit(check).alias("check"), F.lit(name).cast("string").alias("column_name"), n.cast("bigint").alias("n_violations"), F.lit(severity).alias("severity")
    )
    n = F.col("__rows")
    rows = [row("not_empty", None, (n == 0).cast("int"), "error")]
    for check, wrong in (("min_rows", n < schema.rows[0] if schema.rows[0] else None), ("max_rows", n > schema.rows[1] if schema.rows[1] else None)):
        if wrong is not None:
            rows.append(row(check, None, wrong.cast("int"), "error"))
    rows += [row("required", c, F.lit(0 if c in have else 1), "error") for c in schema.required]
    rows += [row("kind", c, F.lit(0 if isinstance(have[c], KINDS[k]) else 1), "warning") for c, k in schema.kinds.items() if c in have]
    rows += [row("range", c, F.col(f"__r_{c}"), "error") for c in ranges]
    if schema.min_features is not None:
        rows.append(row("min_features", None, F.lit(0 if len(have) >= schema.min_features else 1), "error"))
    if schema.max_gap_days is not None and date_col in have:
        days = df.select(F.col(date_col).cast("date").alias("d")).where("d is not null").distinct()
        gap = F.datediff("d", F.lag("d").over(Window.partitionBy(F.lit(0)).orderBy("d")))
        gaps = days.select(gap.alias("gap")).agg(F.count(F.when(F.col("gap") > schema.max_gap_days, 1)).alias("__gaps"))
        one = one.crossJoin(gaps)  # one row each
        rows.append(row("date_continuity", date_col, F.col("__gaps"), "warning"))
    return inline_rows(one, rows)


def verdicts(checks: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Per dataset: errors, warnings, and whether it may be used."""
    broken = F.col("n_violations") > 0
    count = lambda level: F.count(F.when(broken & (F.col("severity") == level), 1))
    return checks.groupBy(dataset).agg(count("error").alias("n_errors"), count("warning").alias("n_warnings")).withColumn("is_valid", F.col("n_errors") == 0)
