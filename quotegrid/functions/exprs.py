"""Column builders: calendar keys, rounding, ladders, reproducible draws."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- missing data
def nan_to_null(c: str | Column) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, in one projection."""
    return df.select(
        *[
            nan_to_null(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def is_finite(c: str | Column) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


# ---------------------------------------------------------------- rounding
def half_even(c: str | Column, decimals: int) -> Column:
    return F.bround(col(c), decimals)


# ---------------------------------------------------------------- calendar
def week_ending_sunday(d: str | Column) -> Column:
    d = col(d).cast("date")
    return F.date_add(d, F.pmod(F.lit(8) - F.dayofweek(d), F.lit(7)))


def quarter_label(d: str | Column) -> Column:
    d = col(d)
    return F.concat(F.year(d).cast("string"), F.lit("_Q"), F.quarter(d).cast("string"))


def holiday_flag(day_of_year: str | Column, first_day: int = 13, last_day: int = 359) -> Column:
    """1 outside the working part of the year."""
    c = col(day_of_year)
    return F.when((c < first_day) | (c > last_day), 1).otherwise(0)


def calendar_columns(d: str | Column) -> list[Column]:
    d = col(d)
    parts = [F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month")]
    parts += [(F.month(d) == m).alias(f"month_{m}") for m in range(1, 13)]
    parts += [(F.quarter(d) == q).alias(f"q{q}") for q in range(1, 5)]
    return parts


# ---------------------------------------------------------------- strings
def canonical_name(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Lower-case, then exact lookup; names outside the map stay lower-case."""
    low = F.lower(col(c))
    if not mapping:
        return low
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, low), low)


def basis_points(rate: str | Column, multiplier: int = 100) -> Column:
    return (col(rate) * multiplier).cast("int")


def basis_point_label(bps: str | Column) -> Column:
    return F.format_string("%dbps", col(bps).cast("int"))


# ---------------------------------------------------------------- ladders
def ladder(c: str | Column, steps: Sequence[tuple[float, object]], otherwise: object, op: str = "<=") -> Column:
    """First step whose bound holds wins."""
    c = col(c)
    tests = {
        "<=": lambda b: c <= b,
        "<": lambda b: c < b,
        ">=": lambda b: c >= b,
        ">": lambda b: c > b,
    }[op]
    out = None
    for bound, label in steps:
        out = F.when(tests(bound), F.lit(label)) if out is None else out.when(tests(bound), F.lit(label))
    return out.otherwise(F.lit(otherwise))


# ---------------------------------------------------------------- transforms with a domain
# name -> (forward builder, domain predicate)
TRANSFORMS = {
    "none": (lambda c: c, lambda c: F.lit(True)),
    "log1p": (lambda c: F.log1p(c), lambda c: c > -1),
    "log": (lambda c: F.log(c), lambda c: c > 0),
    "sqrt": (lambda c: F.sqrt(c), lambda c: c >= 0),
    "exp": (lambda c: F.exp(c), lambda c: F.lit(True)),
    "expm1": (lambda c: F.expm1(c), lambda c: F.lit(True)),
}


def transformed(c: str | Column, name: str) -> Column:
    """NULL where the value lies outside the domain (see :func:`domain_violations`)."""
    forward, domain = TRANSFORMS[name]
    c = col(c)
    return F.when(domain(c), forward(c))


def domain_violations(c: str | Column, name: str) -> Column:
    _, domain = TRANSFORMS[name]
    c = col(c)
    return F.count(F.when(c.isNotNull() & ~domain(c), 1))


# ---------------------------------------------------------------- row-wise ranks over columns
def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def zero_if_null(names: Iterable[str], suffix: str = "") -> list[str]:
    """SQL terms; one parsed text is far cheaper to build than hundreds of Column objects."""
    return [f"coalesce({quoted(n + suffix)}, 0D)" for n in names]


def _rates(columns: Iterable[str | Column], null_policy: str) -> Column:
    columns = list(columns)
    if null_policy == "zero" and all(isinstance(c, str) for c in columns):
        return F.expr(f"array({', '.join(zero_if_null(columns))})")
    cols = [col(c) for c in columns]
    if null_policy == "zero":
        return F.array(*[F.coalesce(c, F.lit(0.0)) for c in cols])
    if null_policy == "skip":
        return F.array_compact(F.array(*cols))
    raise ValueError(f"unknown null policy {null_policy!r}")


def rates_descending(columns: Iterable[str | Column], null_policy: str = "zero") -> Column:
    return F.sort_array(_rates(columns, null_policy), asc=False)


def array_mean(arr: Column) -> Column:
    total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(arr) > 0, total / F.size(arr))


def array_median(sorted_arr: Column) -> Column:
    n = F.size(sorted_arr)
    upper = F.get(sorted_arr, F.floor(n / 2).cast("int"))
    lower = F.get(sorted_arr, F.floor((n - 1) / 2).cast("int"))
    return F.when(n > 0, (upper + lower) / 2)


def row_median(columns: Iterable[str | Column], null_policy: str = "zero") -> Column:
    return array_median(rates_descending(columns, null_policy))


def top_n_mean(columns: Iterable[str | Column], n: int, null_policy: str = "zero") -> Column:
    return array_mean(F.slice(rates_descending(columns, null_policy), 1, n))


def nth_highest(columns: Iterable[str | Column], n: int, null_policy: str = "zero") -> Column:
    """n-th largest; the largest when fewer values exist."""
    arr = rates_descending(columns, null_policy)
    return F.coalesce(F.get(arr, F.lit(n - 1)), F.get(arr, F.lit(0)))


# ---------------------------------------------------------------- reproducible draws
# Fixed values of the draw recipe (a prime modulus and three multipliers).
DRAW_MODULUS = 2147483647
DRAW_ROW, DRAW_REPLICATE, DRAW_OFFSET, DRAW_MIX = 48271, 69621, 12345, 16807


def with_draw(df: DataFrame, row_id: str | Column, replicate: str | Column, out: str) -> DataFrame:
    """Adds an integer in [0, DRAW_MODULUS squared) that depends on (row_id, replicate) only.

    Pure integer arithmetic: a recomputed partition yields the same draws. Each step is a
    column of its own, because the next one reads it twice. About 62 bits, so that a
    remainder by the length of a series is even for series of any length.
    """
    m = F.lit(DRAW_MODULUS).cast("bigint")
    i, r = F.pmod(col(row_id).cast("bigint"), m), F.pmod(col(replicate).cast("bigint"), m)
    x, y = F.col("__x"), F.col("__y")
    return (
        df.withColumn("__x", (i * DRAW_ROW + r * DRAW_REPLICATE + DRAW_OFFSET) % m)
        .withColumn("__x", (x * x + i + 1) % m)
        .withColumn("__x", (x * DRAW_MIX + r * 7 + 3) % m)
        .withColumn("__x", (x * x + r + 1) % m)
        .withColumn("__y", (x * DRAW_ROW + i * 5 + r) % m)
        .withColumn("__y", (y * y + x + 1) % m)
        .withColumn(out, x * m + y)
        .drop("__x", "__y")
    )


def poisson_thresholds() -> list[int]:
    """Cumulative Poisson(1) probabilities scaled to the draw modulus, as far as its steps tell counts apart."""
    from math import exp, factorial

    out, acc, k = [], 0.0, 0
    while not out or out[-1] < DRAW_MODULUS - 1:
        acc += exp(-1.0) / factorial(k)
        out.append(int(acc * DRAW_MODULUS))
        k += 1
    return out


def poisson_one(draw_col: str | Column) -> Column:
    """Count of a Poisson(1) variable from a draw; every count that the draw can tell apart occurs."""
    draw = col(draw_col)
    m = F.lit(DRAW_MODULUS).cast("bigint")
    c = F.call_function("div", draw, m)
    bounds = poisson_thresholds()
    out = None
    for k, bound in enumerate(bounds):
        out = F.when(c < bound, k) if out is None else out.when(c < bound, k)
    return out.otherwise(len(bounds))
