"""Content fingerprints: mergeable multiset hashes of rows, whole or by range of keys.

A table's hash is made of sums over its rows, so it does not depend on their order or on how they are dealt out, and
two tables are compared by one small aggregate each. Only ranges of keys whose hashes differ are read again and joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = 4096
SEPARATOR, NOTHING = "\x1f", "\x1e"


# ---------------------------------------------------------------- portable hashes
def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Values as text that other engines write alike: fractions with six decimals, NULL and NaN as one mark."""
    parts = []
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c).try_cast("decimal(38,6)")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("decimal(38,6)")
        parts.append(F.coalesce(c.cast("string"), F.lit(NOTHING)))
    return F.concat_ws(SEPARATOR, *parts)


def _half(digest: Column, start: int) -> Column:
    """Fifteen hexadecimal digits as a number."""
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)")


def content_hash(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: n_rows, n_duplicates (rows that repeat an earlier one), content_hash; columns in the table's order.

    Rows are reduced to their digests and counts before they are shuffled.
    """
    digests = df.select(F.md5(row_text(df, columns)).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("decimal(18,0)")
    one = digests.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("__distinct"),
        *[F.coalesce(F.sum((_half(F.col("d"), at) * n).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"__s{at}") for at in (1, 16)],
    )
    body = F.concat_ws(":", F.col("n_rows").cast("string"), F.col("__s1").cast("string"), F.col("__s16").cast("string"))
    return one.select("n_rows", (F.col("n_rows") - F.col("__distinct")).alias("n_duplicates"), F.substring(F.md5(body), 1, 16).alias("content_hash"))


# ---------------------------------------------------------------- drill-down by key range
def _halves(h: Column) -> list[Column]:
    low = h.bitwiseAND(F.lit((1 << 32) - 1))
    return [low, F.call_function("shiftrightunsigned", h, F.lit(32))]


def key_range(keys: Sequence[str], ranges: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(ranges))


def range_digests(df: DataFrame, keys: Sequence[str], columns: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """At most ``ranges`` rows: range, n and four sums over 128-bit hashes of the range's rows. A partial aggregate."""
    cols = [F.col(c) for c in (*keys, *columns)]
    # NULL leaves a hash as it is; a mark for each column keeps (1, NULL) and (NULL, 1) apart
    marks = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in cols])
    rows = df.select(key_range(keys, ranges).alias("range"), F.xxhash64(marks, *cols).alias("a"), F.xxhash64(F.lit("second"), *cols, marks).alias("b"))
    sums = [F.sum(part).alias(f"{name}{i}") for name in ("a", "b") for i, part in enumerate(_halves(F.col(name)))]
    return rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"), *sums)


def differing_ranges(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """The ranges of keys in which the two tables do not hold the same rows."""
    names = ["n", "a0", "a1", "b0", "b1"]
    a = range_digests(left, keys, columns, ranges).select("range", F.struct(*names).alias("x"))
    b = range_digests(right, keys, columns, ranges).select("range", F.struct(*names).alias("y"))
    return a.join(b, "range", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("range")


def differing_rows(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], ranges: int = RANGES
) -> tuple[DataFrame, DataFrame]:
    """Both tables, only the rows of ranges that differ; the list of ranges is at most ``ranges`` numbers long."""
    wanted = F.broadcast(differing_ranges(left, right, keys, columns, ranges))
    pick = lambda df: df.withColumn("range", key_range(keys, ranges)).join(wanted, "range", "left_semi").drop("range")
    return pick(left), pick(right)
