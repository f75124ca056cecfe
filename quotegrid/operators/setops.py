"""Union, column-set differences, feature-set overlap."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotegrid.functions.exprs import col


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def schema_difference(spark: SparkSession, before: T.StructType, after: T.StructType) -> DataFrame:
    """Added, removed and retyped columns. Metadata only, no data is read."""
    old = {f.name: f.dataType.simpleString() for f in before.fields}
    new = {f.name: f.dataType.simpleString() for f in after.fields}
    rows = [(c, "added", None, new[c]) for c in new if c not in old]
    rows += [(c, "removed", old[c], None) for c in old if c not in new]
    rows += [(c, "retyped", old[c], new[c]) for c in new if c in old and old[c] != new[c]]
    return spark.createDataFrame(
        rows, "column_name string, change string, type_before string, type_after string"
    )


def dates_missing_from(expected: DataFrame, observed: DataFrame, on: Sequence[str]) -> DataFrame:
    return expected.select(*on).exceptAll(observed.select(*on).distinct())


def set_overlap(a: str | Column, b: str | Column) -> dict[str, Column]:
    a, b = col(a), col(b)
    union = F.size(F.array_union(a, b))
    return {
        "jaccard": F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0)),
        "common": F.array_sort(F.array_intersect(a, b)),
        "only_a": F.array_sort(F.array_except(a, b)),
        "only_b": F.array_sort(F.array_except(b, a)),
    }


def jaccard_of_sets(members: DataFrame, group: str, item: str) -> DataFrame:
    """Overlap of every two groups that share an item, from (group, item) rows: a, b, jaccard, n_common, n_only_a, n_only_b.

    Pairs arise from a join on the item, so no set is gathered; ``a < b``. Groups that share nothing have no row.
    """
    rows = members.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(
        F.col(group).alias("g"), F.col(item).alias("i")
    ).distinct()
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    left, right = rows.select(F.col("g").alias("a"), "i"), rows.select(F.col("g").alias("b"), "i")
    common = left.join(right, "i").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_common"))
    both = common.join(sizes.select(F.col("g").alias("a"), F.col("n").alias("na")), "a").join(
        sizes.select(F.col("g").alias("b"), F.col("n").alias("nb")), "b"
    )
    c = F.col("n_common")
    return both.select(
        "a", "b", F.round(c / (F.col("na") + F.col("nb") - c), 8).alias("jaccard"),
        "n_common", (F.col("na") - c).alias("n_only_a"), (F.col("nb") - c).alias("n_only_b"),
    )
