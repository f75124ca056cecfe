"""Group summaries that are not tied to a calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegrid.functions.exprs import half_even, ladder
from quotegrid.operators.gram import gram_tiles, pair_correlations
from quotegrid.operators.quantiles import exact_quantiles


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, decimals: int = 2) -> DataFrame:
    """Percent of the grand total, which is one row."""
    grouped = df.groupBy(*keys).agg(F.sum(value).alias("total"))
    grand = grouped.agg(F.sum("total")).scalar()
    return grouped.withColumn("share_pct", half_even(F.col("total") / grand * 100, decimals))


def mean_and_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Mean and exact interpolated quantiles per group, over raw rows."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    q = exact_quantiles(df, value, list(probs.values()), keys)
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == p, F.col("value"))).alias(n) for n, p in probs.items()])
    return means.join(wide, list(keys))


def distribution_stats(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean, deviation, extremes and quartiles of bounded replicate sets."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for v in values:
        quart = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        aggs += [
            F.avg(v).alias(f"{v}_mean"),
            F.stddev_samp(v).alias(f"{v}_std"),
            F.min(v).alias(f"{v}_min"),
            F.max(v).alias(f"{v}_max"),
            quart[0].alias(f"{v}_q25"),
            quart[1].alias(f"{v}_median"),
            quart[2].alias(f"{v}_q75"),
        ]
    return df.groupBy(*keys).agg(*aggs)


def min_per_group(df: DataFrame, keys: Sequence[str], value: str, where: str | None = None) -> DataFrame:
    src = df.where(where) if where else df
    return src.groupBy(*keys).agg(F.min(value).alias(f"min_{value}"))


def counts_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def token_counts(df: DataFrame, column: str, separator: str = r" \+ ") -> DataFrame:
    """Usage counts after splitting ``a + b + c``."""
    return df.select(F.explode(F.split(column, separator)).alias("feature")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n")
    )


def pairwise_correlation(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), wide: int = 24) -> DataFrame:
    """Pearson correlation of every pair and variance on the diagonal, one pass over the rows.

    More than ``wide`` columns go through tiles, since a plan cannot hold an expression for each pair.
    """
    if len(columns) > wide:
        pairs_ = pair_correlations(gram_tiles(df, keys, columns), keys, columns)
        same = F.col("a") == F.col("b")
        return pairs_.select(
            *keys, "a", "b", F.when(same, 1.0).otherwise(F.col("corr")).alias("corr"), F.when(same, F.col("covariance")).alias("variance")
        )
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    aggs = [
        (F.var_samp(a) if a == b else F.corr(a, b)).alias(f"__{i}") for i, (a, b) in enumerate(pairs)
    ]
    one = df.groupBy(*keys).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("a"),
                F.lit(b).alias("b"),
                F.when(F.lit(a == b), F.lit(1.0)).otherwise(F.col(f"__{i}")).alias("corr"),
                F.when(F.lit(a == b), F.col(f"__{i}")).alias("variance"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return one.select(*keys, F.inline(rows))


def usage_consistency(df: DataFrame, features: str = "features", separator: str = r" \+ ") -> DataFrame:
    """How many models use a feature, in percent and as a class."""
    total = df.agg(F.count(F.lit(1)).alias("n_models")).scalar()
    used = token_counts(df, features, separator).withColumn("n_models", total)
    pct = F.col("n") / F.col("n_models") * 100
    return used.withColumn("usage_pct", pct).withColumn(
        "consistency", ladder("usage_pct", [(70, "High"), (30, "Moderate")], "Low", ">=")
    )
