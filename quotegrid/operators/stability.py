"""What the replicates say about the models. Input: fact table (keys, model, replicate, aic, r2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrid.functions import grades
from quotegrid.functions.exprs import col
from quotegrid.operators.joins import left_join_chain
from quotegrid.operators.windows import average_rank, drawdown, longest_streak


def relative_spread(value: str, original: str | Column) -> Column:
    """Population deviation over |mean|, else over |original|, else interquartile range over |median|."""
    v, o = col(value), col(original)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    sd, mean = F.stddev_pop(v), F.abs(F.avg(v))
    orig = F.abs(F.max(o))
    return (
        F.when(mean > 1e-10, sd / mean)
        .when(orig > 1e-10, sd / orig)
        .when(F.abs(q[1]) > 1e-10, (q[2] - q[0]) / F.abs(q[1]))
        .otherwise(F.lit(float("inf")))
    )


LEVELS = (50, 70, 90)  # fixed values: interval levels in percent


def stability_metrics(facts: DataFrame, keys: Sequence[str], attempts: int, min_success: float = 0.5, floor: int = 30) -> DataFrame:
    """Spread, intervals and class per model.

    Replicates that failed carry NULL. A model needs max(``floor``, half the attempts) fits.
    """
    aggs = [
        F.count("aic").alias("successful_fits"),
        relative_spread("aic", "original_aic").alias("aic_cv"),
        relative_spread("r2", "original_r2").alias("r2_cv"),
    ]
    probs = [p for lv in LEVELS for p in ((100 - lv) / 200, 1 - (100 - lv) / 200)]
    for v in ("aic", "r2"):
        aggs.append(F.percentile(v, F.array(*[F.lit(p) for p in probs])).alias(f"__{v}"))
    out = facts.groupBy(*keys).agg(*aggs)
    cols = [
        F.col(f"__{v}")[2 * i + s].alias(f"{v}_{side}_{lv}")
        for v in ("aic", "r2")
        for i, lv in enumerate(LEVELS)
        for s, side in enumerate(("lower", "upper"))
    ]
    need = max(floor, int(attempts * min_success))
    label = grades.stability("aic_cv", "r2_cv", F.col("successful_fits") / attempts)
    return out.select(
        *keys,
        "successful_fits",
        "aic_cv",
        "r2_cv",
        *cols,
        F.when(F.col("successful_fits") < need, "FAILED").otherwise(label).alias("stability"),
    )


def block_stability(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    cv = facts.groupBy(*keys).agg(
        (F.stddev_pop("aic") / F.abs(F.avg("aic"))).alias("aic_cv"),
        (F.stddev_pop("r2") / F.abs(F.avg("r2"))).alias("r2_cv"),
        F.count("aic").alias("n_fits"),
    )
    g = grades.block_stability("aic_cv", "r2_cv")
    return cv.withColumns(g)


def best_block_size(by_size: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest stability score, smallest size on ties."""
    return by_size.groupBy(*keys).agg(
        F.max_by("block_size", F.struct("stability_score", -F.col("block_size"))).alias("block_size"),
        F.max("stability_score").alias("stability_score"),
    )


def coefficient_intervals(coefs: DataFrame, keys: Sequence[str], levels: Sequence[float] = (0.8, 0.9, 0.95)) -> DataFrame:
    probs = [p for lv in levels for p in ((1 - lv) / 2, 1 - (1 - lv) / 2)]
    agg = coefs.groupBy(*keys).agg(F.percentile("coef", F.array(*[F.lit(p) for p in probs])).alias("__q"))
    rows = F.array(
        *[
            F.struct(F.lit(lv).alias("level"), F.col("__q")[2 * i].alias("lower"), F.col("__q")[2 * i + 1].alias("upper"))
            for i, lv in enumerate(levels)
        ]
    )
    return agg.select(*keys, F.inline(rows))


def win_rates(facts: DataFrame, group: Sequence[str], model: str, order: str) -> DataFrame:
    """Share of replicates in which a model has the lowest AIC (lowest ``order`` on ties).

    A failed replicate (no AIC) neither wins nor counts.
    """
    facts = facts.where(F.col("aic").isNotNull() & ~F.isnan("aic"))
    winners = (
        facts.groupBy(*group, "replicate")
        .agg(F.min_by(model, F.struct("aic", order)).alias(model))
        .groupBy(*group, model)
        .agg(F.count(F.lit(1)).alias("win_count"))
    )
    base = facts.groupBy(*group, model).agg(
        F.percentile("aic", F.lit(0.5)).alias("median_aic"), F.count(F.lit(1)).alias("n_replicates")
    )
    return (
        left_join_chain(base, [winners], [*group, model])
        .withColumn("win_count", F.coalesce("win_count", F.lit(0)))
        .withColumn("win_rate_pct", F.col("win_count") / F.col("n_replicates") * 100)
    )


def information_ratios(facts: DataFrame, group: Sequence[str], model: str) -> DataFrame:
    """Excess = pooled median AIC minus AIC; higher is better.

    Windows run over the replicates of one model, a bounded number.
    """
    bench = facts.groupBy(*group).agg(F.percentile("aic", F.lit(0.5)).alias("benchmark_aic"))
    ids = [*group, model]
    ex = facts.join(bench, list(group)) if group else facts.crossJoin(F.broadcast(bench))
    ex = ex.withColumn("excess", F.col("benchmark_aic") - F.col("aic"))
    ex = ex.withColumn("dd", drawdown("excess", ids, "replicate"))
    mean, sd = F.avg("excess"), F.stddev_pop("excess")
    down = F.stddev_pop(F.when(F.col("excess") < 0, F.col("excess")))
    base = ex.groupBy(*ids).agg(
        F.max("benchmark_aic").alias("benchmark_aic"),
        F.max("original_aic").alias("original_aic"),
        mean.alias("mean_excess"),
        sd.alias("std_excess"),
        F.coalesce(down, F.lit(0.0)).alias("__down"),
        F.max("dd").alias("max_drawdown"),
    )
    streaks = longest_streak(ex.withColumn("hit", F.col("excess") > 0), "hit", ids, "replicate").select(
        *ids, F.col("hit_pct").alias("success_rate"), F.col("longest_streak").alias("consecutive_wins")
    )

    def ratio(num: str, den: str) -> Column:
        capped = F.least(F.lit(999.0), F.col(num) / F.nullif(F.col(den), F.lit(0.0)))
        return F.when(F.col(den) > 0, capped).when(F.col(num) > 0, 999.0).otherwise(0.0)

    plain = lambda num: F.when(F.col("std_excess") > 0, num / F.nullif(F.col("std_excess"), F.lit(0.0))).otherwise(0.0)
    return (
        base.join(streaks, ids)
        .withColumns(
            {
                "information_ratio": plain(F.col("mean_excess")),
                "sharpe_like": plain(F.col("benchmark_aic") - F.col("original_aic")),
                "sortino_ratio": ratio("mean_excess", "__down"),
                "calmar_ratio": ratio("mean_excess", "max_drawdown"),
            }
        )
        .drop("__down")
    )


def information_ratio_low_is_good(facts: DataFrame, group: Sequence[str], model: str) -> DataFrame:
    """Opposite sign: (mean AIC - benchmark) / deviation; lower is better."""
    bench = facts.groupBy(*group).agg(F.percentile("aic", F.lit(0.5)).alias("benchmark_aic"))
    j = facts.join(bench, list(group)) if group else facts.crossJoin(F.broadcast(bench))
    sd = F.stddev_pop("aic")
    return j.groupBy(*group, model).agg(
        F.when(sd > 0, (F.avg("aic") - F.max("benchmark_aic")) / F.nullif(sd, F.lit(0.0)))
        .otherwise(0.0)
        .alias("ir_low_is_good")
    )


def composite_score(wins: DataFrame, ratios: DataFrame, on: Sequence[str], w_win: float = 0.5, w_ir: float = 0.5) -> DataFrame:
    j = left_join_chain(wins, [ratios.select(*on, "information_ratio")], on)
    j = j.withColumn("information_ratio", F.coalesce("information_ratio", F.lit(0.0)))
    j = j.withColumn("composite_score", w_win * F.col("win_rate_pct") + w_ir * grades.ir_score("information_ratio"))
    return j.withColumn("grade", grades.composite_grade("composite_score"))


def stability_ranks(stats: DataFrame, keys: Sequence[str], stability: str, aic: str) -> DataFrame:
    out = stats.withColumns(
        {"stability_rank": average_rank(stability, keys, descending=True), "aic_rank": average_rank(aic, keys)}
    )
    return out.withColumn("combined_rank", (F.col("stability_rank") + F.col("aic_rank")) / 2)


def rank_agreement(stats: DataFrame, keys: Sequence[str], criteria: dict[str, bool]) -> DataFrame:
    """Correlation of the model rankings under several criteria (value: True = high is good)."""
    from quotegrid.operators.aggregates import pairwise_correlation

    ranked = stats.select(*keys, *[average_rank(c, keys, descending=high).alias(c) for c, high in criteria.items()])
    return pairwise_correlation(ranked, list(criteria), keys).select(*keys, "a", "b", "corr")
