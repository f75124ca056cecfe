"""Splits, cross validation, rolling origin, metrics and intervals of forecasts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrid.functions import grades
from quotegrid.functions.exprs import col
from quotegrid.operators import bootstrap
from quotegrid.operators.moments import _key_ddl, centre, fit_models, moment_blocks, parallelism, prefix_blocks, ridge_fits
from quotegrid.operators.windows import numbered


def temporal_split(df: DataFrame, keys: Sequence[str], order: str, ratio: float = 0.8, min_test: int = 20) -> DataFrame:
    """First floor(n x ratio) rows train; at least ``min_test`` rows test."""
    rows = numbered(df, keys, order)
    first = F.floor(F.col("n") * ratio)
    train = F.when(F.col("n") - first < min_test, F.col("n") - min_test).otherwise(first)
    return rows.withColumn("role", F.when(F.col("rn") <= train, "train").otherwise("test")).drop("rn", "n")


def split_integrity(split: DataFrame, keys: Sequence[str], date_col: str, max_gap: int = 7) -> DataFrame:
    train, test = F.col("role") == "train", F.col("role") == "test"
    g = split.groupBy(*keys).agg(
        F.count(F.when(train, 1)).alias("n_train"),
        F.count(F.when(test, 1)).alias("n_test"),
        F.max(F.when(train, F.col(date_col))).alias("train_end"),
        F.min(F.when(test, F.col(date_col))).alias("test_start"),
    )
    share = F.col("n_train") / (F.col("n_train") + F.col("n_test"))
    return g.withColumns(
        {
            "no_overlap": F.col("train_end") < F.col("test_start"),
            "gap_ok": F.datediff("test_start", "train_end") <= max_gap,
            "ratio_ok": share.between(0.6, 0.9),
        }
    )


def expanding_cv(
    df: DataFrame, keys: Sequence[str], order: str, target: str, features: Sequence[str], splits: int = 5
) -> DataFrame:
    """Expanding-window folds: a row joins every training set whose start lies after it.

    Returns one row per key and fold with out-of-sample metrics.
    """
    rows = numbered(df.select(*keys, order, target, *features), keys, order)
    size = F.floor(F.col("n") / (splits + 1)).cast("int")
    first = F.col("n") - splits * size
    segment = F.when(F.col("rn") <= first, 0).otherwise(1 + F.floor((F.col("rn") - 1 - first) / F.nullif(size, F.lit(0))).cast("int"))
    rows = rows.withColumn("segment", segment)
    # a row is copied to at most `splits` folds
    train = rows.where(F.col("segment") < splits).withColumn(
        "fold", F.explode(F.sequence(F.col("segment") + 1, F.lit(splits)))
    )
    cols = [*features, target]
    fits = fit_models(moment_blocks(train, [*keys, "fold"], cols), [*keys, "fold"], cols, [("m", list(features))])
    coef = fits.select(*keys, F.col("fold"), F.col("n_obs").alias("train_size"), F.col("coef").alias("__coef"))
    test = rows.where(F.col("segment") > 0).withColumnRenamed("segment", "fold").join(coef, [*keys, "fold"])
    pred = F.col("__coef")[0]
    for i, f in enumerate(features, 1):
        pred = pred + F.col("__coef")[i] * F.col(f)
    test = test.withColumn("__pred", pred)
    return regression_metrics(test, [*keys, "fold", "train_size"], target, "__pred")


def regression_metrics(df: DataFrame, keys: Sequence[str], actual: str | Column, predicted: str | Column) -> DataFrame:
    """R2, MSE, RMSE, MAE, MAPE (zero targets left out), correlation; rows with a missing side are dropped."""
    rows = df.select(*keys, col(actual).alias("__y"), col(predicted).alias("__p")).where(
        F.col("__y").isNotNull() & F.col("__p").isNotNull()
    )
    e = F.col("__y") - F.col("__p")
    mse = F.avg(e * e)
    ape = F.avg(F.when(F.col("__y") != 0, F.abs(e / F.nullif(F.col("__y"), F.lit(0.0)))))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_observations"),
        (1 - mse / F.nullif(F.var_pop("__y"), F.lit(0.0))).alias("r_squared"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (ape * 100).alias("mape"),
        F.corr("__y", "__p").alias("correlation"),
    )


def weighted_metrics(df: DataFrame, keys: Sequence[str], actual: str, predicted: str, weight: str) -> DataFrame:
    """Weighted R2 and MAPE with a floor on |y|; the weighted mean is a first aggregate joined back."""
    sw = F.sum(weight)
    mean = df.groupBy(*keys).agg((F.sum(F.col(weight) * F.col(actual)) / sw).alias("__mean"))
    rows = df.join(mean, list(keys))
    e = F.col(actual) - F.col(predicted)
    rss = F.sum(F.col(weight) * e * e)
    tss = F.sum(F.col(weight) * F.pow(F.col(actual) - F.col("__mean"), F.lit(2.0)))
    ape = F.abs(e / F.greatest(F.abs(F.col(actual)), F.lit(1e-10)))
    return rows.groupBy(*keys).agg(
        F.when(tss == 0, F.when(rss == 0, 1.0).otherwise(0.0)).otherwise(1 - rss / F.nullif(tss, F.lit(0.0))).alias("weighted_r2"),
        (F.sum(F.col(weight) * ape) / sw * 100).alias("weighted_mape"),
    )


def origin_ensemble(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    target: str,
    features: Sequence[str],
    replicates: int = 1000,
    alpha: float = 1.0,
    decay: float = 0.98,
    min_train: int = 30,
    chunk: int = 125,
) -> DataFrame:
    """Poisson-bootstrapped ridge forecasts of every row with at least ``min_train`` earlier ones: keys, order, replicate,
    prediction.

    In a replicate every row counts as often as a Poisson(1) variable of (row number, replicate) says, at all origins
    alike, and weights decay towards the past. So an origin's sums are those of the origin before, decayed, plus one
    row: a task carries the sums of one chunk of replicates along the series, and the cost is rows x replicates, not
    origins x rows x replicates. (key, chunk) is dealt out, so one series uses several tasks; rows stream, so it may be of
    any length. Without a single count an origin has no prediction in that replicate. Rows with a missing value are left out.
    """
    cols, key_list = [*features, target], list(keys)
    # the mean of a column only moves the origin of its values, so that sums of products lose no digits
    rows = centre(df.select(*keys, order, *cols).dropna(subset=cols), keys, cols)
    chunks = -(-replicates // chunk)
    names = [*keys, "__chunk"]
    jobs = rows.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    jobs = jobs.repartition(parallelism(df), *names).sortWithinPartitions(*names, order)
    p = len(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, sums, seen, reps = None, None, 0, None
        for batch in batches:
            values = batch[cols].to_numpy(float)
            out = []
            for at, mine in enumerate(zip(*(batch[n] for n in names))):
                mine = tuple(None if v is None or v != v else v for v in mine)
                if mine != held:
                    held, seen = mine, 0
                    reps = np.arange(mine[-1] * chunk + 1, min((mine[-1] + 1) * chunk, replicates) + 1)
                    sums = np.zeros((len(reps), p + 2, p + 2))
                    middle = np.asarray(batch["__centre"].iloc[at], float)
                z = np.concatenate(([1.0], values[at]))
                if seen >= min_train:
                    predicted = _ridge_prediction(sums, z[1 : p + 1], alpha)
                    out.append((*mine[:-1], batch[order].iloc[at], reps[0], (predicted + middle[p]).tolist()))
                seen += 1
                sums = sums * decay + bootstrap.poisson_counts(np.array([seen]), reps)[:, :, None] * np.outer(z, z)
            yield pd.DataFrame(out, columns=[*key_list, order, "__first", "predictions"])

    types = dict(df.dtypes)
    ddl = _key_ddl(df, keys) + f"`{order}` {types[order]}, __first int, predictions array<double>"
    packed = jobs.mapInPandas(run, ddl).select(*keys, order, "__first", F.posexplode("predictions").alias("__at", "prediction"))
    return packed.select(*keys, order, (F.col("__first") + F.col("__at")).alias("replicate"), "prediction").where(~F.isnan("prediction"))


def _ridge_prediction(sums: np.ndarray, x: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge with a free intercept from sums of products of [1, features, target], at ``x``; one per replicate."""
    p = len(x)
    sw = sums[:, 0, 0]
    with np.errstate(all="ignore"):
        m = sums[:, 0, 1:] / sw[:, None]
        cov = sums[:, 1:, 1:] - sw[:, None, None] * m[:, :, None] * m[:, None, :]
    empty = sw <= 0
    cov[empty], m[empty] = 0.0, np.nan
    beta = np.linalg.solve(cov[:, :p, :p] + alpha * np.eye(p), cov[:, :p, p:])[:, :, 0]
    return m[:, p] + ((x - m[:, :p]) * beta).sum(axis=1)


def rolling_origin(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    target: str,
    features: Sequence[str],
    alpha: float = 1.0,
    decay: float | None = 0.98,
    min_train: int = 30,
    positive: bool = False,
) -> DataFrame:
    """One-step forecasts of log targets: for every row, a weighted ridge on all earlier rows.

    One window pass yields the moment block of every origin; no refit reads rows again.
    """
    cols = [*features, "__log_target"]
    rows = df.withColumn("__log_target", F.log(F.col(target))).select(*keys, order, *cols)
    blocks = prefix_blocks(rows, keys, order, cols, decay).where(F.col("n") >= min_train)
    fits = ridge_fits(blocks, [*keys, order], cols, features, alpha, positive, keep=["row"])
    pred = F.col("coef")[0]
    for i in range(len(features)):
        pred = pred + F.col("coef")[i + 1] * F.col("row")[i]
    return fits.select(
        *keys,
        order,
        F.col("n_obs").alias("train_size"),
        F.exp(F.col("row")[len(features)]).alias("y_true"),
        F.exp(pred).alias("y_predict"),
    ).withColumn("abs_pct_error", F.abs(F.col("y_true") - F.col("y_predict")) / F.col("y_true"))


def forecast_intervals(preds: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[float]) -> DataFrame:
    """Percentiles over replicates, labelled by the true percentile."""
    agg = preds.groupBy(*keys).agg(
        F.percentile(value, F.array(*[F.lit(p / 100) for p in percentiles])).alias("__q")
    )
    return agg.select(*keys, *[F.col("__q")[i].alias(f"p{p:g}".replace(".", "_")) for i, p in enumerate(percentiles)])


def compare_to_benchmark(model: DataFrame, benchmark: DataFrame, on: Sequence[str]) -> DataFrame:
    m = model.select(*on, F.col("mape").alias("model_mape"), F.col("r_squared").alias("model_r2"))
    b = benchmark.select(*on, F.col("mape").alias("benchmark_mape"), F.col("r_squared").alias("benchmark_r2"))
    j = m.join(b, list(on))
    return j.withColumns(
        {
            "mape_improvement_pct": (F.col("benchmark_mape") - F.col("model_mape")) / F.col("benchmark_mape") * 100,
            "r2_improvement_pct": (F.col("model_r2") - F.col("benchmark_r2"))
            / F.greatest(F.col("benchmark_r2"), F.lit(0.001))
            * 100,
            "model_outperforms": F.col("model_mape") < F.col("benchmark_mape"),
        }
    )


def generalization_gap(train: DataFrame, test: DataFrame, on: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    a = train.select(*on, *[F.col(m).alias(f"train_{m}") for m in metrics])
    b = test.select(*on, *[F.col(m).alias(f"test_{m}") for m in metrics])
    j = a.join(b, list(on))
    for m in metrics:
        gap = F.col(f"train_{m}") - F.col(f"test_{m}")
        rel = F.when(F.abs(F.col(f"train_{m}")) > 1e-10, gap / F.nullif(F.col(f"train_{m}"), F.lit(0.0)) * 100)
        j = j.withColumns({f"{m}_gap": gap, f"{m}_relative_gap_pct": rel})
    g = grades.generalization(F.coalesce(F.col(f"{metrics[0]}_relative_gap_pct"), F.lit(0.0)))
    failed = F.col(f"test_{metrics[0]}") < 0
    return j.withColumns(
        {
            "generalization_quality": g["quality"],
            "generalization_score": g["score"],
            "worse_than_mean": F.coalesce(failed, F.lit(False)),
        }
    )


def cv_summary(folds: DataFrame, keys: Sequence[str], r2: str = "r_squared") -> DataFrame:
    """Per series: folds, those with a score, mean and variation of R2, and the class of both."""
    mean = F.avg(r2)
    out = folds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_folds"), F.count(r2).alias("successful_folds"), mean.alias("average_r2"),
        (F.stddev_pop(r2) / F.abs(F.nullif(mean, F.lit(0.0)))).alias("r2_variation"),
    )
    rate = F.col("successful_folds") / F.col("total_folds")
    return out.withColumn("success_rate", rate).withColumn("cv_quality", grades.cv_quality(F.coalesce("r2_variation", F.lit(float("inf"))), "average_r2"))


def production_readiness(
    train: DataFrame,
    test: DataFrame,
    residuals: DataFrame,
    on: Sequence[str],
    min_test_r2: float = 0.3,
    max_test_mape: float = 25.0,
    max_r2_loss_pct: float = 30.0,
    max_bias: float = 0.1,
) -> DataFrame:
    """Four checks of a fitted model per series: test R2, test MAPE, loss of R2, clean residuals; and what they amount to.

    ``train`` and ``test`` come from :func:`regression_metrics`; ``residuals`` has ``mean`` and ``heteroscedastic``.
    """
    gap = generalization_gap(train, test, on, ["r_squared", "mape"])
    j = gap.join(residuals.select(*on, "mean", "heteroscedastic"), list(on))
    checks = {
        "test_r2_ok": F.col("test_r_squared") >= min_test_r2,
        "test_mape_ok": F.col("test_mape") <= max_test_mape,
        "generalization_ok": F.coalesce("r_squared_relative_gap_pct", F.lit(0.0)) <= max_r2_loss_pct,
        "residuals_ok": (F.abs("mean") <= max_bias) & ~F.col("heteroscedastic"),
    }
    j = j.withColumns({name: F.coalesce(check, F.lit(False)) for name, check in checks.items()})
    passed = sum((F.col(name).cast("int") for name in checks), F.lit(0))
    j = j.withColumn("checks_passed", passed)
    share = F.col("checks_passed") / len(checks)
    return j.withColumns(grades.readiness(share)).select(*on, *checks, "checks_passed", "confidence_level", "production_ready")
