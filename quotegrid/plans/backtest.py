"""Rolling-origin back-test against a persistence benchmark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegrid.operators import forecast as fc
from quotegrid.operators.windows import persistence, rolling_weighted_error, volatility_weights


def backtest(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    target: str,
    features: Sequence[str],
    benchmark_lag: int = 5,
    **model: object,
) -> DataFrame:
    """Model and benchmark error per series with the improvement."""
    preds = fc.rolling_origin(df, keys, order, target, features, **model)
    bench = df.select(*keys, order, target, persistence(target, benchmark_lag, keys, order).alias("__p"))
    return fc.compare_to_benchmark(
        fc.regression_metrics(preds, keys, "y_true", "y_predict"), fc.regression_metrics(bench, keys, target, "__p"), keys
    )


def backtest_report(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    target: str,
    features: Sequence[str],
    benchmark_lag: int = 5,
    replicates: int = 1000,
    alpha: float = 1.0,
    decay: float = 0.98,
    min_train: int = 30,
    confidence: float = 0.95,
) -> DataFrame:
    """Per series: model against benchmark, and how the bootstrap intervals of the same forecasts held.

    ``coverage`` is the share of actual values inside their interval, ``relative_width`` the mean width over the actual value,
    ``calibrated`` whether the share lies within three standard errors of the nominal one.
    """
    compared = backtest(df, keys, order, target, features, benchmark_lag, alpha=alpha, decay=decay, min_train=min_train)
    logs = df.withColumn("__log", F.log(F.col(target)))
    preds = fc.origin_ensemble(logs, keys, order, "__log", features, replicates, alpha, decay, min_train)
    tail = (1 - confidence) / 2 * 100
    ends = fc.forecast_intervals(preds.withColumn("prediction", F.exp("prediction")), [*keys, order], "prediction", [tail, 100 - tail])
    low, high = ends.columns[-2:]
    actual = F.col(target)
    share = F.avg((actual.between(F.col(low), F.col(high))).cast("double"))
    held = ends.join(df.select(*keys, order, target), [*keys, order]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_forecasts"), share.alias("coverage"), F.avg((F.col(high) - F.col(low)) / actual).alias("relative_width")
    )
    error = F.sqrt(F.lit(confidence * (1 - confidence)) / F.col("n_forecasts"))
    held = held.withColumn("calibrated", F.abs(F.col("coverage") - confidence) <= 3 * error)
    return compared.join(held, list(keys))


def weighted_error_path(preds: DataFrame, keys: Sequence[str], order: str, size: int = 13) -> DataFrame:
    """Volatility-weighted rolling percentage error of a back-test."""
    w = volatility_weights(preds, "y_true", keys, order, size)
    out = rolling_weighted_error(w, "abs_pct_error", "weight", keys, order, size)
    return out.select(*keys, order, (F.col("weighted_mape") * 100).alias("weighted_mape"))
