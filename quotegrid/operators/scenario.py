"""Predictions from coefficient tables and rate scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrid.operators.joins import scenario_grid


def linear_prediction(coef: str, features: Sequence[Column]) -> Column:
    """Dot product of an array [intercept, slopes...] with feature columns."""
    out = F.col(coef)[0]
    for i, x in enumerate(features, 1):
        out = out + F.col(coef)[i] * x
    return out


def predict_long(coefs: DataFrame, rows: DataFrame, keys: Sequence[str], row_ids: Sequence[str]) -> DataFrame:
    """Prediction from a long coefficient table (term, coef) and long features (term, x).

    The intercept term needs a feature row with x = 1.
    """
    j = coefs.join(rows, [*keys, "term"])
    ids = [c for c in coefs.columns if c not in ("term", "coef", *keys)]
    return j.groupBy(*keys, *ids, *row_ids).agg(F.sum(F.col("coef") * F.col("x")).alias("prediction"))


def price_scenarios(
    ensemble: DataFrame,
    current: DataFrame,
    scenarios: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    own: str,
    competitors: Sequence[str],
    competitor_shift: float | str | Column = 0.0,
    multiplier: float = 13.0,
    invert: str = "log1p",
    scale: float = 1.0,
) -> DataFrame:
    """Every scenario rate with every replicate: yearly-quarter amount and percent change.

    ``ensemble`` (keys, replicate, coef), ``current`` (keys, one row of features),
    ``scenarios`` (scenario). The own rate takes the scenario value, competitor rates
    are shifted; other features keep their current value. Long output, no wide matrix.
    """
    back = {"log1p": lambda c: F.expm1(c), "log": lambda c: F.exp(c), "none": lambda c: c}[invert]
    j = scenario_grid(ensemble.join(current, list(keys)), scenarios)
    shift = F.lit(competitor_shift) if isinstance(competitor_shift, (int, float)) else (
        F.col(competitor_shift) if isinstance(competitor_shift, str) else competitor_shift
    )

    def adjusted(f: str) -> Column:
        if f == own:
            return F.col("scenario")
        return F.col(f) + shift if f in competitors else F.col(f)

    base = back(linear_prediction("coef", [F.col(f) for f in features])) * scale
    priced = back(linear_prediction("coef", [adjusted(f) for f in features])) * scale
    return j.select(
        *keys,
        "replicate",
        "scenario",
        (priced * multiplier).alias("dollars"),
        ((priced / base - 1) * 100).alias("pct_change"),
    )


def scenario_intervals(
    facts: DataFrame, keys: Sequence[str], value: str, confidence: float = 0.95, decimals: int = 3
) -> DataFrame:
    a = 1 - confidence
    q = F.percentile(value, F.array(F.lit(a / 2), F.lit(0.5), F.lit(1 - a / 2)))
    agg = facts.groupBy(*keys, "scenario").agg(q.alias("__q"))
    names = ["bottom", "median", "top"]
    return agg.select(
        *keys, "scenario", *[F.bround(F.col("__q")[i], decimals).alias(n) for i, n in enumerate(names)]
    )


def current_momentum(df: DataFrame, keys: Sequence[str], lag_columns: Sequence[str], out: str = "momentum") -> DataFrame:
    """Mean of the lag columns of a one-row-per-key table."""
    total = F.col(lag_columns[0])
    for c in lag_columns[1:]:
        total = total + F.col(c)
    return df.withColumn(out, total / len(lag_columns))
