"""Residual diagnostics and two-sample tests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegrid.functions import distributions as D
from quotegrid.functions import grades
from quotegrid.functions.exprs import ladder, nan_to_null
from quotegrid.operators.gram import gram_tiles, inverse_diagonal, whole_correlations
from quotegrid.operators.moments import Model, fit_models, moment_blocks
from quotegrid.operators.quantiles import ecdf_distance, exact_quantiles
from quotegrid.operators.windows import series_window


def residuals(df: DataFrame, keys: Sequence[str], target: str, features: Sequence[str], out: str = "residual") -> DataFrame:
    """Rows with the fitted value and residual of one least-squares model per key."""
    blocks = moment_blocks(df, keys, [*features, target])
    fits = fit_models(blocks, keys, [*features, target], [("m", list(features))])
    coef = fits.select(*keys, F.col("coef").alias("__coef"))
    j = df.join(coef, list(keys))
    fitted = F.col("__coef")[0]
    for i, f in enumerate(features, 1):
        fitted = fitted + F.col("__coef")[i] * F.col(f)
    return j.withColumn("fitted", fitted).withColumn(out, F.col(target) - F.col("fitted")).drop("__coef")


def autocorrelation(res: DataFrame, keys: Sequence[str], order: str, e: str = "residual", lags: int = 10) -> DataFrame:
    """Durbin-Watson ratio and Ljung-Box Q with its chi-squared tail."""
    w = series_window(keys, order)
    mean = F.avg(e).over(series_window(keys))
    rows = res.select(
        *keys,
        F.col(e).alias("__e"),
        (F.col(e) - mean).alias("__d"),
        F.lag(e, 1).over(w).alias("__p"),
        *[(F.lag(e, k).over(w) - mean).alias(f"__l{k}") for k in range(1, lags + 1)],
    )
    d2 = F.sum(F.col("__d") * F.col("__d"))
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(F.pow(F.col("__e") - F.col("__p"), F.lit(2.0))) / F.sum(F.col("__e") * F.col("__e"))).alias("durbin_watson"),
        *[(F.sum(F.col("__d") * F.col(f"__l{k}")) / d2).alias(f"__r{k}") for k in range(1, lags + 1)],
    )
    q = F.lit(0.0)
    for k in range(1, lags + 1):
        q = q + F.col(f"__r{k}") * F.col(f"__r{k}") / (F.col("n") - k)
    out = agg.withColumn("ljung_box", F.col("n") * (F.col("n") + 2) * q)
    out = out.withColumn("ljung_box_p", D.chi2_sf("ljung_box", lags))
    return out.select(*keys, "n", "durbin_watson", "ljung_box", "ljung_box_p")


def heteroscedasticity(res: DataFrame, keys: Sequence[str], features: Sequence[str], e: str = "residual") -> DataFrame:
    """Breusch-Pagan and White: n R2 of squared residuals on X, and on X with squares and products."""
    feats = list(features)
    squares = [(a, b) for i, a in enumerate(feats) for b in feats[i:]]
    names = [f"__x_{a}_{b}" for a, b in squares]
    rows = res.select(
        *keys,
        *feats,
        *[(F.col(a) * F.col(b)).alias(n) for (a, b), n in zip(squares, names)],
        (F.col(e) * F.col(e)).alias("__e2"),
    )
    cols = [*feats, *names, "__e2"]
    models: list[Model] = [("breusch_pagan", feats), ("white", [*feats, *names])]
    fits = fit_models(moment_blocks(rows, keys, cols), keys, cols, models)
    lm = F.col("n_obs") * F.col("r2")
    p = F.when(F.col("model_id") == "breusch_pagan", D.chi2_sf(lm, len(feats))).otherwise(
        D.chi2_sf(lm, len(feats) + len(names))
    )
    return fits.select(*keys, F.col("model_id").alias("test"), lm.alias("lm"), p.alias("p_value"))


# Upper bounds of the variance inflation bands.
VIF_BANDS = [(5, "LOW"), (10, "MODERATE"), (20, "HIGH")]


def variance_inflation(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """1 / (1 - R2) of each feature on the others: the diagonal of the inverse correlation matrix, one scan and one inverse."""
    cols = list(features)
    whole = df.select(*keys, *cols).dropna(subset=cols)

    def factors(corr: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"feature": cols, "vif": inverse_diagonal(corr)})

    out = whole_correlations(gram_tiles(whole, keys, cols), keys, cols, factors, "feature string, vif double")
    return out.withColumn("vif", nan_to_null("vif")).withColumn("band", ladder("vif", VIF_BANDS, "SEVERE", "<"))


def residual_moments(res: DataFrame, keys: Sequence[str], e: str = "residual") -> DataFrame:
    """Mean, deviation, extremes, median, skewness, excess kurtosis and the Jarque-Bera statistic."""
    agg = res.groupBy(*keys).agg(
        F.count(e).alias("n"),
        F.avg(e).alias("mean"),
        F.stddev_pop(e).alias("std"),
        F.min(e).alias("min"),
        F.max(e).alias("max"),
        F.percentile(e, F.lit(0.5)).alias("median"),
        F.skewness(e).alias("skewness"),
        F.kurtosis(e).alias("kurtosis"),
    )
    jb = F.col("n") / 6 * (F.pow("skewness", F.lit(2.0)) + F.pow("kurtosis", F.lit(2.0)) / 4)
    return agg.withColumn("jarque_bera", jb).withColumn("jarque_bera_p", D.chi2_sf("jarque_bera", 2))


def mean_t_test(df: DataFrame, keys: Sequence[str], value: str, with_p: bool = True) -> DataFrame:
    """One-sample t of the mean against zero."""
    out = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        (F.avg(value) / (F.stddev_samp(value) / F.sqrt(F.count(value)))).alias("t_statistic"),
    )
    return out.withColumn("p_value", D.t_p_value("t_statistic", F.col("n") - 1)) if with_p else out


def levene(df: DataFrame, keys: Sequence[str], group: str, value: str, with_p: bool = True) -> DataFrame:
    """Median-centred Levene statistic of the groups inside every key."""
    med = exact_quantiles(df, value, [0.5], [*keys, group]).select(*keys, group, F.col("value").alias("__med"))
    z = df.join(med, [*keys, group]).withColumn("__z", F.abs(F.col(value) - F.col("__med")))
    per = z.groupBy(*keys, group).agg(
        F.count("__z").cast("double").alias("__n"), F.avg("__z").alias("__zm"), F.var_pop("__z").alias("__zv")
    )
    n, k = F.sum("__n"), F.count(F.lit(1))
    # bounded number of groups per key
    grand = F.sum(F.col("__n") * F.col("__zm")).over(series_window(keys)) / F.sum("__n").over(series_window(keys))
    between = F.sum(F.col("__n") * F.pow(F.col("__zm") - F.col("__g"), F.lit(2.0)))
    within = F.sum(F.col("__n") * F.col("__zv"))
    out = per.withColumn("__g", grand).groupBy(*keys).agg(
        ((n - k) / (k - 1) * between / within).alias("levene"), (k - 1).alias("df1"), (n - k).alias("df2")
    )
    return out.withColumn("p_value", D.f_p_value("levene", "df1", "df2")) if with_p else out


def ks_two_sample(df: DataFrame, keys: Sequence[str], value: str, in_first: str) -> DataFrame:
    """Kolmogorov-Smirnov distance between the rows with ``in_first`` true and false, with its asymptotic tail."""
    out = ecdf_distance(df, value, in_first, keys).withColumnRenamed("distance", "ks_distance")
    en = F.sqrt(F.col("n_first") * F.col("n_second") / (F.col("n_first") + F.col("n_second")))
    return out.withColumn("ks_p", D.kolmogorov_sf(en * F.col("ks_distance")))


def severity_report(df: DataFrame, keys: Sequence[str], order: str, target: str, features: Sequence[str]) -> DataFrame:
    """Keys, test, subject, statistic, p_value, severity and whether an assumption of least squares is broken."""
    res = residuals(df, keys, target, features)
    none = F.lit(None).cast("double")

    def part(rows: DataFrame, test, subject, statistic: str, p, graded: str, name: str) -> DataFrame:
        value = F.col(statistic)
        return rows.select(*keys, test.alias("test"), subject.alias("subject"), value.alias("statistic"), p.alias("p_value"), grades.severity(name, graded).alias("severity"))

    auto = autocorrelation(res, keys, order)
    whole = F.lit("residuals")
    parts = [
        part(auto, F.lit("durbin_watson"), whole, "durbin_watson", none, "durbin_watson", "durbin_watson"),
        part(auto, F.lit("ljung_box"), whole, "ljung_box", F.col("ljung_box_p"), "ljung_box_p", "ljung_box"),
        part(heteroscedasticity(res, keys, features), F.col("test"), whole, "lm", F.col("p_value"), "p_value", "heteroscedasticity"),
        part(residual_moments(res, keys), F.lit("jarque_bera"), whole, "jarque_bera", F.col("jarque_bera_p"), "jarque_bera_p", "jarque_bera"),
    ]
    if len(features) > 1:
        parts.append(part(variance_inflation(df, keys, features), F.lit("variance_inflation"), F.col("feature"), "vif", none, "vif", "variance_inflation"))
    # a mild inflation is a remark, a mild p value is a finding
    broken = F.when(F.col("test") == "variance_inflation", F.col("severity").isin("MODERATE", "SEVERE")).otherwise(F.col("severity") != "NONE")
    return reduce(DataFrame.unionByName, parts).withColumn("violated", broken)
