"""Reduced candidate spaces, sign constraints and multiple-testing corrections on model tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotegrid.functions import distributions as D
from quotegrid.functions.exprs import col
from quotegrid.operators import ranged
from quotegrid.operators.subsets import beside, enumerate_ranges
from quotegrid.operators.windows import series_window


# ---------------------------------------------------------------- enumeration
def reduced_space(
    candidates: DataFrame, name: str, priority: Sequence[str], min_size: int, max_size: int, limit: int
) -> DataFrame:
    """Combinations with a priority feature first, topped up with the others.

    More priority combinations than the limit: those with most priority features, then
    the longest, win. Fewer: the rest is filled in order of size and name.
    """
    subsets = enumerate_ranges(candidates, name, [], max_size).where(F.col("n_features") >= min_size)
    wanted = F.array(*[F.lit(p) for p in priority])
    n_prio = F.size(F.array_intersect("features", wanted))
    tagged = subsets.withColumn("n_priority", n_prio)
    has = F.col("n_priority") > 0
    return (
        tagged.withColumn("strategy", F.when(has, "priority_inclusive").otherwise("non_priority"))
        .orderBy(
            has.desc(),
            F.desc("n_priority"),
            F.when(has, -F.col("n_features")).otherwise(F.col("n_features")),
            "features",
        )
        .limit(limit)
    )


# ---------------------------------------------------------------- sign rules
# Ordered (pattern name, regular expression, expected sign); first match decides.
SIGN_PATTERNS = [
    ("own_rate", r"(own|p)_?rate", "positive"),
    ("competitor_weighted", r"competitor_(mid|weighted|mean)", "negative"),
    ("competitor_core", r"competitor_core", "negative"),
    ("competitor_top", r"competitor_(top\d+|1st|2nd|3rd)", "negative"),
    ("competitor_lag", r"competitor_.*_t\d+", "negative"),
    ("c_weighted_mean", r"c_weighted_mean", "negative"),
    ("treasury", r"(dgs5|treasury|econ\.treasury)", "context_dependent"),
    ("vix", r"(vix|volatility)", "context_dependent"),
    ("spread", r"spread", "context_dependent"),
]
# Names of same-period competitor features.
LAG_ZERO_PATTERNS = [r"c_lag_?0\b", r"competitor.*lag.*0", r"lag_0.*competitor", r"c_t\b(?!_)"]


def expected_sign(feature: str | Column, own_brands: Sequence[str] = ()) -> dict[str, Column]:
    """First pattern that matches; ``own_brands`` are further prefixes of the own rate's name."""
    low = F.lower(col(feature))
    brands = "|".join(re.escape(b.lower()) for b in own_brands)
    extra = [("own_rate", rf"({brands})_?rate", "positive")] if own_brands else []
    name = sign = None
    for n, pattern, s in [*extra, *SIGN_PATTERNS]:
        hit = low.rlike(pattern)
        name = F.when(hit, n) if name is None else name.when(hit, n)
        sign = F.when(hit, s) if sign is None else sign.when(hit, s)
    return {"pattern": name, "expected_sign": sign}


def sign_status(coef: str | Column, sign: str | Column) -> Column:
    c, s = col(coef), col(sign)
    bad = ((s == "positive") & (c <= 0)) | ((s == "negative") & (c >= 0))
    return (
        F.when(s.isNull(), "no constraint")
        .when(s == "context_dependent", "warning")
        .when(bad, "violated")
        .otherwise("passed")
    )


def is_lag_zero(feature: str | Column) -> Column:
    low = F.lower(col(feature))
    out = F.lit(False)
    for p in LAG_ZERO_PATTERNS:
        out = out | low.rlike(p)
    return out


Rule = tuple[str, str, bool]  # (substring, expected sign, strict)


def _with_rules(coefs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Each coefficient with the rules whose substring its term contains; the hand-written list is part of the plan."""
    listed = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.lit(s).alias("expected_sign"), F.lit(strict).alias("strict"))
            for r, s, strict in rules
        ]
    )
    terms = coefs.where(F.col("term") != "Intercept")
    return terms.select("*", F.inline(F.filter(listed, lambda r: F.col("term").contains(r["rule"]))))


def constraint_violations(coefs: DataFrame, rules: Sequence[Rule], confidence: float = 0.95) -> DataFrame:
    """Coefficients whose normal interval does not lie on the expected side of zero.

    Without a usable standard error the point estimate decides.
    """
    z = D.normal_quantile(1 - (1 - confidence) / 2)
    j = _with_rules(coefs, rules)
    lo, hi = F.col("coef") - z * F.col("se"), F.col("coef") + z * F.col("se")
    has_se = F.col("se").isNotNull() & ~F.isnan("se") & (F.col("se") > 0)
    pos = F.when(has_se, lo <= 0).otherwise(F.col("coef") <= 0)
    neg = F.when(has_se, hi >= 0).otherwise(F.col("coef") >= 0)
    bad = F.when(F.col("expected_sign") == "positive", pos).when(F.col("expected_sign") == "negative", neg)
    usable = F.col("coef").isNotNull() & ~F.isnan("coef")
    return j.where(usable & F.coalesce(bad, F.lit(False))).withColumn(
        "severity", F.when(F.col("strict"), "ERROR").otherwise("WARNING")
    )


def drop_violating(models: DataFrame, violations: DataFrame, keys: Sequence[str]) -> DataFrame:
    bad = violations.where(F.col("severity") == "ERROR").select(*keys, "model_id").distinct()
    return models.join(bad, [*keys, "model_id"], "left_anti")


def t_constraints(coefs: DataFrame, rules: Sequence[Rule], confidence: float = 0.95) -> DataFrame:
    """t interval, strength class and satisfaction per constrained coefficient."""
    j = _with_rules(coefs, rules)
    j = j.withColumn("dof", F.col("n_obs") - F.col("n_features") - 1)
    j = j.withColumn("t_critical", D.t_critical("dof", confidence))
    j = j.withColumns(
        {
            "t_statistic": F.col("coef") / F.col("se"),
            "ci_lower": F.col("coef") - F.col("t_critical") * F.col("se"),
            "ci_upper": F.col("coef") + F.col("t_critical") * F.col("se"),
        }
    )
    c, lo, hi = F.col("coef"), F.col("ci_lower"), F.col("ci_upper")
    pos = F.when(lo > 0.01, "STRONG").when(lo > 0, "MODERATE").when((c > 0) & (hi > 0), "WEAK").otherwise("VIOLATED")
    neg = F.when(hi < -0.01, "STRONG").when(hi < 0, "MODERATE").when((c < 0) & (lo < 0), "WEAK").otherwise("VIOLATED")
    strength = F.when(F.col("expected_sign") == "positive", pos).otherwise(neg)
    return j.withColumn("strength", strength).withColumn(
        "significant", F.abs(F.col("t_statistic")) > F.col("t_critical")
    )


def compliance(strengths: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("strength") == s, 1)).alias(s.lower())
    g = strengths.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), n("STRONG"), n("MODERATE"), n("WEAK"), n("VIOLATED")
    )
    t, strong = F.col("total"), F.col("strong")
    good, some = strong + F.col("moderate"), strong + F.col("moderate") + F.col("weak")
    return g.withColumn(
        "compliance",
        F.when(F.col("violated") > 0, "POOR")
        .when(strong >= t * 0.7, "EXCELLENT")
        .when(good >= t * 0.6, "GOOD")
        .when(some >= t * 0.5, "ACCEPTABLE")
        .otherwise("CONCERNING"),
    )


# ---------------------------------------------------------------- multiple testing
def _aic_gap(models: DataFrame, keys: Sequence[str], aic: str) -> DataFrame:
    if not keys:
        least = models.agg(F.min(aic).alias("__least"))
        return beside(models, least, keys).withColumn("aic_diff", F.col(aic) - F.col("__least")).drop("__least")
    return models.withColumn("aic_diff", F.col(aic) - F.min(aic).over(series_window(keys)))


def bonferroni(models: DataFrame, n_tests: int, aic: str = "aic", keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Keep models within the chi-squared quantile of the corrected level."""
    critical = D.chi2_one_quantile(1 - alpha / n_tests)
    return _aic_gap(models, keys, aic).withColumn("bonferroni_significant", F.col("aic_diff") <= critical)


def benjamini_hochberg(models: DataFrame, aic: str = "aic", keys: Sequence[str] = (), alpha: float = 0.05, tie: str = "model_id") -> DataFrame:
    """Step-up on p = P(chi2_1 > AIC difference); small p means far from the best model."""
    m = _aic_gap(models, keys, aic)
    p = F.greatest(F.lit(1e-16), F.least(F.lit(1.0), D.chi2_sf("aic_diff", 1)))
    m = m.withColumn("p_value", p)
    if not keys:
        # one long table of models: ranked by ranges, not in one task
        m = ranged.step_up(m, "p_value", keys, tie, "fdr_corrected_p")
        return m.withColumn("differs_from_best", F.col("fdr_corrected_p") <= alpha)
    asc = series_window(keys).orderBy("p_value", tie)
    n = F.count(F.lit(1)).over(series_window(keys))
    m = m.withColumn("__raw", F.col("p_value") * n / F.row_number().over(asc))
    later = series_window(keys).orderBy("p_value", tie).rowsBetween(0, Window.unboundedFollowing)
    m = m.withColumn("fdr_corrected_p", F.least(F.lit(1.0), F.min("__raw").over(later)))
    return m.drop("__raw").withColumn("differs_from_best", F.col("fdr_corrected_p") <= alpha)


def compare_corrections(models: DataFrame, n_tests: int, keys: Sequence[str], alpha: float = 0.05, reduced: int = 100) -> DataFrame:
    b = bonferroni(models, n_tests, keys=keys, alpha=alpha)
    h = benjamini_hochberg(models, keys=keys, alpha=alpha)

    def summary(df: DataFrame, method: str, kept: Column) -> DataFrame:
        g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_models"), F.count(F.when(kept, 1)).alias("n_kept"))
        return g.select(*keys, F.lit(method).alias("method"), "n_models", "n_kept")

    out = summary(b, "bonferroni", F.col("bonferroni_significant"))
    out = out.unionByName(summary(h, "fdr_bh", F.col("differs_from_best")))
    small = summary(models, "reduced_space", F.lit(True)).withColumn("n_kept", F.least("n_models", F.lit(reduced).cast("bigint")))
    return out.unionByName(small).withColumn("rejection_rate", 1 - F.col("n_kept") / F.col("n_models"))
