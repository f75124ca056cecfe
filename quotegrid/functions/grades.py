"""Threshold ladders that turn stability and fit numbers into classes and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotegrid.functions.exprs import col, ladder

# Fixed values: (bound on the AIC variation, bound on the R2 variation, class).
STABILITY = [(0.005, 0.1, "STABLE"), (0.01, 0.2, "MODERATE")]
# Fixed values: (bound on the AIC variation, bound on the R2 variation, class, score).
BLOCK_STABILITY = [
    (0.002, 0.05, "HIGHLY_STABLE", 95),
    (0.005, 0.1, "STABLE", 85),
    (0.01, 0.2, "MODERATE", 65),
    (0.02, 0.3, "UNSTABLE", 40),
]
# Relative R2 loss in percent -> (class, score).
GENERALIZATION = [(5, "EXCELLENT", 95), (10, "GOOD", 80), (20, "ACCEPTABLE", 65), (40, "CONCERNING", 40)]
# Composite score -> grade.
COMPOSITE = [(80, "A+ (Excellent)"), (70, "A (Very Good)"), (60, "B+ (Good)"), (50, "B (Average)")]


def stability(aic_cv: str | Column, r2_cv: str | Column, success_rate: Column) -> Column:
    a, r = col(aic_cv), col(r2_cv)
    out = F.when(success_rate < 0.5, "FAILED")
    for bound_a, bound_r, label in STABILITY:
        out = out.when((a < bound_a) & (r < bound_r), label)
    return out.otherwise("UNSTABLE")


def block_stability(aic_cv: str | Column, r2_cv: str | Column) -> dict[str, Column]:
    a, r = col(aic_cv), col(r2_cv)
    label = score = None
    for bound_a, bound_r, name, points in BLOCK_STABILITY:
        hit = (a < bound_a) & (r < bound_r)
        label = F.when(hit, name) if label is None else label.when(hit, name)
        score = F.when(hit, points) if score is None else score.when(hit, points)
    return {"stability_assessment": label.otherwise("HIGHLY_UNSTABLE"), "stability_score": score.otherwise(20)}


def generalization(relative_gap_pct: str | Column) -> dict[str, Column]:
    return {
        "quality": ladder(relative_gap_pct, [(b, n) for b, n, _ in GENERALIZATION], "POOR"),
        "score": ladder(relative_gap_pct, [(b, s) for b, _, s in GENERALIZATION], 20),
    }


def composite_grade(score: str | Column) -> Column:
    return ladder(score, COMPOSITE, "C (Below Average)", ">=")


def ir_score(ir: str | Column) -> Column:
    """Maps [-2, 2] onto [0, 100]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (col(ir) + 2) * 25))


# Upper bounds of a p value -> severity of a broken assumption.
P_SEVERITY = [(0.001, "SEVERE"), (0.01, "MODERATE"), (0.05, "MILD")]
NORMALITY_SEVERITY = [(0.001, "MODERATE"), (0.05, "MILD")]
# Lower bounds of the variance inflation.
INFLATION_SEVERITY = [(20, "SEVERE"), (10, "MODERATE"), (5, "MILD")]
# Distance of the Durbin-Watson ratio from 2.
DURBIN_WATSON_SEVERITY = [(1.0, "SEVERE"), (0.5, "MODERATE")]


def severity(test: str, value: str | Column) -> Column:
    """NONE, MILD, MODERATE or SEVERE by the p value of a test, the inflation factor or the Durbin-Watson ratio."""
    c = col(value)
    if test == "durbin_watson":
        return ladder(F.abs(c - 2), DURBIN_WATSON_SEVERITY, "NONE", ">")
    if test == "variance_inflation":
        return ladder(c, INFLATION_SEVERITY, "NONE", ">")
    return ladder(c, NORMALITY_SEVERITY if test == "jarque_bera" else P_SEVERITY, "NONE", "<")


# Fixed values: (bound on the variation of R2 over folds, bound on its mean, class).
CV_QUALITY = [(0.1, 0.4, "EXCELLENT"), (0.2, 0.3, "GOOD"), (0.3, 0.2, "ACCEPTABLE")]
# Share of passed checks -> (confidence, ready).
READINESS = [(1.0, "HIGH", True), (0.75, "MODERATE", True), (0.5, "LOW", False)]


def cv_quality(variation: str | Column, mean: str | Column) -> Column:
    out = F.when(col(mean).isNull(), "FAILED")
    for bound, least, label in CV_QUALITY:
        out = out.when((col(variation) < bound) & (col(mean) > least), label)
    return out.otherwise("POOR")


def readiness(share: Column) -> dict[str, Column]:
    confidence = ready = None
    for bound, label, yes in READINESS:
        hit = share >= bound
        confidence = F.when(hit, label) if confidence is None else confidence.when(hit, label)
        ready = F.when(hit, F.lit(yes)) if ready is None else ready.when(hit, F.lit(yes))
    return {"confidence_level": confidence.otherwise("VERY LOW"), "production_ready": ready.otherwise(F.lit(False))}
