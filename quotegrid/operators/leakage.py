"""Leakage gates: each returns rows (gate, status, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrid.functions import exprs as X
from quotegrid.functions.exprs import col
from quotegrid.operators import selection as sel
from quotegrid.operators.moments import fit_models, moment_blocks
from quotegrid.operators.windows import numbered

# Gate thresholds; every function takes them as parameters.
SHUFFLED_LIMIT = 0.10
R2_HALT, R2_WARN = 0.30, 0.20
GAIN_HALT, GAIN_WARN = 0.20, 0.10


def gate_row(keys: Sequence[str], name: str, status: Column, value: Column) -> list[Column]:
    return [*[F.col(k) for k in keys], F.lit(name).alias("gate"), status.alias("status"), value.cast("double").alias("value")]


def temporal_boundary(split: DataFrame, keys: Sequence[str], date_col: str) -> DataFrame:
    """HALT when the training set reaches into the test period."""
    g = split.groupBy(*keys).agg(
        F.max(F.when(F.col("role") == "train", F.col(date_col))).alias("a"),
        F.min(F.when(F.col("role") == "test", F.col(date_col))).alias("b"),
    )
    return g.select(
        *gate_row(keys, "temporal_boundary", F.when(F.col("a") >= F.col("b"), "HALT").otherwise("PASS"), F.datediff("b", "a"))
    )


def shuffled_target(
    df: DataFrame, keys: Sequence[str], order: str, target: str, features: Sequence[str], shuffles: int = 5, limit: float = SHUFFLED_LIMIT
) -> DataFrame:
    """Mean R2 over targets re-paired by a reproducible permutation of row numbers."""
    rows = numbered(df.select(*keys, order, target, *features), keys, order).drop("n")
    x = rows.select(*keys, "rn", *features, F.explode(F.sequence(F.lit(1), F.lit(shuffles))).alias("shuffle"))
    y = rows.select(*keys, F.col("rn").alias("__src"), target, F.explode(F.sequence(F.lit(1), F.lit(shuffles))).alias("shuffle"))
    y = X.with_draw(y, "__src", "shuffle", "__u")
    y = numbered(y.withColumn("__o", F.struct("__u", "__src")), [*keys, "shuffle"], "__o").select(*keys, "shuffle", "rn", target)
    cols = [*features, target]
    blocks = moment_blocks(x.join(y, [*keys, "shuffle", "rn"]), [*keys, "shuffle"], cols)
    fits = fit_models(blocks, [*keys, "shuffle"], cols, [("m", list(features))])
    g = fits.groupBy(*keys).agg(F.avg("r2").alias("v"))
    return g.select(*gate_row(keys, "shuffled_target", F.when(F.col("v") > limit, "HALT").otherwise("PASS"), F.col("v")))


def ladder_status(value: str | Column, halt: float, warn: float) -> Column:
    v = col(value)
    return F.when(v > halt, "HALT").when(v > warn, "WARN").otherwise("PASS")


def r2_gate(df: DataFrame, keys: Sequence[str], r2: str, halt: float = R2_HALT, warn: float = R2_WARN) -> DataFrame:
    return df.select(*gate_row(keys, "r_squared", ladder_status(r2, halt, warn), F.col(r2)))


def improvement_gate(
    df: DataFrame, keys: Sequence[str], base: str, new: str, higher_is_better: bool = True, halt: float = GAIN_HALT, warn: float = GAIN_WARN
) -> DataFrame:
    gain = F.col(new) - F.col(base) if higher_is_better else F.col(base) - F.col(new)
    rel = gain / F.nullif(F.abs(F.col(base)), F.lit(0.0))
    return df.select(*gate_row(keys, "improvement", ladder_status(F.coalesce(rel, F.lit(0.0)), halt, warn), rel))


def lag_zero_gate(coefs: DataFrame, keys: Sequence[str], feature: str) -> DataFrame:
    n = F.count(F.when(sel.is_lag_zero(feature), 1))
    return coefs.groupBy(*keys).agg(n.alias("v")).select(
        *gate_row(keys, "lag_zero_features", F.when(F.col("v") > 0, "HALT").otherwise("PASS"), F.col("v"))
    )


def sign_gate(coefs: DataFrame, keys: Sequence[str], feature: str, coef: str) -> DataFrame:
    status = sel.sign_status(coef, sel.expected_sign(feature)["expected_sign"])
    g = coefs.select(*keys, status.alias("s")).groupBy(*keys).agg(F.count(F.when(F.col("s") == "violated", 1)).alias("v"))
    return g.select(*gate_row(keys, "coefficient_signs", F.when(F.col("v") > 0, "HALT").otherwise("PASS"), F.col("v")))


def gate_report(gates: Sequence[DataFrame]) -> DataFrame:
    from quotegrid.operators.setops import union_all

    return union_all(gates)
