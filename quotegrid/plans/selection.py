"""Search, constraints, resampling and choice of one model per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegrid.operators import bootstrap as bs
from quotegrid.operators import moments as mo
from quotegrid.operators import selection as sel
from quotegrid.operators import stability as stb
from quotegrid.operators.topk import best_model


def select_models(
    df: DataFrame,
    rules: Sequence[sel.Rule],
    keys: Sequence[str],
    order: str,
    target: str,
    features: Sequence[str],
    models: Sequence[mo.Model],
    replicates: int = 200,
    block_size: int = 4,
) -> DataFrame:
    """Best valid model per series with its block-bootstrap stability; a noted fallback where none is valid."""
    cols = [*features, target]
    fits = mo.fit_models(mo.moment_blocks(df, keys, cols), keys, cols, models)
    bad = sel.constraint_violations(mo.coefficient_rows(fits, keys), rules)
    bad = bad.where(F.col("severity") == "ERROR").select(*keys, "model_id").distinct().withColumn("__bad", F.lit(True))
    table = fits.select(*keys, "model_id", "n_features", "aic", "adj_r2", "converged").join(bad, [*keys, "model_id"], "left")
    table = table.withColumn("valid", F.col("converged") & F.col("__bad").isNull()).drop("__bad")
    chosen = best_model(table, keys, "aic", "valid", "converged", "model_id")
    blocks = bs.replicate_blocks(df, keys, order, cols, replicates, block_sizes=[block_size])
    reps = mo.fit_models(blocks, [*keys, "replicate"], cols, models)
    facts = reps.select(*keys, "replicate", "model_id", "aic", F.col("adj_r2").alias("r2"))
    stable = stb.block_stability(facts, [*keys, "model_id"])
    return chosen.join(stable, [*keys, "model_id"])
