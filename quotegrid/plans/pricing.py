"""Bootstrap ensemble to scenario price table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

from quotegrid.functions.exprs import basis_points
from quotegrid.operators import bootstrap as bs
from quotegrid.operators import moments as mo
from quotegrid.operators import scenario as sc
from quotegrid.operators.reshape import melt
from quotegrid.operators.selection import LAG_ZERO_PATTERNS
from quotegrid.operators.topk import latest_row
from quotegrid.operators.windows import decay_weight


def reject_lag_zero(features: Sequence[str]) -> None:
    """Same-period competitor features are not allowed in a pricing model."""
    bad = [f for f in features if any(re.search(p, f.lower()) for p in LAG_ZERO_PATTERNS)]
    if bad:
        raise ValueError(f"same-period competitor features: {bad}")


def price_table(
    df: DataFrame,
    scenarios: DataFrame,
    keys: Sequence[str],
    order: str,
    target: str,
    features: Sequence[str],
    own: str,
    competitors: Sequence[str],
    replicates: int = 1000,
    alpha: float = 1.0,
    decay: float = 0.99,
    confidence: float = 0.95,
    packed: bool = False,
) -> DataFrame:
    """Intervals of dollars and percent change per scenario, joined on (basis points, range)."""
    cols = [*features, target]
    rows = df.withColumn("__w", decay_weight(decay, keys, order, 0)).select(*keys, order, *cols, "__w")
    if packed:
        ensemble = bs.packed_ridge_ensemble(rows, keys, order, target, features, replicates, alpha, weight="__w")
    else:
        blocks = bs.replicate_blocks(rows, keys, order, cols, replicates, weight="__w")
        ensemble = mo.ridge_fits(blocks, [*keys, "replicate"], cols, features, alpha)
    current = latest_row(df.select(*keys, order, *dict.fromkeys([*features, own, *competitors])), keys, order)
    facts = sc.price_scenarios(ensemble, current.drop(order), scenarios, keys, features, own, competitors)
    parts = []
    for value, out in (("dollars", "dollar"), ("pct_change", "pct_change")):
        ci = sc.scenario_intervals(facts, keys, value, confidence)
        ci = ci.withColumn("rate_change_in_basis_points", basis_points("scenario")).drop("scenario")
        parts.append(melt(ci, [*keys, "rate_change_in_basis_points"], ["bottom", "median", "top"], "range", out))
    return parts[0].join(parts[1], [*keys, "rate_change_in_basis_points", "range"])


__all__ = ["price_table", "reject_lag_zero"]
