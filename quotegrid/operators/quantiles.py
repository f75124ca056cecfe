"""Exact order statistics over raw rows without collecting a group in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer.
That is fine for a few hundred replicates; for raw rows with a hot key it is not.
Here one pass of a mergeable sketch brackets the wanted rank between two values of the
table, and a second pass counts the rows below the bracket and orders only those inside:
about ``4 / accuracy`` of a key's rows, however the values are distributed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotegrid.operators.subsets import beside, beside_hot


def _present(value: str) -> Column:
    """Missing values, NULL or NaN, take no part."""
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), accuracy: int = 20_000, few_keys: bool = False
) -> DataFrame:
    """Linearly interpolated quantiles: one row per key and probability (``q``, ``value``).

    ``few_keys``: the caller knows that the keys are a fixed few, so brackets are broadcast and no row is moved.

    The sketch's ranks are off by at most ``1 / accuracy`` of the rows; a bracket reaches that far and three rows
    on either side, in steps of powers of four. The smallest and largest value bracket the ends.
    """
    keys = list(keys)
    rows = df.where(_present(value)).select(*keys, F.col(value).cast("double").alias("__v"))
    reach = [2.0 / accuracy]
    while reach[-1] < 1:
        reach.append(reach[-1] * 4)
    cuts = sorted({c for p in probs for w in reach for c in (p - w, p + w) if 0 < c < 1}) or [0.5]
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__total"),
        F.min("__v").alias("__lo"),
        F.max("__v").alias("__hi"),
        F.percentile_approx("__v", F.array(*[F.lit(c) for c in cuts]), accuracy).alias("__cuts"),
    )
    if not keys:
        stats = stats.where(F.col("__total") > 0)

    def at(p: float, side: int, end: str) -> Column:
        out = F.col(end)
        for w in reversed(reach):
            c = p + side * w
            cut = F.get("__cuts", F.lit(cuts.index(c))) if 0 < c < 1 else F.col(end)
            out = F.when((w - 1.0 / accuracy) * F.col("__total") >= 3, cut).otherwise(out)
        return out

    targets = F.array(
        *[
            F.struct(F.lit(float(p)).alias("q"), at(p, -1, "__lo").alias("lo"), at(p, 1, "__hi").alias("hi"))
            for p in probs
        ]
    )
    # one row per key; a task neither sorts nor gathers the rows of a key
    brackets = stats.select(*keys, "__total", targets.alias("__t"))
    bracketed = beside(rows, F.broadcast(brackets), keys) if few_keys else beside_hot(rows, brackets, keys)
    # a row below a bracket only counts; partial sums leave one such row per task
    inside = bracketed.select(*keys, "__total", "__v", F.explode("__t").alias("t")).where(F.col("__v") <= F.col("t.hi"))
    counts = inside.groupBy(
        *keys, F.col("t.q").alias("q"), F.when(F.col("__v") >= F.col("t.lo"), F.col("__v")).alias("__v")
    ).agg(F.count(F.lit(1)).alias("__n"), F.max("__total").alias("__total"))
    rank = F.col("q") * (F.col("__total") - 1)
    upto = Window.partitionBy(*keys, "q").orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = counts.withColumn("__cum", F.sum("__n").over(upto)).withColumn("__rank", rank)
    holds = lambda pos: F.max(
        F.when((pos >= F.col("__cum") - F.col("__n")) & (pos < F.col("__cum")), F.col("__v"))
    )
    low, high = holds(F.floor("__rank")), holds(F.ceil("__rank"))
    fraction = F.max(F.col("__rank") - F.floor("__rank"))
    return found.groupBy(*keys, "q").agg((low + (high - low) * fraction).alias("value"))


def _slots(rows: DataFrame, cuts: str, buckets: int) -> DataFrame:
    """Adds ``__slot``: how many of the ``buckets - 1`` ascending cut points lie below the value, by bisection."""
    out = rows.withColumn("__slot", F.lit(0))
    step = buckets // 2
    while step:
        # each step reads the one before twice, so it is a column of its own
        out = out.withColumn(
            "__slot", F.col("__slot") + F.when(F.element_at(cuts, F.col("__slot") + step) < F.col("__v"), step).otherwise(0)
        )
        step //= 2
    return out


def ecdf_distance(
    df: DataFrame, value: str, in_first: str, keys: Sequence[str] = (), buckets: int = 256, leaf: int = 1 << 20
) -> DataFrame:
    """Largest distance between the two empirical distributions of ``value`` per key, exact.

    Columns ``distance``, ``n_first``, ``n_second``. ``buckets`` (a power of two) buckets of about equal numbers of rows,
    cut by a sketch of both samples, give the distance at every bucket's end and an upper bound inside. Only buckets whose
    bound exceeds the best end are opened, and are cut again in the same way until a bucket holds about ``leaf`` rows; then
    its values (repeated ones are one row) are put in order. Depths, not values, cut the buckets, so neither outliers nor
    modes far apart crowd rows into one.
    """
    if buckets & (buckets - 1) or buckets < 2:
        raise ValueError("buckets must be a power of two")
    keys = list(keys)
    rows = df.where(_present(value)).select(
        *keys, F.col(value).cast("double").alias("__v"), F.col(in_first).cast("int").alias("__a"), F.lit(0).cast("bigint").alias("__g")
    )
    n_first, n_second = F.sum("__a"), F.count(F.lit(1)) - F.sum("__a")
    totals = rows.groupBy(*keys).agg(n_first.alias("n_first"), n_second.alias("n_second")).where("n_first is not null")
    largest = totals.agg(F.max(F.col("n_first") + F.col("n_second"))).first()[0] or 0
    levels = 1
    while largest / buckets**levels > leaf:
        levels += 1
    groups, about = [*keys, "__g"], ["n_first", "n_second", "__sa", "__sb", "__best"]
    zero = F.lit(0).cast("bigint")
    known = totals.select(*keys, zero.alias("__g"), "n_first", "n_second", zero.alias("__sa"), zero.alias("__sb"), F.lit(-1.0).alias("__best"))
    counts = [n_first.alias("__ca"), n_second.alias("__cb")]
    distance = lambda a, b: F.abs(a / F.col("n_first") - b / F.col("n_second"))
    probs = [i / buckets for i in range(1, buckets)]
    found = []
    for _ in range(levels):
        cuts = rows.groupBy(*groups).agg(F.percentile_approx("__v", probs, F.lit(10 * buckets)).alias("__cuts"))
        placed = _slots(beside(rows, cuts, groups), "__cuts", buckets).drop("__cuts")
        # counts stay integers until the end: the order of partial sums cannot change the result
        hist = beside(placed.groupBy(*groups, "__slot").agg(*counts), known, groups)
        # at most ``buckets`` rows for each group
        ordered = Window.partitionBy(*groups).orderBy("__slot").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumns({"__ea": F.col("__sa") + F.sum("__ca").over(ordered), "__eb": F.col("__sb") + F.sum("__cb").over(ordered)})
        hist = hist.withColumns({"__sa": F.col("__ea") - F.col("__ca"), "__sb": F.col("__eb") - F.col("__cb"), "__d": distance(F.col("__ea"), F.col("__eb"))})
        whole = Window.partitionBy(*(keys or [F.lit(0)]))
        hist = hist.withColumn("__best", F.greatest("__best", F.max("__d").over(whole)))
        found.append(hist.select(*keys, "__d"))
        bound = F.greatest(distance(F.col("__ea"), F.col("__sb")), distance(F.col("__sa"), F.col("__eb")))
        opened = hist.where((bound > F.col("__best")) & (F.col("__ca") > 0) & (F.col("__cb") > 0)).select(*groups, "__slot", *about)
        deeper = (F.col("__g") * buckets + F.col("__slot")).alias("__g")
        rows = beside(placed, opened.select(*groups, "__slot"), [*groups, "__slot"]).select(*keys, "__v", "__a", deeper)
        known = opened.select(*keys, deeper, *about)
    values = beside(rows.groupBy(*groups, "__v").agg(*counts), known, groups)
    inside = Window.partitionBy(*groups).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    fine = values.select(*keys, distance(F.col("__sa") + F.sum("__ca").over(inside), F.col("__sb") + F.sum("__cb").over(inside)).alias("__d"))
    found.append(fine)
    top = reduce(DataFrame.unionByName, found).groupBy(*keys).agg(F.max("__d").alias("distance"))
    return beside(top, totals, keys)
