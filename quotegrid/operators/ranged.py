"""Windows over series that do not fit one task, keyed or not.

A window without keys, or with a key that holds most rows, is one task. Here rows get their exact position first (cut
points of the order column deal them into ranges, a range's rows count on from the ranges before it), and positions
deal them into blocks of bounded size. Running frames add what the earlier blocks hand on (one row a block), bounded
frames copy the rows at a block's ends to its neighbours. The result is that of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quotegrid.operators.moments import parallelism
from quotegrid.operators.subsets import beside

BLOCK = 1 << 16
RANGES = 64

Running = tuple[str, str]  # (kind, column); kinds: sum, count, min, max, last (not NULL)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int = RANGES, out: str = "pos") -> DataFrame:
    """One-based position of every row in its series by ``order``; NULLs first, ties broken by the later columns.

    The cut points are ``ranges - 1`` approximate quantiles of the first order column over all rows, fetched once so that
    both uses see the same ones. Rows that share a value of it stay in one range.
    """
    first = order[0]
    probs = [i / ranges for i in range(1, ranges)]
    row = df.where(F.col(first).isNotNull()).agg(F.percentile_approx(first, probs, F.lit(10 * ranges)).alias("cuts")).first()
    cuts = sorted(set(row["cuts"] or []))
    number = F.lit(0)
    for c in cuts:
        number = number + F.coalesce((F.col(first) > F.lit(c)).cast("int"), F.lit(0))
    placed = df.withColumn("__range", number)
    counts = placed.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*(list(keys) or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # at most ``ranges`` rows for each key
    before = counts.select(*keys, "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    before = _dealt(before, keys, "__range")
    inside = Window.partitionBy(*keys, "__range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    ranked = placed.withColumn("__at", F.row_number().over(inside))
    joined = beside(ranked, before, [*keys, "__range"])
    return joined.withColumn(out, F.col("__before") + F.col("__at")).drop("__range", "__before", "__at")


def _dealt(totals: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """A window without keys leaves its rows in one partition, into which a join would draw the other side."""
    return totals.repartition(parallelism(totals), *keys, part)


def running(
    df: DataFrame,
    aggregates: Mapping[str, Running],
    keys: Sequence[str],
    order: Sequence[str],
    include_current: bool = True,
    block: int = BLOCK,
    backwards: bool = False,
) -> DataFrame:
    """Running aggregates from the first row on (``backwards``: from the last); ``include_current`` False ends them a row earlier."""
    placed = positions(df, keys, order, out="__pos").withColumn("__block", F.floor((F.col("__pos") - 1) / block))
    direction = F.col("__pos").desc() if backwards else F.col("__pos").asc()
    inside = Window.partitionBy(*keys, "__block").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    along = F.col("__block").desc() if backwards else F.col("__block").asc()
    earlier = Window.partitionBy(*(list(keys) or [F.lit(0)])).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    # the value that the scan direction meets last in a block
    last = F.min_by if backwards else F.max_by
    totals, carried = [], []
    for name, (kind, c) in aggregates.items():
        whole = {
            "sum": F.sum(c), "count": F.count(c), "min": F.min(c), "max": F.max(c),
            "last": last(F.col(c), F.when(F.col(c).isNotNull(), F.col("__pos"))),
        }[kind]
        totals.append(whole.alias(f"__t_{name}"))
        over = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "last": lambda t: F.last(t, ignorenulls=True)}[kind]
        carried.append(over(F.col(f"__t_{name}")).over(earlier).alias(f"__c_{name}"))
    # a row for each block
    handed = _dealt(placed.groupBy(*keys, "__block").agg(*totals).select(*keys, "__block", *carried), keys, "__block")
    rows = beside(
        placed.withColumns(
            {
                f"__l_{name}": {
                    "sum": F.sum(c), "count": F.count(c), "min": F.min(c), "max": F.max(c), "last": F.last(c, ignorenulls=True),
                }[kind].over(inside)
                for name, (kind, c) in aggregates.items()
            }
        ),
        handed,
        [*keys, "__block"],
    )
    out = {}
    for name, (kind, _) in aggregates.items():
        here, there = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        out[name] = {
            "sum": F.when(here.isNull(), there).when(there.isNull(), here).otherwise(here + there),
            "count": F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0)),
            "min": F.least(here, there),
            "max": F.greatest(here, there),
            "last": F.coalesce(here, there),
        }[kind]
    return rows.withColumns(out).select(*df.columns, *aggregates)


def framed(
    df: DataFrame,
    columns: Mapping[str, Callable[[WindowSpec], Column]],
    keys: Sequence[str],
    order: Sequence[str],
    preceding: int,
    following: int = 0,
    block: int = BLOCK,
) -> DataFrame:
    """Window expressions over frames that reach at most ``preceding`` rows back and ``following`` ahead.

    Each entry gets the window of its block, ordered by position, and sets its own frame. A block is at least as long as
    the reach, so its rows need the ends of its direct neighbours only.
    """
    block = max(block, preceding, following, 1)
    at = (F.col("__pos") - 1) % block
    own = F.floor((F.col("__pos") - 1) / block)
    placed = positions(df, keys, order, out="__pos").withColumn("__own", own)
    copies = F.array_compact(
        F.array(
            F.col("__own"),
            F.when(at >= block - preceding, F.col("__own") + 1),
            F.when(at < following, F.col("__own") - 1),
        )
    )
    dealt = placed.withColumn("__block", F.explode(copies))
    window = Window.partitionBy(*keys, "__block").orderBy("__pos")
    done = dealt.withColumns({name: make(window) for name, make in columns.items()})
    return done.where(F.col("__block") == F.col("__own")).select(*df.columns, *columns)


# ---------------------------------------------------------------- operators on long series
def trailing_mean(df: DataFrame, c: str, keys: Sequence[str], order: Sequence[str], size: int, out: str, block: int = BLOCK) -> DataFrame:
    return framed(df, {out: lambda w: F.avg(c).over(w.rowsBetween(-(size - 1), 0))}, keys, order, size - 1, 0, block)


def forward_fill(df: DataFrame, c: str, keys: Sequence[str], order: Sequence[str], out: str, block: int = BLOCK) -> DataFrame:
    return running(df, {out: ("last", c)}, keys, order, block=block)


def drawdown(df: DataFrame, c: str, keys: Sequence[str], order: Sequence[str], out: str, block: int = BLOCK) -> DataFrame:
    """Running maximum (at least 0) of the earlier rows minus the current value."""
    rows = running(df, {"__peak": ("max", c)}, keys, order, include_current=False, block=block)
    return rows.withColumn(out, F.greatest(F.lit(0.0), F.coalesce("__peak", F.lit(0.0))) - F.col(c)).drop("__peak")


def longest_streak(df: DataFrame, flag: str, keys: Sequence[str], order: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Per series: rows, hits, hit share in percent, longest run of hits; runs are found by their count of misses before."""
    marked = df.select(*keys, *order, F.coalesce(F.col(flag), F.lit(False)).alias("__hit"))
    marked = marked.withColumn("__miss", F.when(~F.col("__hit"), 1))
    runs = running(marked, {"__run": ("count", "__miss")}, keys, order, block=block)
    per_run = runs.groupBy(*keys, "__run").agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col("__hit").cast("int")).alias("__hits"))
    out = per_run.groupBy(*keys).agg(
        F.sum("__n").alias("n_rows"), F.sum("__hits").alias("n_hits"), F.max("__hits").alias("longest_streak")
    )
    return out.where("n_rows is not null").withColumn("hit_pct", F.col("n_hits") / F.col("n_rows") * 100)


def average_rank(df: DataFrame, c: str, keys: Sequence[str] = (), descending: bool = False, out: str = "rank", block: int = BLOCK) -> DataFrame:
    """Rank with ties sharing the mean of their positions. Equal values are one row before anything is ordered."""
    values = df.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("__ties"))
    below = running(values, {"__below": ("sum", "__ties")}, keys, [c], include_current=False, block=block, backwards=descending)
    ranks = below.select(*keys, c, (F.coalesce("__below", F.lit(0)) + (F.col("__ties") + 1) / 2).alias(out))
    return beside(df, ranks, [*keys, c])


def step_up(df: DataFrame, p: str, keys: Sequence[str], tie: str, out: str, block: int = BLOCK) -> DataFrame:
    """Benjamini-Hochberg: the smallest p x n / rank of this row and all with larger p, at most 1."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__all"))
    placed = beside(positions(df, keys, [p, tie], out="__rank"), n, keys)
    raw = placed.withColumn("__raw", F.col(p) * F.col("__all") / F.col("__rank")).drop("__all", "__rank")
    done = running(raw, {"__least": ("min", "__raw")}, keys, [p, tie], block=block, backwards=True)
    return done.withColumn(out, F.least(F.lit(1.0), F.col("__least"))).drop("__raw", "__least")
