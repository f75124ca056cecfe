"""Windows by ranges and blocks against plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quotegrid.operators import ranged, windows as win
from quotegrid.operators import selection as sel


@pytest.fixture(scope="module")
def series(spark):
    draw = random.Random(11)
    rows = []
    for k, n in (("hot", 900), ("a", 1), ("b", 40), (None, 25)):
        for i in range(n):
            v = None if draw.random() < 0.2 else draw.choice([1.0, 2.5, 2.5, -3.0, 7.25])
            rows.append((k, draw.randint(0, 60) if draw.random() < 0.97 else None, i, v, None if draw.random() < 0.05 else draw.random() < 0.7))
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t int, i int, v double, hit boolean").repartition(7).cache()


def same(a, b, digits=9):
    norm = lambda df: sorted([tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.collect()], key=repr)
    left, right = norm(a), norm(b)
    assert left == right


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("block", [3, 64, 100_000])
def test_running_and_framed_equal_plain_windows(series, keys, block):
    order = ["t", "i"] if keys else ["t", "i", "k"]
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    upto, before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    same(ranged.positions(series, keys, order, ranges=9), series.withColumn("pos", F.row_number().over(w)))
    same(
        ranged.running(series, {"s": ("sum", "v"), "n": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "l": ("last", "v")}, keys, order, block=block),
        series.withColumns({"s": F.sum("v").over(upto), "n": F.count("v").over(upto), "lo": F.min("v").over(upto), "hi": F.max("v").over(upto), "l": F.last("v", True).over(upto)}),
    )
    same(
        ranged.running(series, {"hi": ("max", "v"), "l": ("last", "v")}, keys, order, include_current=False, block=block),
        series.withColumns({"hi": F.max("v").over(before), "l": F.last("v", True).over(before)}),
    )
    same(
        ranged.running(series, {"lo": ("min", "v"), "l": ("last", "v")}, keys, order, block=block, backwards=True),
        series.withColumns({"lo": F.min("v").over(after), "l": F.first("v", True).over(after)}),
    )
    frames = {"m": lambda x: F.avg("v").over(x.rowsBetween(-4, 0)), "c": lambda x: F.sum("v").over(x.rowsBetween(-2, 3)), "p": lambda x: F.lag("v", 4).over(x)}
    same(ranged.framed(series, frames, keys, order, 4, 3, block), series.withColumns({n: f(w) for n, f in frames.items()}))


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_streaks_ranks_and_drawdown(series, keys):
    order = ["t", "i"] if keys else ["t", "i", "k"]
    clean = series.where("hit is not null and t is not null")
    one = clean.withColumn("o", F.struct(*order))
    same(ranged.longest_streak(clean, "hit", keys, order, block=10), win.longest_streak(one, "hit", keys, "o"))
    for down in (False, True):
        there = series.where("v is not null")
        same(
            ranged.average_rank(there, "v", keys, down, "r", block=2).select(*there.columns, "r"),
            there.withColumn("r", win.average_rank("v", keys, down)),
        )
    same(ranged.drawdown(one.where("v is not null"), "v", keys, order, "d", block=5), one.where("v is not null").withColumn("d", win.drawdown("v", keys, "o")))


def test_long_windows_use_several_tasks(spark):
    df = spark.range(20_000).select(F.col("id").alias("t"), (F.col("id") % 97).cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay as they were dealt
    try:
        for out in (
            ranged.trailing_mean(df, "v", [], ["t"], 13, "m", block=500),
            ranged.forward_fill(df, "v", [], ["t"], "m", block=500),
            ranged.average_rank(df, "t", out="m", block=500),
        ):
            tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert len(tasks) > 4 and max(tasks) < 10_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_series(spark):
    df = spark.createDataFrame([], "t int, v double, hit boolean")
    assert ranged.running(df, {"s": ("sum", "v")}, [], ["t"]).count() == 0
    assert ranged.framed(df, {"m": lambda w: F.avg("v").over(w.rowsBetween(-1, 0))}, [], ["t"], 1).count() == 0
    assert ranged.longest_streak(df, "hit", [], ["t"]).count() == 0


def test_step_up_without_keys_equals_one_key(spark):
    draw = random.Random(3)
    models = spark.createDataFrame([("p", f"m{i}", 100 + draw.choice([0.0, 1.0, 2.0, 9.0]) + draw.random()) for i in range(300)], "k string, model_id string, aic double")
    keyed = sel.benjamini_hochberg(models, keys=["k"]).select("model_id", "p_value", "fdr_corrected_p", "differs_from_best")
    same(sel.benjamini_hochberg(models).select(*keyed.columns), keyed)
