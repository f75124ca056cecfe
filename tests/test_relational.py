"""Hand-computed frames and pandas equivalence for filters, calendars, windows, ranks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quotegrid.functions import exprs as X
from quotegrid.operators import calendar as cal
from quotegrid.operators import features as ft
from quotegrid.operators import filters as flt
from quotegrid.operators import joins as jon
from quotegrid.operators import rates as rt
from quotegrid.operators import setops
from quotegrid.operators import topk
from quotegrid.operators import windows as win
from quotegrid.sources import scan
from quotegrid.workloads.catalog import QUERIES

D = dt.date
SLOW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_filters_raise_on_missing_column_and_empty_result(spark):
    df = spark.createDataFrame([(1, "a")], "id int, product string")
    with pytest.raises(ValueError):
        flt.equals(df, "absent", "a")
    with pytest.raises(ValueError):
        flt.require_non_empty(flt.equals(df, "product", "b"))
    with pytest.raises(ValueError):
        flt.within(df, "id", 5, 5)


def test_nan_becomes_null(spark):
    df = X.normalise_missing(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double"))
    assert df.where("x is null").count() == 2


def test_cap_keeps_null_and_fill_replaces_it(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 7.0), (3, None)], "id int, rate double")
    assert rows(flt.cap_at(df, "rate", 4.5), "id") == [(1, 3.0), (2, 4.5), (3, None)]
    assert rows(flt.cap_at(flt.fill_constant(df, "rate", 9.99), "rate", 4.5), "id")[2] == (3, 4.5)


def test_exclude_value_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "firm string")
    assert flt.exclude_value(df, "firm", "a").count() == 2


def test_name_normaliser_round_trip(spark):
    df = spark.createDataFrame([(1, 2, 3)], "competitor_mid_current int, own_rate_t3 int, x int")
    out = flt.normalise_names(df)
    assert out.columns == ["competitor_weighted_t0", "own_rate_t3", "x"]
    assert flt.normalise_names(out, reverse=True).columns == df.columns


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(X.half_even("x", 0)).collect()] == [0.0, 2.0, 2.0, 0.0]


def test_basis_points_truncate(spark):
    df = spark.createDataFrame([(0.259,), (-0.259,)], "r double")
    assert [r[0] for r in df.select(X.basis_points("r")).collect()] == [25, -25]
    assert df.select(X.basis_point_label(F.lit(25))).first()[0] == "25bps"


def test_require_columns_and_quote_contract(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), 1.0)], "date date, cap_rate double")
    with pytest.raises(ValueError):
        scan.load_quotes(df)
    with pytest.raises(ValueError):
        scan.require_columns(df, ["premium"])
    with pytest.raises(ValueError):
        scan.load_sales(df, {"premium": "absent"})


def test_week_key_is_the_sunday(spark):
    days = pd.date_range("2023-12-25", "2024-01-08")
    df = spark.createDataFrame([(d.date(),) for d in days], "d date").withColumn("w", X.week_ending_sunday("d"))
    want = {d.date(): (d + pd.Timedelta(days=6 - d.dayofweek)).date() for d in days}
    assert {r["d"]: r["w"] for r in df.collect()} == want


@SLOW
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 500)), min_size=1, max_size=30))
def test_gap_filled_daily_equals_pandas(spark, data):
    base = pd.Timestamp("2024-01-01")
    pdf = pd.DataFrame([(base + pd.Timedelta(days=d), float(v)) for d, v in data], columns=["d", "v"])
    want = pdf.set_index("d")["v"].resample("D").sum()
    smooth = want.rolling(14, min_periods=1).mean()
    df = spark.createDataFrame([(r.d.date(), r.v, "k") for r in pdf.itertuples()], "d date, v double, k string")
    got = cal.gap_filled_daily(df, "d", "v", ["k"]).orderBy("date").collect()
    assert [r["date"] for r in got] == [x.date() for x in want.index]
    assert np.allclose([r["sales"] for r in got], want.values)
    assert np.allclose([r["sales_smooth"] for r in got], smooth.values)


@SLOW
@given(st.lists(st.tuples(st.integers(0, 80), st.one_of(st.none(), st.integers(1, 50))), min_size=2, max_size=25, unique_by=lambda x: x[0]))
def test_weekly_equals_pandas(spark, data):
    base = pd.Timestamp("2024-01-01")
    s = pd.Series({base + pd.Timedelta(days=d): (np.nan if v is None else float(v)) for d, v in data}).sort_index()
    g = s.resample("W")
    df = spark.createDataFrame([(i.date(), None if np.isnan(v) else v) for i, v in s.items()], "date date, m double")
    df = df.withColumns({"t": F.col("m"), "l": F.col("m")})
    got = cal.weekly(df, {"m": "mean", "t": "sum", "l": "last"}).orderBy("date").toPandas()
    assert list(got["date"]) == [i.date() for i in g.mean().index]
    assert np.allclose(got["m"].astype(float), g.mean(), equal_nan=True)
    assert np.allclose(got["t"].astype(float), g.sum())
    assert np.allclose(got["l"].astype(float), g.last(), equal_nan=True)


def test_as_of_fill_carries_values_to_the_end(spark):
    df = spark.createDataFrame(
        [("a", D(2024, 1, 1), 1.0), ("a", D(2024, 1, 3), 2.0), ("b", D(2024, 1, 4), 5.0)], "c string, date date, r double"
    )
    got = rows(jon.as_of_daily(df, "r", ["c"]), "c", "date")
    assert got == [
        ("a", D(2024, 1, 1), 1.0), ("a", D(2024, 1, 2), 1.0), ("a", D(2024, 1, 3), 2.0), ("a", D(2024, 1, 4), 2.0), ("b", D(2024, 1, 4), 5.0),
    ]
    assert jon.as_of_daily(df, "r", ["c"], end="2024-01-06").count() == 6 + 3


@pytest.mark.parametrize("size", [2, 5])
def test_window_means_equal_pandas(spark, size):
    values = [1.0, None, 3.0, 4.0, None, 6.0, 7.5, 8.0]
    s = pd.Series(values, dtype=float)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = df.select(
        "i",
        win.trailing_mean("v", [], "i", size).alias("a"),
        win.trailing_mean_strict("v", [], "i", size).alias("b"),
        win.trailing_std("v", [], "i", size).alias("c"),
        win.centred_mean("v", [], "i", size).alias("d"),
        win.forward_fill("v", [], "i").alias("e"),
    ).orderBy("i").toPandas()
    want = {
        "a": s.rolling(size, min_periods=1).mean(), "b": s.rolling(size).mean(), "c": s.rolling(size, min_periods=1).std(),
        "d": s.rolling(size, min_periods=1, center=True).mean(), "e": s.ffill(),
    }
    for c, w in want.items():
        assert np.allclose(got[c].astype(float), w, equal_nan=True), c


def test_average_rank_equals_pandas(spark):
    v = [3.0, 1.0, 3.0, 2.0, 2.0, 2.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double")
    got = [r[0] for r in df.select("i", win.average_rank("v").alias("r")).orderBy("i").select("r").collect()]
    assert got == pd.Series(v).rank().tolist()


def test_lags_do_not_cross_the_cutoff(spark):
    df = spark.createDataFrame([(D(2024, 1, d), float(d)) for d in range(1, 7)], "date date, x double")
    out = win.split_lag_bank(df, [("x", "x", "backward")], 2, [], "date", "2024-01-04")
    assert [r["x_t1"] for r in out.orderBy("date").collect()] == [None, 1.0, 2.0, None, 4.0, 5.0]


def test_lag_bank_is_one_window(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), "k", 1.0, 2.0)], "date date, k string, x double, y double")
    out = win.lag_bank(df, [("x", "x", "both"), ("y", "y", "backward")], 18, ["k"], "date")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
    with pytest.raises(ValueError):
        win.lag_bank(df, [("z", "z", "backward")], 1, ["k"], "date", missing="raise")


def test_drawdown_and_streak(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 3.0, -2.0, 2.0, 4.0, 5.0])], "i int, e double")
    got = [r[0] for r in df.select("i", win.drawdown("e", [], "i").alias("d")).orderBy("i").select("d").collect()]
    assert got == [-1.0, -2.0, 5.0, 1.0, -1.0, -1.0]
    s = win.longest_streak(df.withColumn("hit", F.col("e") > 0), "hit", [], "i").first()
    assert (s["n_rows"], s["n_hits"], s["longest_streak"]) == (6, 5, 3)


def test_row_ranks(spark):
    df = spark.createDataFrame([(5.0, None, 1.0, 3.0)], "a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    r = rt.with_competitor_ranks(df, names).first()
    assert r["raw_median"] == 2.0 and r["top_3"] == 3.0 and r["top_5"] == 2.25
    assert (r["first_highest_benefit"], r["second_highest_benefit"], r["third_highest_benefit"]) == (5.0, 3.0, 1.0)
    assert df.select(rt.firm_level_strategy(names, "median", "skip")).first()[0] == 3.0
    assert df.select(rt.firm_level_strategy(names, "min")).first()[0] == 0.0
    with pytest.raises(ValueError):
        rt.competitor_ranks(["a"])


def test_weighted_means_and_dispatch(spark):
    df = spark.createDataFrame([(4.0, None, 0.5, 0.25)], "a double, b double, a_weight double, b_weight double")
    assert abs(df.select(rt.market_weighted_mean(["a", "b"])).first()[0] - 2.0 / (0.75 + 1e-8)) < 1e-12
    assert df.select(rt.weighted_mean_excluding(["a", "b"], ["b"])).first()[0] == 2.0 / 0.75
    assert df.select(rt.weighted_strategy(["a", "b"], {})).first()[0] == 2.0
    assert [rt.strategy_for(p)[0] for p in ("rila", "FIA", "myga")] == ["weighted", "top_n", "firm_level"]
    with pytest.raises(ValueError):
        rt.strategy_for("other")


def test_dedup_keeps_highest_then_lowest_id(spark):
    df = spark.createDataFrame([("k", 1.0, 5), ("k", 3.0, 9), ("k", 3.0, 2), ("l", None, 1)], "k string, rate double, id int")
    assert rows(rt.keep_highest(df, ["k"], "rate", "id"), "k") == [("k", 3.0, 2), ("l", None, 1)]
    assert rows(rt.keep_highest(df.select("k", "rate"), ["k"], "rate"), "k") == [("k", 3.0), ("l", None)]


@SLOW
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=40))
def test_pareto_equals_brute_force(spark, pts):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id int, x double, y double")
    got = sorted(r["id"] for r in topk.pareto_frontier(df, "x", "y", ranges=4).collect())
    want = [
        i for i, (x, y) in enumerate(pts)
        if not any((a <= x and b >= y) and (a < x or b > y) for a, b in pts)
    ]
    assert got == want


def test_best_model_falls_back(spark):
    df = spark.createDataFrame(
        [("p", "m1", 1.0, False, True), ("p", "m2", 2.0, True, True), ("q", "m1", 1.0, False, True), ("q", "m2", 0.5, False, False)],
        "k string, model string, aic double, valid boolean, converged boolean",
    )
    got = {r["k"]: (r["model"], r["note"]) for r in topk.best_model(df, ["k"], "aic", "valid", "converged", "model").collect()}
    assert got["p"] == ("m2", None)
    assert got["q"][0] == "m1" and got["q"][1]


def test_jaccard_and_union(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c", "d"])], "x array<string>, y array<string>")
    o = setops.set_overlap("x", "y")
    r = df.select(*[c.alias(n) for n, c in o.items()]).first()
    assert (r["jaccard"], r["common"], r["only_a"], r["only_b"]) == (0.25, ["b"], ["a"], ["c", "d"])
    u = setops.union_all([df.select("x"), df.select("y")])
    assert u.columns == ["x", "y"] and u.count() == 2


def test_kink_is_zero_below_competitor(spark):
    df = spark.createDataFrame([(3.0, 2.0), (1.0, 2.0)], "own_current double, comp_t2 double")
    out = ft.kink_features(df, "own", "comp", 1)
    assert [r["pos_lag_0"] for r in out.orderBy("own_current").collect()] == [0.0, 2.0]


def test_polynomials_need_their_inputs(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a_current double, b_current double")
    out = ft.polynomial_bank(df, ["a", "b"], 1)
    assert out.first()["derived_a_b_interaction_current"] == 6.0 and "derived_a_squared_t1" not in out.columns
    with pytest.raises(ValueError):
        ft.polynomial_bank(df, ["a", "b"], 1, missing="raise")


def test_transform_domains_and_log_targets(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,), (4.0,), (None,)], "x double")
    got = [r[0] for r in df.select(X.transformed("x", "sqrt")).collect()]
    assert got == [None, 0.0, 2.0, None]
    assert df.agg(X.domain_violations("x", "log")).first()[0] == 2
    t = spark.createDataFrame([(0.0, 5.0)], "sales_target_t1 double, other double")
    assert tuple(ft.log_targets(t).first()) == (0.0, 5.0)


def test_momentum_and_stability_ranks(spark):
    from quotegrid.operators import scenario, stability

    m = spark.createDataFrame([(1.0, 2.0, 6.0)], "a double, b double, c double")
    assert scenario.current_momentum(m, [], ["a", "b", "c"]).first()["momentum"] == 3.0
    s = spark.createDataFrame([("m1", 80.0, 10.0), ("m2", 80.0, 12.0), ("m3", 20.0, 11.0)], "m string, st double, aic double")
    r = {x["m"]: (x["stability_rank"], x["aic_rank"], x["combined_rank"]) for x in stability.stability_ranks(s, [], "st", "aic").collect()}
    assert r == {"m1": (1.5, 1.0, 1.25), "m2": (1.5, 3.0, 2.25), "m3": (3.0, 2.0, 2.5)}


def test_day_differences_are_dealt_out_by_size(spark, tmp_path, monkeypatch):
    days = spark.range(3000).select(F.col("id").alias("o_orderkey"), F.lit(dt.date(2024, 1, 1)).alias("o_orderdate"))
    days.union(days.limit(1)).union(spark.sql("select cast(null as bigint), date'2024-01-01'")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(9000).select(
        (F.col("id") % 3000).alias("l_orderkey"), (F.col("id") % 3).cast("int").alias("l_linenumber"), F.lit(dt.date(2024, 1, 8)).alias("l_shipdate")
    )
    lines.union(spark.sql("select cast(null as bigint), 1, date'2024-01-08'")).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {}
    for most in (1 << 19, 500):
        monkeypatch.setattr(jon, "ROWS_A_TASK", most)
        out = QUERIES["flt13_day_difference"](spark, str(tmp_path)).withColumn("p", F.spark_partition_id()).collect()
        got[most] = sorted((r["l_orderkey"], r["l_linenumber"], r["processing_days"], r["n"]) for r in out)
        if most == 500:
            tasks = [r["p"] for r in out]
            assert len(set(tasks)) > 16 and max(map(tasks.count, set(tasks))) <= 500
    assert got[500] == got[1 << 19] and sum(r[3] for r in got[500]) == 9003 and {r[2] for r in got[500]} == {7}
