"""Estimation against NumPy, resampling paths against each other, tails against the JVM library."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotegrid.functions import distributions as D
from quotegrid.functions import exprs as X
from quotegrid.functions import linear
from quotegrid.operators import bootstrap as bs
from quotegrid.operators import diagnostics as dg
from quotegrid.operators import forecast as fc
from quotegrid.operators import moments as mo
from quotegrid.operators import subsets as sub
from quotegrid.operators import selection as sel
from quotegrid.operators import stability as stb
from quotegrid.operators.quantiles import ecdf_distance, exact_quantiles

FEATS = ["x1", "x2", "x3", "x4"]


@pytest.fixture(scope="module")
def panel(spark):
    """Two series with a known linear law; deterministic."""
    rng = np.random.default_rng(42)
    data = []
    for key, n in (("a", 90), ("b", 61)):
        x = rng.normal(size=(n, 4)) + 3
        y = 2 + x @ np.array([1.5, -0.7, 0.0, 0.3]) + rng.normal(scale=0.5, size=n)
        data += [(key, i, *map(float, x[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(data, "k string, t int, x1 double, x2 double, x3 double, x4 double, y double")
    arrays = {k: np.array([r[2:] for r in data if r[0] == k]) for k in ("a", "b")}
    return df.cache(), arrays


def lstsq(z, idx):
    a = np.column_stack([np.ones(len(z)), z[:, idx]])
    b, *_ = np.linalg.lstsq(a, z[:, -1], rcond=None)
    ssr = float(np.sum((z[:, -1] - a @ b) ** 2))
    n, k = a.shape
    cov = ssr / (n - k) * np.linalg.inv(a.T @ a)
    return b, np.sqrt(np.diag(cov)), n * (np.log(2 * np.pi) + np.log(ssr / n) + 1) + 2 * k


def test_all_subsets_equal_least_squares(panel):
    df, arrays = panel
    models = mo.all_subsets(["x1"], FEATS, 3)
    assert len(models) == 7 and all(m[1][0] == "x1" for m in models)
    fits = mo.fit_models(mo.moment_blocks(df, ["k"], [*FEATS, "y"]), ["k"], [*FEATS, "y"], models).collect()
    assert len(fits) == 14
    for r in fits:
        b, se, aic = lstsq(arrays[r["k"]], [FEATS.index(f) for f in r["terms"][1:]])
        assert np.allclose(r["coef"], b, atol=1e-8) and np.allclose(r["se"], se, atol=1e-8)
        assert abs(r["aic"] - aic) < 1e-7


def test_listwise_deletion_per_subset(panel):
    df, arrays = panel
    holed = df.withColumn("x2", F.when(F.col("t") % 5 != 0, F.col("x2"))).withColumn(
        "x3", F.when(F.col("t") % 7 != 0, F.col("x3")).otherwise(float("nan"))
    )
    for r in sub.fit_subsets(holed, ["k"], "y", FEATS, 2, per_range=3).collect():
        z = arrays[r["k"]]
        t = np.arange(len(z))
        keep = np.ones(len(z), bool)
        if "x2" in r["model_id"]:
            keep &= t % 5 != 0
        if "x3" in r["model_id"]:
            keep &= t % 7 != 0
        b, _, aic = lstsq(z[keep], [FEATS.index(f) for f in r["terms"][1:]])
        assert r["n_obs"] == keep.sum() and np.allclose(r["coef"], b, atol=1e-8) and abs(r["aic"] - aic) < 1e-7


def test_collinear_model_does_not_converge(panel):
    df, _ = panel
    twin = df.withColumn("x5", F.col("x1") * 2 + 1)
    cols = ["x1", "x5", "y"]
    r = mo.fit_models(mo.moment_blocks(twin, ["k"], cols), ["k"], cols, [("m", ["x1", "x5"])]).collect()
    assert not any(x["converged"] for x in r) and all(x["aic"] is None for x in r)


def test_weighted_fit_equals_numpy(panel):
    df, arrays = panel
    rows = df.withColumn("w", F.pow(F.lit(0.97), F.col("t").cast("double")))
    cols = ["x1", "x2", "y"]
    blocks = mo.weighted_blocks(mo.centre(rows.select("k", "w", *cols), ["k"], cols), ["k"], cols, weight="w")
    for r in mo.fit_models(blocks, ["k"], cols, [("m", ["x1", "x2"])]).collect():
        z = arrays[r["k"]]
        w = 0.97 ** np.arange(len(z))
        a = np.column_stack([np.ones(len(z)), z[:, :2]])
        b = np.linalg.solve(a.T @ (w[:, None] * a), a.T @ (w * z[:, -1]))
        ssr = np.sum(w * (z[:, -1] - a @ b) ** 2)
        n = len(z)
        se = np.sqrt(np.diag(ssr / (n - 3) * np.linalg.inv(a.T @ (w[:, None] * a))))
        assert np.allclose(r["coef"], b, atol=1e-8) and np.allclose(r["se"], se, atol=1e-8)
        assert abs(r["aic"] - (n * (np.log(2 * np.pi) + np.log(ssr / n) + 1) + 6 - np.log(w).sum())) < 1e-6


def test_non_negative_ridge_satisfies_optimality():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(80, 5))
    z[:, -1] = z[:, 0] - z[:, 1] + 0.2 * z[:, 2] + rng.normal(size=80)
    mean, cov = z.mean(0), np.cov(z.T, bias=True)
    coef = linear.ridge(np.array([80.0]), mean[None], cov[None], range(4), 1.0, positive=True)[0]
    beta = coef[1:]
    grad = 80 * (cov[:4, :4] @ beta - cov[:4, 4]) + beta
    assert (beta >= 0).all() and np.all(np.abs(grad[beta > 0]) < 1e-8) and np.all(grad[beta == 0] > -1e-8)


def test_packed_and_joined_ensembles_agree(panel):
    df, _ = panel
    feats, cols = ["x1", "x2"], ["x1", "x2", "y"]
    packed = bs.packed_ridge_ensemble(df, ["k"], "t", "y", feats, 23, 0.5, chunk=7)
    joined = mo.ridge_fits(bs.replicate_blocks(df, ["k"], "t", cols, 23), ["k", "replicate"], cols, feats, 0.5)
    a = {(r["k"], r["replicate"]): r["coef"] for r in packed.collect()}
    b = {(r["k"], r["replicate"]): r["coef"] for r in joined.collect()}
    assert a.keys() == b.keys() and len(a) == 46
    assert max(np.max(np.abs(np.array(a[k]) - np.array(b[k]))) for k in a) < 1e-9


def test_both_ensembles_give_the_same_replicates(panel):
    df, _ = panel
    args = (["k"], "t", "y", ["x1", "x2"], 9, 0.5)
    whole = {(r["k"], r["replicate"]): r["coef"] for r in bs.packed_ridge_ensemble(df, *args).collect()}
    mixed = {(r["k"], r["replicate"]): r["coef"] for r in bs.joined_ridge_ensemble(df, *args).collect()}
    assert whole.keys() == mixed.keys() and len(whole) == 18
    assert max(np.max(np.abs(np.array(whole[k]) - np.array(mixed[k]))) for k in whole) < 1e-9


def test_ensemble_without_keys(panel):
    df, _ = panel
    out = bs.packed_ridge_ensemble(df.where("k = 'a'"), [], "t", "y", ["x1"], 4, 0.5)
    assert out.columns == ["replicate", "coef"] and out.count() == 4


def test_draws_are_whole_and_reproducible(spark, panel):
    reps = np.arange(1, 11)
    for n in (90, 61, 5000):
        assert (bs.draw_counts(n, reps).sum(axis=1) == n).all() and (bs.draw_counts(n, reps) == bs.draw_counts(n, reps)).all()
        for size, overlap in ((4, True), (7, True), (6, False), (100, True) if n > 100 else (1, True)):
            assert (bs.block_draws(n, reps, size, overlap).sum(axis=1) == n).all()
    # the arrays repeat the column recipe
    drawn = X.with_draw(spark.range(1, 91).withColumn("r", F.lit(7)), "id", "r", "u").select("id", "u", X.poisson_one("u").alias("c")).collect()
    assert np.bincount([r["u"] % 90 for r in drawn], minlength=90).tolist() == bs.draw_counts(90, np.array([7]))[0].tolist()
    assert [r["c"] for r in drawn] == bs.poisson_counts(np.arange(1, 91), np.array([7]))[0].tolist()


def test_no_two_block_sizes_share_a_seed():
    starts = lambda r, b: bs.block_draws(4000, np.array([r]), b)[0].tobytes()
    assert len({starts(r, b) for r in range(1, 60) for b in (2, 64, 128)}) == 59 * 3


def test_replicate_blocks_of_long_series_use_small_chunks(panel, monkeypatch):
    df, arrays = panel
    rows = df.withColumn("w", F.lit(0.5) + F.col("t") / 100)
    whole = bs.replicate_blocks(rows, ["k"], "t", ["x1", "y"], 9, weight="w")
    monkeypatch.setattr(bs, "DRAWN", 200)
    small = bs.replicate_blocks(rows, ["k"], "t", ["x1", "y"], 9, weight="w")
    by = lambda d: {(r["k"], r["replicate"]): (r["n"], r["sw"], r["slw"], *r["mean"], *r["cov"]) for r in d.collect()}
    a, b = by(whole), by(small)
    assert a.keys() == b.keys() and len(a) == 18 and all(np.allclose(a[k], b[k]) for k in a)
    z = arrays["a"]
    c = bs.draw_counts(90, np.array([3]))[0]
    w = c * (0.5 + np.arange(90) / 100)
    mean = np.average(z[:, [0, 4]], axis=0, weights=w)
    assert np.allclose(a["a", 3][:5], [90, w.sum(), (c * np.log(0.5 + np.arange(90) / 100)).sum(), *mean])


def test_poisson_counts_have_mean_and_variance_one(spark):
    d = X.with_draw(spark.range(1, 20001), "id", F.lit(3), "u").select(X.poisson_one("u").alias("c"))
    r = d.agg(F.avg("c"), F.var_pop("c")).first()
    assert abs(r[0] - 1) < 0.03 and abs(r[1] - 1) < 0.05


def test_bootstrap_interval_covers_the_true_slope(panel):
    df, _ = panel
    e = bs.packed_ridge_ensemble(df, ["k"], "t", "y", FEATS, 400, 0.01)
    q = e.groupBy("k").agg(F.percentile(F.col("coef")[1], F.array(F.lit(0.005), F.lit(0.995))).alias("q")).collect()
    assert all(r["q"][0] < 1.5 < r["q"][1] for r in q)


def test_rolling_origin_equals_refits(panel):
    df, arrays = panel
    pos = df.withColumn("y", F.exp(F.col("y") / 10))
    got = fc.rolling_origin(pos, ["k"], "t", "y", ["x1", "x2"], alpha=0.7, decay=0.95, min_train=40).collect()
    assert len(got) == 50 + 21
    for r in got[::9]:
        z = arrays[r["k"]]
        m = r["t"]
        w = 0.95 ** np.arange(m - 1, -1, -1)
        x, ly = z[:m, :2], z[:m, -1] / 10
        mx, my = np.average(x, axis=0, weights=w), np.average(ly, weights=w)
        s = (x - mx).T @ (w[:, None] * (x - mx)) + 0.7 * np.eye(2)
        beta = np.linalg.solve(s, (x - mx).T @ (w * (ly - my)))
        assert abs(r["y_predict"] - np.exp(my + beta @ (z[m, :2] - mx))) < 1e-8


def test_ridge_cv_equals_manual_folds(panel):
    df, arrays = panel
    out = sub.ridge_cv_subsets(df, ["k"], "t", "y", FEATS, 4, [0.1, 5.0], folds=4).where("n_features = 4").collect()
    for r in out:
        z = arrays[r["k"]]
        folds = np.array_split(np.arange(len(z)), 4)
        table = []
        for alpha in (0.1, 5.0):
            scores = []
            for f in folds:
                tr = np.setdiff1d(np.arange(len(z)), f)
                mx, my = z[tr, :4].mean(0), z[tr, 4].mean()
                b = np.linalg.solve((z[tr, :4] - mx).T @ (z[tr, :4] - mx) + alpha * np.eye(4), (z[tr, :4] - mx).T @ (z[tr, 4] - my))
                p = my + (z[f, :4] - mx) @ b
                scores.append(1 - np.sum((z[f, 4] - p) ** 2) / np.sum((z[f, 4] - z[f, 4].mean()) ** 2))
            table.append(scores)
        best = int(np.argmax(np.mean(table, axis=1)))
        assert r["best_alpha"] == (0.1, 5.0)[best] and abs(r["cv_mean"] - np.mean(table[best])) < 1e-9


def test_vif_equals_inverse_correlation(panel):
    df, arrays = panel
    got = {(r["k"], r["feature"]): r["vif"] for r in dg.variance_inflation(df, ["k"], FEATS).collect()}
    for k, z in arrays.items():
        want = np.diag(np.linalg.inv(np.corrcoef(z[:, :4].T)))
        assert np.allclose([got[k, f] for f in FEATS], want)


def test_quantiles_of_skewed_data_with_a_hot_key(spark):
    rng = np.random.default_rng(3)
    hot, cold = np.exp(rng.normal(scale=4, size=4000)), rng.integers(0, 5, size=37).astype(float)
    df = spark.createDataFrame(
        [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold] + [("one", 2.0), ("none", None)], "k string, v double"
    )
    probs = [0.0, 0.025, 0.5, 0.99, 1.0]
    got = {(r["k"], r["q"]): r["value"] for r in exact_quantiles(df, "v", probs, ["k"], accuracy=200).collect()}
    for k, v in (("hot", hot), ("cold", cold), ("one", np.array([2.0]))):
        assert np.allclose([got[k, p] for p in probs], np.quantile(v, probs), rtol=1e-12)
    assert ("none", 0.5) not in got
    whole = exact_quantiles(df, "v", [0.5]).first()["value"]
    assert np.isclose(whole, np.quantile(np.concatenate([hot, cold, [2.0]]), 0.5))


def test_ecdf_distance_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    data = []
    for k, scale in (("wide", 5.0), ("ties", 0.0)):
        a = np.round(np.exp(rng.normal(scale=scale, size=500)) if scale else rng.integers(0, 4, 500), 3)
        b = np.round(np.exp(rng.normal(0.4, scale, size=333)) if scale else rng.integers(1, 5, 333), 3)
        data += [(k, float(v), True) for v in a] + [(k, float(v), False) for v in b]
    got = {r["k"]: r["distance"] for r in ecdf_distance(spark.createDataFrame(data, "k string, v double, f boolean"), "v", "f", ["k"], 16).collect()}
    for k in got:
        a = np.sort([v for kk, v, f in data if kk == k and f])
        b = np.sort([v for kk, v, f in data if kk == k and not f])
        pts = np.concatenate([a, b])
        d = np.abs(np.searchsorted(a, pts, "right") / len(a) - np.searchsorted(b, pts, "right") / len(b)).max()
        assert abs(got[k] - d) < 1e-12


def test_tails_equal_the_jvm_library(spark):
    lib = spark._jvm.org.apache.commons.math3.distribution
    for df_ in (1, 2, 5, 10):
        chi = lib.ChiSquaredDistribution(float(df_))
        for x in (0.1, 1.0, 3.84, 12.0):
            got = spark.range(1).select(D.chi2_sf(F.lit(x), df_)).first()[0]
            assert abs(got - (1 - chi.cumulativeProbability(x))) < 1e-9
    for df_ in (3, 28, 330):
        t = lib.TDistribution(float(df_))
        assert abs(D.t_quantile(0.975, np.array([df_]))[0] - t.inverseCumulativeProbability(0.975)) < 1e-7
        assert abs(D.t_two_sided_p(np.array([1.7]), np.array([df_]))[0] - 2 * (1 - t.cumulativeProbability(1.7))) < 1e-9
    assert abs(D.f_sf(np.array([2.5]), np.array([3.0]), np.array([40.0]))[0] - (1 - lib.FDistribution(3.0, 40.0).cumulativeProbability(2.5))) < 1e-9
    assert abs(D.chi2_one_quantile(0.95) - 3.841458820694124) < 1e-9


def test_sign_rules(spark):
    co = spark.createDataFrame(
        [("m1", "own_rate", 0.5, 0.1, 50, 1), ("m2", "own_rate", 0.1, 0.5, 50, 1), ("m3", "competitor_weighted", -0.4, None, 50, 1), ("m4", "competitor_weighted", 0.4, None, 50, 1)],
        "model_id string, term string, coef double, se double, n_obs bigint, n_features int",
    )
    rules = [("own", "positive", True), ("competitor", "negative", False)]
    v = {r["model_id"]: r["severity"] for r in sel.constraint_violations(co, rules).collect()}
    assert v == {"m2": "ERROR", "m4": "WARNING"}
    assert {r["model_id"] for r in sel.drop_violating(co, sel.constraint_violations(co, rules), []).collect()} == {"m1", "m3", "m4"}


def test_name_patterns(spark):
    df = spark.createDataFrame([("own_rate_t0",), ("competitor_weighted_t2",), ("dgs5",), ("C_lag_0",), ("C_lag0_x",), ("other",)], "f string")
    s = sel.expected_sign("f")
    got = {r[0]: (r[1], r[2]) for r in df.select("f", s["expected_sign"], sel.is_lag_zero("f")).collect()}
    assert got["own_rate_t0"] == ("positive", False) and got["competitor_weighted_t2"] == ("negative", False)
    assert got["dgs5"][0] == "context_dependent" and got["other"] == (None, False)
    assert got["C_lag_0"][1] and not got["C_lag0_x"][1]


def test_levene_and_t_test(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 9.0], [2.0, 2.5, 3.0, 3.5]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double").withColumn("k", F.lit("k"))
    r = dg.levene(df, ["k"], "g", "v").first()
    z = [np.abs(np.array(x) - np.median(x)) for x in (a, b)]
    n, grand = 9, np.mean(np.concatenate(z))
    want = (n - 2) * sum(len(q) * (q.mean() - grand) ** 2 for q in z) / sum(((q - q.mean()) ** 2).sum() for q in z)
    assert abs(r["levene"] - want) < 1e-10 and 0 < r["p_value"] < 1
    t = dg.mean_t_test(df.where("g = 'a'"), ["k"], "v").first()
    assert abs(t["t_statistic"] - np.mean(a) / (np.std(a, ddof=1) / np.sqrt(5))) < 1e-12


# ---------------------------------------------------------------- values that used to go wrong
def test_means_and_sums_do_not_round_their_input(spark):
    from quotegrid.operators import calendar, rates

    df = spark.createDataFrame([("a", "2024-01-01", 4.125)] * 2 + [("b", "2024-01-01", 0.0004)] * 1000, "k string, d string, v double")
    mean = {r["k"]: r["v"] for r in rates.daily_company_mean(df, "k", "d", "v").collect()}
    assert mean["a"] == 4.125 and abs(mean["b"] - 0.0004) < 1e-15
    total = {r["k"]: r["sales"] for r in calendar.gap_filled_daily(df, "d", "v", keys=["k"]).collect()}
    assert total["a"] == 8.25 and abs(total["b"] - 0.4) < 1e-12


def test_decayed_origins_of_a_long_series(spark):
    n = 50_000
    df = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("t"), F.sin(F.col("id") / 7).alias("x"), F.cos(F.col("id") / 5).alias("y"))
    got = mo.prefix_blocks(df, ["k"], "t", ["x", "y"], 0.7).where("t in (1, 2, 600, 643, 644, 645, 1288, 1289, 3000, 49999)").collect()
    assert len(got) == 10
    x, y = np.sin(np.arange(n) / 7), np.cos(np.arange(n) / 5)
    for r in got:
        w = 0.7 ** np.arange(r["t"] - 1, -1, -1.0)
        mx, my = (w * x[: r["t"]]).sum() / w.sum(), (w * y[: r["t"]]).sum() / w.sum()
        assert np.isclose(r["sw"], w.sum()) and np.allclose(r["mean"], [mx, my])
        assert np.isclose(r["cov"][1], (w * x[: r["t"]] * y[: r["t"]]).sum() / w.sum() - mx * my)


def test_failed_replicates_do_not_win(spark):
    facts = spark.createDataFrame([("m1", 0, 1, 10.0), ("m2", 1, 1, None), ("m1", 0, 2, 9.0), ("m2", 1, 2, 8.0)], "model string, i int, replicate int, aic double")
    got = {r["model"]: (r["win_count"], r["n_replicates"]) for r in stb.win_rates(facts, [], "model", "i").collect()}
    assert got == {"m1": (1, 2), "m2": (1, 1)}


def test_quantiles_skip_nan_and_bear_outliers(spark):
    nan = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (3.0,), (None,)], "v double")
    assert exact_quantiles(nan, "v", [0.5]).first()["value"] == 2.0
    far = spark.range(1000).select(F.when(F.col("id") == 7, 1e15).otherwise(F.col("id") % 300).cast("double").alias("v"), (F.col("id") % 3 == 0).alias("f"))
    values = np.array([r["v"] for r in far.collect()])
    for p in (0.0, 0.1, 0.5, 0.999, 1.0):
        assert np.isclose(exact_quantiles(far, "v", [p], accuracy=100).first()["value"], np.quantile(values, p))
    first = np.array([r["f"] for r in far.collect()])
    a, b = np.sort(values[first]), np.sort(values[~first])
    d = np.abs(np.searchsorted(a, values, "right") / len(a) - np.searchsorted(b, values, "right") / len(b)).max()
    assert abs(ecdf_distance(far, "v", "f", [], 32).first()["distance"] - d) < 1e-12


def test_far_t_quantiles_are_not_cut():
    from quotegrid.functions.distributions import t_quantile

    got = t_quantile(1 - 1e-5, np.array([1.0]))[0]
    assert abs(got / np.tan(np.pi * (0.5 - 1e-5)) - 1) < 1e-6


def test_bootstrapped_forecast_of_every_origin(spark):
    rows = [("a", i, float(i % 7), 2.0 + 0.5 * (i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, t int, x double, y double")
    got = fc.origin_ensemble(df, ["k"], "t", "y", ["x"], 5, 0.001, min_train=30).collect()
    assert {r["t"] for r in got} == set(range(30, 60)) and len(got) == 150
    assert all(abs(r["prediction"] - (2.0 + 0.5 * (r["t"] % 7))) < 0.05 for r in got)


def ks_brute(a, b):
    at = np.unique(np.concatenate((a, b)))
    return np.abs(np.searchsorted(np.sort(a), at, side="right") / len(a) - np.searchsorted(np.sort(b), at, side="right") / len(b)).max()


@pytest.mark.parametrize("leaf", [5, 200, 1 << 20])
def test_ecdf_distance_of_far_modes_and_ties(spark, leaf):
    draw = np.random.default_rng(8)
    a = np.concatenate((draw.standard_normal(1500), 1e9 + draw.standard_normal(1500) * 1e-3, np.full(400, 7.0)))
    b = np.concatenate((draw.standard_normal(1500) + 0.1, 1e9 + draw.standard_normal(1500) * 1e-3 + 5e-4, np.full(300, 7.0)))
    far = [("x", float(v), True) for v in a] + [("x", float(v), False) for v in b]
    same = [("s", float(v), f) for v in a[:100] for f in (True, False)]
    one = [(None, 1.0, True), (None, 2.0, False), ("t", 3.0, True), ("t", 3.0, False)]
    df = spark.createDataFrame(far + same + one, "k string, v double, f boolean")
    got = {r["k"]: r["distance"] for r in ecdf_distance(df, "v", "f", ["k"], 16, leaf).collect()}
    assert abs(got["x"] - ks_brute(a, b)) < 1e-12 and got["s"] == 0 and got["t"] == 0 and got[None] == 1
    whole = ecdf_distance(df.where("k = 'x'"), "v", "f", [], 64, leaf).first()
    assert abs(whole["distance"] - ks_brute(a, b)) < 1e-12 and (whole["n_first"], whole["n_second"]) == (3400, 3300)


def test_buckets_hold_a_bounded_share_of_far_modes(spark):
    from quotegrid.operators.quantiles import _slots

    draw = np.random.default_rng(4)
    v = np.concatenate((draw.standard_normal(20_000), 1e9 + draw.standard_normal(20_000) * 1e-6))
    rows = spark.createDataFrame([(float(x),) for x in v], "__v double")
    cuts = rows.agg(F.percentile_approx("__v", [i / 64 for i in range(1, 64)], F.lit(640)).alias("cuts"))
    sizes = [r["count"] for r in _slots(rows.crossJoin(F.broadcast(cuts)), "cuts", 64).groupBy("__slot").count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) < 40_000 / 64 * 2


def test_origin_ensemble_equals_fits_of_every_origin(panel):
    df, arrays = panel
    got = {(r["k"], r["t"], r["replicate"]): r["prediction"] for r in fc.origin_ensemble(df, ["k"], "t", "y", ["x1", "x2"], 7, 0.5, 0.9, 40, chunk=3).collect()}
    assert len(got) == 7 * (90 - 40 + 61 - 40)
    for k, z in arrays.items():
        counts = bs.poisson_counts(np.arange(1, len(z) + 1), np.arange(1, 8))
        for t in range(40, len(z), 9):
            for r in range(7):
                w = counts[r, :t] * 0.9 ** np.arange(t - 1, -1, -1)
                x, y = z[:t, :2], z[:t, 4]
                mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
                beta = np.linalg.solve((x - mx).T @ (w[:, None] * (x - mx)) + 0.5 * np.eye(2), (x - mx).T @ (w * (y - my)))
                assert abs(got[k, t, r + 1] - (my + (z[t, :2] - mx) @ beta)) < 1e-8


def test_carried_intervals_lie_near_drawn_ones(panel):
    """Ends of 80 % intervals against ordinary draws with replacement, within their sampling error."""
    df, arrays = panel
    z, t = arrays["a"], 89
    out = fc.origin_ensemble(df.where("k = 'a'"), ["k"], "t", "y", ["x1"], 2000, 0.01, 1.0, 60).where(F.col("t") == t)
    ends = np.quantile([r["prediction"] for r in out.collect()], [0.1, 0.5, 0.9])
    draw = np.random.default_rng(3)
    drawn = []
    for _ in range(2000):
        at = draw.integers(0, t, t)
        x, y = z[at, 0], z[at, 4]
        b = ((x - x.mean()) * (y - y.mean())).sum() / (((x - x.mean()) ** 2).sum() + 0.01)
        drawn.append(y.mean() + b * (z[t, 0] - x.mean()))
    want = np.quantile(drawn, [0.1, 0.5, 0.9])
    assert np.abs(ends - want).max() < 0.2 * (want[2] - want[0])


def test_jaccard_by_join(spark):
    from quotegrid.operators import setops

    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("b", 3), ("c", 9), (None, 1)], "g string, i int")
    (row,) = setops.jaccard_of_sets(df, "g", "i").collect()
    assert tuple(row) == ("a", "b", round(1 / 3, 8), 1, 1, 1)


def test_unbounded_scenario_lists_are_refused(spark):
    from quotegrid.operators import joins

    with pytest.raises(ValueError):
        joins.scenario_grid(spark.range(3), spark.range(20), max_rows=10)


def test_cv_quality_and_readiness_classes(spark):
    folds = spark.createDataFrame([("a", 0.5), ("a", 0.52), ("b", 0.3), ("b", 0.5), ("c", None), ("c", 0.1)], "k string, r_squared double")
    got = {r["k"]: (r["cv_quality"], r["successful_folds"], r["success_rate"]) for r in fc.cv_summary(folds, ["k"]).collect()}
    assert got == {"a": ("EXCELLENT", 2, 1.0), "b": ("ACCEPTABLE", 2, 1.0), "c": ("POOR", 1, 0.5)}
    none = spark.createDataFrame([("d", None)], "k string, r_squared double")
    assert fc.cv_summary(none, ["k"]).first()["cv_quality"] == "FAILED"
    cols = "k string, r_squared double, mape double"
    train = spark.createDataFrame([("a", 0.8, 5.0), ("b", 0.8, 5.0), ("c", 0.8, 5.0), ("d", 0.8, 5.0)], cols)
    test = spark.createDataFrame([("a", 0.7, 9.0), ("b", 0.7, 9.0), ("c", 0.4, 9.0), ("d", 0.1, 90.0)], cols)
    res = spark.createDataFrame([("a", 0.01, False), ("b", 0.01, True), ("c", 0.3, False), ("d", None, None)], "k string, mean double, heteroscedastic boolean")
    got = {r["k"]: (r["checks_passed"], r["confidence_level"], r["production_ready"]) for r in fc.production_readiness(train, test, res, ["k"]).collect()}
    assert got == {"a": (4, "HIGH", True), "b": (3, "MODERATE", True), "c": (2, "LOW", False), "d": (0, "VERY LOW", False)}


def test_poisson_blocks_equal_counts_row_by_row(spark, panel, monkeypatch):
    df, arrays = panel
    rows = df.withColumn("w", F.lit(0.5) + F.col("t") / 100).repartition(4)
    want = {}
    for k, z in arrays.items():
        c = bs.poisson_counts(np.arange(len(z)), np.arange(1, 8))
        w = c * (0.5 + np.arange(len(z)) / 100)
        want |= {(k, r + 1): (c[r].sum(), w[r].sum(), *np.average(z[:, [0, 4]], axis=0, weights=w[r])) for r in range(7)}
    for drawn in (1 << 22, 40):
        monkeypatch.setattr(bs, "DRAWN", drawn)
        got = {(r["k"], r["replicate"]): (r["n"], r["sw"], *r["mean"]) for r in bs.poisson_blocks(rows, ["k"], "t", ["x1", "y"], 7, "w").collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert bs.poisson_blocks(rows.limit(0), ["k"], "t", ["x1", "y"], 7).count() == 0
    assert bs.poisson_blocks(rows, [], "t", ["x1", "y"], 3).count() == 3


def test_poisson_counts_follow_the_draws(spark):
    rng = np.random.default_rng(3)
    m = X.DRAW_MODULUS
    rows = np.concatenate(([0, 1, -5, m - 1, m, m + 1, 2**62], rng.integers(-(2**62), 2**62, 3000)))
    reps = np.concatenate(([0, 1, m - 1, m, 2**40], rng.integers(0, 2**40, 300)))
    want = np.searchsorted(np.array(X.poisson_thresholds()), bs._draw_parts(rows, reps)[0], side="right")
    assert (bs.poisson_counts(rows, reps) == want).all() and want.max() > 6


def test_poisson_rows_are_dealt_to_many_tasks(spark, monkeypatch):
    rows = spark.range(4000).coalesce(1).select("id", F.lit("a").alias("k"), F.col("id").cast("double").alias("y"))
    seen = []
    frame = type(rows)
    before = frame.mapInPandas

    def noted(self, *args, **kwargs):
        seen.append(self.groupBy(F.spark_partition_id().alias("p")).count().collect())
        return before(self, *args, **kwargs)

    monkeypatch.setattr(frame, "mapInPandas", noted)
    out = bs.poisson_blocks(rows, ["k"], "id", ["y"], 5).collect()
    assert len(out) == 5 and len(seen[0]) > 1 and max(r["count"] for r in seen[0]) < 1000
    c = bs.poisson_counts(np.arange(4000), np.arange(1, 6))
    assert {r["replicate"]: r["n"] for r in out} == {i + 1: c[i].sum() for i in range(5)}
