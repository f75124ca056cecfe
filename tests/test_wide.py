"""Wide moment blocks, subsets by rank, sweeps: against NumPy and plain enumeration."""

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotegrid.operators import gram, subsets as sub
from quotegrid.operators import moments as mo


@pytest.fixture(scope="module")
def holed(spark):
    """Two keys, twelve features and a target, one value in ten missing (NULL or NaN)."""
    draw = np.random.default_rng(7)
    frames = []
    for k, n in (("a", 260), ("b", 90)):
        x = draw.standard_normal((n, 12)) * 10 ** draw.uniform(-2, 2, 12) + draw.uniform(-1e4, 1e4, 12)
        y = x[:, 0] * 0.3 - x[:, 3] + draw.standard_normal(n) * np.abs(x[:, 3]).std()
        whole = np.column_stack((x, y))
        whole[draw.random(whole.shape) < 0.1] = np.nan
        frames.append(pd.DataFrame(whole, columns=[*(f"x{i}" for i in range(12)), "y"]).assign(k=k, t=range(n)))
    data = pd.concat(frames, ignore_index=True)
    df = spark.createDataFrame(data).withColumn("x1", F.when(~F.isnan("x1"), F.col("x1"))).repartition(5)
    return df.cache(), data


POOL = [f"x{i}" for i in range(12)]


def test_pair_sums_merge_like_one_pass():
    draw = np.random.default_rng(2)
    x = draw.standard_normal((300, 7)) + 1e6
    x[draw.random(x.shape) < 0.2] = np.nan
    x[:, 6] = np.nan
    parts = [gram.pair_sums(x[a:b]) for a, b in ((0, 1), (1, 50), (50, 60), (60, 300))]
    total = parts[0]
    for p in parts[1:]:
        total = gram.merged(total, p)
    assert np.allclose(total, gram.pair_sums(x), rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("tile", [3, 64])
def test_tiles_give_pairwise_correlations(holed, tile):
    df, data = holed
    cols = [*POOL, "y"]
    tiles = gram.gram_tiles(df, ["k"], cols, tile)
    got = {(r["k"], r["a"], r["b"]): r for r in gram.pair_correlations(tiles, ["k"], cols, tile).collect()}
    assert len(got) == 2 * 13 * 14 // 2
    for k, part in data.groupby("k"):
        want, n = part[cols].corr(), part[cols].notna().astype(int)
        for a, b in combinations(cols, 2):
            assert abs(got[k, a, b]["corr"] - want.loc[a, b]) < 1e-9 and got[k, a, b]["n"] == (n[a] * n[b]).sum()
        assert abs(got[k, "y", "y"]["covariance"] / part["y"].var() - 1) < 1e-9
    profile = {(r["k"], r["feature"]): r for r in gram.correlation_profile(tiles, ["k"], cols, tile).collect()}
    r = np.abs(data[data["k"] == "a"][cols].corr().to_numpy())
    np.fill_diagonal(r, np.nan)
    for i, c in enumerate(cols):
        assert abs(profile["a", c]["max_abs_corr"] - np.nanmax(r[i])) < 1e-9
        assert abs(profile["a", c]["mean_abs_corr"] - np.nanmean(r[i])) < 1e-9 and profile["a", c]["partners"] == 12


def test_constant_and_empty_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (4.0, 5.0, None)], "a double, b double, c double")
    tiles = gram.gram_tiles(df, [], ["a", "b", "c"])
    assert all(r["corr"] is None for r in gram.pair_correlations(tiles, [], ["a", "b", "c"]).collect() if r["a"] != r["b"])
    assert gram.gram_tiles(df.limit(0), [], ["a", "b", "c"]).count() == 0


def test_six_hundred_columns(spark):
    draw = np.random.default_rng(5)
    x = draw.standard_normal((400, 6)) @ draw.standard_normal((6, 598)) + draw.standard_normal((400, 598))
    cols = [f"c{i}" for i in range(598)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols)).repartition(3)
    got = gram.pair_correlations(gram.gram_tiles(df, [], cols), [], cols)
    assert "corr(" not in got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    want = np.corrcoef(x.T)
    rows = got.where(F.xxhash64("a", "b") % 50 == 0).collect()
    assert len(rows) > 2000 and all(abs(r["corr"] - want[int(r["a"][1:]), int(r["b"][1:])]) < 1e-9 for r in rows)


def test_few_and_many_columns_agree(holed):
    from quotegrid.operators import aggregates as agg

    df, _ = holed
    whole = df.dropna(subset=POOL)
    few = {(r["k"], r["a"], r["b"]): r for r in agg.pairwise_correlation(whole, POOL, ["k"]).collect()}
    many = {(r["k"], r["a"], r["b"]): r for r in agg.pairwise_correlation(whole, POOL, ["k"], wide=4).collect()}
    assert few.keys() == many.keys()
    for at, r in few.items():
        assert abs(r["corr"] - many[at]["corr"]) < 1e-9 and (r["variance"] is None) == (many[at]["variance"] is None)


# ---------------------------------------------------------------- subsets by rank
def test_every_subset_has_one_number():
    for p in range(1, 9):
        for most in range(1, p + 1):
            total = sub.subset_count(p, most)
            want = [c for k in range(1, most + 1) for c in combinations(range(p), k)]
            for step in (1, 3, 1000):
                got = [tuple(r) for lo in range(0, total, step) for part in sub.subsets_between(lo, min(lo + step, total), p, most) for r in part.tolist()]
                assert len(got) == total and sorted(got) == sorted(want)
    first = comb(600, 4) - 3
    assert sub.unrank(first, first + 3, 600, 4).tolist()[-1] == [596, 597, 598, 599]


def test_enumeration_needs_no_join_and_no_global_window(spark):
    names = spark.createDataFrame([(f"f{i}",) for i in (3, 1, 2, 0, 1)] + [(None,), ("base",)], "f string")
    out = sub.enumerate_ranges(names, "f", ["base"], 3, per_range=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    want = {("base", *c) for k in (1, 2, 3) for c in combinations(["f0", "f1", "f2", "f3"], k)}
    got = [tuple(r["features"]) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert all(r["model_id"] == " + ".join(r["features"]) and r["n_features"] == len(r["features"]) for r in out.collect())
    assert sub.enumerate_ranges(names.limit(0), "f", [], 2).count() == 0


def plain_fit(part, features):
    rows = part.dropna(subset=[*features, "y"])
    a = np.column_stack((np.ones(len(rows)), rows[features] - rows[features].mean()))
    y = rows["y"].to_numpy()
    b, *_ = np.linalg.lstsq(a, y, rcond=None)
    ssr, n, k = float(((y - a @ b) ** 2).sum()), *a.shape
    return n, b[1:], n * (np.log(2 * np.pi) + np.log(ssr / n) + 1) + 2 * k


def test_subset_fits_delete_rows_model_by_model(holed):
    df, data = holed
    out = sub.fit_subsets(df, ["k"], "y", POOL, 3, per_range=40).withColumn("task", F.spark_partition_id())
    got = {(r["k"], tuple(r["terms"][1:])): r for r in out.collect()}
    assert len(got) == 2 * sub.subset_count(12, 3)
    assert len({r["task"] for (k, _), r in got.items() if k == "a"}) > 1
    for (k, features), r in got.items():
        n, b, aic = plain_fit(data[data["k"] == k], list(features))
        assert r["n_obs"] == n and np.allclose(r["coef"][1:], b, rtol=1e-6, atol=1e-9) and abs(r["aic"] - aic) < 1e-6


def test_listed_models_reach_the_fits(spark, holed):
    df, data = holed
    names = spark.createDataFrame([(c,) for c in POOL], "f string")
    models = sub.enumerate_ranges(names, "f", ["x0"], 2).where("n_features = 3")
    got = sub.fit_listed(df, ["k"], "y", POOL, models).collect()
    assert len(got) == 2 * comb(11, 2)
    for r in got[::7]:
        n, b, aic = plain_fit(data[data["k"] == r["k"]], r["terms"][1:])
        assert r["n_obs"] == n and np.allclose(r["coef"][1:], b, rtol=1e-6, atol=1e-9) and abs(r["aic"] - aic) < 1e-6


def test_missing_keys_are_keys(spark, holed):
    df, data = holed
    odd = df.withColumn("k", F.when(F.col("k") == "a", 1)).select("k", "x0", "y")
    got = {r["k"]: r["n_obs"] for r in sub.fit_subsets(odd, ["k"], "y", ["x0"], 1).collect()}
    want = data.dropna(subset=["x0", "y"]).groupby("k").size()
    assert got == {1: want["a"], None: want["b"]}


def test_sweeping_inverts():
    draw = np.random.default_rng(1)
    x = draw.standard_normal((50, 6))
    a = x.T @ x
    s = sub.sweep(a, [0, 2, 3])
    at, rest = [0, 2, 3], [1, 4, 5]
    assert np.allclose(-s[np.ix_(at, at)], np.linalg.inv(a[np.ix_(at, at)]))
    assert np.allclose(s[np.ix_(rest, rest)], a[np.ix_(rest, rest)] - a[np.ix_(rest, at)] @ np.linalg.inv(a[np.ix_(at, at)]) @ a[np.ix_(at, rest)])
    assert np.isclose(sub.original_scale(s, 4, at), a[4, 4])


def test_six_rounds_over_sixty_candidates(spark):
    draw = np.random.default_rng(9)
    frames, want = [], []
    for k in range(3):
        x = draw.standard_normal((150, 60))
        y = x[:, :8] @ draw.uniform(-1, 1, 8) + draw.standard_normal(150)
        x[:, 59] = x[:, 0] + x[:, 1]  # never next to both
        part = pd.DataFrame(np.column_stack((x, y)), columns=[*(f"c{i}" for i in range(60)), "y"])
        frames.append(part.assign(k=k))
        chosen: list[str] = []
        for _ in range(6):
            scores = {}
            for c in part.columns[:60]:
                if c not in chosen:
                    z = part[[*chosen, c]].to_numpy()
                    if np.linalg.matrix_rank(z - z.mean(0)) == z.shape[1]:
                        scores[c] = plain_fit(part, [*chosen, c])[2]
            best = min(scores, key=scores.get)
            chosen.append(best)
            want.append((k, len(chosen), best, " + ".join(chosen), round(scores[best], 6)))
    cols = [f"c{i}" for i in range(60)]
    df = spark.createDataFrame(pd.concat(frames))
    blocks = mo.moment_blocks(df, ["k"], [*cols, "y"])
    out = sub.stepwise_sweeps(blocks, ["k"], [*cols, "y"], [[c] for c in cols], 6).collect()
    got = sorted((r["k"], r["step"], r["added"], r["features"], round(r["aic"], 6)) for r in out)
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want)]
    assert np.allclose([g[4] for g in got], [w[4] for w in sorted(want)], atol=1e-5)


def test_stepwise_adds_groups_from_a_start(spark, holed):
    df, data = holed
    whole = df.dropna(subset=[*POOL, "y"])
    blocks = mo.moment_blocks(whole, ["k"], [*POOL, "y"])
    groups = [["x1", "x2"], ["x3", "x0"], ["x4"], ["x0"]]
    rows = sub.stepwise_sweeps(blocks, ["k"], [*POOL, "y"], groups, 2, start=["x0"], per_chunk=1).where("k = 'a'").orderBy("step").collect()
    part = data[(data["k"] == "a")].dropna(subset=[*POOL, "y"])
    score = {tuple(g): plain_fit(part, ["x0", *(c for c in g if c != "x0")])[2] for g in groups[:3]}
    best = min(score, key=score.get)
    assert rows[0]["added"] == " + ".join(c for c in best if c != "x0") and abs(rows[0]["aic"] - score[best]) < 1e-6
    assert rows[0]["features"].startswith("x0 + ") and len(rows) == 2
