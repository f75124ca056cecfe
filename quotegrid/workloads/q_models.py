"""Queries: estimation, resampling, stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotegrid.functions import exprs as X
from quotegrid.operators import bootstrap as bs
from quotegrid.operators import moments as mo
from quotegrid.operators import selection as sel
from quotegrid.operators import stability as stb
from quotegrid.operators import subsets as sub
from quotegrid.operators.windows import decay_weight
from quotegrid.workloads import tables as t
from quotegrid.workloads.registry import query
from quotegrid.workloads.sqltext import Fit, draw_sql, moments_sql, rnd, weighted_moments_sql

K = ["product"]
OVER = "partition by product order by date"
ORDER = ["own", "comp", "tax", "qty", "y"]


def r6(df, *cols, decimals=6):
    return df.withColumns({c: F.round(c, decimals) for c in cols})


# ---------------------------------------------------------------- enumeration
CANDIDATES = """cand as (select distinct o_orderpriority as f from orders union select distinct o_orderstatus from orders),
c as (select f, row_number() over (order by f) as i from cand),
l1 as (select [f] as items, i as last from c), l2 as (select list_append(l1.items, c.f) as items, c.i as last from l1 join c on c.i > l1.last),
l3 as (select list_append(l2.items, c.f) as items, c.i as last from l2 join c on c.i > l2.last),
subs as (select items from l1 union all select items from l2 union all select items from l3)"""


def candidates(spark, sf):
    o = t.table(spark, sf, "orders")
    return o.select(F.explode(F.array("o_orderpriority", "o_orderstatus")).alias("feature")).distinct()


@query(
    "mod01_candidate_models",
    f"with {CANDIDATES} select 'base + ' || array_to_string(items, ' + ') as model_id, (len(items) + 1)::integer as n_features from subs",
)
def mod01(spark, sf):
    return sub.enumerate_ranges(candidates(spark, sf), "feature", ["base"], 3).select("model_id", "n_features")


@query(
    "mod02_priority_reduced_models",
    f"""with {CANDIDATES}, p as (select *, len(list_intersect(items, ['1-URGENT', 'F'])) as np from subs where len(items) >= 2)
  select array_to_string(items, ' + ') as model_id, len(items)::integer as n_features, np::integer as n_priority,
   case when np > 0 then 'priority_inclusive' else 'non_priority' end as strategy from p
  order by np > 0 desc, np desc, case when np > 0 then -len(items) else len(items) end, items limit 60""",
)
def mod02(spark, sf):
    out = sel.reduced_space(candidates(spark, sf), "feature", ["1-URGENT", "F"], 2, 3, 60)
    return out.select("model_id", "n_features", "n_priority", "strategy")


# ---------------------------------------------------------------- all subsets
MODELS = mo.all_subsets([], t.FEATURES, 2)
WMN = f"{t.WEEKLY_MODEL}, wn as (select product, date, y, own, comp, tax, case when day(date) > 7 then qty end as qty from wm)"


def _subset_sql(source: str) -> str:
    rows = []
    for name, feats in MODELS:
        cols = [c for c in ORDER if c in feats or c == "y"]
        f = Fit([c for c in ORDER if c in feats], cols)
        ok = " and ".join(f"{c} is not null" for c in cols)
        second = f"{f.b[1]}" if len(feats) == 2 else "null::double"
        second_se = f"{f.se[1]}" if len(feats) == 2 else "null::double"
        rows.append(
            f"select product, '{name}' as model_id, {len(feats)} as n_features, n as n_obs, {f.aic} as aic, {f.bic} as bic, {f.r2} as r2, "
            f"{f.adj} as adj_r2, {f.a} as b0, {f.b[0]} as b1, {second} as b2, {f.se0} as se0, {f.se[0]} as se1, {second_se} as se2 "
            f"from (select product, {moments_sql(cols)} from {source} where {ok} group by product)"
        )
    return " union all ".join(rows)


FITS = f"{WMN}, fits as materialized ({_subset_sql('wn')})"


def fits(spark, sf):
    wn = t.weekly_model(spark, sf).withColumn("qty", F.when(F.dayofmonth("date") > 7, F.col("qty")))
    return sub.fit_subsets(wn, K, "y", t.FEATURES, 2, per_range=4)


@query(
    "mod03_all_subsets_ols",
    f"""with {FITS} select product, model_id, n_features, n_obs, {', '.join(rnd(c, c) for c in
    ('aic', 'bic', 'r2', 'adj_r2', 'b0', 'b1', 'b2', 'se0', 'se1', 'se2'))}, true as converged from fits""",
)
def mod03(spark, sf):
    f = fits(spark, sf)
    out = f.select(
        "product", "model_id", "n_features", "n_obs", "aic", "bic", "r2", "adj_r2", "converged",
        *[F.get("coef", F.lit(i)).alias(f"b{i}") for i in range(3)],
        *[F.get("se", F.lit(i)).alias(f"se{i}") for i in range(3)],
    )
    return r6(out, "aic", "bic", "r2", "adj_r2", *[f"b{i}" for i in range(3)], *[f"se{i}" for i in range(3)])


RN = f"""{t.WEEKLY_MODEL}, rows_ as (select *, row_number() over ({OVER}) as rn, count(*) over (partition by product) as len from wm)"""
WROWS = f"{RN}, wrows as (select *, power(0.98, len - rn) as w from rows_), wmom as (select product, {weighted_moments_sql(ORDER)} from wrows group by 1)"


def weighted_rows(spark, sf, rate=0.98, offset=1):
    return t.weekly_model(spark, sf).withColumn("w", decay_weight(rate, K, "date", offset))


_PAIRS = [(a, b) for a in t.FEATURES for b in t.FEATURES if a != b]


@query(
    "mod04_weighted_stepwise",
    f"""with {WROWS}, s1 as ({' union all '.join(f"select product, '{f}' as f, {Fit([f], ORDER).waic} as aic from wmom" for f in t.FEATURES)}),
  b1 as (select product, arg_min(f, aic) as f, min(aic) as aic from s1 group by 1),
  s2 as ({' union all '.join(f"select product, '{a}' as f, '{b}' as g, {Fit([a, b], ORDER).waic} as aic from wmom" for a, b in _PAIRS)}),
  b2 as (select s2.product, b1.f as f, arg_min(g, s2.aic) as g, min(s2.aic) as aic from s2 join b1 on s2.product = b1.product and s2.f = b1.f group by 1, 2)
  select product, 1 as step, f as added, f as features, {rnd('aic', 'aic')} from b1 union all
  select product, 2, g, f || ' + ' || g, {rnd('aic', 'aic')} from b2""",
)
def mod04(spark, sf):
    rows = mo.centre(weighted_rows(spark, sf).select("product", "w", *ORDER), K, ORDER)
    blocks = mo.weighted_blocks(rows, K, ORDER, weight="w")
    return r6(sub.stepwise_sweeps(blocks, K, ORDER, [[f] for f in t.FEATURES], 2), "aic")


ALPHAS = [0.1, 1.0, 10.0]


def _ridge_cv_sql(f: str) -> str:
    return f"""select product, '{f}' as model_id, arg_max(alpha, (m, -alpha)) as best_alpha, max(m) as cv_mean, arg_max(sd, (m, -alpha)) as cv_std from (
   select product, alpha, avg(r2) as m, stddev_pop(r2) as sd from (
    select tr.product, tr.k, alpha, 1 - sum(power(te.y - (my - b*mx) - b*te.{f}, 2)) / (count(*) * var_pop(te.y)) as r2 from (
     select f.product, f.k, alpha, avg(r.y) as my, avg(r.{f}) as mx, count(*)*covar_pop(r.y, r.{f})/(count(*)*var_pop(r.{f}) + alpha) as b
     from (select distinct product, fold as k from folds) f join folds r on r.product = f.product and r.fold <> f.k
     cross join (select unnest([0.1, 1.0, 10.0]::double[]) as alpha) group by 1,2,3) tr
    join folds te on te.product = tr.product and te.fold = tr.k group by 1,2,3) group by 1,2) group by 1"""


@query(
    "mod05_ridge_cv",
    f"""with {RN}, folds as (select *, case when rn - 1 < (len % 5) * (len // 5 + 1) then (rn - 1) // (len // 5 + 1)
   else len % 5 + (rn - 1 - (len % 5) * (len // 5 + 1)) // (len // 5) end as fold from rows_),
  cv as ({_ridge_cv_sql('own')} union all {_ridge_cv_sql('tax')})
  select product, model_id, best_alpha, {rnd('cv_mean', 'cv_mean')}, {rnd('cv_std', 'cv_std')} from cv""",
)
def mod05(spark, sf):
    out = sub.ridge_cv_subsets(t.weekly_model(spark, sf), K, "date", "y", ["own", "tax"], 1, ALPHAS)
    return r6(out.select("product", "model_id", "best_alpha", "cv_mean", "cv_std"), "cv_mean", "cv_std")


PATH_ALPHAS = [round(10 ** (-2 + 5 * i / 49), 6) for i in range(50)]
PATH_POOL = ["own", "comp", "tax"]


def _det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    minors = [[row[:j] + row[j + 1 :] for row in m[1:]] for j in range(len(m))]
    return "(" + "".join(f" {'-' if j % 2 else '+'} ({m[0][j]})*{_det(minors[j])}" for j in range(len(m))) + ")"


def _ridge_path_sql(feats: list[str]) -> str:
    """R2 of the held-out fold for every alpha, by Cramer's rule on the moments of the other folds."""
    cols = [*PATH_POOL, "y"]
    v = lambda s, a, b: f"{s}v_{a}_{b}" if cols.index(a) <= cols.index(b) else f"{s}v_{b}_{a}"
    lhs = [[f"(n*{v('', a, b)}{' + alpha' if a == b else ''})" for b in feats] for a in feats]
    rhs = [f"(n*{v('', a, 'y')})" for a in feats]
    beta = [f"{_det([[rhs[i] if j == k else lhs[i][j] for j in range(len(feats))] for i in range(len(feats))])}/{_det(lhs)} as b{k}" for k in range(len(feats))]
    fit = " - ".join(["m_y", *(f"b{k}*m_{f}" for k, f in enumerate(feats))])
    bias = " - ".join(["tm_y", f"({fit})", *(f"b{k}*tm_{f}" for k, f in enumerate(feats))])
    cross = " + ".join(f"2*b{k}*{v('t', f, 'y')}" for k, f in enumerate(feats))
    square = " + ".join(f"b{i}*b{j}*{v('t', a, b)}" for i, a in enumerate(feats) for j, b in enumerate(feats))
    return f"""select product, '{' + '.join(feats)}' as model_id, {len(feats)} as n_features, alpha, k,
   1 - (tv_y_y - ({cross}) + ({square}) + power({bias}, 2))/tv_y_y as r2 from (select *, {', '.join(beta)} from cells)"""


_PATH_SETS = [[f for j, f in enumerate(PATH_POOL) if n >> j & 1] for n in range(1, 8)]
_OTHERS = [f"{m}_{x}" for m, xs in (("m", [*PATH_POOL, "y"]), ("v", [f"{a}_{b}" for i, a in enumerate([*PATH_POOL, 'y']) for b in [*PATH_POOL, 'y'][i:]])) for x in xs]


@query(
    "mod05_ridge_path_subsets",
    f"""with {RN}, folds as (select *, case when rn - 1 < (len % 5) * (len // 5 + 1) then (rn - 1) // (len // 5 + 1)
   else len % 5 + (rn - 1 - (len % 5) * (len // 5 + 1)) // (len // 5) end as fold from rows_),
  train as (select f.product, f.k, {moments_sql([*PATH_POOL, 'y'])} from (select distinct product, fold as k from folds) f
   join folds r on r.product = f.product and r.fold <> f.k group by 1, 2),
  test as (select product, fold as k, {moments_sql([*PATH_POOL, 'y'])} from folds group by 1, 2),
  cells as (select train.*, alpha, {', '.join(f'test.{c} as t{c}' for c in _OTHERS)} from train join test on train.product = test.product and train.k = test.k
   cross join (select unnest([{', '.join(map(repr, PATH_ALPHAS))}]::double[]) as alpha)),
  scored as ({' union all '.join(_ridge_path_sql(f) for f in _PATH_SETS)}),
  path as (select product, model_id, n_features, alpha, avg(r2) as m, stddev_pop(r2) as sd from scored group by 1, 2, 3, 4)
  select product, model_id, n_features, arg_max(alpha, (m, -alpha)) as best_alpha, round(max(m), 6) + 0.0 as cv_mean, round(arg_max(sd, (m, -alpha)), 6) + 0.0 as cv_std
  from path group by 1, 2, 3""",
)
def mod05_path(spark, sf):
    """50 alphas over all subsets of three features; (product, range of subsets) is dealt out."""
    out = sub.ridge_cv_subsets(t.weekly_model(spark, sf), K, "date", "y", PATH_POOL, 3, PATH_ALPHAS, per_range=3)
    return r6(out.select("product", "model_id", "n_features", "best_alpha", "cv_mean", "cv_std"), "cv_mean", "cv_std")


@query(
    "mod06_non_negative_weighted_ridge",
    f"""with {WROWS}, g as (select product, m_y, m_own, m_comp, sw*v_own_own + 1 as a, sw*v_own_comp as c, sw*v_comp_comp + 1 as d,
    sw*v_own_y as p, sw*v_comp_y as q from wmom),
  b as (select *, (p*d - q*c)/(a*d - c*c) as u, (q*a - p*c)/(a*d - c*c) as v from g),
  s as (select *, case when u >= 0 and v >= 0 then u when greatest(p,0)*greatest(p,0)/a >= greatest(q,0)*greatest(q,0)/d then greatest(p,0)/a else 0 end as b_own,
    case when u >= 0 and v >= 0 then v when greatest(p,0)*greatest(p,0)/a >= greatest(q,0)*greatest(q,0)/d then 0 else greatest(q,0)/d end as b_comp from b)
  select product, {rnd('m_y - b_own*m_own - b_comp*m_comp', 'intercept')}, {rnd('b_own', 'b_own')}, {rnd('b_comp', 'b_comp')} from s""",
)
def mod06(spark, sf):
    cols = ["own", "comp", "y"]
    rows = mo.centre(weighted_rows(spark, sf).select("product", "w", *cols), K, cols)
    out = mo.ridge_fits(mo.weighted_blocks(rows, K, cols, weight="w"), K, cols, ["own", "comp"], 1.0, positive=True)
    names = ["intercept", "b_own", "b_comp"]
    return out.select("product", *[F.round(F.col("coef")[i], 6).alias(n) for i, n in enumerate(names)])


# ---------------------------------------------------------------- bagged ridge
def drawn_sql(replicates: int) -> str:
    pick = f"({draw_sql('s', 'r')} % len + 1)"
    return f"""lens as (select product, max(rn) as len from rows_ group by 1),
slots as (select product, len, r, unnest(range(1, len + 1)) as s from lens, (select unnest(range(1, {replicates + 1})) as r)),
picks as (select product, r as replicate, {pick} as rn from slots)"""


def _bagged_sql(b: int) -> str:
    return f"""with {RN}, {drawn_sql(b)}, z as (select p.product, p.replicate, y, own, power(0.99, len - rows_.rn + 1) as w
    from picks p join rows_ on rows_.product = p.product and rows_.rn = p.rn),
  m as (select product, replicate, {weighted_moments_sql(['own', 'y'])} from z group by 1,2),
  f as (select product, replicate, sw*v_own_y/(sw*v_own_own + 1) as b, m_y, m_own from m)
  select product, replicate::integer as replicate, {rnd('m_y - b*m_own', 'intercept')}, {rnd('b', 'slope')} from f"""


def _two(df, *keys):
    return df.select(
        *keys, F.round(F.col("coef")[0], 6).alias("intercept"), F.round(F.col("coef")[1], 6).alias("slope")
    )


@query("mod07_bagged_ridge", _bagged_sql(1000))
def mod07(spark, sf):
    rows = weighted_rows(spark, sf, 0.99, 0).select("product", "date", "own", "y", "w")
    blocks = bs.replicate_blocks(rows, K, "date", ["own", "y"], 1000, weight="w")
    return _two(mo.ridge_fits(blocks, ["product", "replicate"], ["own", "y"], ["own"], 1.0), "product", "replicate")


@query("mod07_bagged_ridge_many_replicates", _bagged_sql(1000))
def mod07_packed(spark, sf):
    rows = weighted_rows(spark, sf, 0.99, 0).select("product", "date", "own", "y", "w")
    return _two(
        bs.packed_ridge_ensemble(rows, K, "date", "y", ["own"], 1000, 1.0, weight="w"), "product", "replicate"
    )


POISSON_B = 1000


@query(
    "mod07_poisson_ensemble_raw_rows",
    f"""with {t.SALES}, r as (select unnest(range(1, {POISSON_B + 1})) as r), d as (select product, r, ln(premium) as y, epoch(date)/86400/1000 as x,
    {draw_sql('o_orderkey', 'r')} as u from sales, r),
  c as (select *, case {' '.join(f'when u // {X.DRAW_MODULUS} < {b} then {k}' for k, b in enumerate(X.poisson_thresholds()))} else {len(X.poisson_thresholds())} end as c from d),
  m as (select product, r, sum(c) as n, sum(c*x)/sum(c) as mx, sum(c*y)/sum(c) as my from c where c > 0 group by 1,2),
  f as (select m.product, m.r, any_value(n) as n, any_value(mx) as mx, any_value(my) as my, sum(c*(x-mx)*(y-my)) as sxy, sum(c*(x-mx)*(x-mx)) as sxx
    from c join m on c.product = m.product and c.r = m.r where c > 0 group by 1,2)
  select product, r::integer as replicate, n::bigint as n_obs, {rnd('my - sxy/(sxx+1)*mx', 'intercept')}, {rnd('sxy/(sxx+1)', 'slope')} from f""",
)
def mod07_poisson(spark, sf):
    s = t.sales(spark, sf).select(
        "product", "o_orderkey", (F.unix_date("date") / 1000).alias("x"), F.log("premium").alias("y")
    )
    blocks = bs.poisson_blocks(s, K, "o_orderkey", ["x", "y"], POISSON_B)
    return _two(mo.ridge_fits(blocks, ["product", "replicate"], ["x", "y"], ["x"], 1.0), "product", "replicate", "n_obs")


# ---------------------------------------------------------------- bootstrap of OLS, shared by all models
BOOT_MODELS = [("own", ["own"]), ("comp", ["comp"]), ("own + tax", ["own", "tax"])]
B = 1000
BCOLS = ["own", "comp", "tax", "y"]


def facts_sql(mom: str, keys: str) -> str:
    return " union all ".join(
        f"select {keys}, '{name}' as model_id, {i} as model_index, {Fit(f, BCOLS).aic} as aic, {Fit(f, BCOLS).adj} as r2 from {mom}"
        for i, (name, f) in enumerate(BOOT_MODELS)
    )


REPS = f"""{RN}, {drawn_sql(B)}, rmom as (select p.product, p.replicate, {moments_sql(BCOLS)} from picks p join rows_ on rows_.product = p.product
   and rows_.rn = p.rn group by 1,2), omom as (select product, {moments_sql(BCOLS)} from rows_ group by 1),
 orig as ({facts_sql('omom', 'product')}), fact0 as ({facts_sql('rmom', 'product, replicate')}),
 facts as (select f.*, o.aic as original_aic, o.r2 as original_r2 from fact0 f join orig o on f.product = o.product and f.model_id = o.model_id)"""


def replicate_fits(spark, sf):
    rows = t.weekly_model(spark, sf).select("product", "date", *BCOLS)
    blocks = bs.replicate_blocks(rows, K, "date", BCOLS, B)
    return mo.fit_models(blocks, ["product", "replicate"], BCOLS, BOOT_MODELS)


def facts(spark, sf):
    """Replicate facts with the original fit of each model beside them."""
    rows = t.weekly_model(spark, sf).select("product", "date", *BCOLS)
    original = mo.fit_models(mo.moment_blocks(rows, K, BCOLS), K, BCOLS, BOOT_MODELS).select(
        "product", "model_id", F.col("aic").alias("original_aic"), F.col("adj_r2").alias("original_r2")
    )
    index = F.array_position(F.array(*[F.lit(n) for n, _ in BOOT_MODELS]), F.col("model_id"))
    return (
        replicate_fits(spark, sf)
        .select("product", "model_id", "replicate", "aic", F.col("adj_r2").alias("r2"))
        .join(original, ["product", "model_id"])
        .withColumn("model_index", index)
    )


@query(
    "mod08_iid_bootstrap_ols",
    f"with {REPS} select product, model_id, replicate::integer as replicate, {rnd('aic', 'aic')}, {rnd('r2', 'r2')} from facts",
)
def mod08(spark, sf):
    return r6(facts(spark, sf).select("product", "model_id", "replicate", "aic", "r2"), "aic", "r2")


def block_sql(sizes: list[int], b: int, overlap: bool = True) -> str:
    d = draw_sql("s", "seed")
    first = f"{d} % (len - b + 1) + 1" if overlap else f"({d} % (len // b)) * b + 1"
    return f"""{RN}, lens as (select product, max(rn) as len from rows_ group by 1),
bslots as (select product, len, b, r, {draw_sql('b', 'r')} % {X.DRAW_MODULUS} as seed, unnest(range(1, cast(ceil(len/b) as bigint) + 1)) as s from lens, (select unnest({sizes}::bigint[]) as b), (select unnest(range(1, {b + 1})) as r)),
bfirst as (select *, {first} as f from bslots), boff as (select *, unnest(range(0, b)) as o from bfirst),
bpick as (select product, b, r as replicate, f + o as rn from boff where (s-1)*b + o < len),
bmom as (select p.product, p.b, p.replicate, {moments_sql(BCOLS)} from bpick p join rows_ on rows_.product = p.product and rows_.rn = p.rn group by 1,2,3),
bfact as ({facts_sql('bmom', 'product, b, replicate')})"""


def block_facts(spark, sf, sizes, b, overlap=True):
    rows = t.weekly_model(spark, sf).select("product", "date", *BCOLS)
    blocks = bs.replicate_blocks(rows, K, "date", BCOLS, b, block_sizes=sizes, overlap=overlap)
    out = mo.fit_models(blocks, ["product", "block_size", "replicate"], BCOLS, BOOT_MODELS)
    return out.select("product", "block_size", "replicate", "model_id", "aic", F.col("adj_r2").alias("r2"))


@query(
    "mod09_block_bootstrap",
    f"""with {block_sql([4], 1000)} select product, model_id, replicate::integer as replicate, {rnd('aic', 'aic')}, {rnd('r2', 'r2')} from bfact""",
)
def mod09(spark, sf):
    return r6(block_facts(spark, sf, [4], 1000).drop("block_size"), "aic", "r2")


@query(
    "mod09_block_bootstrap_disjoint",
    f"""with {block_sql([6], 1000, False)} select product, model_id, replicate::integer as replicate, {rnd('aic', 'aic')}, {rnd('r2', 'r2')} from bfact""",
)
def mod09_disjoint(spark, sf):
    return r6(block_facts(spark, sf, [6], 1000, overlap=False).drop("block_size"), "aic", "r2")


BLOCK_SCORE = """case when aic_cv < 0.002 and r2_cv < 0.05 then 95 when aic_cv < 0.005 and r2_cv < 0.1 then 85
  when aic_cv < 0.01 and r2_cv < 0.2 then 65 when aic_cv < 0.02 and r2_cv < 0.3 then 40 else 20 end"""


@query(
    "mod10_block_size_sensitivity",
    f"""with {block_sql([2, 4, 6, 8], 1000)}, cv as (select product, model_id, b, stddev_pop(aic)/abs(avg(aic)) as aic_cv, stddev_pop(r2)/abs(avg(r2)) as r2_cv
   from bfact group by 1,2,3), sc as (select *, {BLOCK_SCORE} as score from cv)
  select product, model_id, arg_max(b, (score, -b))::integer as block_size, max(score) as stability_score from sc group by 1,2""",
)
def mod10(spark, sf):
    by_size = stb.block_stability(block_facts(spark, sf, [2, 4, 6, 8], 1000), ["product", "model_id", "block_size"])
    return stb.best_block_size(by_size, ["product", "model_id"])


_F2 = Fit(["own", "tax"], BCOLS)


@query(
    "mod11_coefficient_intervals",
    f"""with {REPS}, co as (select product, 'Intercept' as term, {_F2.a} as c from rmom union all select product, 'own', {_F2.b[0]} from rmom union all
   select product, 'tax', {_F2.b[1]} from rmom), lv as (select unnest([0.8, 0.9, 0.95]::double[]) as level),
   q as (select product, term, quantile_cont(c, [0.1, 0.05, 0.025, 0.9, 0.95, 0.975]) as q from co group by 1,2)
  select product, term, level, round(q[i], 6) + 0.0 as lower, round(q[i+3], 6) + 0.0 as upper from q,
   (select 0.8::double as level, 1 as i union all select 0.9, 2 union all select 0.95, 3)""",
)
def mod11(spark, sf):
    one = replicate_fits(spark, sf).where(F.col("model_id") == "own + tax")
    coefs = mo.coefficient_rows(one, ["product", "replicate"])
    return r6(stb.coefficient_intervals(coefs, ["product", "term"]), "lower", "upper")


@query(
    "mod12_stability_metrics",
    f"""with {REPS}, s as (select product, model_id, count(aic) as successful_fits, stddev_pop(aic)/abs(avg(aic)) as aic_cv, stddev_pop(r2)/abs(avg(r2)) as r2_cv,
   quantile_cont(aic, 0.05) as al, quantile_cont(aic, 0.95) as au, quantile_cont(r2, 0.25) as rl, quantile_cont(r2, 0.75) as ru from facts group by 1,2)
  select product, model_id, successful_fits, {rnd('aic_cv', 'aic_cv')}, {rnd('r2_cv', 'r2_cv')}, {rnd('al', 'aic_lower_90')}, {rnd('au', 'aic_upper_90')},
  {rnd('rl', 'r2_lower_50')}, {rnd('ru', 'r2_upper_50')}, case when aic_cv < 0.005 and r2_cv < 0.1 then 'STABLE' when aic_cv < 0.01 and r2_cv < 0.2 then 'MODERATE'
  else 'UNSTABLE' end as stability from s""",
)
def mod12(spark, sf):
    out = stb.stability_metrics(facts(spark, sf), ["product", "model_id"], B)
    num = ["aic_cv", "r2_cv", "aic_lower_90", "aic_upper_90", "r2_lower_50", "r2_upper_50"]
    return r6(out.select("product", "model_id", "successful_fits", *num, "stability"), *num)


WINS = """wins as (select product, w as model_id, count(*) as win_count from (select product, replicate, arg_min(model_id, (aic, model_index)) as w
  from facts group by 1,2) group by 1,2),
 wr as (select f.product, f.model_id, median(aic) as median_aic, count(*) as n_replicates, coalesce(any_value(win_count), 0) as win_count,
  coalesce(any_value(win_count), 0)::double / count(*) * 100 as win_rate_pct from facts f left join wins w on f.product = w.product and f.model_id = w.model_id group by 1,2)"""


@query(
    "mod13_win_rate",
    f"with {REPS}, {WINS} select product, model_id, {rnd('median_aic', 'median_aic')}, n_replicates, win_count, {rnd('win_rate_pct', 'win_rate_pct')} from wr",
)
def mod13(spark, sf):
    return r6(stb.win_rates(facts(spark, sf), K, "model_id", "model_index"), "median_aic", "win_rate_pct")


IR = """bm as (select product, median(aic) as bench from facts group by 1),
 ex as (select f.product, f.model_id, f.replicate, bench, original_aic, aic, bench - aic as e from facts f join bm on f.product = bm.product),
 dd as (select *, greatest(0, coalesce(max(e) over (partition by product, model_id order by replicate rows between unbounded preceding and 1 preceding), 0)) - e as d,
  row_number() over (partition by product, model_id order by replicate) - row_number() over (partition by product, model_id, e > 0 order by replicate) as isl from ex),
 st as (select product, model_id, max(l) as streak from (select product, model_id, isl, e > 0 as hit, count(*) as l from dd group by 1,2,3,4) where hit group by 1,2),
 ir as (select dd.product, dd.model_id, any_value(bench) as benchmark_aic, any_value(original_aic) as original_aic, avg(e) as mean_excess, stddev_pop(e) as std_excess,
  coalesce(stddev_pop(e) filter (where e < 0), 0) as dn, max(d) as max_drawdown, avg((e > 0)::integer) * 100 as success_rate, coalesce(any_value(streak), 0) as consecutive_wins
  from dd left join st on dd.product = st.product and dd.model_id = st.model_id group by 1,2),
 irs as (select *, case when std_excess > 0 then mean_excess/std_excess else 0 end as information_ratio,
  case when std_excess > 0 then (benchmark_aic - original_aic)/std_excess else 0 end as sharpe_like,
  case when dn > 0 then least(999, mean_excess/dn) when mean_excess > 0 then 999 else 0 end as sortino_ratio,
  case when max_drawdown > 0 then least(999, mean_excess/max_drawdown) when mean_excess > 0 then 999 else 0 end as calmar_ratio from ir)"""
IR_COLS = ["benchmark_aic", "original_aic", "mean_excess", "std_excess", "max_drawdown", "success_rate",
           "information_ratio", "sharpe_like", "sortino_ratio", "calmar_ratio"]


@query(
    "mod14_information_ratios",
    f"with {REPS}, {IR} select product, model_id, consecutive_wins, {', '.join(rnd(c, c) for c in IR_COLS)} from irs",
)
def mod14(spark, sf):
    return r6(stb.information_ratios(facts(spark, sf), K, "model_id"), *IR_COLS)


@query(
    "mod15_information_ratio_low_is_good",
    f"""with {REPS}, bm as (select product, median(aic) as bench from facts group by 1)
  select f.product, model_id, round(case when stddev_pop(aic) > 0 then (avg(aic) - any_value(bench))/stddev_pop(aic) else 0 end, 6) + 0.0 as ir_low_is_good
  from facts f join bm on f.product = bm.product group by 1,2""",
)
def mod15(spark, sf):
    return r6(stb.information_ratio_low_is_good(facts(spark, sf), K, "model_id"), "ir_low_is_good")


SCORE = """cs as (select wr.product, wr.model_id, win_rate_pct, coalesce(information_ratio, 0) as information_ratio,
  0.5*win_rate_pct + 0.5*greatest(0, least(100, (coalesce(information_ratio, 0) + 2)*25)) as composite_score from wr left join irs on wr.product = irs.product and wr.model_id = irs.model_id)"""


@query(
    "mod16_composite_score",
    f"""with {REPS}, {WINS}, {IR}, {SCORE} select product, model_id, {rnd('win_rate_pct', 'win_rate_pct')}, {rnd('information_ratio', 'information_ratio')},
  {rnd('composite_score', 'composite_score')}, case when composite_score >= 80 then 'A+ (Excellent)' when composite_score >= 70 then 'A (Very Good)'
  when composite_score >= 60 then 'B+ (Good)' when composite_score >= 50 then 'B (Average)' else 'C (Below Average)' end as grade from cs""",
)
def mod16(spark, sf):
    f = facts(spark, sf)
    out = stb.composite_score(
        stb.win_rates(f, K, "model_id", "model_index"), stb.information_ratios(f, K, "model_id"), ["product", "model_id"]
    )
    cols = ["win_rate_pct", "information_ratio", "composite_score"]
    return r6(out.select("product", "model_id", *cols, "grade"), *cols)


# ---------------------------------------------------------------- constraints and corrections
RULES = [("own", "positive", True), ("comp", "negative", True), ("qty", "positive", False)]
Z95 = 1.959963984540054
LONG = """lc as materialized (select product, model_id, n_obs, n_features, string_split(model_id, ' + ')[1] as term, b1 as coef, se1 as se from fits union all
  select product, model_id, n_obs, n_features, string_split(model_id, ' + ')[2], b2, se2 from fits where b2 is not null),
 rules(rule, expected_sign, strict) as (values ('own', 'positive', true), ('comp', 'negative', true), ('qty', 'positive', false)),
 lr as (select lc.*, rules.* from lc join rules on contains(term, rule))"""
VIOL = f"""viol as materialized (select * from lr where case when expected_sign = 'positive' then coef - {Z95}*se <= 0 else coef + {Z95}*se >= 0 end)"""


@query(
    "mod28_sign_constraints",
    f"""with {FITS}, {LONG}, {VIOL}, bad as (select distinct product, model_id from viol where strict)
  select product, model_id, 'kept' as outcome, null as term, round(aic, 6) as value from fits f
   where not exists (select 1 from bad where bad.product = f.product and bad.model_id = f.model_id)
  union all select product, model_id, case when strict then 'ERROR' else 'WARNING' end, term, round(coef, 6) from viol""",
)
def mod28(spark, sf):
    f = fits(spark, sf)
    v = sel.constraint_violations(mo.coefficient_rows(f, K), RULES)
    kept = sel.drop_violating(f, v, K).select(
        "product", "model_id", F.lit("kept").alias("outcome"), F.lit(None).cast("string").alias("term"), F.col("aic").alias("value")
    )
    out = kept.union(v.select("product", "model_id", F.col("severity").alias("outcome"), "term", F.col("coef").alias("value")))
    return r6(out, "value")


def _tsql() -> str:
    from quotegrid.workloads.sqltext import t_critical_sql

    return f"""tc as (select *, {t_critical_sql('(n_obs - n_features - 1)', Z95)} as tcrit from lr),
 ts as (select *, coef - tcrit*se as lo, coef + tcrit*se as hi from tc),
 tt as (select *, case when expected_sign = 'positive' then case when lo > 0.01 then 'STRONG' when lo > 0 then 'MODERATE' when coef > 0 and hi > 0 then 'WEAK' else 'VIOLATED' end
  else case when hi < -0.01 then 'STRONG' when hi < 0 then 'MODERATE' when coef < 0 and lo < 0 then 'WEAK' else 'VIOLATED' end end as strength from ts)"""


@query(
    "mod29_statistical_constraints",
    f"""with {FITS}, {LONG}, {_tsql()}, g as (select product, model_id, count(*) as total, count(*) filter (where strength='STRONG') as strong,
   count(*) filter (where strength='MODERATE') as moderate, count(*) filter (where strength='WEAK') as weak, count(*) filter (where strength='VIOLATED') as violated from tt group by 1,2)
  select tt.product, tt.model_id, term, {rnd('lo', 'ci_lower')}, {rnd('hi', 'ci_upper')}, strength, abs(coef/se) > tcrit as significant,
   case when violated > 0 then 'POOR' when strong >= total*0.7 then 'EXCELLENT' when moderate+strong >= total*0.6 then 'GOOD' when weak+moderate+strong >= total*0.5 then 'ACCEPTABLE' else 'CONCERNING' end as compliance
  from tt join g on tt.product = g.product and tt.model_id = g.model_id""",
)
def mod29(spark, sf):
    tcon = sel.t_constraints(mo.coefficient_rows(fits(spark, sf), K), RULES)
    comp = sel.compliance(tcon, ["product", "model_id"]).select("product", "model_id", "compliance")
    out = tcon.join(comp, ["product", "model_id"]).select(
        "product", "model_id", "term", "ci_lower", "ci_upper", "strength", "significant", "compliance"
    )
    return r6(out, "ci_lower", "ci_upper")


def _mt_sql() -> str:
    from quotegrid.functions.distributions import chi2_one_quantile
    from quotegrid.workloads.sqltext import chi2_1_sf_sql

    crit = chi2_one_quantile(1 - 0.05 / len(MODELS))
    return f"""gap as (select product, model_id, aic, aic - min(aic) over (partition by product) as d from fits),
 mt as (select *, d <= {crit!r} as bonferroni_significant, greatest(1e-16, least(1.0, {chi2_1_sf_sql('d')})) as p from gap),
 bh as (select *, p * count(*) over (partition by product) / row_number() over (partition by product order by p, model_id) as raw from mt),
 bh2 as (select *, least(1.0, min(raw) over (partition by product order by p, model_id rows between current row and unbounded following)) as q from bh)"""


@query(
    "mod30_bonferroni",
    f"with {FITS}, {_mt_sql()} select product, model_id, {rnd('d', 'aic_diff')}, bonferroni_significant from bh2",
)
def mod30(spark, sf):
    out = sel.bonferroni(fits(spark, sf), len(MODELS), keys=K)
    return r6(out.select("product", "model_id", "aic_diff", "bonferroni_significant"), "aic_diff")


@query(
    "mod31_benjamini_hochberg",
    f"with {FITS}, {_mt_sql()} select product, model_id, {rnd('p', 'p_value')}, {rnd('q', 'fdr_corrected_p')}, q <= 0.05 as differs_from_best from bh2",
)
def mod31(spark, sf):
    out = sel.benjamini_hochberg(fits(spark, sf), keys=K)
    return r6(
        out.select("product", "model_id", "p_value", "fdr_corrected_p", "differs_from_best"), "p_value", "fdr_corrected_p"
    )


@query(
    "mod32_correction_comparison",
    f"""with {FITS}, {_mt_sql()}, s as (select product, 'bonferroni' as method, count(*) as n_models, count(*) filter (where bonferroni_significant) as n_kept from bh2 group by 1
   union all select product, 'fdr_bh', count(*), count(*) filter (where q <= 0.05) from bh2 group by 1 union all select product, 'reduced_space', count(*), least(count(*), 6) from bh2 group by 1)
  select product, method, n_models, n_kept, round(1 - n_kept::double/n_models, 6) + 0.0 as rejection_rate from s""",
)
def mod32(spark, sf):
    return r6(sel.compare_corrections(fits(spark, sf), len(MODELS), K, reduced=6), "rejection_rate")


@query(
    "mod38_rank_agreement",
    f"""with {FITS}, rk as (select product, rank() over (partition by product order by aic) + (count(*) over (partition by product, aic) - 1)/2 as ra,
   rank() over (partition by product order by bic) + (count(*) over (partition by product, bic) - 1)/2 as rb,
   rank() over (partition by product order by adj_r2 desc) + (count(*) over (partition by product, adj_r2) - 1)/2 as rr from fits)
  select product, 'aic' as a, 'aic' as b, 1.0::double as corr from rk group by 1 union all select product, 'bic', 'bic', 1.0 from rk group by 1 union all
  select product, 'adj_r2', 'adj_r2', 1.0 from rk group by 1 union all select product, 'aic', 'bic', round(corr(ra, rb), 6) from rk group by 1 union all
  select product, 'aic', 'adj_r2', round(corr(ra, rr), 6) from rk group by 1 union all select product, 'bic', 'adj_r2', round(corr(rb, rr), 6) from rk group by 1""",
)
def mod38(spark, sf):
    return r6(stb.rank_agreement(fits(spark, sf), K, {"aic": False, "bic": False, "adj_r2": True}), "corr")


# ---------------------------------------------------------------- name tests (needs a coefficient table)
NAMES = {"own": "own_rate_t0", "comp": "competitor_weighted_t2", "tax": "market_volatility_t1", "qty": "C_lag_0"}


def named_coefficients(spark, sf):
    m = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    co = mo.coefficient_rows(fits(spark, sf), K).where(F.col("term") != "Intercept")
    return co.withColumn("feature", m[F.col("term")])


NAMED = f"""nc as materialized (select *, case term {' '.join(f"when '{k}' then '{v}'" for k, v in NAMES.items())} end as feature from lc),
 ns as (select *, case when regexp_matches(lower(feature), '(own|p)_?rate') then 'own_rate' when regexp_matches(lower(feature), 'competitor_(mid|weighted|mean)') then 'competitor_weighted'
  when regexp_matches(lower(feature), '(vix|volatility)') then 'vix' end as pattern from nc),
 nx as (select *, case pattern when 'own_rate' then 'positive' when 'competitor_weighted' then 'negative' when 'vix' then 'context_dependent' end as expected_sign from ns),
 ny as materialized (select *, case when expected_sign is null then 'no constraint' when expected_sign = 'context_dependent' then 'warning'
  when (expected_sign = 'positive' and coef <= 0) or (expected_sign = 'negative' and coef >= 0) then 'violated' else 'passed' end as status,
  regexp_matches(lower(feature), 'c_lag_?0\\b') or regexp_matches(lower(feature), 'competitor.*lag.*0') as lag_zero from nx)"""


@query(
    "sca13_name_patterns",
    f"with {FITS}, {LONG}, {NAMED} select product, model_id, feature, pattern, expected_sign, status, lag_zero from ny",
)
def sca13(spark, sf):
    co = named_coefficients(spark, sf)
    s = sel.expected_sign("feature")
    return co.select(
        "product", "model_id", "feature", s["pattern"].alias("pattern"), s["expected_sign"].alias("expected_sign"),
        sel.sign_status("coef", s["expected_sign"]).alias("status"), sel.is_lag_zero("feature").alias("lag_zero"),
    )


__all__ = ["FITS", "LONG", "MODELS", "NAMED", "RN", "drawn_sql", "facts", "fits", "named_coefficients", "r6"]
