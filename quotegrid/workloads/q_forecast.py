"""Queries: splits, back-tests, scenarios, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotegrid.functions import exprs as X
from quotegrid.operators import bootstrap as bs
from quotegrid.operators import diagnostics as dg
from quotegrid.operators import forecast as fc
from quotegrid.operators import moments as mo
from quotegrid.operators import scenario as sc
from quotegrid.operators import windows as win
from quotegrid.operators.topk import latest_row
from quotegrid.workloads import tables as t
from quotegrid.workloads.q_models import RN, drawn_sql, r6, weighted_rows
from quotegrid.workloads.registry import ORACLE, query
from quotegrid.workloads.sqltext import chi2_1_sf_sql, chi2_even_sf_sql, draw_sql, rnd, weighted_moments_sql

K = ["product"]
OVER = "partition by product order by date"

SPLIT = f"""{RN}, split as (select *, case when rn <= case when len - floor(len*0.8) < 20 then len - 20 else floor(len*0.8) end then 'train' else 'test' end as role from rows_)"""


def split(spark, sf):
    return fc.temporal_split(t.weekly_model(spark, sf), K, "date")


@query(
    "mod17_temporal_split",
    f"""with {SPLIT} select product, count(*) filter (where role='train') as n_train, count(*) filter (where role='test') as n_test,
  max(date) filter (where role='train') as train_end, min(date) filter (where role='test') as test_start,
  max(date) filter (where role='train') < min(date) filter (where role='test') as no_overlap,
  date_diff('day', max(date) filter (where role='train'), min(date) filter (where role='test')) <= 7 as gap_ok,
  count(*) filter (where role='train') / count(*) between 0.6 and 0.9 as ratio_ok from split group by 1""",
)
def mod17(spark, sf):
    return fc.split_integrity(split(spark, sf), K, "date")


METRICS = ["r_squared", "mse", "rmse", "mae", "mape", "correlation"]
METRIC_SQL = """count(*) as n_observations, 1 - avg((y_-p_)*(y_-p_))/nullif(var_pop(y_),0) as r_squared, avg((y_-p_)*(y_-p_)) as mse, sqrt(avg((y_-p_)*(y_-p_))) as rmse,
 avg(abs(y_-p_)) as mae, avg(case when y_ <> 0 then abs((y_-p_)/y_) end)*100 as mape, corr(y_, p_) as correlation"""


def metric_cols() -> str:
    return ", ".join(rnd(m, m) for m in METRICS)


@query(
    "mod18_expanding_window_cv",
    f"""with {RN}, seg as (select *, len // 6 as sz, len - 5*(len // 6) as first from rows_), sg as (select *, case when rn <= first then 0 else 1 + (rn - 1 - first) // sz end as segment from seg),
  folds as (select unnest(range(1, 6)) as fold), fit as (select product, fold, count(*) as train_size, regr_slope(y, own) as b, regr_intercept(y, own) as a from sg join folds on segment < fold group by 1,2),
  te as (select sg.product, fit.fold, train_size, y as y_, a + b*own as p_ from sg join fit on sg.product = fit.product and sg.segment = fit.fold),
  m as (select product, fold::integer as fold, train_size, {METRIC_SQL} from te group by 1,2,3)
  select product, fold, train_size, n_observations, {metric_cols()} from m""",
)
def mod18(spark, sf):
    return r6(fc.expanding_cv(t.weekly_model(spark, sf), K, "date", "y", ["own"]), *METRICS)


ROLL = f"""{RN}, pw as (select product, date, rn, own, ln(sales) as ly, power(1/0.98, rn - 1) as w from rows_),
 pf as (select *, count(*) over o as n, sum(w) over o * power(0.98, rn - 2) as sw, sum(w*own) over o / sum(w) over o as mx, sum(w*ly) over o / sum(w) over o as my,
  sum(w*own*own) over o / sum(w) over o as qx, sum(w*own*ly) over o / sum(w) over o as qy from pw window o as ({OVER} rows between unbounded preceding and 1 preceding)),
 fo as (select product, date, n, ly, own, sw*(qy - mx*my)/(sw*(qx - mx*mx) + 1) as b, mx, my from pf where n >= 30),
 fr as (select product, date, n as train_size, exp(ly) as y_true, exp(my - b*mx + b*own) as y_predict from fo)"""


def rolling(spark, sf):
    return fc.rolling_origin(t.weekly_model(spark, sf), K, "date", "sales", ["own"], alpha=1.0, decay=0.98)


@query(
    "mod19_rolling_origin",
    f"""with {ROLL} select product, date, train_size, round(y_true, 2) as y_true, round(y_predict, 2) as y_predict,
  round(abs(y_true - y_predict)/y_true, 6) as abs_pct_error from fr""",
)
def mod19(spark, sf):
    out = rolling(spark, sf)
    return out.select(
        "product", "date", "train_size", F.round("y_true", 2).alias("y_true"), F.round("y_predict", 2).alias("y_predict"),
        F.round("abs_pct_error", 6).alias("abs_pct_error"),
    )


BENCH = f"""bench as (select product, date, sales as y_, lag(sales, 5) over ({OVER}) as p_ from wm),
 bm as (select product, {METRIC_SQL} from bench where p_ is not null group by 1)"""


def benchmark(spark, sf):
    wm = t.weekly_model(spark, sf)
    return wm.select("product", "date", "sales", win.persistence("sales", 5, K, "date").alias("prediction"))


@query(
    "mod20_benchmark_forecast",
    f"with {t.WEEKLY_MODEL}, {BENCH} select product, n_observations, {', '.join(rnd(m, m, 4 if m in ('mse', 'rmse', 'mae') else 6) for m in METRICS if m != 'mse')} from bm",
)
def mod20(spark, sf):
    m = fc.regression_metrics(benchmark(spark, sf), K, "sales", "prediction").drop("mse")
    return r6(r6(m, "rmse", "mae", decimals=4), "r_squared", "mape", "correlation")


@query(
    "mod21_model_vs_benchmark",
    f"""with {ROLL}, {BENCH}, mm as (select product, {METRIC_SQL} from (select product, y_true as y_, y_predict as p_ from fr) group by 1)
  select mm.product, round(mm.mape, 6) as model_mape, round(bm.mape, 6) as benchmark_mape, round((bm.mape - mm.mape)/bm.mape*100, 6) + 0.0 as mape_improvement_pct,
   round((mm.r_squared - bm.r_squared)/greatest(bm.r_squared, 0.001)*100, 4) + 0.0 as r2_improvement_pct, mm.mape < bm.mape as model_outperforms from mm join bm on mm.product = bm.product""",
)
def mod21(spark, sf):
    m = fc.regression_metrics(rolling(spark, sf), K, "y_true", "y_predict")
    b = fc.regression_metrics(benchmark(spark, sf), K, "sales", "prediction")
    out = fc.compare_to_benchmark(m, b, K)
    cols = ["model_mape", "benchmark_mape", "mape_improvement_pct"]
    return r6(r6(out, *cols), "r2_improvement_pct", decimals=4).select("product", *cols, "r2_improvement_pct", "model_outperforms")


ENSEMBLE_B = 1000
ENS = f"""{RN}, {drawn_sql(ENSEMBLE_B)}, z as (select p.product, p.replicate, y, own, power(0.99, len - rows_.rn + 1) as w
    from picks p join rows_ on rows_.product = p.product and rows_.rn = p.rn),
  em as (select product, replicate, {weighted_moments_sql(['own', 'y'])} from z group by 1,2),
  ens as (select product, replicate, sw*v_own_y/(sw*v_own_own + 1) as b, m_y - sw*v_own_y/(sw*v_own_own + 1)*m_own as a from em),
  cur as (select * from rows_ where rn = len)"""


def ensemble(spark, sf):
    rows = weighted_rows(spark, sf, 0.99, 0).select("product", "date", "own", "y", "w")
    blocks = bs.replicate_blocks(rows, K, "date", ["own", "y"], ENSEMBLE_B, weight="w")
    return mo.ridge_fits(blocks, ["product", "replicate"], ["own", "y"], ["own"], 1.0)


def current(spark, sf):
    return latest_row(t.weekly_model(spark, sf), K, "date")


@query(
    "mod22_prediction_from_coefficients",
    f"with {ENS} select ens.product, replicate::integer as replicate, date, round(exp(a + b*own) - 1, 6) + 0.0 as prediction from ens join cur on ens.product = cur.product",
)
def mod22(spark, sf):
    e = ensemble(spark, sf).select(
        "product",
        "replicate",
        F.explode(F.arrays_zip(F.array(F.lit("Intercept"), F.lit("own")).alias("term"), F.col("coef"))).alias("z"),
    )
    coefs = e.select("product", "replicate", F.col("z.term").alias("term"), F.col("z.coef").alias("coef"))
    rows = current(spark, sf).select("product", "date", F.lit(1.0).alias("Intercept"), "own").unpivot(
        ["product", "date"], ["Intercept", "own"], "term", "x"
    )
    out = sc.predict_long(coefs, rows, K, ["date"])
    return out.withColumn("prediction", F.round(F.expm1("prediction"), 6))


SCEN = f"""{ENS}, s as (select unnest(range(0, 9)) * 1.25::double as scenario),
 facts as (select ens.product, replicate::integer as replicate, scenario, (exp(a + b*scenario) - 1)*13 as dollars,
  ((exp(a + b*scenario) - 1)/(exp(a + b*own) - 1) - 1)*100 as pct_change from ens join cur on ens.product = cur.product cross join s)"""


def scenario_facts(spark, sf):
    scenarios = spark.range(9).select((F.col("id") * 1.25).alias("scenario"))
    return sc.price_scenarios(
        ensemble(spark, sf), current(spark, sf).select("product", "own", "comp"), scenarios, K, ["own"], "own", ["comp"]
    )


@query(
    "mod23_scenario_engine",
    f"with {SCEN} select product, replicate, scenario, {rnd('dollars', 'dollars')}, {rnd('pct_change', 'pct_change')} from facts",
)
def mod23(spark, sf):
    return r6(scenario_facts(spark, sf), "dollars", "pct_change")


@query(
    "mod24_scenario_intervals",
    f"""with {SCEN}, q as (select product, scenario, quantile_cont(dollars, [0.025, 0.5, 0.975]) as q from facts group by 1,2)
  select product, scenario, cast(round_even(q[1], 3) as double) as bottom, cast(round_even(q[2], 3) as double) as median, cast(round_even(q[3], 3) as double) as top from q""",
)
def mod24(spark, sf):
    return sc.scenario_intervals(scenario_facts(spark, sf), K, "dollars")


CI_B = 1000
_POISSON = X.poisson_thresholds()
#: forecasts of every origin and replicate from running sums; weights grow with the row instead of decaying, and are scaled back
def origins_sql(target: str) -> str:
    return f"""{RN}, reps as (select product, date, own, {target} as y, rn, r, {draw_sql('rn', 'r')} // {X.DRAW_MODULUS} as u from rows_, (select unnest(range(1, {CI_B + 1})) as r)),
  counted as (select *, power(0.98, -rn) * case {' '.join(f'when u < {b} then {k}' for k, b in enumerate(_POISSON))} else {len(_POISSON)} end as w from reps),
  sums as (select product, date, r, rn, own, y, {', '.join(f'sum({e}) over before as {n}' for n, e in (('sw', 'w'), ('sx', 'w*own'), ('sy', 'w*y'), ('sxx', 'w*own*own'), ('sxy', 'w*own*y')))}
   from counted window before as (partition by product, r order by rn rows between unbounded preceding and 1 preceding)),
  origin as (select product, date, r, own, y, sx/sw as mx, sy/sw as my, (sxy - sx*sy/sw)*power(0.98, rn - 1) as cxy, (sxx - sx*sx/sw)*power(0.98, rn - 1) as cxx from sums where rn > 30 and sw > 0),
  p as (select product, date, r, exp(y) as actual, exp(my + cxy/(cxx + 1)*(own - mx)) as pred from origin)"""


ORIGINS = origins_sql("y")


@query(
    "mod25_forecast_intervals",
    f"""with {ORIGINS}, q as (select product, date, quantile_cont(pred, [0.025, 0.25, 0.5, 0.75, 0.975]) as q from p group by 1,2)
  select product, date, {', '.join(f"round(q[{i + 1}], 6) as p{n}" for i, n in enumerate(['2_5', '25', '50', '75', '97_5']))} from q""",
)
def mod25(spark, sf):
    preds = rolling_replicates(spark, sf)
    out = fc.forecast_intervals(preds, ["product", "date"], "prediction", [2.5, 25, 50, 75, 97.5])
    return r6(out, *[c for c in out.columns if c.startswith("p") and c != "product"])


def rolling_replicates(spark, sf):
    preds = fc.origin_ensemble(t.weekly_model(spark, sf).select("product", "date", "own", "y"), K, "date", "y", ["own"], CI_B)
    return preds.withColumn("prediction", F.exp("prediction"))


@query(
    "mod26_regression_metrics",
    f"""with {ROLL}, m as (select product, {METRIC_SQL} from (select product, ln(y_true) as y_, ln(y_predict) as p_ from fr) group by 1),
  wt as (select product, sum(train_size*ln(y_true))/sum(train_size) as mu from fr group by 1),
  w as (select fr.product, 1 - sum(train_size*power(ln(y_true)-ln(y_predict),2))/sum(train_size*power(ln(y_true)-mu,2)) as weighted_r2,
   sum(train_size*abs((ln(y_true)-ln(y_predict))/ln(y_true)))/sum(train_size)*100 as weighted_mape from fr join wt on fr.product = wt.product group by 1)
  select m.product, n_observations, {metric_cols()}, {rnd('weighted_r2', 'weighted_r2')}, {rnd('weighted_mape', 'weighted_mape')} from m join w on m.product = w.product""",
)
def mod26(spark, sf):
    r = rolling(spark, sf).select("product", F.log("y_true").alias("a"), F.log("y_predict").alias("p"), "train_size")
    out = fc.regression_metrics(r, K, "a", "p").join(fc.weighted_metrics(r, K, "a", "p", "train_size"), K)
    return r6(out, *METRICS, "weighted_r2", "weighted_mape")


@query(
    "mod27_generalisation_gap",
    f"""with {SPLIT}, fit as (select product, regr_slope(y, own) as b, regr_intercept(y, own) as a from split where role='train' group by 1),
  p as (select split.product, role, y as y_, a + b*own as p_ from split join fit on split.product = fit.product),
  m as (select product, role, {METRIC_SQL} from p group by 1,2),
  g as (select a.product, a.r_squared as r0, b.r_squared as r1, a.mae as m0, b.mae as m1 from m a join m b on a.product = b.product and a.role='train' and b.role='test')
  select product, {rnd('r0 - r1', 'r_squared_gap')}, {rnd('case when abs(r0) > 1e-10 then (r0-r1)/r0*100 end', 'r_squared_relative_gap_pct', 3)}, {rnd('m0 - m1', 'mae_gap')},
   {rnd('(m0-m1)/m0*100', 'mae_relative_gap_pct')}, case when (r0-r1)/r0*100 <= 5 then 'EXCELLENT' when (r0-r1)/r0*100 <= 10 then 'GOOD' when (r0-r1)/r0*100 <= 20 then 'ACCEPTABLE'
   when (r0-r1)/r0*100 <= 40 then 'CONCERNING' else 'POOR' end as generalization_quality, r1 < 0 as worse_than_mean from g""",
)
def mod27(spark, sf):
    s = split(spark, sf)
    cols = ["own", "y"]
    fits = mo.fit_models(mo.moment_blocks(s.where("role = 'train'"), K, cols), K, cols, [("m", ["own"])])
    p = s.join(fits.select("product", "coef"), "product").withColumn("p", sc.linear_prediction("coef", [F.col("own")]))
    m = fc.regression_metrics(p, ["product", "role"], "y", "p")
    out = fc.generalization_gap(m.where("role = 'train'"), m.where("role = 'test'"), K, ["r_squared", "mae"])
    out = r6(out, "r_squared_gap", "mae_gap", "mae_relative_gap_pct")
    return r6(out, "r_squared_relative_gap_pct", decimals=3).select(
        "product", "r_squared_gap", "r_squared_relative_gap_pct", "mae_gap", "mae_relative_gap_pct", "generalization_quality", "worse_than_mean"
    )


# ---------------------------------------------------------------- residual diagnostics
RES = f"""{RN}, rf as (select product, regr_slope(y, own) as b, regr_intercept(y, own) as a from rows_ group by 1),
 res as (select rows_.*, y - (a + b*own) as e from rows_ join rf on rows_.product = rf.product)"""


def res(spark, sf):
    return dg.residuals(t.weekly_model(spark, sf), K, "y", ["own"])


@query(
    "mod33_autocorrelation",
    f"""with {RES}, d as (select product, date, e, e - avg(e) over (partition by product) as d from res),
  l as (select product, e, d, lag(e) over ({OVER}) as p, {', '.join(f'lag(d, {k}) over ({OVER}) as l{k}' for k in range(1, 11))} from d),
  g as (select product, count(*) as n, sum(power(e - p, 2))/sum(e*e) as dw, {', '.join(f'sum(d*l{k})/sum(d*d) as r{k}' for k in range(1, 11))} from l group by 1),
  q as (select product, n, dw, n*(n+2)*({'+'.join(f'r{k}*r{k}/(n-{k})' for k in range(1, 11))}) as lb from g)
  select product, n, {rnd('dw', 'durbin_watson')}, {rnd('lb', 'ljung_box')}, {rnd(chi2_even_sf_sql('lb', 10), 'ljung_box_p')} from q""",
)
def mod33(spark, sf):
    return r6(dg.autocorrelation(res(spark, sf), K, "date"), "durbin_watson", "ljung_box", "ljung_box_p")


@query(
    "mod34_heteroscedasticity",
    f"""with {RES}, q as (select product, own as x, own*own as x2, e*e as e2 from res),
  m as (select product, count(*) as n, covar_pop(x, e2) as c1, covar_pop(x2, e2) as c2, var_pop(x) as v1, var_pop(x2) as v2, covar_pop(x, x2) as v12, var_pop(e2) as ve from q group by 1),
  l as (select product, n*c1*c1/(v1*ve) as bp, n*(c1*(c1*v2 - c2*v12) + c2*(c2*v1 - c1*v12))/(v1*v2 - v12*v12)/ve as wh from m)
  select product, 'breusch_pagan' as test, {rnd('bp', 'lm')}, {rnd(chi2_1_sf_sql('bp'), 'p_value')} from l union all
  select product, 'white', {rnd('wh', 'lm')}, {rnd(chi2_even_sf_sql('wh', 2), 'p_value')} from l""",
)
def mod34(spark, sf):
    return r6(dg.heteroscedasticity(res(spark, sf), K, ["own"]), "lm", "p_value")


@query(
    "mod35_variance_inflation",
    f"""with {t.WEEKLY_MODEL}, c as (select product, corr(own, comp) as a, corr(own, tax) as b, corr(comp, tax) as c from wm group by 1),
  d as (select *, 1 + 2*a*b*c - a*a - b*b - c*c as det from c), v as (select product, 'own' as feature, (1-c*c)/det as vif from d union all
   select product, 'comp', (1-b*b)/det from d union all select product, 'tax', (1-a*a)/det from d)
  select product, feature, round(vif, 6) as vif, case when vif < 5 then 'LOW' when vif < 10 then 'MODERATE' when vif < 20 then 'HIGH' else 'SEVERE' end as band from v""",
)
def mod35(spark, sf):
    return r6(dg.variance_inflation(t.weekly_model(spark, sf), K, ["own", "comp", "tax"]), "vif")


@query(
    "mod36_residual_moments",
    f"""with {RES}, m as (select product, avg(e) as mu, var_pop(e) as v from res group by 1),
  s as (select res.product, count(*) as n, any_value(mu) as mean, sqrt(any_value(v)) as std, min(e) as min, max(e) as max, median(e) as median,
   avg(power(e-mu,3))/power(any_value(v),1.5) as skewness, avg(power(e-mu,4))/power(any_value(v),2) - 3 as kurtosis from res join m on res.product = m.product group by 1),
  j as (select *, n/6*(skewness*skewness + kurtosis*kurtosis/4) as jb from s)
  select product, n, {', '.join(rnd(c, c) for c in ('mean', 'std', 'min', 'max', 'median', 'skewness', 'kurtosis'))}, {rnd('jb', 'jarque_bera')}, {rnd('exp(-jb/2)', 'jarque_bera_p')} from j""",
)
def mod36(spark, sf):
    out = dg.residual_moments(res(spark, sf), K)
    return r6(out, "mean", "std", "min", "max", "median", "skewness", "kurtosis", "jarque_bera", "jarque_bera_p")


_P_SQL = "case when {p} < 0.001 then 'SEVERE' when {p} < 0.01 then 'MODERATE' when {p} < 0.05 then 'MILD' else 'NONE' end"
_PARTS = [
    ("mod33_autocorrelation", "'durbin_watson' as test, durbin_watson as statistic, null::double as p_value, "
     "case when durbin_watson < 1 or durbin_watson > 3 then 'SEVERE' when durbin_watson < 1.5 or durbin_watson > 2.5 then 'MODERATE' else 'NONE' end as severity"),
    ("mod33_autocorrelation", f"'ljung_box', ljung_box, ljung_box_p, {_P_SQL.format(p='ljung_box_p')}"),
    ("mod34_heteroscedasticity", f"test, lm, p_value, {_P_SQL.format(p='p_value')}"),
    ("mod36_residual_moments", "'jarque_bera', jarque_bera, jarque_bera_p, case when jarque_bera_p < 0.001 then 'MODERATE' when jarque_bera_p < 0.05 then 'MILD' else 'NONE' end"),
]


@query(
    "mod33_diagnostic_severities",
    "with report as (" + " union all ".join(f"select product, {cols} from ({ORACLE[name]})" for name, cols in _PARTS) + """)
  select product, test, 'residuals' as subject, statistic, p_value, severity, severity <> 'NONE' as violated from report""",
)
def mod33_severities(spark, sf):
    return r6(dg.severity_report(t.weekly_model(spark, sf), K, "date", "y", ["own"]), "statistic", "p_value")


@query(
    "mod18_cv_quality",
    f"""with f as ({ORACLE['mod18_expanding_window_cv']}), g as (select product, count(*) as total_folds, count(r_squared) as successful_folds, avg(r_squared) as a,
   stddev_pop(r_squared)/abs(nullif(avg(r_squared), 0)) as v from f group by 1)
  select product, total_folds, successful_folds, round(a, 6) + 0.0 as average_r2, round(v, 6) as r2_variation, successful_folds / total_folds as success_rate,
   case when a is null then 'FAILED' when v < 0.1 and a > 0.4 then 'EXCELLENT' when v < 0.2 and a > 0.3 then 'GOOD' when v < 0.3 and a > 0.2 then 'ACCEPTABLE' else 'POOR' end as cv_quality from g""",
)
def mod18_quality(spark, sf):
    return r6(fc.cv_summary(mod18(spark, sf), K), "average_r2", "r2_variation")


@query(
    "mod27_production_readiness",
    f"""with {SPLIT}, fit as (select product, regr_slope(y, own) as b, regr_intercept(y, own) as a from split where role='train' group by 1),
  pr as (select split.product, role, y as y_, a + b*own as p_ from split join fit on split.product = fit.product),
  m as (select product, role, {METRIC_SQL} from pr group by 1,2),
  j as (select a.product, a.r_squared as r0, b.r_squared as r1, b.mape as m1, bi.bias, bp.p_value < 0.05 as het from m a join m b on a.product = b.product and a.role='train' and b.role='test'
   join (select product, avg(y_ - p_) as bias from pr where role='test' group by 1) bi on bi.product = a.product
   join (select product, p_value from ({ORACLE['mod34_heteroscedasticity']}) where test = 'breusch_pagan') bp on bp.product = a.product),
  c as (select product, r1 >= 0.3 as test_r2_ok, m1 <= 25 as test_mape_ok, coalesce(case when abs(r0) > 1e-10 then (r0 - r1)/r0*100 end, 0) <= 30 as generalization_ok, abs(bias) <= 0.1 and not het as residuals_ok from j),
  n as (select *, test_r2_ok::integer + test_mape_ok::integer + generalization_ok::integer + residuals_ok::integer as checks_passed from c)
  select *, case when checks_passed = 4 then 'HIGH' when checks_passed >= 3 then 'MODERATE' when checks_passed >= 2 then 'LOW' else 'VERY LOW' end as confidence_level, checks_passed >= 3 as production_ready from n""",
)
def mod27_readiness(spark, sf):
    fitted = dg.residuals(split(spark, sf).where("role = 'train'"), K, "y", ["own"])
    coef = mo.fit_models(mo.moment_blocks(split(spark, sf).where("role = 'train'"), K, ["own", "y"]), K, ["own", "y"], [("m", ["own"])])
    test = split(spark, sf).where("role = 'test'").join(coef.select("product", F.col("coef").alias("c")), K)
    test = test.withColumn("fitted", F.col("c")[0] + F.col("c")[1] * F.col("own"))
    bias = test.groupBy(*K).agg(F.avg(F.col("y") - F.col("fitted")).alias("mean"))
    spread = dg.heteroscedasticity(res(spark, sf), K, ["own"]).where("test = 'breusch_pagan'")
    residuals = bias.join(spread.select(*K, (F.col("p_value") < 0.05).alias("heteroscedastic")), K)
    return fc.production_readiness(
        fc.regression_metrics(fitted, K, "y", "fitted"), fc.regression_metrics(test, K, "y", "fitted"), residuals, K
    )


@query(
    "mod35_inflation_severities",
    f"""select product, feature as subject, vif as statistic, case when vif > 20 then 'SEVERE' when vif > 10 then 'MODERATE' when vif > 5 then 'MILD' else 'NONE' end as severity,
   vif > 10 as violated from ({ORACLE['mod35_variance_inflation']})""",
)
def mod35_severities(spark, sf):
    out = dg.severity_report(t.weekly_model(spark, sf), K, "date", "y", ["own", "comp", "tax"]).where("test = 'variance_inflation'")
    return r6(out.select("product", "subject", "statistic", "severity", "violated"), "statistic")


@query(
    "mod37_residual_tests",
    f"""with {SPLIT}, f as (select product, regr_slope(y, own) as b, regr_intercept(y, own) as a from split where role='train' group by 1),
  e as (select split.product, role, y - a - b*own as e from split join f on split.product = f.product),
  tt as (select product, avg(e)/(stddev_samp(e)/sqrt(count(*))) as t_test from e where role='test' group by 1),
  md as (select product, role, median(e) as md from e group by 1,2), z as (select e.product, e.role, abs(e - md) as z from e join md on e.product = md.product and e.role = md.role),
  gz as (select product, role, count(*) as n, avg(z) as zm, var_pop(z) as zv from z group by 1,2),
  gg as (select *, sum(n*zm) over (partition by product)/sum(n) over (partition by product) as g from gz),
  lv as (select product, (sum(n) - 2)*sum(n*power(zm-g,2))/sum(n*zv) as levene from gg group by 1),
  cv as (select product, e, count(*) filter (where role='train') as a, count(*) filter (where role='test') as b from e group by 1,2),
  cc as (select product, sum(a) over (partition by product order by e) / sum(a) over (partition by product) as fa, sum(b) over (partition by product order by e) / sum(b) over (partition by product) as fb,
    sum(a) over (partition by product) as na, sum(b) over (partition by product) as nb from cv),
  ks as (select product, max(abs(fa - fb)) as d, any_value(na)::double as na, any_value(nb)::double as nb from cc group by 1),
  kl as (select *, sqrt(na*nb/(na+nb))*d as lam from ks)
  select tt.product, {rnd('t_test', 't_statistic')}, {rnd('levene', 'levene')}, {rnd('d', 'ks_distance')},
   round(greatest(0.0, least(1.0, 2*list_sum(list_transform(range(1, 101), lambda j: case when j % 2 = 1 then 1 else -1 end * exp(-2.0*j*j*lam*lam))))), 6) + 0.0 as ks_p
  from tt join lv on tt.product = lv.product join kl on kl.product = tt.product""",
)
def mod37(spark, sf):
    s = split(spark, sf)
    cols = ["own", "y"]
    fits = mo.fit_models(mo.moment_blocks(s.where("role = 'train'"), K, cols), K, cols, [("m", ["own"])])
    e = s.join(fits.select("product", "coef"), "product").select(
        "product", "role", (F.col("y") - sc.linear_prediction("coef", [F.col("own")])).alias("e")
    )
    tt = dg.mean_t_test(e.where("role = 'test'"), K, "e", with_p=False).select("product", "t_statistic")
    lv = dg.levene(e, K, "role", "e", with_p=False).select("product", "levene")
    ks = dg.ks_two_sample(e.withColumn("first", F.col("role") == "train"), K, "e", "first").select("product", "ks_distance", "ks_p")
    return r6(tt.join(lv, "product").join(ks, "product"), "t_statistic", "levene", "ks_distance", "ks_p")


__all__ = ["SPLIT", "ROLL", "split", "rolling", "rolling_replicates", "RES", "res"]
