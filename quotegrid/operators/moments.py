"""Distributed moment blocks (Gram matrices) and the fits solved from them.

Rows are reduced by ordinary partial aggregation to one block per (key, replicate,
fold, ...). Every candidate model is then solved from the same block, so the data
is read once however many models are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotegrid.functions import linear
from quotegrid.operators.windows import numbered, series_window

Model = tuple[str, list[str]]


def parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Blocks are tiny in bytes but costly to solve: keep AQE from putting them in one task."""
    return df.repartition(parallelism(df), *keys)


def beside(rows: DataFrame, one: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``one``, which has one row for each key; a missing key meets a missing key."""
    if not keys:
        return rows.crossJoin(F.broadcast(one))  # one row
    renamed = one.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return rows.join(renamed, same).drop(*[f"__k_{k}" for k in keys])


def beside_hot(rows: DataFrame, one: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`beside` for raw rows of which a few keys may hold most.

    A salt made of the row itself deals a key's rows to many tasks, and ``one`` is there once for each salt. Nothing after the join
    takes a key's rows to lie together, so partial sums are made before they are gathered.
    """
    if not keys:
        return beside(rows, one, keys)
    salts = parallelism(rows)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    each = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return beside(salted, each, [*keys, "__salt"]).drop("__salt")


# ---------------------------------------------------------------- blocks
def moment_blocks(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """n, mean and covariance of ``columns`` (target last) per key; complete rows expected."""
    cols = list(columns)
    cov = {(a, b): F.covar_pop(a, b) for i, a in enumerate(cols) for b in cols[i:]}
    aggs = [F.count(F.lit(1)).cast("double").alias("n")]
    aggs += [F.avg(c).alias(f"__m_{i}") for i, c in enumerate(cols)]
    aggs += [cov[a, b].alias(f"__c_{i}_{i + j}") for i, a in enumerate(cols) for j, b in enumerate(cols[i:])]
    return _packed(df.groupBy(*keys).agg(*aggs), keys, len(cols), ["n"])


def _packed(agg: DataFrame, keys: Sequence[str], size: int, extra: Sequence[str]) -> DataFrame:
    mean = F.array(*[F.col(f"__m_{i}") for i in range(size)])
    cov = F.array(*[F.col(f"__c_{min(i, j)}_{max(i, j)}") for i in range(size) for j in range(size)])
    return agg.select(*keys, *extra, mean.alias("mean"), cov.alias("cov"))


def centre(df: DataFrame, keys: Sequence[str], columns: Sequence[str], raw: bool = False) -> DataFrame:
    """Subtract per-key means and keep them; sums of products then lose no digits.

    Calendar-bounded series take the mean from a window (one pass, the partitioning is
    needed anyway); ``raw`` rows join a first aggregate by a salt too, so a hot key is never gathered.
    """
    if raw:
        means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"__mu_{c}") for c in columns])
        joined = beside_hot(df.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys], F.lit(True))), means, keys)
    else:
        joined = df.withColumns({f"__mu_{c}": F.avg(c).over(series_window(keys)) for c in columns})
    rest = [c for c in df.columns if c not in columns]
    return joined.select(
        *rest,
        *[(F.col(c) - F.col(f"__mu_{c}")).alias(c) for c in columns],
        F.array(*[F.col(f"__mu_{c}") for c in columns]).alias("__centre"),
    )


def weighted_blocks(
    centred: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    weight: str | Column | None = None,
    count: str | Column | None = None,
) -> DataFrame:
    """Blocks from rows prepared by :func:`centre`.

    ``count`` multiplies rows (resampling), ``weight`` only weighs them:
    n = sum(count), sw = sum(weight x count), slw = sum(count x ln weight).
    """
    cols = list(columns)
    c = F.lit(1.0) if count is None else (F.col(count) if isinstance(count, str) else count).cast("double")
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    cw = c * w
    sums = [F.sum(c).alias("n"), F.sum(cw).alias("sw"), F.sum(c * F.log(w)).alias("slw")]
    sums += [F.first("__centre").alias("__centre")]
    sums += [F.sum(cw * F.col(x)).alias(f"__s_{i}") for i, x in enumerate(cols)]
    sums += [
        F.sum(cw * F.col(a) * F.col(b)).alias(f"__p_{i}_{i + j}")
        for i, a in enumerate(cols)
        for j, b in enumerate(cols[i:])
    ]
    return _finish_sums(centred.groupBy(*keys).agg(*sums), keys, len(cols))


def _finish_sums(agg: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    sw = F.col("sw")
    m = [F.col(f"__s_{i}") / sw for i in range(size)]
    out = agg.select(
        *keys,
        "n",
        "sw",
        "slw",
        *[(m[i] + F.col("__centre")[i]).alias(f"__m_{i}") for i in range(size)],
        *[(F.col(f"__p_{i}_{j}") / sw - m[i] * m[j]).alias(f"__c_{i}_{j}") for i in range(size) for j in range(i, size)],
    )
    return _packed(out, keys, size, ["n", "sw", "slw"])


def prefix_blocks(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], decay: float | None = None
) -> DataFrame:
    """For every row the block of all earlier rows of its series: window passes for all origins.

    Decay weights ``r ** (t - 1 - k)``. The series is cut into spans of ``m`` positions with ``r ** m`` below
    1e-100: a row's sums are those of the earlier rows of its span, rescaled from the span's start, plus those of
    the span before. What lies further back weighs less than 1e-100 and is beyond a double's digits.
    """
    cols = list(columns)
    rows = centre(df, keys, cols)
    pos = (F.row_number().over(series_window(keys, order)) - 1).cast("double")
    rows = rows.withColumn("__pos", pos)
    before = series_window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    terms = {"sw": F.lit(1.0)}
    terms |= {f"__s_{i}": F.col(x) for i, x in enumerate(cols)}
    terms |= {f"__p_{i}_{i + j}": F.col(a) * F.col(b) for i, a in enumerate(cols) for j, b in enumerate(cols[i:])}
    if decay is None or decay == 1:
        sums = [F.sum(x).over(before).alias(name) for name, x in terms.items()]
    else:
        size = max(1, int(-230.0 / math.log(decay)))
        rows = rows.withColumn("__span", F.floor(F.col("__pos") / size)).withColumn("__at", F.col("__pos") - F.col("__span") * size)
        r = F.lit(decay)
        here = series_window([*keys, "__span"], order).rowsBetween(Window.unboundedPreceding, -1)
        earlier = series_window(keys, "__span").rangeBetween(-1, -1)
        grown, shrunk = F.pow(1 / r, F.col("__at")), F.pow(r, F.lit(float(size - 1)) - F.col("__at"))
        rows = rows.withColumns({"__grown": grown, "__shrunk": shrunk})
        sums = [
            (
                F.coalesce(F.sum(F.col("__grown") * x).over(here), F.lit(0.0)) * F.pow(r, F.col("__at") - 1)
                + F.coalesce(F.sum(F.col("__shrunk") * x).over(earlier), F.lit(0.0)) * F.pow(r, F.col("__at"))
            ).alias(name)
            for name, x in terms.items()
        ]
    sums = [F.count(F.lit(1)).over(before).cast("double").alias("n"), *sums, F.lit(0.0).alias("slw")]
    current = F.array(*[F.col(c) + F.col("__centre")[i] for i, c in enumerate(cols)]).alias("row")
    agg = rows.select(*keys, order, current, "__centre", *sums).where(F.col("n") > 0)
    return _finish_sums(agg, [*keys, order, "row"], len(cols))


# ---------------------------------------------------------------- model lists
def all_subsets(base: Sequence[str], candidates: Sequence[str], max_size: int) -> list[Model]:
    """Base features plus every combination of up to ``max_size`` candidates, repeats dropped."""
    pool = [c for c in dict.fromkeys(candidates) if c not in base]
    out: dict[str, list[str]] = {}
    for k in range(1, max_size + 1):
        for combo in combinations(pool, k):
            features = [*base, *combo]
            out.setdefault(" + ".join(features), features)
    return list(out.items())


# ---------------------------------------------------------------- fits
FIT_SCHEMA = (
    "model_id string, n_features int, n_obs bigint, aic double, bic double, r2 double, adj_r2 double, "
    "ssr double, converged boolean, terms array<string>, coef array<double>, se array<double>"
)


def _key_ddl(df: DataFrame, keys: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{k}` {types[k]}, " for k in keys)


def _fit_frame(keys: pd.DataFrame, name: str, features: list[str], n: np.ndarray, r: dict) -> pd.DataFrame:
    out = keys.copy()
    ok = r["ok"]
    out["model_id"] = name
    out["n_features"] = len(features)
    out["n_obs"] = n.astype("int64")
    for c in ("aic", "bic", "r2", "adj_r2", "ssr"):
        out[c] = np.where(ok, r[c], np.nan)
    out["converged"] = ok
    terms = ["Intercept", *features]
    out["terms"] = [terms] * len(out)
    out["coef"] = list(r["coef"])
    out["se"] = list(r["se"])
    return out


def _in_chunks(blocks: DataFrame, keys: Sequence[str], models: int, step: int) -> DataFrame:
    """Repeats every block for each chunk of models and deals (key, chunk) out, so one key uses many tasks."""
    chunks = max(1, -(-models // step))
    out = blocks.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return out.repartition(parallelism(blocks), *keys, "__chunk")


def fit_models(
    blocks: DataFrame, keys: Sequence[str], columns: Sequence[str], models: Sequence[Model], models_per_task: int = 64
) -> DataFrame:
    """Least squares of every model on every block; one row per (key, model)."""
    pos = {c: i for i, c in enumerate(columns)}
    plan = [(name, feats, [pos[f] for f in feats]) for name, feats in models]
    size, key_list = len(columns), list(keys)
    weighted = "slw" in blocks.columns

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            n = pdf["n"].to_numpy(float)
            mean = np.stack(pdf["mean"].to_numpy())
            cov = np.stack(pdf["cov"].to_numpy()).reshape(-1, size, size)
            # weights scale the residual sum; the number of rows does not change
            scale = pdf["sw"].to_numpy(float) / n if weighted else np.ones_like(n)
            logw = pdf["slw"].to_numpy(float) if weighted else None
            chunk = pdf["__chunk"].to_numpy()
            for k in np.unique(chunk):
                at = chunk == k
                for name, feats, idx in plan[k * models_per_task : (k + 1) * models_per_task]:
                    w = logw[at] if weighted else None
                    fit = linear.ols(n[at], mean[at], cov[at] * scale[at, None, None], idx, w, (n * scale)[at])
                    yield _fit_frame(pdf.loc[at, key_list], name, feats, n[at], fit)

    wanted = [*key_list, "n", "mean", "cov", *(["sw", "slw"] if weighted else [])]
    out = _in_chunks(blocks.select(*wanted), key_list, len(plan), models_per_task)
    return _nan_free(out.mapInPandas(solve, _key_ddl(blocks, keys) + FIT_SCHEMA))


def _nan_free(df: DataFrame) -> DataFrame:
    from quotegrid.functions.exprs import nan_to_null

    return df.withColumns({c: nan_to_null(c) for c in ("aic", "bic", "r2", "adj_r2", "ssr")})


def coefficient_rows(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long coefficient table: one row per (key, model, term)."""
    z = F.arrays_zip("terms", "coef", "se")
    return fits.select(*keys, "model_id", "n_obs", "n_features", F.explode(z).alias("z")).select(
        *keys,
        "model_id",
        "n_obs",
        "n_features",
        F.col("z.terms").alias("term"),
        F.col("z.coef").alias("coef"),
        F.col("z.se").alias("se"),
    )


def ridge_fits(
    blocks: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    features: Sequence[str],
    alpha: float,
    positive: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Weighted ridge per block: ``coef`` = [intercept, slopes...] in the order of ``features``."""
    pos = {c: i for i, c in enumerate(columns)}
    idx = [pos[f] for f in features]
    size, key_list = len(columns), [*keys, *keep]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            mean = np.stack(pdf["mean"].to_numpy())
            cov = np.stack(pdf["cov"].to_numpy()).reshape(-1, size, size)
            out = pdf[key_list].copy()
            out["n_obs"] = pdf["n"].astype("int64")
            out["coef"] = list(linear.ridge(pdf["sw"].to_numpy(float), mean, cov, idx, alpha, positive))
            yield out

    src = blocks if "sw" in blocks.columns else blocks.withColumn("sw", F.col("n"))
    src = src.select(*key_list, "n", "sw", "mean", "cov")
    src = spread_rows(src, *keys) if keys else src
    return src.mapInPandas(solve, _key_ddl(blocks, key_list) + "n_obs bigint, coef array<double>")


def numbered_folds(df: DataFrame, keys: Sequence[str], order: str, folds: int) -> DataFrame:
    """Rows with ``fold``: contiguous parts of every series; the first n % folds of them are one row longer."""
    rows = numbered(df, keys, order)
    size_lo, extra = F.floor(F.col("n") / folds), F.col("n") % folds
    big = extra * (size_lo + 1)
    at = F.col("rn") - 1
    fold = F.when(at < big, F.floor(at / (size_lo + 1))).otherwise(extra + F.floor((at - big) / size_lo))
    return rows.withColumn("fold", fold.cast("int"))
