"""Feature subsets by rank: enumeration and fits without a list or a table of models.

Subsets of up to ``max_size`` of ``p`` candidates are numbered: smaller sizes first, within a size by the combinatorial
number system. A task turns a range of numbers into its own subsets, so (key, range) is the unit of work, models are
neither joined nor listed on the driver, and one key uses as many tasks as it has ranges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegrid.functions import linear
from quotegrid.functions.exprs import nan_to_null
from quotegrid.operators.moments import FIT_SCHEMA, _key_ddl, _nan_free, beside, beside_hot, numbered_folds, parallelism

PER_RANGE = 256


# ---------------------------------------------------------------- numbers and subsets
def subset_count(p: int, max_size: int) -> int:
    return sum(comb(p, k) for k in range(1, max_size + 1))


def unrank(lo: int, hi: int, p: int, size: int) -> np.ndarray:
    """Subsets lo..hi-1 of ``size`` out of ``p``, a row each, positions ascending."""
    left = np.arange(lo, hi, dtype=np.int64)
    out = np.empty((len(left), size), dtype=np.int64)
    for k in range(size, 0, -1):
        steps = np.array([comb(c, k) for c in range(p + 1)], dtype=np.int64)
        out[:, k - 1] = np.searchsorted(steps, left, side="right") - 1
        left = left - steps[out[:, k - 1]]
    return out


def subsets_between(lo: int, hi: int, p: int, max_size: int) -> Iterator[np.ndarray]:
    """Subsets numbered lo..hi-1, one array for each size among them."""
    first = 0
    for size in range(1, max_size + 1):
        n = comb(p, size)
        a, b = max(lo - first, 0), min(hi - first, n)
        if a < b:
            yield unrank(a, b, p, size)
        first += n


def enumerate_ranges(candidates: DataFrame, name: str, base: Sequence[str], max_size: int, per_range: int = 4096) -> DataFrame:
    """``model_id``, ``features``, ``n_features`` of every subset of the names in a column, behind the base features."""
    fixed = list(base)
    names = candidates.where(F.col(name).isNotNull() & ~F.col(name).isin(fixed or [""])).agg(F.sort_array(F.collect_set(name)).alias("names"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pool in batch["names"]:
                total = subset_count(len(pool), max_size)
                yield pd.DataFrame({"names": [list(pool)], "total": [total]})

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pool, total, number in zip(batch["names"], batch["total"], batch["number"]):
                lo = int(number) * per_range
                for picked in subsets_between(lo, min(lo + per_range, int(total)), len(pool), max_size):
                    features = [[*fixed, *(pool[i] for i in row)] for row in picked.tolist()]
                    yield pd.DataFrame({"model_id": [" + ".join(f) for f in features], "features": features, "n_features": len(fixed) + picked.shape[1]})

    sized = names.mapInPandas(split, "names array<string>, total bigint").where("total > 0")
    last = F.floor((F.col("total") - 1) / per_range)
    ranges = sized.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("number"))
    dealt = ranges.repartition(parallelism(candidates), "number")
    return dealt.mapInPandas(spell, "model_id string, features array<string>, n_features int")


# ---------------------------------------------------------------- sums by null pattern
def pattern_sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Sums of products of [1, columns] for every key and null pattern: keys, groups, missing, centre, sums.

    Values are centred by the key's means, so that sums of products lose no digits; sums add up over patterns, folds
    and tasks. A task holds one matrix for each key and pattern that it has met since it last handed them on.
    """
    cols, all_keys = list(columns), [*keys, *groups]
    size = len(cols) + 1
    clean = df.select(*all_keys, *[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    means = clean.groupBy(*keys).agg(F.array(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in cols]).alias("centre"))
    joined = beside(clean, means, keys)
    most = max(1, (1 << 22) // (size * size))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        centres: dict[tuple, list[float]] = {}

        def handed() -> pd.DataFrame:
            rows = [(*k, centres[k], s.tobytes()) for k, s in held.items()]
            return pd.DataFrame(rows, columns=[*all_keys, "missing", "centre", "sums"])

        for batch in batches:
            if not len(batch):
                continue
            x = batch[cols].to_numpy(float)
            missing = np.isnan(x)
            marks = np.packbits(missing, axis=1)
            parts = batch[all_keys].assign(__m=[m.tobytes() for m in marks])
            for _, at in parts.groupby([*all_keys, "__m"], dropna=False, sort=False).indices.items():
                i = at[0]
                key = (*_key([batch[k].iloc[i] for k in all_keys]), parts["__m"].iloc[i])
                centre = np.asarray(batch["centre"].iloc[i], float)
                z = np.column_stack((np.ones(len(at)), np.where(missing[at], 0.0, x[at] - centre)))
                held[key] = held.get(key, 0.0) + z.T @ z
                centres[key] = centre.tolist()
            if len(held) > most:
                yield handed()
                held, centres = {}, {}
        if held:
            yield handed()

    ddl = _key_ddl(df, all_keys) + "missing binary, centre array<double>, sums binary"
    parts = joined.mapInPandas(gather, ddl)
    names = [*all_keys, "missing"]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, centre, total = None, None, None
        for batch in batches:
            out = []
            for *mine, c, raw in zip(*(batch[n] for n in (*names, "centre", "sums"))):
                if _key(mine) == key:
                    total = total + np.frombuffer(raw)
                    continue
                if key is not None:
                    out.append((*key, centre, total.tobytes()))
                key, centre, total = _key(mine), c, np.frombuffer(raw)
            yield pd.DataFrame(out, columns=[*names, "centre", "sums"])
        if key is not None:
            yield pd.DataFrame([(*key, centre, total.tobytes())], columns=[*names, "centre", "sums"])

    return parts.repartition(parallelism(df), *names).sortWithinPartitions(*names).mapInPandas(add, ddl)


def _key(values: Sequence) -> tuple:
    """A key that equals itself, also where pandas made NaN of a missing number."""
    return tuple(None if v is None or v != v else v for v in values)


def _missing(raw: bytes, columns: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=columns).astype(bool)


def _moments(sums: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, means and covariances (target last) from sums of products of [1, features, target], one per model."""
    n = sums[:, 0, 0]
    with np.errstate(all="ignore"):
        m = sums[:, 0, 1:] / n[:, None]
        cov = sums[:, 1:, 1:] / n[:, None, None] - m[:, :, None] * m[:, None, :]
    return n, m + centre, cov


class _Models:
    """Sums of each model of one range, over the null patterns that leave its columns filled."""

    def __init__(self, picked: np.ndarray, target: int):
        self.columns = np.column_stack((picked, np.full(len(picked), target)))
        self.at = np.column_stack((np.zeros(len(picked), dtype=np.int64), self.columns + 1))
        self.sums = np.zeros((len(picked), self.at.shape[1], self.at.shape[1]))

    def add(self, missing: np.ndarray, sums: np.ndarray) -> None:
        whole = ~missing[self.columns].any(axis=1)
        at = self.at[whole]
        self.sums[whole] += sums[at[:, :, None], at[:, None, :]]


def _fit_rows(key: dict, names: list[str], models: _Models, centre: np.ndarray) -> pd.DataFrame:
    n, mean, cov = _moments(models.sums, centre[models.columns])
    some = np.flatnonzero(n > 0)
    k = models.columns.shape[1] - 1
    r = linear.ols(n[some], mean[some], cov[some], range(k))
    features = [[names[c] for c in row[:-1]] for row in models.columns[some].tolist()]
    ok = r["ok"]
    out = pd.DataFrame({c: [v] * len(some) for c, v in key.items()}, index=range(len(some)))
    out["model_id"] = [" + ".join(f) for f in features]
    out["n_features"], out["n_obs"] = k, n[some].round().astype("int64")
    for c in ("aic", "bic", "r2", "adj_r2", "ssr"):
        out[c] = np.where(ok, r[c], np.nan)
    out["converged"] = ok
    out["terms"] = [["Intercept", *f] for f in features]
    out["coef"], out["se"] = list(r["coef"]), list(r["se"])
    return out


def _by_key_and_range(patterns: DataFrame, keys: Sequence[str], ranges: int) -> DataFrame:
    """Every pattern once for each range of models, dealt out by (key, range)."""
    each = patterns.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(max(ranges, 1) - 1))))
    names = [*keys, "range"]
    return each.repartition(parallelism(patterns), *names).sortWithinPartitions(*names)


def fit_subsets(
    df: DataFrame,
    keys: Sequence[str],
    target: str,
    candidates: Sequence[str],
    max_size: int,
    base: Sequence[str] = (),
    per_range: int = PER_RANGE,
) -> DataFrame:
    """Least squares of every subset of up to ``max_size`` candidates behind the base features, listwise deletion each.

    Rows are summed by null pattern; a model adds up the patterns that leave its own columns filled while they stream
    by, so a task holds the sums of one range of models, however many patterns there are.
    """
    pool = [c for c in dict.fromkeys(candidates) if c not in base]
    cols, key_list = [*base, *pool, target], list(keys)
    fixed, p = len(base), len(pool)
    total = subset_count(p, max_size)

    def models_of(number: int) -> list[_Models]:
        lo = number * per_range
        return [
            _Models(np.column_stack((np.tile(np.arange(fixed), (len(picked), 1)), picked + fixed)).astype(np.int64), len(cols) - 1)
            for picked in subsets_between(lo, min(lo + per_range, total), p, max_size)
        ]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, models, centre = None, [], None

        def fits() -> Iterator[pd.DataFrame]:
            for m in models:
                yield _fit_rows(dict(zip(key_list, held)), cols, m, centre)

        for batch in batches:
            for *mine, missing, c, raw in zip(*(batch[n] for n in (*key_list, "range", "missing", "centre", "sums"))):
                if _key(mine) != held:
                    yield from fits()
                    held, models, centre = _key(mine), models_of(int(mine[-1])), np.asarray(c, float)
                sums = np.frombuffer(raw).reshape(len(cols) + 1, -1)
                for m in models:
                    m.add(_missing(missing, len(cols)), sums)
        yield from fits()

    patterns = pattern_sums(df, keys, cols)
    dealt = _by_key_and_range(patterns, keys, -(-total // per_range))
    return _nan_free(dealt.mapInPandas(solve, _key_ddl(df, keys) + FIT_SCHEMA))


def fit_listed(
    df: DataFrame, keys: Sequence[str], target: str, features: Sequence[str], models: DataFrame, chunks: int = 8
) -> DataFrame:
    """Fits of the models in a table (``features``: array of names), listwise deletion each; dealt out by (key, chunk)."""
    cols, key_list = [*features, target], list(keys)
    pos = {c: i for i, c in enumerate(cols)}
    patterns = pattern_sums(df, keys, cols).withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    chunk = F.pmod(F.xxhash64("features"), F.lit(chunks)).cast("int")
    listed = models.select("features", chunk.alias("range")).distinct()
    wanted = listed.join(patterns.select(*keys, "range").distinct(), "range")
    wanted = wanted.toDF(*wanted.columns)  # columns of their own, apart from those of the patterns
    names = [*key_list, "range"]

    def solve(blocks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(asked):
            return pd.DataFrame(columns=[*key_list, *(f.split()[0] for f in FIT_SCHEMA.split(", "))])
        by_size: dict[int, list[list[int]]] = {}
        for row in asked["features"]:
            by_size.setdefault(len(row), []).append([pos[f] for f in row])
        models = [_Models(np.array(rows, dtype=np.int64), len(cols) - 1) for rows in by_size.values()]
        for missing, raw in zip(blocks["missing"], blocks["sums"]):
            for m in models:
                m.add(_missing(missing, len(cols)), np.frombuffer(raw).reshape(len(cols) + 1, -1))
        centre = np.asarray(blocks["centre"].iloc[0], float)
        key = {k: blocks[k].iloc[0] for k in key_list}
        return pd.concat([_fit_rows(key, cols, m, centre) for m in models])

    out = patterns.groupBy(*names).cogroup(wanted.groupBy(*names)).applyInPandas(solve, _key_ddl(df, keys) + FIT_SCHEMA)
    return _nan_free(out)


# ---------------------------------------------------------------- ridge over subsets, folds and alphas
def ridge_paths(train: tuple, test: tuple, alphas: np.ndarray) -> np.ndarray:
    """R2 on the test fold, [model, alpha], from one eigendecomposition a model; blocks are (n, mean, cov), target last."""
    (n, mean, cov), (tn, tm, tc) = train, test
    k = mean.shape[1] - 1
    value, vector = np.linalg.eigh(cov[:, :k, :k] * n[:, None, None])
    turned = np.einsum("mij,mi->mj", vector, cov[:, :k, k] * n[:, None])
    beta = np.einsum("mij,maj->mai", vector, turned[:, None, :] / (value[:, None, :] + alphas[None, :, None]))
    intercept = mean[:, None, k] - np.einsum("mai,mi->ma", beta, mean[:, :k])
    bias = tm[:, None, k] - intercept - np.einsum("mai,mi->ma", beta, tm[:, :k])
    sse = tc[:, None, k, k] - 2 * np.einsum("mai,mi->ma", beta, tc[:, :k, k]) + np.einsum("mai,mij,maj->ma", beta, tc[:, :k, :k], beta) + bias**2
    with np.errstate(all="ignore"):
        return 1 - sse / tc[:, None, k, k]


def ridge_cv_subsets(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    target: str,
    candidates: Sequence[str],
    max_size: int,
    alphas: Sequence[float],
    folds: int = 5,
    per_range: int = PER_RANGE,
) -> DataFrame:
    """Contiguous k-fold ridge of every subset over all alphas; rows with a missing value are left out before folding."""
    pool, key_list, grid = list(dict.fromkeys(candidates)), list(keys), np.asarray(alphas, float)
    cols = [*pool, target]
    whole = df.select(*keys, order, *cols).dropna(subset=cols)
    sums = pattern_sums(numbered_folds(whole, keys, order, folds).select(*keys, "fold", *cols), keys, cols, ["fold"])
    total = subset_count(len(pool), max_size)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, parts, centre = None, {}, None

        def fits() -> Iterator[pd.DataFrame]:
            if held is None or len(parts) < 2:
                return
            lo = int(held[-1]) * per_range
            every = sum(parts.values())
            for picked in subsets_between(lo, min(lo + per_range, total), len(pool), max_size):
                columns = np.column_stack((picked, np.full(len(picked), len(pool))))
                at = np.column_stack((np.zeros(len(picked), dtype=np.int64), columns + 1))
                own = lambda s: _moments(s[at[:, :, None], at[:, None, :]], centre[columns])
                table = np.stack([ridge_paths(own(every - s), own(s), grid) for _, s in sorted(parts.items())])  # fold, model, alpha
                mean = table.mean(axis=0)
                best = np.argmax(mean, axis=1)
                row = np.arange(len(picked))
                n, m, cov = own(every)
                k = picked.shape[1]
                beta = np.linalg.solve(cov[:, :k, :k] * n[:, None, None] + grid[best][:, None, None] * np.eye(k), (cov[:, :k, k] * n[:, None])[..., None])[..., 0]
                coef = np.column_stack((m[:, k] - (beta * m[:, :k]).sum(axis=1), beta))
                out = pd.DataFrame({c: [v] * len(picked) for c, v in zip(key_list, held)}, index=row)
                out["model_id"] = [" + ".join(pool[c] for c in r) for r in picked.tolist()]
                out["n_features"], out["best_alpha"] = k, grid[best]
                out["cv_mean"], out["cv_std"], out["coef"] = mean[row, best], table[:, row, best].std(axis=0), list(coef)
                yield out

        for batch in batches:
            for *mine, fold, c, raw in zip(*(batch[n] for n in (*key_list, "range", "fold", "centre", "sums"))):
                if _key(mine) != held:
                    yield from fits()
                    held, parts, centre = _key(mine), {}, np.asarray(c, float)
                parts[int(fold)] = np.frombuffer(raw).reshape(len(cols) + 1, -1)
        yield from fits()

    dealt = _by_key_and_range(sums, keys, -(-total // per_range))
    ddl = "model_id string, n_features int, best_alpha double, cv_mean double, cv_std double, coef array<double>"
    return dealt.mapInPandas(solve, _key_ddl(df, keys) + ddl)


# ---------------------------------------------------------------- stepwise by sweeps
def sweep(a: np.ndarray, columns: Sequence[int]) -> np.ndarray:
    """The sweep operator on a symmetric block; swept columns become regressors of all others."""
    a = a.copy()
    for k in columns:
        d = a[k, k]
        row = a[k] / d
        a = a - np.outer(a[:, k], row)
        a[k], a[:, k] = row, row
        a[k, k] = -1.0 / d
    return a


def stepwise_sweeps(
    blocks: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    candidates: Sequence[Sequence[str]],
    rounds: int,
    start: Sequence[str] = (),
    per_chunk: int = 16,
) -> DataFrame:
    """Greedy forward search by AIC; a candidate may add several columns at once.

    A key's block is carried from round to round, swept by what was chosen. In a round, tasks score chunks of candidates
    on the swept block (one division for a single column), the smallest AIC is kept by an aggregate, and so is its block.
    """
    pos = {c: i for i, c in enumerate(columns)}
    size, key_list, target = len(columns), list(keys), len(columns) - 1
    weighted = "slw" in blocks.columns
    wanted = [[pos[c] for c in cand] for cand in candidates]
    chunks = max(1, -(-len(wanted) // per_chunk))
    ddl = _key_ddl(blocks, keys) + "n double, logw double, chosen array<int>, swept binary, steps array<struct<added:array<int>,aic:double>>"
    scale = F.col("sw") / F.col("n") if weighted else F.lit(1.0)
    logw = F.col("slw") if weighted else F.lit(0.0)

    def aic_of(n: float, logw: float, rss: float, k: int) -> float:
        return n * (np.log(2 * np.pi) + np.log(max(rss, 0.0) / n) + 1) - logw + 2 * k

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first = [pos[c] for c in start]
            out = batch[key_list].copy()
            out["n"], out["logw"] = batch["n"], batch["logw"]
            out["chosen"] = [first] * len(batch)
            out["swept"] = [
                sweep(np.asarray(c, float).reshape(size, size) * s * n, first).tobytes() for c, s, n in zip(batch["cov"], batch["scale"], batch["n"])
            ]
            out["steps"] = [[] for _ in range(len(batch))]
            yield out

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for *key, n, lw, chosen, raw, steps, chunk in zip(*(batch[c] for c in (*key_list, "n", "logw", "chosen", "swept", "steps", "chunk"))):
                a, chosen = np.frombuffer(raw).reshape(size, size), [int(c) for c in chosen]
                best = None
                for number in range(chunk * per_chunk, min((chunk + 1) * per_chunk, len(wanted))):
                    new = [c for c in wanted[number] if c not in chosen]
                    scale = np.array([original_scale(a, c, chosen) for c in new])
                    if not new or n <= len(chosen) + len(new) + 1 or not (scale > 0).all():
                        continue
                    part = a[np.ix_(new, new)] / np.sqrt(np.outer(scale, scale))
                    if np.linalg.eigvalsh(part)[0] <= 1e-12:
                        continue
                    b = a[new, target]
                    rss = a[target, target] - b @ np.linalg.solve(a[np.ix_(new, new)], b)
                    aic = aic_of(n, lw, rss, len(chosen) + len(new) + 1)
                    if np.isfinite(aic) and (best is None or aic < best[0]):
                        best = (aic, number, new)
                done = [([int(c) for c in s["added"]], float(s["aic"])) for s in steps]
                if best is None:
                    out.append((*key, n, lw, chosen, raw, done, None, None))
                else:
                    out.append((*key, n, lw, chosen + best[2], sweep(a, best[2]).tobytes(), [*done, (best[2], best[0])], best[0], best[1]))
            yield pd.DataFrame(out, columns=[*key_list, "n", "logw", "chosen", "swept", "steps", "aic", "number"], dtype=object)

    state = blocks.select(*keys, "n", logw.alias("logw"), scale.alias("scale"), "cov").mapInPandas(begin, ddl)
    fields = ["n", "logw", "chosen", "swept", "steps"]
    for _ in range(rounds):
        spread = state.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(parallelism(blocks), *keys, "chunk")
        scored = spread.mapInPandas(score, ddl + ", aic double, number int")
        # a key without a candidate left keeps its state
        place = F.struct(F.col("aic").isNull(), F.col("aic"), F.col("number"))
        state = scored.groupBy(*keys).agg(F.min_by(F.struct(*fields), place).alias("s")).select(*keys, "s.*")
    names = F.array(*[F.lit(c) for c in columns])
    spelt = lambda added: F.array_join(F.transform(added, lambda c: F.get(names, c)), " + ")
    first = F.array(*[F.lit(pos[c]) for c in start]).cast("array<int>")
    steps = state.select(*keys, F.col("steps.added").alias("all"), F.posexplode("steps").alias("at", "s"))
    chosen = F.concat(first, F.flatten(F.slice("all", F.lit(1), F.col("at") + 1)))
    return steps.select(
        *keys, (F.col("at") + 1).alias("step"), spelt(F.col("s.added")).alias("added"), spelt(chosen).alias("features"), F.col("s.aic").alias("aic")
    )


def original_scale(swept: np.ndarray, column: int, chosen: list[int]) -> float:
    """The column's own sum of squares before the chosen ones were swept, against which a remainder is judged."""
    if not chosen:
        return float(swept[column, column])
    s = -np.linalg.inv(swept[np.ix_(chosen, chosen)])
    b = swept[chosen, column]
    return float(swept[column, column] + b @ s @ b)
