"""Resampling: row draws made in tasks, moment blocks shared by all models.

Draws come from integer arithmetic on (slot, replicate), see ``exprs.with_draw``: a
recomputed task repeats its draws exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrid.functions import exprs as X
from quotegrid.functions import linear
from quotegrid.operators.moments import _key_ddl, centre, parallelism, ridge_fits
from quotegrid.operators.windows import numbered


#: numbers that a task draws at once, and replicates of one chunk at most
DRAWN, CHUNK = 1 << 22, 125
#: Poisson counts made at once: their arithmetic stays in a core's cache
CACHED = 1 << 15


def replicate_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    replicates: int,
    weight: str | None = None,
    block_sizes: Sequence[int] | None = None,
    overlap: bool = True,
) -> DataFrame:
    """One moment block per (key, replicate[, block_size]), shared by every model.

    A series travels once for each chunk of replicates, not once for each: (key, block size, chunk) is dealt out, so one
    series uses several tasks. A task makes the counts of its own replicates from their seeds and adds up rows as
    they stream by; it holds ``DRAWN`` counts, so chunks of a longer series have fewer replicates.
    """
    cols, key_list = list(columns), list(keys)
    rows = numbered(df.select(*keys, order, *cols, *([weight] if weight else [])), keys, order)
    rows = centre(rows, keys, cols).drop(order)
    sized = block_sizes is not None
    each = F.greatest(F.lit(1), F.least(F.lit(CHUNK), F.floor(F.lit(DRAWN) / F.col("n")))).cast("int")
    jobs = rows.withColumn("__size", F.explode(F.array(*[F.lit(int(b)) for b in (block_sizes if sized else [0])])))
    jobs = jobs.withColumn("__each", each).withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(replicates) / F.col("__each")).cast("int") - 1))
    )
    names = [*keys, "__size", "__chunk"]
    jobs = jobs.repartition(parallelism(df), *names).sortWithinPartitions(*names, "rn")
    p = len(cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, counts, reps, sums, extra, middle = None, None, None, None, None, None

        def blocks() -> pd.DataFrame:
            n, sw = extra[:, 0], sums[:, 0]
            mean = sums[:, 1 : p + 1] / sw[:, None]
            cov = sums[:, p + 1 :].reshape(-1, p, p) / sw[:, None, None] - mean[:, :, None] * mean[:, None, :]
            out = pd.DataFrame({"replicate": reps.astype("int32"), "n": n, "sw": sw, "slw": extra[:, 1]})
            out["mean"], out["cov"] = list(mean + middle), list(cov.reshape(len(reps), -1))
            for name, value in zip([*key_list, "block_size"], held[:-1]):
                out[name] = value
            return out[[*key_list, "block_size", "replicate", "n", "sw", "slw", "mean", "cov"]]

        for batch in batches:
            if not len(batch):
                continue
            groups = pd.Series(list(zip(*(batch[c] for c in names))))
            cuts = np.flatnonzero(np.concatenate(([True], groups.iloc[1:].to_numpy() != groups.iloc[:-1].to_numpy(), [True])))
            values = batch[cols].to_numpy(float)
            w = batch[weight].to_numpy(float) if weight else np.ones(len(batch))
            at = batch["rn"].to_numpy(dtype=np.int64) - 1
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                mine = tuple(None if v is None or v != v else v for v in groups.iloc[lo])
                if mine != held:
                    if held is not None:
                        yield blocks()
                    held, length, step = mine, int(batch["n"].iloc[lo]), int(batch["__each"].iloc[lo])
                    reps = np.arange(mine[-1] * step + 1, min((mine[-1] + 1) * step, replicates) + 1)
                    counts = block_draws(length, reps, int(mine[-2]), overlap) if sized else draw_counts(length, reps)
                    sums, extra = np.zeros((len(reps), 1 + p + p * p)), np.zeros((len(reps), 2))
                    middle = np.asarray(batch["__centre"].iloc[lo], float)
                z, c = values[lo:hi], counts[:, at[lo:hi]]
                products = np.concatenate((np.ones((hi - lo, 1)), z, (z[:, :, None] * z[:, None, :]).reshape(hi - lo, -1)), axis=1)
                sums += (c * w[lo:hi]) @ products
                extra += c @ np.column_stack((np.ones(hi - lo), np.log(w[lo:hi])))
        if held is not None:
            yield blocks()

    ddl = "block_size int, replicate int, n double, sw double, slw double, mean array<double>, cov array<double>"
    out = jobs.mapInPandas(run, _key_ddl(df, keys) + ddl)
    return out if sized else out.drop("block_size")


def poisson_blocks(
    df: DataFrame, keys: Sequence[str], row_id: str, columns: Sequence[str], replicates: int, weight: str | None = None
) -> DataFrame:
    """Poisson(1) replicates over raw rows of any number.

    No row numbers: a row decides its own counts, and a task adds them up for all replicates of the keys that it meets,
    so a hot key costs nothing extra and only keys x replicates sums a task are shuffled. Rows are dealt out by themselves
    first: a row costs as many draws as there are replicates, however few files or keys the rows come from.
    """
    cols, key_list = list(columns), list(keys)
    rows = centre(df.select(*keys, row_id, *cols, *([weight] if weight else [])), keys, cols, raw=True)
    rows = rows.repartition(parallelism(df), *[c for c in rows.columns if c != "__centre"])
    p, reps = len(cols), np.arange(1, replicates + 1)
    width = 2 + 1 + p + p * p  # n, sum of c ln w, then weighted sums of 1, columns, products
    most = max(1, DRAWN // (replicates * width))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def handed() -> pd.DataFrame:
            return pd.DataFrame([(*k, v[0], v[1].tobytes()) for k, v in held.items()], columns=[*key_list, "centre", "sums"])

        for batch in batches:
            if not len(batch):
                continue
            groups = batch.groupby(key_list, dropna=False, sort=False).indices.values() if key_list else [np.arange(len(batch))]
            values = batch[cols].to_numpy(float)
            w = batch[weight].to_numpy(float) if weight else np.ones(len(batch))
            ids = batch[row_id].to_numpy(dtype=np.int64)
            for every in groups:
                key = tuple(None if v is None or v != v else v for v in (batch[k].iloc[every[0]] for k in key_list))
                if key not in held:
                    held[key] = [list(batch["__centre"].iloc[every[0]]), np.zeros((replicates, width))]
                for lo in range(0, len(every), max(1, DRAWN // replicates)):
                    at = every[lo : lo + max(1, DRAWN // replicates)]
                    z, v = values[at], w[at, None]
                    products = np.concatenate((np.ones((len(at), 1)), np.log(v), v, v * z, v * (z[:, :, None] * z[:, None, :]).reshape(len(at), -1)), axis=1)
                    step = max(1, CACHED // len(at))
                    for first in range(0, replicates, step):
                        held[key][1][first : first + step] += poisson_counts(ids[at], reps[first : first + step]) @ products
            if len(held) > most:
                yield handed()
                held.clear()
        if held:
            yield handed()

    def blocks(key: tuple, middle: list, sums: np.ndarray) -> pd.DataFrame:
        some = sums[:, 0] > 0
        sw, total = sums[some, 2], sums[some, 3:]
        mean = total[:, :p] / sw[:, None]
        cov = total[:, p:].reshape(-1, p, p) / sw[:, None, None] - mean[:, :, None] * mean[:, None, :]
        out = pd.DataFrame({"replicate": reps[some].astype("int32"), "n": sums[some, 0], "sw": sw, "slw": sums[some, 1]})
        out["mean"], out["cov"] = list(mean + np.asarray(middle)), list(cov.reshape(len(out), -1))
        for k, v in zip(key_list, key):
            out[k] = v
        return out[[*key_list, "replicate", "n", "sw", "slw", "mean", "cov"]]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, middle, total = None, None, None
        for batch in batches:
            for *mine, centre_, raw in zip(*(batch[c] for c in (*key_list, "centre", "sums"))):
                key = tuple(None if v is None or v != v else v for v in mine)
                if key != held:
                    if held is not None:
                        yield blocks(held, middle, total)
                    held, middle, total = key, centre_, np.zeros((replicates, width))
                total += np.frombuffer(raw).reshape(replicates, width)
        if held is not None:
            yield blocks(held, middle, total)

    parts = rows.mapInPandas(gather, _key_ddl(df, keys) + "centre array<double>, sums binary")
    dealt = parts.repartition(parallelism(df), *keys).sortWithinPartitions(*keys) if key_list else parts.repartition(1)
    ddl = "replicate int, n double, sw double, slw double, mean array<double>, cov array<double>"
    return dealt.mapInPandas(add, _key_ddl(df, keys) + ddl)


# ---------------------------------------------------------------- bagged ridge
def joined_ridge_ensemble(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    target: str,
    features: Sequence[str],
    replicates: int,
    alpha: float,
    weight: str | None = None,
    positive: bool = False,
) -> DataFrame:
    """Bagged ridge by joins and aggregations, for series of any length: keys, replicate, coef."""
    cols = [*features, target]
    blocks = replicate_blocks(df, keys, order, cols, replicates, weight)
    return ridge_fits(blocks, [*keys, "replicate"], cols, features, alpha, positive).drop("n_obs")


def packed_ridge_ensemble(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    target: str,
    features: Sequence[str],
    replicates: int,
    alpha: float,
    weight: str | None = None,
    positive: bool = False,
    chunk: int = 250,
) -> DataFrame:
    """Bagged ridge for thousands of replicates of calendar-bounded series.

    A series of a few hundred weeks travels as one row to many tasks, each of which
    draws its own range of replicates; the draws equal those of :func:`replicate_blocks`. Made for
    series that fit in a row: :func:`joined_ridge_ensemble` gives the same replicates for
    series of any length.
    """
    if not keys:
        one = packed_ridge_ensemble(
            df.withColumn("__all", F.lit(0)), ["__all"], order, target, features, replicates, alpha, weight, positive, chunk
        )
        return one.drop("__all")
    cols = [*features, target, *([weight] if weight else [])]
    df = df.select(*keys, order, *cols)
    series = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("__s"))
    flat = series.select(*keys, *[F.col("__s")[c].alias(f"__v_{i}") for i, c in enumerate(cols)])
    chunks = -(-replicates // chunk)
    jobs = flat.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    jobs = jobs.repartition(max(parallelism(df), chunks), *keys, "__chunk")
    p, key_list, has_weight = len(features), list(keys), weight is not None

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):
                row = pdf.iloc[i]
                z = np.column_stack([np.asarray(row[f"__v_{j}"], float) for j in range(p + 1)])
                w = np.asarray(row[f"__v_{p + 1}"], float) if has_weight else np.ones(len(z))
                reps = np.arange(row["__chunk"] * chunk + 1, min((row["__chunk"] + 1) * chunk, replicates) + 1)
                counts = draw_counts(len(z), reps)
                centre_ = z.mean(axis=0)
                zc = z - centre_
                cw = counts * w
                sw = cw.sum(axis=1)
                mean = cw @ zc / sw[:, None]
                prod = (zc[:, :, None] * zc[:, None, :]).reshape(len(z), -1)
                cov = (cw @ prod / sw[:, None]).reshape(-1, p + 1, p + 1) - mean[:, :, None] * mean[:, None, :]
                coef = linear.ridge(sw, mean + centre_, cov, range(p), alpha, positive)
                out = pd.DataFrame({"replicate": reps.astype("int32"), "coef": list(coef)})
                for k in reversed(key_list):
                    out.insert(0, k, row[k])
                yield out

    return jobs.mapInPandas(fit, _key_ddl(df, keys) + "replicate int, coef array<double>")


def _draw_parts(rows: np.ndarray, replicates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The draw recipe on arrays, [replicate, row]: both parts of ``exprs.with_draw``, draw = first x modulus + second."""
    m = X.DRAW_MODULUS
    i = rows.astype(np.int64)[None, :] % m
    r = replicates.astype(np.int64)[:, None] % m
    x = (i * X.DRAW_ROW + r * X.DRAW_REPLICATE + X.DRAW_OFFSET) % m
    x = (x * x + i + 1) % m
    x = (x * X.DRAW_MIX + r * 7 + 3) % m
    x = (x * x + r + 1) % m
    y = (x * X.DRAW_ROW + i * 5 + r) % m
    return x, (y * y + x + 1) % m


def draw_counts(n: int, replicates: np.ndarray) -> np.ndarray:
    """counts[replicate, row] of n draws out of n rows."""
    x, y = _draw_parts(np.arange(1, n + 1), replicates)
    rows = ((x * X.DRAW_MODULUS + y) % n) + np.arange(len(replicates))[:, None] * n
    return np.bincount(rows.ravel(), minlength=n * len(replicates)).reshape(len(replicates), n).astype(float)


def block_draws(n: int, replicates: np.ndarray, size: int, overlap: bool = True) -> np.ndarray:
    """counts[replicate, row] of moving (or disjoint) blocks of ``size`` rows: ceil(n / size) starts, cut at n rows.

    Each block size and replicate has a seed of its own, made by a draw, so that no two sums of both can coincide.
    """
    x, y = _draw_parts(np.array([size]), replicates)
    # the seed is the remainder of the first draw, of which the second draw reads no more
    seeds = y[:, 0] % X.DRAW_MODULUS
    blocks = -(-n // size)
    x, y = _draw_parts(np.arange(1, blocks + 1), seeds)
    draw = x * X.DRAW_MODULUS + y
    first = draw % (n - size + 1) if overlap else (draw % (n // size)) * size
    rows = (first[:, :, None] + np.arange(size)).reshape(len(replicates), -1)[:, :n] + np.arange(len(replicates))[:, None] * n
    return np.bincount(rows.ravel(), minlength=n * len(replicates)).reshape(len(replicates), n).astype(float)


def poisson_counts(rows: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """counts[replicate, row] of Poisson(1) variables, as ``exprs.poisson_one`` makes them.

    The first part of the draw of :func:`_draw_parts`, by shifts instead of divisions: the modulus is 2^31 - 1, so the high
    bits of a number are added to its low ones. Only the last step needs the remainder itself.
    """
    m, bits = np.uint64(X.DRAW_MODULUS), np.uint64(31)
    i = (rows.astype(np.int64)[None, :] % X.DRAW_MODULUS).astype(np.uint64)
    r = (replicates.astype(np.int64)[:, None] % X.DRAW_MODULUS).astype(np.uint64)
    # below 2^32, so its square has 64 bits at most
    x = i * np.uint64(X.DRAW_ROW) % m + (r * np.uint64(X.DRAW_REPLICATE) + np.uint64(X.DRAW_OFFSET)) % m
    high = np.empty_like(x)

    def fold() -> None:
        np.right_shift(x, bits, out=high)
        np.bitwise_and(x, m, out=x)
        np.add(x, high, out=x)

    np.multiply(x, x, out=x)
    x += i + np.uint64(1)
    fold()
    np.multiply(x, np.uint64(X.DRAW_MIX), out=x)
    x += r * np.uint64(7) + np.uint64(3)
    fold()
    np.multiply(x, x, out=x)
    x += r + np.uint64(1)
    fold()
    fold()
    # below two moduli now; where it is below one, the difference wraps to a larger number
    np.subtract(x, m, out=high)
    draw = np.minimum(x, high, out=x).astype(np.int32)
    bounds = np.array(X.poisson_thresholds())
    counts = np.zeros(draw.shape, dtype=np.int8)
    for bound in bounds[:6].astype(np.int32):
        counts += draw >= bound
    far = np.nonzero(counts == 6)
    counts[far] = np.searchsorted(bounds, draw[far], side="right")
    return counts.astype(float)
