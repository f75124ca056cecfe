"""Moments of wide tables: sums over pairs of columns, kept as tiles.

An aggregate expression for every pair of columns cannot be planned for hundreds of columns. Here a task multiplies the
rows of a key as matrices and emits tiles (row block x column block of the pair table) as bytes; tiles of the same place
are merged by key. Pairs are complete pair by pair: a row counts for a pair where both values are there. Each tile holds
counts, means and centred sums, which are merged without losing digits (sums of squares never meet raw values).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegrid.functions.exprs import nan_to_null
from quotegrid.operators.moments import _key_ddl, parallelism

TILE = 64
HELD = 1 << 24  # numbers that a task holds before it hands tiles on
#: planes of a tile: rows of the pair, mean of the first and of the second, centred squares of both, centred products
PLANES = 6


def pair_sums(x: np.ndarray) -> np.ndarray:
    """The six planes over all pairs of columns of ``x`` (rows x columns, NaN where missing)."""
    there = ~np.isnan(x)
    n_each = there.sum(axis=0)
    centre = np.where(there, x, 0.0).sum(axis=0) / np.maximum(n_each, 1)
    m = there.astype(float)
    z = np.where(there, x - centre, 0.0)
    n = m.T @ m
    s = z.T @ m  # sum of the first over rows where the second is there
    per = np.maximum(n, 1.0)
    out = np.empty((PLANES, *n.shape))
    out[0] = n
    out[1] = np.where(n > 0, centre[:, None] + s / per, 0.0)
    out[2] = out[1].T
    out[3] = (z * z).T @ m - s * s / per
    out[4] = out[3].T
    out[5] = z.T @ z - s * s.T / per
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Planes of the union of two disjoint row sets."""
    n = a[0] + b[0]
    per = np.maximum(n, 1.0)
    dx, dy, share = b[1] - a[1], b[2] - a[2], b[0] / per
    both = a[0] * share
    out = np.empty_like(a)
    out[0] = n
    out[1], out[2] = a[1] + dx * share, a[2] + dy * share
    out[3], out[4], out[5] = a[3] + b[3] + dx * dx * both, a[4] + b[4] + dy * dy * both, a[5] + b[5] + dx * dy * both
    # a side without rows has no mean to move away from
    for empty, other in ((a[0] == 0, b), (b[0] == 0, a)):
        out = np.where(empty, other, out)
    return out


def _accumulate(keys: list[str], columns: list[str], tile: int):
    p = len(columns)
    edges = [(lo, min(lo + tile, p)) for lo in range(0, p, tile)]
    most = max(1, HELD // (PLANES * p * p))

    def tiles(key: tuple, planes: np.ndarray) -> pd.DataFrame:
        rows = [
            (*key, i, j, np.ascontiguousarray(planes[:, a:b, c:d]).tobytes())
            for i, (a, b) in enumerate(edges)
            for j, (c, d) in enumerate(edges)
            if i <= j
        ]
        return pd.DataFrame(rows, columns=[*keys, "tile_a", "tile_b", "planes"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            groups = batch.groupby(keys, dropna=False, sort=False).indices.items() if keys else [((), np.arange(len(batch)))]
            values = batch[columns].to_numpy(float)
            for _, at in groups:
                key = tuple(batch[k].iloc[at[0]] for k in keys)
                sums = pair_sums(values[at])
                held[key] = merged(held[key], sums) if key in held else sums
                if len(held) > most:
                    first = next(iter(held))
                    yield tiles(first, held.pop(first))
        for key, sums in held.items():
            yield tiles(key, sums)

    return run


def _merge(names: list[str], shape) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None

        def row() -> pd.DataFrame:
            return pd.DataFrame([(*key, total.tobytes())], columns=[*names, "planes"])

        for batch in batches:
            for *mine, raw in zip(*(batch[c] for c in (*names, "planes"))):
                planes = np.frombuffer(raw).reshape(PLANES, *shape(int(mine[-2]), int(mine[-1])))
                if tuple(mine) == key:
                    total = merged(total, planes)
                else:
                    if key is not None:
                        yield row()
                    key, total = tuple(mine), planes
        if key is not None:
            yield row()

    return run


def gram_tiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], tile: int = TILE) -> DataFrame:
    """One row per key and tile of the upper triangle: keys, tile_a, tile_b, planes.

    NULL and NaN are missing. Memory of a task: the planes of ``HELD`` numbers, whatever the rows and keys.
    """
    cols, names = list(columns), [*keys, "tile_a", "tile_b"]
    p = len(cols)
    ddl = _key_ddl(df, keys) + "tile_a int, tile_b int, planes binary"

    def shape(i: int, j: int) -> tuple[int, int]:
        return min(tile, p - i * tile), min(tile, p - j * tile)

    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    parts = rows.mapInPandas(_accumulate(list(keys), cols, tile), ddl)
    dealt = parts.repartition(parallelism(df), *names).sortWithinPartitions(*names)
    return dealt.mapInPandas(_merge(names, shape), ddl)


def _planes(raw: bytes, i: int, j: int, p: int, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = np.arange(i * tile, min((i + 1) * tile, p)), np.arange(j * tile, min((j + 1) * tile, p))
    return np.frombuffer(raw).reshape(PLANES, len(a), len(b)), a, b


def _corr(planes: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        r = planes[5] / np.sqrt(planes[3] * planes[4])
    return np.where((planes[0] > 1) & np.isfinite(r), np.clip(r, -1.0, 1.0), np.nan)


def pair_correlations(tiles: DataFrame, keys: Sequence[str], columns: Sequence[str], tile: int = TILE) -> DataFrame:
    """Long form: keys, a, b (a before b in ``columns``, or the same), n, corr, covariance."""
    cols, key_list = list(columns), list(keys)
    names = np.array(cols, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for *key, i, j, raw in zip(*(batch[c] for c in (*key_list, "tile_a", "tile_b", "planes"))):
                planes, a, b = _planes(raw, i, j, len(cols), tile)
                at, to = np.nonzero(a[:, None] <= b[None, :])
                n = planes[0][at, to]
                out = pd.DataFrame({"a": names[a[at]], "b": names[b[to]], "n": n.astype("int64"), "corr": _corr(planes)[at, to]})
                out["covariance"] = np.where(n > 1, planes[5][at, to] / np.maximum(n - 1, 1), np.nan)
                for k, v in zip(key_list, key):
                    out[k] = v
                yield out[[*key_list, "a", "b", "n", "corr", "covariance"]]

    ddl = _key_ddl(tiles, keys) + "a string, b string, n bigint, corr double, covariance double"
    return tiles.mapInPandas(run, ddl).withColumns({c: nan_to_null(c) for c in ("corr", "covariance")})


def correlation_profile(tiles: DataFrame, keys: Sequence[str], columns: Sequence[str], tile: int = TILE) -> DataFrame:
    """Per column: partners with a defined correlation, mean and largest absolute correlation, and rows of the column.

    Each tile is reduced where it lies; only two rows a column and tile are shuffled.
    """
    cols, key_list = list(columns), list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for *key, i, j, raw in zip(*(batch[c] for c in (*key_list, "tile_a", "tile_b", "planes"))):
                planes, a, b = _planes(raw, i, j, len(cols), tile)
                r = np.abs(_corr(planes))
                rows = np.zeros(r.shape)
                if i == j:
                    rows = np.where(np.eye(len(a), dtype=bool), planes[0], 0.0)
                    r = np.where(np.eye(len(a), dtype=bool), np.nan, r)
                there = ~np.isnan(r)
                filled = np.where(there, r, 0.0)
                for side, names in ((1, a), (0, b)) if i != j else ((1, a),):
                    out = pd.DataFrame(
                        {
                            "feature": [cols[k] for k in names],
                            "partners": there.sum(axis=side).astype("int64"),
                            "total": filled.sum(axis=side),
                            "largest": filled.max(axis=side),
                            "n": rows.sum(axis=side).astype("int64"),
                        }
                    )
                    for k, v in zip(key_list, key):
                        out[k] = v
                    yield out[[*key_list, "feature", "partners", "total", "largest", "n"]]

    ddl = _key_ddl(tiles, keys) + "feature string, partners bigint, total double, largest double, n bigint"
    parts = tiles.mapInPandas(run, ddl)
    summed = parts.groupBy(*keys, "feature").agg(
        F.sum("n").alias("n"), F.sum("partners").alias("partners"), F.sum("total").alias("__t"), F.max("largest").alias("__l")
    )
    some = F.col("partners") > 0
    return summed.select(
        *keys, "feature", "n", "partners",
        F.when(some, F.col("__t") / F.col("partners")).alias("mean_abs_corr"), F.when(some, F.col("__l")).alias("max_abs_corr"),
    )


def whole_correlations(tiles: DataFrame, keys: Sequence[str], columns: Sequence[str], use, ddl: str, tile: int = TILE) -> DataFrame:
    """``use(corr)`` on the full matrix of each key, which is as large as the list of columns, not as the data."""
    cols, key_list = list(columns), list(keys)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        r = np.full((len(cols), len(cols)), np.nan)
        for i, j, raw in zip(frame["tile_a"], frame["tile_b"], frame["planes"]):
            planes, a, b = _planes(raw, int(i), int(j), len(cols), tile)
            part = _corr(planes)
            r[np.ix_(a, b)] = part
            r[np.ix_(b, a)] = part.T
        out = use(r)
        for k in key_list:
            out[k] = frame[k].iloc[0]
        return out[[*key_list, *(c for c in out.columns if c not in key_list)]]

    return tiles.groupBy(*keys).applyInPandas(run, _key_ddl(tiles, keys) + ddl)


def inverse_diagonal(corr: np.ndarray) -> np.ndarray:
    """Diagonal of the inverse; all infinite where columns determine each other, NaN where a correlation is missing."""
    if np.isnan(corr).any():
        return np.full(len(corr), np.nan)
    value, vector = np.linalg.eigh(corr)
    if value[0] <= 1e-12:
        return np.full(len(corr), np.inf)
    return (vector**2 / value).sum(axis=1)
