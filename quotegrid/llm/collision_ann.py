"""Approximate nearest neighbours by collision-counting hashing.

Every vector is projected on ``projections`` random lines; each line's values lie in a sorted array. A query opens a
window around its own value on each line and widens all windows together (virtual rehashing: the width grows by
``growth`` per round, nothing is hashed again). A vector that lies inside the windows of at least ``threshold`` of the
lines is a candidate, and its exact distance is computed. A query is done once its k-th verified distance is so small
that a vector at that distance would, with the given confidence, have collided often enough to be a candidate already.

Vectors are dealt by hash into blocks of about ``block`` rows, each with its own sorted arrays in one task; a vector moves
once. The queries go to every block (a stated query set against all rows) and stream past its arrays, and every block
hands on its k nearest per query. Nothing but k rows per query and block is shuffled afterwards. A task holds one block.

Rough distances in single precision tell which candidates are measured in double; where a query is so much larger or smaller
than a block that single precision cannot hold them, all are measured.

Defined cases: vectors that are null, zero, hold null or non-finite components or have no id take no part; vectors of
another length than the query's are no candidates; rows that repeat an id are each a candidate (not for the query of that id); a query id
that is repeated is answered for its smallest vector; ties go to the smaller id; with fewer than k candidates all are
returned; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotegrid.llm.common import stage
from quotegrid.llm.sorted_projection import usable

PROJECTIONS, SHARE, GROWTH, CONFIDENCE = 60, 0.5, 1.3, 0.975
BLOCK = 4096


def _half_width_factor(share: float, confidence: float, projections: int) -> float:
    """c such that a vector at distance d lies within c * d on at least ``share`` of the lines with ``confidence``.

    A projected difference is normal with deviation d; the number of collisions is binomial.
    """
    z = NormalDist().inv_cdf(confidence)
    # chance p per line so that projections * p - z * sqrt(projections p (1-p)) = share * projections
    p = share
    for _ in range(100):
        p = min(share + z * math.sqrt(p * (1 - p) / projections), 0.999)
    low, high = 0.0, 10.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid / math.sqrt(2)) < p else (low, mid)
    return high


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances; where a square leaves the range of doubles, in units of the largest difference."""
    with np.errstate(over="ignore", invalid="ignore"):
        diff = x - q
        total = (diff * diff).sum(axis=1)
        out = np.sqrt(total)
        largest = np.abs(diff).max(axis=1, initial=0.0)
        odd = np.flatnonzero((~np.isfinite(total) | (total < 1e-290)) & (largest > 0))
        if len(odd):
            unit = largest[odd]
            # halves first, where even a difference is too large
            part = np.where(np.isfinite(unit)[:, None], diff[odd] / unit[:, None], 0.0)
            out[odd] = np.where(np.isfinite(unit), unit * np.sqrt((part * part).sum(axis=1)), np.inf)
    return out


class BlockIndex:
    """Sorted projections of one block of vectors, line after line in one array."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lines: np.ndarray):
        self.ids, self.x, self.lines = ids, x, lines
        values = np.ascontiguousarray((x @ lines).T)  # projections x rows
        order = np.argsort(values, axis=1, kind="stable")
        self.order = order.astype(np.int32).ravel()
        self.sorted = np.take_along_axis(values, order, axis=1)
        self.n, self.m = len(ids), lines.shape[1]
        self.scale = max(float(np.abs(x).max()), 1e-300)
        self.small = (x / self.scale).astype(np.float32)
        self.squares = (self.small * self.small).sum(axis=1)

    def _borders(self, at: np.ndarray, side: str) -> np.ndarray:
        """Place of each value in its line's array."""
        return np.array([col.searchsorted(v, side) for col, v in zip(self.sorted, at)])

    def search(self, q: np.ndarray, own: int, k: int, share: float, growth: float, factor: float) -> list[tuple[float, int]]:
        n, m = self.n, self.m
        need = math.ceil(share * m)
        with np.errstate(over="ignore"):
            small_q = (q / self.scale).astype(np.float32)
            own_square = float(small_q @ small_q)
        # rounding of the rough squares, generously; without bounds where single precision does not reach
        rough_holds = np.isfinite(own_square) and own_square < 1e30
        slack = 1e-5 * (own_square + float(self.squares.max())) + 1e-30
        with np.errstate(over="ignore", invalid="ignore"):
            at = q @ self.lines
        if not np.isfinite(at).all() or np.abs(at).max() > 1e300:  # no window can be opened there
            others = np.flatnonzero(self.ids != own)
            return sorted(zip(distances(self.x[others], q).tolist(), self.ids[others].tolist()))[:k]
        middle = self._borders(at, "left")
        base = np.arange(m) * n
        lo, hi = middle.copy(), middle.copy()
        counts = np.zeros(n, dtype=np.int64)
        seen = np.zeros(n, dtype=bool)
        best: list[tuple[float, int]] = []
        # the first windows hold about k vectors on a line
        reach = max(self._first_reach(at, middle, k), 1e-12)
        while True:
            new_lo, new_hi = np.minimum(self._borders(at - reach, "left"), lo), np.maximum(self._borders(at + reach, "right"), hi)
            left, right = zip(base + new_lo, base + lo), zip(base + hi, base + new_hi)
            fresh_places = [self.order[a:b] for part in (left, right) for a, b in part if b > a]
            if fresh_places:
                counts += np.bincount(np.concatenate(fresh_places), minlength=n)
            lo, hi = new_lo, new_hi
            fresh = np.flatnonzero((counts >= need) & ~seen)
            if len(fresh):
                seen[fresh] = True
                fresh = fresh[self.ids[fresh] != own]
                # single precision tells which of them can be among the nearest; those are measured exactly
                if rough_holds:
                    rough = self.squares[fresh] - 2 * (self.small[fresh] @ small_q)
                    most = (best[-1][0] / self.scale) ** 2 - own_square if len(best) == k else np.inf
                    if len(fresh) > k:
                        most = min(most, float(np.partition(rough, k - 1)[k - 1]))
                    fresh = fresh[rough <= most + slack]
                d = distances(self.x[fresh], q)
                best = sorted([*best, *zip(d.tolist(), self.ids[fresh].tolist())])[:k]
            if len(best) == k and factor * best[-1][0] <= reach:
                return best
            if (lo == 0).all() and (hi == n).all():
                return best
            if len(best) == k:
                # no further than the distance known so far asks for
                reach = min(reach * growth, max(factor * best[-1][0], reach * 1.05))
            else:
                reach *= growth

    def _first_reach(self, at: np.ndarray, middle: np.ndarray, k: int) -> float:
        low, high = np.maximum(middle - k, 0), np.minimum(middle + k, self.n - 1)
        j = np.arange(self.m)
        return float(np.median(np.maximum(at - self.sorted[j, low], self.sorted[j, high] - at)))


def _search(k: int, projections: int, share: float, growth: float, confidence: float, seed: int):
    factor = _half_width_factor(share, confidence, projections)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, data, index = None, [], None

        def build(width: int) -> BlockIndex | None:
            if not data:
                return None
            lines = np.random.default_rng([seed, width]).standard_normal((width, projections))
            ids = np.concatenate([d["vec_id"].to_numpy() for d in data])
            return BlockIndex(ids, np.array([v for d in data for v in d["vec"]], dtype=np.float64), lines)

        for batch in batches:
            if not len(batch):
                continue
            # vectors of a block come before the queries that are put to it
            keys = batch["block"].to_numpy() * 2.0**31 + batch["width"].to_numpy()
            asks = batch["is_query"].to_numpy(dtype=bool)
            change = np.flatnonzero((keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *change], [*change, len(batch)]):
                if keys[lo] != held:
                    held, data, index = keys[lo], [], None
                part = batch.iloc[lo:hi]
                if not asks[lo]:
                    data.append(part)
                    continue
                if data:
                    index, data = build(int(part["width"].iloc[0])), []
                if index is None:
                    continue
                out = []
                for own, vec in zip(part["vec_id"].tolist(), part["vec"]):
                    best = index.search(np.asarray(vec, dtype=np.float64), own, k, share, growth, factor)
                    out += [(own, i, d) for d, i in best]
                if out:
                    yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    projections: int = PROJECTIONS,
    share: float = SHARE,
    growth: float = GROWTH,
    confidence: float = CONFIDENCE,
    block: int = BLOCK,
    seed: int = 5,
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest other rows of every query.

    ``is_query`` is a condition on ``vec_id``.
    """
    able = stage(usable(vectors, id_col, vector_col).withColumn("width", F.size("vec")), "vectors")
    asked = able.where(is_query).groupBy("vec_id", "width").agg(F.min("vec").alias("vec"))
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("width", "vec")).alias("v")).select("vec_id", "v.width", "v.vec")
    blocks = max(1, math.ceil(able.count() / block))
    data = able.select(
        "vec_id", "vec", "width", F.lit(False).alias("is_query"), F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)).cast("int").alias("block")
    )
    questions = asked.select(
        "vec_id", "vec", "width", F.lit(True).alias("is_query"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    )
    found = (
        data.unionByName(questions)
        .repartition(max(1, min(blocks, 100_000)), "block")
        .sortWithinPartitions("block", "width", "is_query", "vec_id")
        .mapInPandas(
            _search(k, projections, share, growth, confidence, seed), "query_id bigint, vec_id bigint, score double"
        )
    )
    nearest_first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(nearest_first))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
