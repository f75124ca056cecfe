"""Shared helpers: stage tables, word shingles, streaming of sorted groups, union-find, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# ---------------------------------------------------------------- stage tables
def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, else the context's own checkpoint folder. Only a session whose
    executors live in this process may go without: a temporary one is set for it here."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.getCheckpointDir():
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("the session names no spark.checkpoint.dir, a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="quotegrid-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def save(df: DataFrame, name: str) -> str:
    """Writes ``df`` once to the shared folder; its path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: cuts lineage, survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(save(df, name))


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores behind it as keep it apart from the names in use."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- words and shingles
MULT = np.uint64(0x9E3779B97F4A7C15)  # fixed values: odd multipliers of two well-known integer mixers
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z to a-z, other bytes as they are
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64)
_POWER = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers."""
    x = (x ^ (x >> np.uint64(33))) * MIX1
    x = (x ^ (x >> np.uint64(33))) * MIX2
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    global _POWER
    if len(_POWER) < n:
        more = np.full(max(n, 2 * len(_POWER), 1024), MULT, dtype=np.uint64)
        more[0] = 1
        _POWER = np.multiply.accumulate(more)
    return _POWER


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of every word (run of bytes other than space, tab, line and page breaks), A-Z lower-cased."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(LOWER), dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.uint64)
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    length = end - start
    owner = np.zeros(len(raw), dtype=np.int64)
    owner[start[1:]] = np.diff(start)
    offset = np.maximum(np.arange(len(raw)) - start[0] - np.cumsum(owner), 0)
    value = _BYTE[raw] * _powers(len(raw))[offset]
    value[_SPACE[raw]] = 0
    return mix64(np.add.reduceat(value, start) + length.astype(np.uint64))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of the whole sequence if there are fewer words."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    size = min(n, width)
    total = np.zeros(n - size + 1, dtype=np.uint64)
    for i in range(size):
        total = total * MULT + mix64(words[i : n - size + 1 + i] + np.uint64(i + 1))
    return np.unique(mix64(total + np.uint64(size)))


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


# ---------------------------------------------------------------- groups in sorted partitions
def sorted_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """(key, rows) of each run of equal keys in a partition that is sorted by them; holds one run at a time."""
    held: list[pd.DataFrame] = []
    held_key: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch[k].to_numpy() for k in keys]
        change = np.zeros(len(batch) - 1, dtype=bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = np.concatenate(([0], np.flatnonzero(change) + 1, [len(batch)]))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[lo] for c in cols)
            if held and key != held_key:
                yield held_key, pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.iloc[lo:hi])
            held_key = key
    if held:
        yield held_key, pd.concat(held) if len(held) > 1 else held[0]


class UnionFind:
    """Over positions 0..n-1; ``union`` says whether it joined two groups."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


# ---------------------------------------------------------------- connected components
def _local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of each batch replaced by stars around the smallest id of each part that the batch connects."""
    for batch in batches:
        ids, at = np.unique(np.concatenate((batch["a"].to_numpy(), batch["b"].to_numpy())), return_inverse=True)
        half = len(at) // 2
        parts = UnionFind(len(ids))
        for i, j in zip(at[:half].tolist(), at[half:].tolist()):
            parts.union(i, j)
        root = np.array([parts.find(i) for i in range(len(ids))], dtype=np.int64)
        keep = root != np.arange(len(ids))
        yield pd.DataFrame({"a": ids[keep], "b": ids[root[keep]]})


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b: bigint); component is the smallest id reachable.

    Alternating large-star and small-star rounds: every round hangs a node's neighbours on the smallest
    of them, so stars around component minima remain. Only aggregates and equi-joins; each round is a
    written table. Empty input gives an empty result.
    """
    # written first: edges that Python made would keep a second Python worker beside this one in every task
    found = stage(edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b"), "found")
    now = stage(found.mapInPandas(_local_forest, "a bigint, b bigint"), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written first, so that both sides of the join are shuffled for it and AQE can split the edges of a hub
        least = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every edge now points from the larger id (a) to a smaller one (b)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        now = stage(
            hung.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct(),
            "edges",
        )
        state = now.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


# ---------------------------------------------------------------- hashed byte n-grams
def gram_buckets(raw: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Bucket (below ``buckets``, a power of two) of every run of ``order`` bytes."""
    if len(raw) < order:
        return np.empty(0, dtype=np.int64)
    n = len(raw) - order + 1
    x = np.full(n, order, dtype=np.uint32)
    for i in range(order):
        x = (x ^ raw[i : i + n]) * np.uint32(0x01000193)  # fixed value: the 32-bit FNV prime
    x ^= x >> np.uint32(15)
    return (x & np.uint32(buckets - 1)).astype(np.int64)


def gram_counts(raw: bytes, orders: tuple[int, ...], buckets: int, chunk: int = 1 << 20) -> np.ndarray:
    """Counts of hashed byte n-grams; long texts go through in chunks that overlap by the longest order."""
    out = np.zeros(buckets, dtype=np.int64)
    data = np.frombuffer(raw, dtype=np.uint8)
    for order in orders:
        for lo in range(0, max(len(data) - order + 1, 0), chunk):
            out += np.bincount(gram_buckets(data[lo : lo + chunk + order - 1], order, buckets), minlength=buckets)
    return out
