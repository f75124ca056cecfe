"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window.

1. One pass over the texts: token ids of every document. Documents longer than a window fill windows of their own from
   the front; what is left (fewer tokens than a window) is an *item*. Ids of items are written, 2 or 4 bytes each.
2. The terms of the index are the token ids, so statistics over all items have at most one number for each entry of the
   vocabulary: document frequencies and the mean length go to the driver as ``VOCABULARY`` numbers at most.
3. Items are sorted by their two rarest terms (range-partitioned, ties spread, so copies are dealt out too) and cut into
   shards of ``SHARD`` neighbouring items. Each shard has its own inverted index.
4. In a shard the next unused item is a seed. Its index returns all unused items by BM25 score, those without a common
   term last, and they fill the seed's window in this order. The one that does not fit is cut, and its rest is the next seed.
   A window that a shard cannot fill goes on with the next shard of the task; the last of a task is cut into sequences
   whose lengths are powers of two, so nothing is padded.

A shard bounds memory: ``SHARD`` items of less than a window, or more where they are so short that they fill fewer than
four windows. Defined cases: a null text is empty and has the end token
alone; a null ``doc_id`` is packed like any other; repeated rows are packed each for itself; ties in score go to the item
that sorts first; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegrid.llm.common import shuffle_width, stage
from quotegrid.llm.pattern_packing import ByteTokens

SIZE, SHARD = 2048, 1024
VOCABULARY = 1 << 17
K1, B = 1.2, 0.75
NUMBERED = 1 << 33  # rows of a task that can be told apart
FRAME = 1000  # rows handed on at once


def _items(rank_file: str, size: int, end_id: int):
    """Whole windows of long documents, with their checksums, and one item each, with its ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = ByteTokens(rank_file)
        number = TaskContext.get().partitionId() * NUMBERED
        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["item", "doc_id", "doc_tokens", "start", "length", "ids_crc32", "ids"], dtype=object)

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if len(rows) >= FRAME:
                    yield frame(rows)
                    rows = []
                ids = np.array([*tokens(text), end_id], dtype="<u4")
                whole = len(ids) - len(ids) % size
                for at in range(0, whole, size):
                    rows.append((number, doc_id, len(ids), at, size, zlib.crc32(ids[at : at + size].tobytes()), None))
                    number += 1
                if whole < len(ids):
                    rest = ids[whole:]
                    packed = rest.astype("<u2") if rest.max() < 1 << 16 else rest
                    rows.append((number, doc_id, len(ids), whole, len(rest), None, packed.tobytes()))
                    number += 1
            yield frame(rows)

    return run


def _ids(raw: bytes, length: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * length else "<u4")


# ---------------------------------------------------------------- statistics over all items
@dataclass
class Statistics:
    idf: np.ndarray
    mean_length: float

    def weights(self, terms: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """BM25 weights of terms that occur ``counts`` times in items of these lengths."""
        norm = K1 * (1 - B + B * lengths / self.mean_length)
        return self.idf[terms] * counts * (K1 + 1) / (counts + norm)


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Items that hold each term; term -1 counts items, term -2 their tokens."""
    found = np.zeros(VOCABULARY + 2, dtype=np.int64)
    for batch in batches:
        for raw, length in zip(batch["ids"], batch["length"]):
            found[np.unique(_ids(raw, length)).astype(np.int64)] += 1
        found[-1] += len(batch)
        found[-2] += int(batch["length"].sum())
    at = np.flatnonzero(found)
    yield pd.DataFrame({"term": np.where(at >= VOCABULARY, at - VOCABULARY - 2, at), "n": found[at]})


def statistics(items: DataFrame) -> Statistics:
    counts = items.select("ids", "length").mapInPandas(_frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    by = dict(zip(counts["term"].to_pylist(), counts["n"].to_pylist()))
    total, tokens = by.pop(-1, 0), by.pop(-2, 0)
    df = np.zeros(VOCABULARY)
    df[np.fromiter(by, dtype=np.int64, count=len(by))] = np.fromiter(by.values(), dtype=float, count=len(by))
    return Statistics(np.log1p((total - df + 0.5) / (df + 0.5)), max(tokens, 1) / max(total, 1))


def _rarest(shared: Broadcast):
    """Adds the two rarest terms of every item; -1 where there is no second."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf = shared.value.idf
        for batch in (whole.iloc[at : at + FRAME] for whole in batches for at in range(0, len(whole), FRAME)):
            best = np.full((len(batch), 2), -1, dtype=np.int64)
            for k, (raw, length) in enumerate(zip(batch["ids"], batch["length"])):
                ids = _ids(raw, length)
                weight = idf[ids]
                first = ids[weight.argmax()]
                weight[ids == first] = -1.0
                second = weight.argmax()
                best[k] = first, ids[second] if weight[second] >= 0 else -1
            yield batch.assign(t1=best[:, 0], t2=best[:, 1])

    return run


# ---------------------------------------------------------------- a shard
@dataclass
class Item:
    doc_id: object
    doc_tokens: int
    start: int
    ids: np.ndarray
    used: int = 0

    @property
    def left(self) -> int:
        return len(self.ids) - self.used


class Index:
    """Inverted index of a shard: for each term the items that hold it, and their weights."""

    def __init__(self, items: list[Item], stats: Statistics):
        self.n = len(items)
        lengths = np.array([len(i.ids) for i in items], dtype=np.int64)
        owner = np.repeat(np.arange(self.n, dtype=np.int64), lengths)
        pair, counts = np.unique(np.concatenate([i.ids for i in items]).astype(np.int64) * self.n + owner, return_counts=True)
        term, self.holder = np.divmod(pair, self.n)
        self.weight = stats.weights(term, counts, lengths[self.holder].astype(float))
        begin = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        self.begin, self.size = begin, np.diff(np.append(begin, len(term)))
        # numbers of the terms of each item
        number = np.repeat(np.arange(len(begin)), self.size)
        by_item = np.argsort(self.holder, kind="stable")
        self.terms = np.split(number[by_item], np.cumsum(np.bincount(self.holder, minlength=self.n))[:-1])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all items for the terms of one of them; rounded, so equal items tie."""
        begin, size = self.begin[self.terms[seed]], self.size[self.terms[seed]]
        at = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
        return np.round(np.bincount(self.holder[at], weights=self.weight[at], minlength=self.n), 9)


Window = list[tuple[Item, int, int]]  # item, from, to


def fill(items: list[Item], stats: Statistics, size: int) -> tuple[list[Window], list[Item]]:
    """Full windows of a shard, and the items that did not fill another one (in the order of that window)."""
    index = Index(items, stats)
    unused = np.ones(len(items), dtype=bool)
    windows: list[Window] = []
    room = sum(i.left for i in items)
    seed: int | None = None
    first = 0
    while room >= size:
        if seed is None:
            while not unused[first]:
                first += 1
            seed = first
        order = np.argsort(np.where(unused, -index.scores(seed), 1.0), kind="stable")
        window: Window = []
        free = size
        following = None
        for k in chain((seed,), order.tolist()):
            if not unused[k] or k == seed and window:
                continue
            item = items[k]
            take = min(free, item.left)
            window.append((item, item.used, item.used + take))
            item.used += take
            free -= take
            if item.left:
                following = k
            else:
                unused[k] = False
            if not free:
                break
        windows.append(window)
        room -= size
        seed = following
    rest = [] if seed is None else [items[seed]]
    return windows, rest + [i for k, i in enumerate(items) if unused[k] and k != seed]


def _pack(shared: Broadcast, size: int, shard: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stats: Statistics = shared.value
        number = TaskContext.get().partitionId() * NUMBERED
        held: list[Item] = []

        def rows(window: Window) -> list[tuple]:
            nonlocal number
            out, offset = [], 0
            for item, lo, hi in window:
                crc = zlib.crc32(item.ids[lo:hi].astype("<u4").tobytes())
                out.append((item.doc_id, item.start + lo, hi - lo, crc, item.doc_tokens, 2 * number + 1, offset))
                offset += hi - lo
            number += 1
            return out

        def frame(out: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(out, columns=COLUMNS, dtype=object)

        def shards() -> Iterator[pd.DataFrame]:
            nonlocal held
            while len(held) >= shard:
                # very short items: as many as give some windows
                many = max(shard, 1 + int(np.searchsorted(np.cumsum([i.left for i in held]), 4 * size)))
                if many > len(held):
                    break
                windows, rest = fill(held[:many], stats, size)
                # an item that was begun counts on as an item of its own
                held = [Item(i.doc_id, i.doc_tokens, i.start + i.used, i.ids[i.used :]) for i in rest] + held[many:]
                yield frame([r for w in windows for r in rows(w)])

        for batch in batches:
            for doc_id, tokens, start, length, raw in zip(*(batch[c] for c in ("doc_id", "doc_tokens", "start", "length", "ids"))):
                held.append(Item(doc_id, int(tokens), int(start), _ids(raw, int(length))))
            yield from shards()
        if held:
            windows, rest = fill(held, stats, size)
            out = [r for w in windows for r in rows(w)]
            left, room = rest, sum(i.left for i in rest)
            while room:
                window, free = [], 1 << (room.bit_length() - 1)
                room -= free
                while free:
                    take = min(free, left[0].left)
                    window.append((left[0], left[0].used, left[0].used + take))
                    left[0].used += take
                    free -= take
                    if not left[0].left:
                        left = left[1:]
                out += rows(window)
            yield frame(out)

    return run


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(
    docs: DataFrame,
    rank_file: str,
    size: int = SIZE,
    end_id: int = 1,
    shard: int = SHARD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    fields = f"item bigint, doc_id {kind}, doc_tokens bigint, start bigint, length bigint, ids_crc32 bigint, ids binary"
    cut = stage(texts.mapInPandas(_items(rank_file, size, end_id), fields), "items")
    items = cut.where("ids is not null").select("item", "doc_id", "doc_tokens", "start", "length", "ids")
    stats = spark.sparkContext.broadcast(statistics(items))
    order = ["t1", "t2", "tie", "item"]
    keyed = items.mapInPandas(_rarest(stats), f"item bigint, doc_id {kind}, doc_tokens bigint, start bigint, length bigint, ids binary, t1 bigint, t2 bigint")
    dealt = keyed.withColumn("tie", F.xxhash64("item")).repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    out = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    packed = dealt.select("doc_id", "doc_tokens", "start", "length", "ids").mapInPandas(_pack(stats, size, shard), out)
    alone = cut.where("ids is null").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("item") * 2).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    # written once: the borders of the ranges are drawn anew whenever they are computed
    return stage(packed.unionByName(alone), "packed")
