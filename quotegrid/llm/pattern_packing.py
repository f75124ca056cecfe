"""Packing token sequences by length patterns fitted with non-negative least squares.

1. One pass over the texts: tokens of every document, cut into pieces of at most ``size`` tokens (only documents
   that are longer; the first piece takes the remainder), with a checksum of each piece's ids.
2. The histogram of piece lengths (at most ``size`` numbers, whatever the table) goes to the driver. There, patterns of
   up to ``depth`` lengths that fill a sequence are enumerated over length classes, repeat counts are fitted to the
   histogram by non-negative least squares and rounded down to what the histogram really holds, and the residual is
   packed best-fit, longest first. The plan is a table of (length, ranks from-to, first sequence, offset).
3. Every piece gets its rank among the pieces of its length, in parallel also where one length holds most rows
   (rank inside a salt, plus the salt's start), and finds its place in the plan by binary search.

No group of pieces is ever gathered. Defined cases: a null text is empty and has the end token alone; a null ``doc_id``
is packed like any other; repeated rows are packed each for itself, ties between them are arbitrary; an empty table
gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotegrid.llm.common import stage

SIZE = 2048
SALTS = 256
WHITE_PAIR = re.compile(r"\s\s")
# the split pattern's white space; a run as long as this is split here, before the pattern's look-ahead meets it, since
# that needs a stack as deep as the run
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = re.compile(f"[{_WHITE}]{{4096,}}")
# the split pattern of the rank file; the second form lacks the look-ahead, which matters only before a second
# white space, and runs about twice as fast
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PATTERN_SINGLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


class ByteTokens:
    """Token ids of whole texts by a file of byte-pair ranks; the special token's string is that token."""

    def __init__(self, rank_file: str):
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.full = tiktoken.Encoding("full", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.single = tiktoken.Encoding("single", pat_str=PATTERN_SINGLE, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> list[int]:
        out: list[int] = []
        for k, part in enumerate((text or "").split(SPECIAL)):
            if k:
                out.append(SPECIAL_ID)
            at = 0
            # a run is one piece; its last character goes with what follows, if anything does
            for run in LONG_RUN.finditer(part):
                stop = run.end() - (run.end() < len(part))
                out += self._ordinary(part[at : run.start()]) + self.single.encode_ordinary(part[run.start() : stop])
                at = stop
            out += self._ordinary(part[at:])
        return out

    def _ordinary(self, part: str) -> list[int]:
        return (self.full if WHITE_PAIR.search(part) else self.single).encode_ordinary(part)


def _pieces(rank_file: str, size: int, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = ByteTokens(rank_file)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.array([*tokens(text), end_id], dtype="<u4")
                first = len(ids) % size or size
                cuts = [0, *range(first, len(ids) + 1, size)]
                for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                    rows.append((number, doc_id, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())))
                    number += 1
            yield pd.DataFrame(rows, columns=["row", "doc_id", "piece", "start", "length", "ids_crc32"], dtype=object)

    return run


# ---------------------------------------------------------------- the plan, from a histogram alone
def enumerate_patterns(classes: np.ndarray, units: int, depth: int) -> np.ndarray:
    """Rows of counts per class: every combination of up to ``depth`` class widths that fills ``units`` exactly."""
    widths = [int(w) for w in classes]
    have, rows = set(widths), []
    at = {w: k for k, w in enumerate(widths)}

    def grow(chosen: list[int], left: int, most: int) -> None:
        if left == 0:
            row = np.zeros(len(widths), dtype=np.float32)
            for w in chosen:
                row[at[w]] += 1
            rows.append(row)
        elif len(chosen) == depth - 1:
            if left in have and left <= most:
                grow([*chosen, left], 0, left)
        else:
            for w in widths:
                if w <= min(left, most):
                    grow([*chosen, w], left - w, w)

    grow([], units, units)
    return np.array(rows, dtype=np.float32).reshape(len(rows), len(widths))


def fit_counts(patterns: np.ndarray, wanted: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Non-negative repeat counts whose pattern totals come closest to ``wanted``, by accelerated projected gradient."""
    if not len(patterns):
        return np.zeros(0)
    scale = max(float(wanted.sum()), 1.0)
    a, b = patterns.astype(np.float64), wanted / scale
    v = np.ones(a.shape[1])
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 1.0 / float(np.linalg.norm(a.T @ (a @ v)) * 1.05)
    x = np.zeros(len(a))
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * (a @ (y @ a - b)), 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        if np.abs(new - x).max() < 1e-12:
            x = new
            break
        x, t = new, t_new
    return x * scale


@dataclass
class Plan:
    """For each length, consecutive ranges of ranks: rank from, first sequence, offset; arrays sorted by (length, from)."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def plan_packing(histogram: dict[int, int], size: int = SIZE, unit: int = 16, depth: int = 3) -> Plan:
    """Packs a histogram of lengths; its work depends on ``size``, ``unit`` and ``depth``, not on the counts."""
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    bins: list[tuple[list[int], int]] = []  # (lengths in a sequence, how many such sequences)
    if size in left:
        bins.append(([size], left.pop(size)))
    units = size // unit
    up = {n: -(-n // unit) for n in left}
    if left and units >= 2:
        classes = np.array(sorted(set(up.values())))
        wanted = np.array([sum(c for n, c in left.items() if up[n] == w) for w in classes], dtype=np.float64)
        patterns = enumerate_patterns(classes, units, depth)
        counts = np.floor(fit_counts(patterns, wanted) + 1e-9).astype(np.int64)
        pools = {int(w): sorted((n for n in left if up[n] == w), reverse=True) for w in classes}

        def closest(free: int, w: int) -> list[int]:
            top = range(-(-free // unit), w - 1, -1)
            return [n for v in top for n in pools.get(v, ())]

        for k in np.argsort(-counts, kind="stable"):
            slots = [int(w) for w, m in zip(classes[::-1], patterns[k][::-1]) for _ in range(int(m))]
            want = int(counts[k])
            while want > 0:
                # the longest length still there in each slot's class; the last slot takes the longest that fits,
                # also from above its class, which uses what rounding up has left over
                chosen: list[int] = []
                for k_slot, w in enumerate(slots):
                    free = size - sum(chosen)
                    pool = pools[w] if k_slot < len(slots) - 1 else closest(free, w)
                    n = next((n for n in pool if n <= free and left[n] > chosen.count(n)), None)
                    if n is None:
                        break
                    chosen.append(n)
                if len(chosen) < len(slots):
                    break
                # as many repeats as all slots allow
                repeat = min([want, *(left[n] // chosen.count(n) for n in chosen)])
                bins.append((chosen, repeat))
                for n in chosen:
                    left[n] -= repeat
                want -= repeat
    # the residual: best fit, longest first, also into the room that rounded-up classes have left
    room: dict[int, list[tuple[list[int], int]]] = {}
    for chosen, repeat in bins:
        room.setdefault(size - sum(chosen), []).append((chosen, repeat))
    for n in sorted((n for n, c in left.items() if c > 0), reverse=True):
        count = left[n]
        while count > 0:
            fit = min((r for r in room if r >= n), default=None)
            if fit is None:
                each = size // n
                full, rest = divmod(count, each)
                for m, repeat in ((each, full), (rest, 1)):
                    if m and repeat:
                        room.setdefault(size - m * n, []).append(([n] * m, repeat))
                break
            chosen, repeat = room[fit].pop()
            if not room[fit]:
                del room[fit]
            take = min(count, repeat)
            room.setdefault(fit - n, []).append(([*chosen, n], take))
            if repeat > take:
                room.setdefault(fit, []).append((chosen, repeat - take))
            count -= take
    used: dict[int, int] = {}
    rows, first = [], 0
    for r in sorted(room):
        for chosen, repeat in room[r]:
            at = 0
            for n in chosen:
                rows.append((n, used.get(n, 0), first, at))
                used[n] = used.get(n, 0) + repeat
                at += n
            first += repeat
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(len(rows), 4).T
    return Plan(*cols, sequences=first)


def _place(plan: Plan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths = np.unique(plan.length)
        begin = np.searchsorted(plan.length, lengths)
        end = np.searchsorted(plan.length, lengths, side="right")
        span = {int(n): (b, e) for n, b, e in zip(lengths, begin, end)}
        for batch in batches:
            n, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.empty(len(batch), dtype=np.int64)
            for value in np.unique(n):
                b, e = span[int(value)]
                mine = n == value
                at[mine] = b + np.searchsorted(plan.rank[b:e], rank[mine], side="right") - 1
            out = batch.drop(columns="rank")
            out["sequence_id"] = plan.sequence[at] + rank - plan.rank[at]
            out["offset"] = plan.offset[at]
            yield out

    return run


def pack(
    docs: DataFrame,
    rank_file: str,
    size: int = SIZE,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    schema = f"row bigint, doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = stage(texts.mapInPandas(_pieces(rank_file, size, end_id), schema), "pieces")
    # by a number of their own, so that repeated rows are dealt out, too
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    counts = stage(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    # at most size x salts rows; the histogram itself has at most ``size`` rows
    before = counts.withColumn(
        "before",
        F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)),
    ).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    plan = plan_packing({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    inside = Window.partitionBy("length", "salt").orderBy("row")
    ranked = salted.withColumn("inside", F.row_number().over(inside) - 1).join(before, ["length", "salt"])
    out = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside")).alias("rank")
    ).mapInPandas(_place(plan), out)
