"""Phrase collocations by SON partitioning: mine shards at lowered support, union, then count all candidates globally.

Everything is per language. Documents are dealt into ``SHARDS`` shards by hash. A phrase that occurs ``support`` times
occurs at least ``support * words of the shard / all words`` times in some shard, so the union of the phrases that reach
this in any shard holds every frequent one. A shard is a share of the corpus, not a task: its phrases are counted by many
tasks and combined by key, so it may be of any size. Four passes over the texts:

1. Words: exact counts of all words, and the number of words of every language and shard.
2. Word pairs of frequent words, by shard.
3. Runs of three and four words whose pairs all are frequent in the shard, by shard.
4. All occurrences of the union's phrases, over everything. Those with the full support are the result's candidates.

What a pass may skip is told by a bitmap (two bits a phrase, at most ``WORDS_OF_BITS`` 64-bit words, sized by the
number of phrases, grown fuller beyond that): it holds all that must not be skipped, and what it lets through besides
is only counted in vain. Words are known by 64-bit hashes, phrases by the hashes of their words; two different words
with one hash would be seen when the words are counted, and stop the run.

Scores use integers alone (decimals of 38 digits where products may pass 64 bits).

Defined cases: a null text is empty; a null language is ``und`` and goes with that; white space other than space and
tab, and anything but A-Z, is taken as it is; very long texts are read in blocks that carry on the last three words, very
long words are known by their hashes like others; repeated rows count each; ties end with the phrase itself, so all
results are determined; an empty table gives an empty result. Only the language and text columns (and, for dealing,
the id) are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotegrid.llm.common import LOWER, MULT, mix64, shuffle_width, sorted_groups, stage

SHARDS = 4
LONGEST = 4
SUPPORT = 30
WORDS_OF_BITS = 1 << 22
KNOWN_WORDS = 300_000
AT_ONCE = 1 << 21  # words of a task that are counted together
RANGE_BYTES = 1 << 24  # of text for each range of hashes
SALTS = 64
BREAK, NONE = 1, 0
# fixed values: the contract's piece ends become line breaks, tabs become spaces
_TABLE = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in LOWER)


_CUT = re.compile(rb"[ \n]")


# ---------------------------------------------------------------- words of a task
class Words(dict):
    """Numbers of words as they come, with their hashes; 0 is nothing, 1 the end of a piece."""

    def __init__(self):
        super().__init__()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.names: list[bytes] = []
        self.digests = bytearray()
        for word in (b"", b"\n"):
            self[word]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.names)
        self.names.append(word)
        self.digests += hashlib.blake2b(word, digest_size=8).digest()
        return number

    def hashes(self) -> np.ndarray:
        return np.frombuffer(bytes(self.digests), dtype="<u8")

    def of(self, block: bytes) -> np.ndarray:
        tokens = block.replace(b"\n", b" \n ").split(b" ")
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.int32, count=len(tokens))


def _blocks(text: str | None, size: int = 1 << 20) -> Iterator[bytes]:
    """The text with lower-cased A-Z, line breaks for piece ends and spaces between words, cut after spaces and breaks."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(raw):
        end = at + size
        if end >= len(raw):
            end = len(raw)
        else:
            after = _CUT.search(raw, end)
            end = after.end() if after else len(raw)
        yield raw[at:end]
        at = end


Group = tuple[str, int]


@dataclass
class Run:
    """Words of one group: numbers and hashes, the piece each is in, and how many at the front were counted before."""

    numbers: np.ndarray
    hashes: np.ndarray
    piece: np.ndarray
    before: int
    names: list[bytes]
    lang: np.uint64

    def starts(self, size: int) -> np.ndarray:
        """Where runs of ``size`` words within a piece begin that end in a word not counted before."""
        n = len(self.numbers) - size + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64)
        return np.flatnonzero((self.piece[:n] == self.piece[size - 1 :]) & (np.arange(size - 1, n + size - 1) >= self.before))

    def phrase_hashes(self, starts: np.ndarray, size: int) -> np.ndarray:
        total = np.zeros(len(starts), dtype=np.uint64)
        for j in range(size):
            total = mix64(total * MULT + self.hashes[starts + j])
        return mix64(total ^ self.lang)


def hash_of(text: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), dtype="<u8")[0]


def _each(count: Callable[[Run, int], pd.DataFrame | None], at_once: int = AT_ONCE):
    """Batch function that gathers the words of each (lang, shard) and hands them to ``count`` in large groups."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        np.seterr(over="ignore")
        words = Words()
        held: dict[Group, list[np.ndarray]] = {}
        before: dict[Group, int] = {}
        stop = np.array([BREAK], dtype=np.int32)
        total = 0

        def flush() -> Iterator[pd.DataFrame]:
            hashes = words.hashes()
            for group, parts in held.items():
                every = np.concatenate(parts)
                real = every > BREAK
                numbers = every[real]
                piece = np.cumsum(every == BREAK)[real]
                found = count(Run(numbers, hashes[numbers], piece, before.get(group, 0), words.names, hash_of(group[0])), group[1])
                if found is not None and len(found):
                    found.insert(0, "lang", group[0])
                    yield found

        for batch in batches:
            for lang, shard, text in zip(batch["lang"], batch["shard"], batch["text"]):
                group = (lang, int(shard))
                for block in _blocks(text):
                    held.setdefault(group, []).append(words.of(block))
                    total += len(held[group][-1])
                    if total >= at_once or len(words) >= KNOWN_WORDS:
                        # an unfinished piece goes on: its last words come first in the next run, as counted before
                        every = np.concatenate(held[group])
                        last = every[every != NONE][-(LONGEST - 1) :]
                        ended = np.flatnonzero(last == BREAK)
                        names = [words.names[i] for i in last[ended[-1] + 1 if len(ended) else 0 :]]
                        yield from flush()
                        total = 0
                        if len(words) >= KNOWN_WORDS:
                            words.reset()
                        held, before = {group: [np.array([words[w] for w in names], dtype=np.int32)]}, {group: len(names)}
                if group in held:
                    held[group].append(stop)
        yield from flush()

    return run


# ---------------------------------------------------------------- what a pass need not look at
def bitmap(hashes: DataFrame, words_of_bits: int = WORDS_OF_BITS) -> np.ndarray:
    """Two bits set for each ``h``; as many 64-bit words as half the number of hashes, up to ``words_of_bits``."""
    rows = hashes.count()
    words = min(words_of_bits, 1 << max(6, (rows // 2).bit_length()))
    places = F.array(*(p.bitwiseAND(F.lit(64 * words - 1)) for p in (F.col("h"), F.call_function("shiftrightunsigned", F.col("h"), F.lit(32)))))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))
    found = (
        hashes.select(F.explode(places).alias("p"))
        .groupBy(F.shiftright("p", 6).cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
        .toArrow()
    )
    out = np.zeros(words, dtype=np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    last = np.uint64(64 * len(bits) - 1)
    found = np.ones(len(h), dtype=bool)
    for p in (h & last, (h >> np.uint64(32)) & last):
        found &= (bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return found


def shard_marks(shards: int) -> np.ndarray:
    """What the hash of a phrase is changed by in each shard."""
    return mix64(np.arange(1, shards + 1, dtype=np.uint64) * MULT)


# ---------------------------------------------------------------- counts on their way
# counts travel as sorted arrays, one block for each range of hashes, not as a row each
COUNTED = np.dtype([("h", "<u8"), ("n", "<u8")])
SPELT = np.dtype([("h", "<u8"), ("n", "<u8"), ("size", "u1"), ("w", "<u8", LONGEST)])
BLOCKS = "lang string, shard int, range int, block binary"


def _cut(entries: np.ndarray, shard: int, ranges: int) -> pd.DataFrame:
    """Entries sorted by hash as one block for each of ``ranges`` (a power of two) equal ranges."""
    bits = ranges.bit_length() - 1
    place = (entries["h"] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(entries), dtype=np.int64)
    number, first = np.unique(place, return_index=True)
    ends = np.append(first[1:], len(entries))
    return pd.DataFrame(
        {"shard": shard, "range": number.astype(np.int32), "block": [entries[lo:hi].tobytes() for lo, hi in zip(first, ends)]}
    )


def _hash_counts(found: list[np.ndarray]) -> np.ndarray:
    h, n = np.unique(np.concatenate(found), return_counts=True)
    out = np.empty(len(h), dtype=COUNTED)
    out["h"], out["n"] = h, n
    return out


def _summed(entries: np.ndarray) -> np.ndarray:
    """One entry for each hash (and, where there are words, for each phrase) with the sum of its counts."""
    entries = entries[np.argsort(entries["h"], kind="stable")]
    change = entries["h"][1:] != entries["h"][:-1]
    if "w" in entries.dtype.names:
        other = (entries["w"][1:] != entries["w"][:-1]).any(axis=1) | (entries["size"][1:] != entries["size"][:-1])
        if (other & ~change).any():  # two phrases with one hash: told apart by all words
            entries = entries[np.lexsort([*entries["w"].T, entries["size"], entries["h"]])]
            change = (entries["w"][1:] != entries["w"][:-1]).any(axis=1) | (entries["size"][1:] != entries["size"][:-1])
            change |= entries["h"][1:] != entries["h"][:-1]
    first = np.flatnonzero(np.concatenate(([True], change)))
    out = entries[first]
    out["n"] = np.add.reduceat(entries["n"], first)
    return out


# ---------------------------------------------------------------- the passes
WORD_BLOCKS = "lang string, shard int, range int, block binary, names binary, words bigint"


def _count_words(ranges: int, at_once: int = AT_ONCE):
    """Blocks of word counts with the words themselves, and a row without a block for the words of each (lang, shard)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        totals: dict[Group, int] = {}
        counts: dict[str, np.ndarray] = {}
        held: dict[str, list[np.ndarray]] = {}
        waiting = 0

        def gather() -> None:
            for lang, parts in held.items():
                fresh = np.bincount(np.concatenate(parts), minlength=len(words))
                known = counts.get(lang)
                if known is not None:
                    fresh[: len(known)] += known
                counts[lang] = fresh
            held.clear()

        def flush() -> Iterator[pd.DataFrame]:
            gather()
            hashes = words.hashes()
            for lang, n in counts.items():
                at = np.flatnonzero(n)
                at = at[at > BREAK]
                at = at[np.argsort(hashes[at], kind="stable")]
                if not len(at):
                    continue
                entries = np.empty(len(at), dtype=COUNTED)
                entries["h"], entries["n"] = hashes[at], n[at]
                out = _cut(entries, -1, ranges)
                ends = np.cumsum(out["block"].map(len).to_numpy() // COUNTED.itemsize)
                out["names"] = [b"\n".join([words.names[i] for i in at[lo:hi].tolist()]) for lo, hi in zip([0, *ends[:-1]], ends)]
                yield out.assign(lang=lang, words=0)[["lang", "shard", "range", "block", "names", "words"]]
            counts.clear()
            words.reset()

        for batch in batches:
            for lang, shard, text in zip(batch["lang"], batch["shard"], batch["text"]):
                for block in _blocks(text):
                    numbers = words.of(block)
                    group = (lang, int(shard))
                    totals[group] = totals.get(group, 0) + int(np.count_nonzero(numbers > BREAK))
                    held.setdefault(lang, []).append(numbers)
                    waiting += len(numbers)
                    if waiting >= at_once:
                        gather()
                        waiting = 0
                    if len(words) >= KNOWN_WORDS:
                        yield from flush()
                        waiting = 0
        yield from flush()
        if totals:
            yield pd.DataFrame(
                [(lang, shard, -1, None, None, n) for (lang, shard), n in totals.items()],
                columns=["lang", "shard", "range", "block", "names", "words"],
            )

    return run


def _frequent_words(support: int):
    """Words that occur ``support`` times, from all blocks of a range; their hashes may not be shared."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        np.seterr(over="ignore")
        for (lang, _), rows in sorted_groups(batches, ["lang", "range"]):
            entries = np.frombuffer(b"".join(rows["block"]), dtype=COUNTED)
            names = [name for part in rows["names"] for name in part.split(b"\n")]
            order = np.argsort(entries["h"], kind="stable")
            h = entries["h"][order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            ends = np.append(first[1:], len(h))
            n = np.add.reduceat(entries["n"][order], first)
            out = []
            for k in np.flatnonzero(n >= support).tolist():
                spelt = {names[i] for i in order[first[k] : ends[k]].tolist()}
                if len(spelt) > 1:
                    raise RuntimeError("two words share a 64-bit hash")
                out.append((lang, h[first[k]], spelt.pop().decode("utf-8", "replace"), int(n[k])))
            if out:
                w = np.array([r[1] for r in out], dtype=np.uint64)
                yield pd.DataFrame(
                    {"lang": lang, "w": w.view(np.int64), "h": mix64(w ^ hash_of(lang)).view(np.int64),
                     "word": [r[2] for r in out], "n": [r[3] for r in out]}
                )

    return run


def _count_pairs(frequent: Broadcast, ranges: int):
    def count(run: Run, shard: int) -> pd.DataFrame:
        known = in_bitmap(frequent.value, mix64(run.hashes ^ run.lang))
        at = run.starts(2)
        at = at[known[at] & known[at + 1]]
        return _cut(_hash_counts([run.phrase_hashes(at, 2)]), shard, ranges)

    return count


def _count_longer(pairs: Broadcast, marks: np.ndarray, ranges: int):
    def count(run: Run, shard: int) -> pd.DataFrame:
        every = np.arange(max(len(run.numbers) - 1, 0))
        held = in_bitmap(pairs.value, run.phrase_hashes(every, 2) ^ marks[shard])
        found = []
        for size in range(3, LONGEST + 1):
            at = run.starts(size)
            for j in range(size - 1):
                at = at[held[at + j]]
            found.append(run.phrase_hashes(at, size))
        return _cut(_hash_counts(found), shard, ranges)

    return count


def _count_all(candidates: Broadcast, ranges: int):
    def count(run: Run, shard: int) -> pd.DataFrame:
        found = []
        for size in range(2, LONGEST + 1):
            at = run.starts(size)
            h = run.phrase_hashes(at, size)
            keep = in_bitmap(candidates.value, h)
            at, h = at[keep], h[keep]
            each = np.zeros(len(at), dtype=SPELT)
            each["h"], each["n"], each["size"] = h, 1, size
            for j in range(size):
                each["w"][:, j] = run.hashes[at + j]
            found.append(each)
        every = np.concatenate(found)
        return _cut(_summed(every), shard, ranges) if len(every) else None

    return count


def _locally_frequent(support: int):
    """Phrases that reach their shard's part of the support, from all blocks of a range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, shard, _), rows in sorted_groups(batches, ["lang", "shard", "range"]):
            words, every = int(rows["words"].iloc[0]), int(rows["every"].iloc[0])
            found = _summed(np.frombuffer(b"".join(rows["block"]), dtype=COUNTED))
            h = found["h"][found["n"] >= -(-support * words // every)]
            if len(h):
                yield pd.DataFrame({"shard": shard, "h": h.view(np.int64)})

    return run


def _frequent(support: int):
    """Phrases that occur ``support`` times over everything, from all blocks of a range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (lang, _), rows in sorted_groups(batches, ["lang", "range"]):
            found = _summed(np.frombuffer(b"".join(rows["block"]), dtype=SPELT))
            found = found[found["n"] >= support]
            if len(found):
                words = found["w"].astype(np.uint64).view(np.int64)
                ws = [w[:size] for w, size in zip(words, found["size"].tolist())]
                yield pd.DataFrame({"lang": lang, "ws": ws, "a": found["n"].astype(np.int64)})

    return run


def _whole(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def mine(
    docs: DataFrame,
    support: int = SUPPORT,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frequent phrases: lang, ws, a; frequent words: lang, w, word, n; all words of each language: lang, n).

    ``ws`` are the hashes of a phrase's words; frequent means at least ``support`` occurrences.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    text = F.col(text_col).cast("string")
    dealt = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.pmod(F.xxhash64(F.col(id_col).cast("string"), text), F.lit(shards)).cast("int").alias("shard"),
        text.alias("text"),
    )
    width = shuffle_width(spark)

    def by_range(blocks: DataFrame, *keys: str) -> DataFrame:
        return blocks.repartition(width, *keys).sortWithinPartitions(*keys)

    # the number of ranges follows the bytes of the texts, so that a range's counts fit a task
    size = dealt.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << max(0, (size // RANGE_BYTES).bit_length())
    counted = stage(dealt.mapInPandas(_count_words(ranges), WORD_BLOCKS), "words")
    in_words = by_range(counted.where("block is not null").select("lang", "range", "block", "names"), "lang", "range")
    words = stage(in_words.mapInPandas(_frequent_words(support), "lang string, w bigint, h bigint, word string, n bigint"), "frequent")
    cells = stage(counted.where("block is null").groupBy("lang", "shard").agg(F.sum("words").alias("words")).where("words > 0"), "cells")
    every = cells.groupBy("lang").agg(F.sum("words").alias("every"))
    shares = stage(cells.join(every, "lang"), "shares")

    def locally_frequent(blocks: DataFrame) -> DataFrame:
        known = blocks.join(shares, ["lang", "shard"])
        return by_range(known, "lang", "shard", "range").mapInPandas(_locally_frequent(support), "shard int, h bigint")

    marks = shard_marks(shards)
    known = context.broadcast(bitmap(words.select("h")))
    pairs = stage(locally_frequent(dealt.mapInPandas(_each(_count_pairs(known, ranges)), BLOCKS)), "pairs")
    mark = F.element_at(F.array(*(F.lit(int(m)) for m in marks.view(np.int64))), F.col("shard") + 1)
    held = context.broadcast(bitmap(pairs.select(F.col("h").bitwiseXOR(mark).alias("h"))))
    longer = stage(locally_frequent(dealt.mapInPandas(_each(_count_longer(held, marks, ranges)), BLOCKS)), "longer")
    union = stage(pairs.select("h").unionByName(longer.select("h")).distinct(), "candidates")
    wanted = context.broadcast(bitmap(union))
    found = dealt.withColumn("shard", F.lit(0)).mapInPandas(_each(_count_all(wanted, ranges)), BLOCKS)
    summed = by_range(found.select("lang", "range", "block"), "lang", "range")
    phrases = stage(summed.mapInPandas(_frequent(support), "lang string, ws array<bigint>, a bigint"), "phrases")
    for b in (known, held, wanted):
        b.unpersist()
    return phrases, words.select("lang", "w", "word", "n"), every.withColumnRenamed("every", "n")


# ---------------------------------------------------------------- scores, on counts alone
def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """lang, ws, a with l, r and score of the lowest-scoring cut."""
    units = phrases.select("lang", "ws", F.col("a").alias("n")).unionByName(words.select("lang", F.array("w").alias("ws"), "n"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("ws", F.lit(1), F.col("k"))).withColumn("right", F.slice("ws", F.col("k") + 1, F.size("ws") - F.col("k")))
    of = lambda side, n: units.select("lang", F.col("ws").alias(side), F.col("n").alias(n))
    both = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr("cast(a as decimal(19,0)) * cast(2000000 as decimal(7,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    least = both.withColumn("score", score).groupBy("lang", "ws", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "ws", "a", "cut.l", "cut.r", "cut.score")


def without_parts(phrases: DataFrame, all_phrases: DataFrame) -> DataFrame:
    """``phrases`` but those inside a longer one that occurs at least 80 times for every 100 of theirs."""
    sizes = F.sequence(F.lit(2), F.size("ws") - 1)
    parts = F.flatten(
        F.transform(sizes, lambda m: F.transform(F.sequence(F.lit(1), F.size("ws") - m + 1), lambda i: F.slice("ws", i, m)))
    )
    inside = all_phrases.where(F.size("ws") > 2).select("lang", "a", F.explode(parts).alias("ws"))
    longest = inside.groupBy("lang", "ws").agg(F.max("a").alias("longer"))
    held = phrases.join(longest, ["lang", "ws"], "left")
    return held.where(F.col("longer").isNull() | (F.lit(100) * _whole("longer") < F.lit(80) * _whole("a"))).drop("longer")


def _first(df: DataFrame, order: list[Column], limit: int, salt: Column) -> DataFrame:
    """``rank`` of each language's first rows; a language is ranked in salts first."""
    salted = df.withColumn("salt", F.pmod(salt, F.lit(SALTS)))
    part = Window.partitionBy("lang", "salt").orderBy(*order)
    some = salted.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= limit)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= limit).drop("salt")


def collocations(docs: DataFrame, limit: int = 2000, support: int = SUPPORT, **columns: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``limit`` phrases."""
    phrases, words, every = mine(docs, support, **columns)
    rated = stage(without_parts(scored(phrases, words), phrases), "rated")
    order = [F.col("score").desc(), F.col("a").desc()]
    # texts only for what may be among the first: all that are not behind the last of them
    last = _first(rated, order, limit, F.xxhash64("ws")).where(F.col("rank") == limit)
    bound = last.select("lang", F.struct("score", "a").alias("bound"))
    near = rated.join(bound, "lang", "left").where(F.col("bound").isNull() | (F.struct("score", "a") >= F.col("bound"))).drop("bound")
    spelt = (
        near.select("*", F.posexplode("ws").alias("at", "w"))
        .join(words.select("lang", "w", "word"), ["lang", "w"])
        .groupBy("lang", "ws", "a", "l", "r", "score")
        .agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("spelt"))
        .withColumn("phrase", F.concat_ws(" ", F.col("spelt.word")))
    )
    ranked = _first(spelt, [*order, F.col("phrase")], limit, F.xxhash64("ws"))
    return ranked.join(every, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
