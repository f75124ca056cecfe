"""Near-duplicate texts by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all signature coordinates: the first scatters the shingle hashes over a circle of
2^32 places, the second is applied after shifting that circle by k, and coordinate k is the smallest value.

The work runs in five steps, each over the whole table:

1. One pass over the texts gives set size, 128-bit fingerprint, band keys and the low byte of every coordinate.
2. Texts with equal sets (copies) are one class; the class goes on as a number of its own, with the text of its smallest id.
3. Classes that share a band are compared by their bytes inside the band's bucket. A bucket emits a spanning
   forest of the pairs whose estimate lies within five standard deviations of the threshold, never all pairs;
   a bucket larger than ``block`` is dealt out as pairs of blocks.
4. The forests' components gather the classes that may be linked. Their texts are read once, and inside each
   component the pairs are verified on full sets, again in pairs of blocks, skipping pairs already connected.
5. Components of the verified links give the result.

Defined cases: null or empty texts and texts without words have an empty set and are linked with nothing; rows that
repeat a ``doc_id`` are judged each by its own text, so they share a component only if their texts are linked (two
components may then have the same smallest id); a null ``doc_id`` is linked with nothing, gets a null component and is
kept; ties go to the smaller id; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrid.llm.common import (
    MIX1,
    MULT,
    UnionFind,
    components,
    free_name,
    mix64,
    save,
    shared_count,
    shuffle_width,
    shingle_set,
    sorted_groups,
    stage,
)

BANDS, ROWS = 24, 5
BLOCK = 1024
_M1, _M2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)  # fixed values: multipliers of a 32-bit integer mixer


def _second_permutation(x: np.ndarray) -> np.ndarray:
    """A bijection on 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= _M1
    x ^= x >> np.uint32(13)
    x *= _M2
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """``size`` coordinates of a non-empty set of 64-bit hashes."""
    first = (mix64(shingles * MULT + MIX1) >> np.uint64(32)).astype(np.uint32)
    out = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    for lo in range(0, len(first), 4096):
        np.minimum(out, _second_permutation(first[None, lo : lo + 4096] + shift).min(axis=1), out=out)
    return out


def describe(width: int = 5, bands: int = BANDS, rows: int = ROWS):
    """Batch function (doc_id, text, digest) -> (doc_id, digest, n_shingles, f1, f2, bands, bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        np.seterr(over="ignore")
        weights = mix64(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        salt = mix64(np.arange(bands, dtype=np.uint64) + np.uint64(77))
        for batch in batches:
            out = []
            for doc_id, text, digest in zip(batch["doc_id"], batch["text"], batch["digest"]):
                s = shingle_set(text, width)
                if not len(s):
                    out.append((doc_id, digest, 0, None, None, None, None))
                    continue
                sig = signature(s, bands * rows)
                keys = mix64((sig.astype(np.uint64).reshape(bands, rows) * weights).sum(axis=1, dtype=np.uint64) + salt)
                out.append(
                    (
                        doc_id,
                        digest,
                        len(s),
                        int(mix64(s).sum(dtype=np.uint64).view(np.int64)),
                        int(mix64(s ^ MIX1).sum(dtype=np.uint64).view(np.int64)),
                        keys.view(np.int64),
                        (sig & np.uint32(255)).astype(np.uint8).tobytes(),
                    )
                )
            frame = pd.DataFrame(out, columns=["doc_id", "digest", "n_shingles", "f1", "f2", "keys", "bytes"], dtype=object)
            yield frame

    return run


DESCRIBED = "doc_id bigint, digest string, n_shingles bigint, f1 bigint, f2 bigint, keys array<bigint>, bytes binary"


def _floor(threshold: float, size: int) -> float:
    """Estimates below this belong to pairs under the threshold, but for five standard deviations."""
    return threshold - 5 * (threshold * (1 - threshold) / size) ** 0.5


def _forest_of_bucket(size: int, floor: float):
    need = int(np.ceil(floor * size))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, i, j), rows in sorted_groups(batches, ["key", "i", "j"]):
            ids = rows["id"].to_numpy()
            side = rows["side"].to_numpy()
            sig = np.frombuffer(b"".join(rows["bytes"]), dtype=np.uint8).reshape(len(ids), size)
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if i == j else 1))
            parts, links = UnionFind(len(ids)), []
            for at, x in enumerate(left):
                others = right[at + 1 :] if i == j else right
                if not len(others):
                    continue
                hits = others[(sig[others] == sig[x]).sum(axis=1) >= need]
                links += [(ids[x], ids[y]) for y in hits.tolist() if parts.union(int(x), y)]
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return run


def _verify(width: int, size: int, floor: float, per_hundred: int):
    need = int(np.ceil(floor * size))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        np.seterr(over="ignore")
        for (_, i, j), rows in sorted_groups(batches, ["cluster", "i", "j"]):
            ids, side = rows["id"].to_numpy(), rows["side"].to_numpy()
            sets = [shingle_set(t, width) for t in rows["text"]]
            n = np.array([len(s) for s in sets])
            sig = np.frombuffer(b"".join(rows["bytes"]), dtype=np.uint8).reshape(len(ids), size)
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if i == j else 1))
            parts, links = UnionFind(len(ids)), []
            for at, x in enumerate(left.tolist()):
                others = right[at + 1 :] if i == j else right
                if not len(others):
                    continue
                fits = 100 * np.minimum(n[others], n[x]) >= per_hundred * np.maximum(n[others], n[x])
                hits = others[fits & ((sig[others] == sig[x]).sum(axis=1) >= need)]
                for y in hits.tolist():
                    if parts.find(x) != parts.find(y):
                        common = shared_count(sets[x], sets[y])
                        if 100 * common >= per_hundred * (int(n[x]) + int(n[y]) - common):
                            parts.union(x, y)
                            links.append((ids[x], ids[y]))
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return run


def _in_blocks(members: DataFrame, group: str, counts: DataFrame, block: int, tie: str) -> DataFrame:
    """Deals the rows of each group into blocks and repeats each row for the pairs of blocks it takes part in.

    ``counts`` has (group, n). A group of up to ``block`` rows is one pair (0, 0); larger ones are spread by hash.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64(tie), F.col("blocks")).cast("int")
    dealt = members.join(counts, group).withColumn("blocks", blocks).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (
        dealt.select("*", other.alias("other"))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .withColumn("side", F.when(F.col("own") == F.col("i"), 0).otherwise(1))
        .drop("n", "blocks", "own", "other")
    )


def near_duplicates(
    docs: DataFrame,
    per_hundred: int = 80,
    width: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Links texts with ``100 * |A and B| >= per_hundred * |A or B|`` on their full sets of ``width``-word shingles.
    """
    size = BANDS * ROWS
    floor = _floor(per_hundred / 100, size)
    # few bytes, long work: a number keeps these shuffles from being put into a handful of tasks
    tasks = shuffle_width(docs.sparkSession)
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _digest(text_col).alias("digest")
    )
    known = stage(texts.mapInPandas(describe(width), DESCRIBED), "minhash")

    full = known.where("n_shingles > 0 and doc_id is not null")
    # one row for each class: a number, its smallest id, which text of that id, and the description all its members share
    classes = stage(
        full.groupBy("f1", "f2")
        .agg(F.min(F.struct("doc_id", "digest")).alias("head"), F.first("keys").alias("keys"), F.first("bytes").alias("bytes"))
        .select("f1", "f2", "head.doc_id", "head.digest", "keys", "bytes", F.monotonically_increasing_id().alias("id")),
        "classes",
    )
    heads = classes.select("id", "doc_id", "digest", "keys", "bytes")
    buckets = heads.select("id", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    held = buckets.join(shared, "key").select("key", "id", "n")
    candidates = (
        _in_blocks(held.drop("n"), "key", shared, block, "id")
        .join(heads.select("id", "bytes"), "id")
        .repartition(tasks, "key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "side", "id")
        .select("key", "i", "j", "side", "id", "bytes")
        .mapInPandas(_forest_of_bucket(size, floor), "a bigint, b bigint")
    )
    clusters = stage(components(candidates).select("id", F.col("component").alias("cluster")), "clusters")
    sizes = stage(clusters.groupBy("cluster").agg(F.count("*").alias("n")), "sizes")
    pairs = (
        _in_blocks(clusters, "cluster", sizes, block, "id")
        .join(heads.select("id", "doc_id", "digest", "bytes"), "id")
        .join(texts, ["doc_id", "digest"])
        # rows that repeat id and text are one class: one of them goes on, however many there are
        .dropDuplicates(["cluster", "i", "j", "side", "id"])
        .repartition(tasks, "cluster", "i", "j")
        .sortWithinPartitions("cluster", "i", "j", "side", "id")
        .select("cluster", "i", "j", "side", "id", "bytes", "text")
        .mapInPandas(_verify(width, size, floor, per_hundred), "a bigint, b bigint")
    )
    found = stage(components(pairs), "links")
    least = found.join(classes.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("least"))
    # every class' component, then every row's; only classes that were joined to others are looked up
    final = classes.select("f1", "f2", "id", "doc_id").join(found.join(least, "component"), "id", "left").select(
        "f1", "f2", F.coalesce("component", "id").alias("group"), F.coalesce("least", "doc_id").alias("component_id")
    )
    marks = (
        known.select("doc_id", "digest", "n_shingles", "f1", "f2")
        .join(stage(final, "components"), ["f1", "f2"], "left")
        .select(
            "doc_id",
            "digest",
            F.col("n_shingles").cast("bigint").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.col("group")).alias("group"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
    )
    marks = marks.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    path = save(marks, "marks")
    # ``kept`` says where its rows' texts are told apart, for keep_one
    kept = F.col("kept").alias("kept", metadata={MARKS: path})
    return docs.sparkSession.read.schema(marks.schema).parquet(path).select("doc_id", "n_shingles", "component_id", kept)


MARKS = "quotegrid.minhash.marks"


def _digest(text_col: str) -> Column:
    return F.coalesce(F.md5(F.col(text_col).cast("string")), F.lit(""))


def keep_one(docs: DataFrame, verdict: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component in ``docs``, of its smallest id; rows without id all stay.

    Rows that repeat an id are told apart by their texts; of those with the same text, the smallest stays. ``verdict`` is
    the result of :func:`near_duplicates` on ``docs``; from any other, every text of a kept id stays.
    """
    where = verdict.schema["kept"].metadata.get(MARKS)
    digest = _digest(text_col)
    own_id, own_digest = (free_name(n, docs.columns) for n in ("__id", "__digest"))
    if where is None:
        kept = verdict.where(F.col("doc_id").isNotNull() & F.col("kept")).select(F.col("doc_id").alias(own_id)).distinct()
        named = docs.join(kept, F.col(id_col).cast("bigint") == F.col(own_id), "left_semi")
    else:
        marks = docs.sparkSession.read.parquet(where).where("doc_id is not null")
        # texts without words are in no group: one row for each id
        alone = F.when(F.col("group").isNull(), F.col("doc_id"))
        kept = marks.groupBy("group", alone.alias("alone")).agg(F.min(F.struct("doc_id", "digest")).alias("head"))
        kept = kept.select(F.col("head.doc_id").alias(own_id), F.col("head.digest").alias(own_digest))
        named = docs.join(kept, (F.col(id_col).cast("bigint") == F.col(own_id)) & (digest == F.col(own_digest)), "left_semi")
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]))
    one = named.groupBy(F.col(id_col).cast("bigint"), digest).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), rest).alias("row"))
    return one.select("row.*").unionByName(docs.where(F.col(id_col).isNull()))
