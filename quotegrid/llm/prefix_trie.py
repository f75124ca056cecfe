"""Conversation prefix trie: count-min screening of prefix digests, exact grouping of what may be shared.

Conversations are rebuilt (a few first turns of another one in front of a conversation's own later turns), and every
distinct sequence of first turns is a node. Only digests, lengths and ids move, never texts:

1. Turns get their place in a conversation. Rows are dealt out by range, so a conversation may reach over several tasks;
   each range's rows count on from those of the ranges before it.
2. The digest of a prefix is the exclusive-or of 128-bit hashes of (turn, place), so it too is carried over blocks of
   ``BLOCK`` places. Two different prefixes share a digest with a chance of 2^-128.
3. A count-min sketch of all prefix digests (two rows of at most 2^24 counters) screens them: an estimate of one proves
   that one conversation alone has the prefix, and so all longer ones. These tails are nodes as they stand.
4. Only the prefixes before a tail are grouped exactly, by combining aggregates. Sums over subtrees need no walk: a
   node's weight lies with its smallest member, whose own prefixes are the node's ancestors.
5. Members that end in a node are hashed in order of their ids: lists of up to ``CHUNK`` neighbouring ids as text, a node
   with several of them streams through the hash.

Defined cases: a null role or text is empty; null turns come first; rows of one conversation with equal turns are
ordered by a hash of role and text, repeated rows are turns of their own; rows without ``conv_id`` are in no
conversation; a conversation may be rebuilt to no turns, it then ends in the root; very long texts are hashed whole; an
empty table has no nodes, not even a root. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotegrid.llm.common import mix64, shuffle_width, sorted_groups, stage

FAMILY, HEAD = 5, 9  # a conversation borrows from the first of its family of ids, fewer turns than HEAD
BLOCK, CHUNK = 4096, 512
SKETCH_ROWS, LARGEST = 2, 1 << 24
NODE = ["depth", "x1", "x2"]


def borrowed_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEAD).cast("int")


def places(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, t1, t2, bytes) with ``place``, from 0, in the conversation."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "t1", "t2", "row"]
    dealt = (
        turns.withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(shuffle_width(turns.sparkSession), *order)
        .withColumn("range", F.spark_partition_id())
    )
    dealt = stage(dealt, "turns")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    counts = counts.select("conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "range").orderBy(*order[1:])
    ranked = dealt.withColumn("inside", F.row_number().over(inside) - 1).join(counts, ["conv_id", "range"])
    return ranked.select("conv_id", "t1", "t2", "bytes", (F.col("before") + F.col("inside")).alias("place"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, depth from 1, c1, c2, bytes, block; conversations: conv_id, length)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit("second"), text, role).alias("t2"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    placed = stage(places(turns), "places")
    lengths = placed.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = lengths.select(
        "conv_id", "own", borrowed_turns(F.col("conv_id")).alias("head"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    )
    convs = stage(
        convs.join(lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own")), "base", "left")
        .withColumn("given", F.least("head", F.coalesce("base_own", F.lit(0))).cast("bigint"))
        .select("conv_id", "base", "head", "given", (F.col("given") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length")),
        "conversations",
    )
    first = placed.where(F.col("place") < HEAD).select(F.col("conv_id").alias("base"), "t1", "t2", "bytes", "place")
    heads = convs.join(first, "base").where(F.col("place") < F.col("given"))
    own = placed.join(convs.select("conv_id", "head", "given"), "conv_id").where(F.col("place") >= F.col("head"))
    depth = {"heads": F.col("place") + 1, "own": F.col("place") - F.col("head") + F.col("given") + 1}
    both = heads.select("conv_id", depth["heads"].alias("depth"), "t1", "t2", "bytes").unionByName(
        own.select("conv_id", depth["own"].alias("depth"), "t1", "t2", "bytes")
    )
    return (
        both.select(
            "conv_id",
            "depth",
            F.xxhash64("t1", "depth", "t2").alias("c1"),
            F.xxhash64("depth", "t2", "t1").alias("c2"),
            "bytes",
            F.floor((F.col("depth") - 1) / BLOCK).alias("block"),
        ),
        convs.select("conv_id", "length"),
    )


def prefixes(turns: DataFrame) -> DataFrame:
    """Digest (x1, x2) of every prefix and (p1, p2) of the one before it; the empty prefix has (0, 0)."""
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = turns.withColumn("l1", F.bit_xor("c1").over(inside)).withColumn("l2", F.bit_xor("c2").over(inside))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    carried = (
        turns.groupBy("conv_id", "block")
        .agg(F.bit_xor("c1").alias("c1"), F.bit_xor("c2").alias("c2"))
        .select("conv_id", "block", *(F.coalesce(F.bit_xor(f"c{i}").over(before), zero).alias(f"b{i}") for i in (1, 2)))
    )
    whole = local.join(carried, ["conv_id", "block"]).select(
        "conv_id", "depth", "bytes", "c1", "c2", *(F.col(f"b{i}").bitwiseXOR(F.col(f"l{i}")).alias(f"x{i}") for i in (1, 2))
    )
    return whole.select(
        "conv_id", "depth", "bytes", "x1", "x2", *(F.col(f"x{i}").bitwiseXOR(F.col(f"c{i}")).alias(f"p{i}") for i in (1, 2))
    )


# ---------------------------------------------------------------- count-min screening
def _cells(x1: np.ndarray, x2: np.ndarray, width: int) -> list[np.ndarray]:
    """The counter of every digest in each row of the sketch."""
    one, two = x1.astype(np.int64).view(np.uint64), x2.astype(np.int64).view(np.uint64)
    return [(mix64(one ^ mix64(two + np.uint64(r + 1))) & np.uint64(width - 1)).astype(np.int64) for r in range(SKETCH_ROWS)]


def _count(width: int, at_once: int = 1 << 18):
    """Counters that the rows of a task touch: (tile of 4,096 counters, counter in it, count), never all of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def counted() -> pd.DataFrame:
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"cell": cell, "n": n.astype(np.int64)})

        for batch in batches:
            for r, cell in enumerate(_cells(batch["x1"].to_numpy(), batch["x2"].to_numpy(), width)):
                held.append(cell + r * width)
            if sum(map(len, held)) >= at_once:
                yield counted()
                held = []
        if held:
            yield counted()

    return run


def sketch(digests: DataFrame, width: int) -> np.ndarray:
    """One bit for each counter, set where it counted more than one; at most SKETCH_ROWS x LARGEST bits."""
    counts = digests.mapInPandas(_count(width), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("cell") % 64).cast("int"))
    words = counts.where("n > 1").groupBy(F.floor(F.col("cell") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    found = words.toArrow()
    out = np.zeros(max(SKETCH_ROWS * width // 64, 1), dtype=np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def _screen(shared: "np.ndarray | object", width: int):
    """Adds ``alone``: the estimate of the prefix is one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for batch in batches:
            many = np.ones(len(batch), dtype=bool)
            for r, cell in enumerate(_cells(batch["x1"].to_numpy(), batch["x2"].to_numpy(), width)):
                at = cell + r * width
                many &= (bits[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1
            yield batch.assign(alone=~many)

    return run


# ---------------------------------------------------------------- digests of ids
def _hash_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the comma-joined lists of each node; a node's lists may come in several batches."""
    key, digest = None, None
    for batch in batches:
        out = []
        for depth, x1, x2, ids in zip(batch["depth"], batch["x1"], batch["x2"], batch["ids"]):
            if (depth, x1, x2) != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (depth, x1, x2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=[*NODE, "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): ids in ascending order, joined by commas."""
    chunk = F.floor(F.col("conv_id") / CHUNK).alias("chunk")
    listed = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")))
    lists = stage(ends.groupBy(*NODE, chunk).agg(listed.alias("ids")), "ends")
    several = lists.groupBy(*NODE).agg(F.count("*").alias("n"), F.first("ids").alias("ids"))
    one = several.where("n = 1").select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))
    more = (
        lists.join(several.where("n > 1").select(*NODE), NODE)
        .repartition(*NODE)
        .sortWithinPartitions(*NODE, "chunk")
        .mapInPandas(_hash_lists, "depth bigint, x1 bigint, x2 bigint, ends_sha256 string")
    )
    return one.unionByName(more)


# ---------------------------------------------------------------- the trie
def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    turns, convs = rebuilt(conversations)
    all_prefixes = stage(prefixes(turns), "prefixes")
    number = all_prefixes.count()
    width = min(LARGEST, 1 << max(10, (8 * number - 1).bit_length() if number else 10))
    bits = spark.sparkContext.broadcast(sketch(all_prefixes.select("x1", "x2"), width))
    kinds = ", ".join(f"{n} {t}" for n, t in all_prefixes.dtypes)
    screened = stage(all_prefixes.mapInPandas(_screen(bits, width), f"{kinds}, alone boolean"), "screened")
    bits.unpersist()
    # where each conversation's tail begins: all of it follows from the first prefix that it has alone
    tails = screened.where("alone").groupBy("conv_id").agg(F.min("depth").alias("tail"))
    known = convs.join(tails, "conv_id", "left").select("conv_id", "length", F.coalesce("tail", F.col("length") + 1).alias("tail"))
    known = stage(known, "lengths")
    placed = screened.drop("alone").join(known, "conv_id")
    tail_rows = placed.where("depth >= tail")
    zero = F.lit(0).cast("bigint")
    roots = known.select("conv_id", *(zero.alias(c) for c in ("depth", "bytes", "x1", "x2", "p1", "p2")), "length")
    maybe = placed.where("depth < tail").select(*roots.columns).unionByName(roots)
    shared = stage(maybe, "shared")

    nodes = stage(
        shared.groupBy(*NODE).agg(
            F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"),
            F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max((F.col("length") == F.col("depth")).cast("int")).alias("ended"),
        ),
        "nodes",
    )
    smallest = nodes.where("depth = 0").select("conv_id").first()
    root = F.lit(smallest[0] if smallest else None).cast("bigint")

    # children: nodes and first turns of tails, by the digest of the prefix before them
    begun = tail_rows.where("depth = tail").select("conv_id", "depth", "p1", "p2")
    parents = nodes.where("depth > 0").select("depth", "p1", "p2").unionByName(begun.select("depth", "p1", "p2"))
    children = parents.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(
        F.count("*").alias("n_children")
    )
    counted = stage(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)), "children")

    # subtree sums: weights lie with a node's smallest member, and every prefix of that member is an ancestor
    weighed = counted.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("w"), F.floor(F.col("depth") / BLOCK).alias("block"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    deeper = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = weighed.groupBy("conv_id", "block").agg(F.sum("w").alias("w"))
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("w").over(deeper), zero).alias("below"))
    from_here = (
        weighed.withColumn("here", F.sum("w").over(inside))
        .join(blocks, ["conv_id", "block"])
        .select("conv_id", "depth", (F.col("here") + F.col("below")).alias("own"))
    )
    leaf = counted.where("n_children = 0").select("conv_id", F.lit(1).alias("leaf"), zero.alias("w"))
    totals = (
        weighed.select("conv_id", F.lit(0).alias("leaf"), "w")
        .unionByName(leaf)
        .unionByName(begun.select("conv_id", F.lit(1).alias("leaf"), zero.alias("w")))
        .groupBy("conv_id")
        .agg(F.max("leaf").alias("leaf"), F.sum("w").alias("total"))
        .where("leaf > 0 or total > 0")
    )
    sums = (
        shared.select("conv_id", *NODE)
        .join(stage(totals, "totals"), "conv_id")
        .join(stage(from_here, "sums"), ["conv_id", "depth"], "left")
        .groupBy(*NODE)
        .agg(F.sum("leaf").cast("bigint").alias("n_leaves"), F.sum(F.coalesce("own", "total")).alias("saved_tokens"))
    )
    ends = ends_digest(shared.where("length = depth").select("conv_id", *NODE))
    none = F.sha2(F.lit(""), 256)
    above = nodes.select(F.col("conv_id").alias("up"), (F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"))
    above = above.where("depth > 1")
    grouped = (
        counted.join(sums, NODE, "left")
        .join(ends, NODE, "left")
        .join(above, ["depth", "p1", "p2"], "left")
        .select(
            "conv_id", "depth", F.when(F.col("depth") == 1, root).otherwise(F.col("up")).alias("parent_conv_id"), "n_convs", "n_children",
            F.coalesce("n_leaves", zero).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"),
            F.coalesce("ends_sha256", none).alias("ends_sha256"),
        )
    )
    first_of_tail = begun.where("depth > 1").join(above, ["depth", "p1", "p2"]).select("conv_id", "up")
    last = F.col("depth") == F.col("length")
    emitted = (
        tail_rows.select("conv_id", "depth", "tail", "length")
        .join(first_of_tail, "conv_id", "left")
        .select(
            "conv_id", "depth",
            F.when(F.col("depth") > F.col("tail"), F.col("conv_id")).when(F.col("depth") == 1, root).otherwise(F.col("up")).alias("parent_conv_id"),
            F.lit(1).cast("bigint").alias("n_convs"), F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"),
            F.lit(1).cast("bigint").alias("n_leaves"), zero.alias("saved_tokens"),
            F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("ends_sha256"),
        )
    )
    return grouped.unionByName(emitted)
