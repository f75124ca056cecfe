"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's repetition rate is target share x total size / its size, where size is counted in characters of text. Each
document's number of copies is the inverse of the Poisson distribution with that rate at a uniform number made from
the seed and its key (its id, if no other has it), so a task that runs again draws the same. Rows are exploded by their count and shuffled globally
by a hash of (seed, key, copy): hash partitions, sorted inside by the same key.

The distribution function of every source is a table over the counts within 12 standard deviations (and 30) of the rate; beyond
it lies less than the step of the uniform numbers. The tables of all sources are joined as a broadcast only after
their size was counted (``max_broadcast_values``); beyond that the join shuffles, and hot sources are split by AQE.

Defined cases: a null source is a source of its own; sources that ``weights`` does not name have ``default_weight``;
weight 0 drops a source; a source without a single character keeps each document once; where an id is null or repeated,
the draw is made from the id, a hash of all columns and the row's number among equal ones, so every row is drawn by
itself; an empty table gives an empty result; columns are passed on as they are, and where one has the name of an
added column, that one gets an underscore behind its name.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotegrid.llm.common import free_name, stage

HEX_DIGITS = 13
CHUNK = 1000
SMALL = 32  # below this, log factorials come from a table; from here on Stirling's series is exact to 1e-14


def _uniform_digits(*parts: Column) -> Column:
    """An integer of ``HEX_DIGITS`` hex digits from the hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, HEX_DIGITS), 16, 10).cast("bigint")


def _log_factorial(k: Column) -> Column:
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(SMALL)])
    x = k.cast("double")
    series = (
        (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi)
        + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    )
    return F.when(k < SMALL, F.get(table, k.cast("int"))).otherwise(series)


def source_rates(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    default_weight: float = 1.0,
    epochs: float = 1.0,
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(source, docs, chars, rate) of every source; the total size times ``epochs`` is dealt out by weight."""
    source = F.col(source_col).cast("string")
    weight: Column = F.lit(float(default_weight))
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(value)).otherwise(weight)
    sums = docs.groupBy(source.alias("source")).agg(
        F.count("*").alias("docs"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).cast("bigint").alias("chars")
    )
    sized = sums.withColumn("weight", weight)
    total = sized.where("chars > 0").agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    # one row: the totals
    return sized.crossJoin(F.broadcast(total)).select(
        "source",
        "docs",
        "chars",
        F.when(F.col("chars") == 0, F.lit(None).cast("double"))
        .when(F.col("all_weight") == 0, F.lit(0.0))
        .otherwise(F.col("weight") / F.col("all_weight") * F.col("all_chars") * float(epochs) / F.col("chars"))
        .alias("rate"),
    )


def distributions(rates: DataFrame) -> DataFrame:
    """(source, least, cdf): distribution function at least, least + 1, ..."""
    reach = F.lit(12) * F.sqrt("rate") + 30
    spread = (
        rates.where("rate > 0")
        .withColumn("k", F.explode(F.sequence(
            F.greatest(F.floor(F.col("rate") - reach), F.lit(0)).cast("bigint"), F.ceil(F.col("rate") + reach).cast("bigint")
        )))
        .withColumn("p", F.exp(F.col("k") * F.log("rate") - F.col("rate") - _log_factorial(F.col("k"))))
    )
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return (
        spread.withColumn("c", F.sum("p").over(upto))
        .groupBy("source")
        .agg(F.min("k").alias("least"), F.sort_array(F.collect_list("c")).alias("cdf"))
    )


def _keyed(docs: DataFrame, id_col: str) -> DataFrame:
    """``doc`` (all columns of a row, so that no name can clash) and ``key``, which tells rows apart: the id, and where
    it is null or repeated a hash of the row and the row's number among equal ones."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("doc"), F.col(f"`{id_col}`").cast("string").alias("id"))
    exact = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    named = packed.where("id is not null")
    counts = docs.select(F.col(f"`{id_col}`").cast("string").alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("n"))
    repeated = stage(counts.where("n > 1").select("id"), "repeated")
    own = named.join(repeated, "id", "left_anti").select("doc", F.col("id").alias("key"))
    # equal rows: one row and its number, dealt out in chunks before it is repeated
    last = F.col("n") - 1
    others = (
        named.join(repeated, "id", "left_semi").select("doc", "id").unionByName(packed.where("id is null").select("doc", "id"))
        .groupBy("id", "doc")
        .agg(F.count("*").alias("n"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / CHUNK))))
        .withColumn("hash", F.md5(F.to_json("doc", exact)))
        .repartition("hash", "chunk")
        .withColumn("k", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(last, F.col("chunk") * CHUNK + (CHUNK - 1)))))
        .select("doc", F.concat_ws(":", F.coalesce("id", F.lit("")), "hash", F.col("k").cast("string")).alias("key"))
    )
    return own.unionByName(others)


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    seed: str = "mix",
    default_weight: float = 1.0,
    epochs: float = 1.0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    max_broadcast_values: int = 1_000_000,
) -> DataFrame:
    """All columns of ``docs`` plus copy (from 0) and shuffle_key, one row per copy.

    Where ``docs`` has columns of these names, the added ones get underscores behind theirs.
    """
    copy_name = free_name("copy", docs.columns)
    key_name = free_name("shuffle_key", [*docs.columns, copy_name])
    rates = stage(source_rates(docs, weights, default_weight, epochs, source_col, text_col), "rates")
    tables = stage(_with_tables(rates), "poisson")
    values = tables.agg(F.coalesce(F.sum(F.size("cdf") + 4), F.lit(0))).first()[0]
    lookup = tables.select("source", F.struct("rate", "least", "cdf").alias("t"))
    if values <= max_broadcast_values:
        lookup = F.broadcast(lookup)
    key = F.col("key")
    u = _uniform_digits(F.lit(seed), key) / F.lit(float(16**HEX_DIGITS))
    keyed = _keyed(docs, id_col)
    drawn = keyed.join(lookup, F.col("doc").getField(source_col).cast("string").eqNullSafe(F.col("source")), "left")
    count = (
        F.when(F.col("t.rate").isNull(), F.lit(1).cast("bigint"))
        .when(F.col("t.rate") == 0, F.lit(0).cast("bigint"))
        .otherwise(F.col("t.least") + F.size(F.filter("t.cdf", lambda c: c <= F.col("u"))))
    )
    copies = (
        drawn.withColumn("u", u)
        .withColumn("n", count)
        .where("n > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
        .withColumn("shuffle_key", _uniform_digits(F.lit(seed), key, F.col("copy").cast("string")))
        .select("doc", "copy", "shuffle_key")
        .repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key", "copy")
    )
    return copies.select(
        *[F.col("doc").getField(c).alias(c) for c in docs.columns], F.col("copy").alias(copy_name), F.col("shuffle_key").alias(key_name)
    )


def _with_tables(rates: DataFrame) -> DataFrame:
    made = distributions(rates).withColumnRenamed("source", "__s")
    return rates.join(made, F.col("source").eqNullSafe(F.col("__s")), "left").select(
        "source", "docs", "chars", "rate", "least", F.coalesce("cdf", F.array().cast("array<double>")).alias("cdf")
    )
