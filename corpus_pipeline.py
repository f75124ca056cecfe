"""A training corpus from raw documents: quality, near-duplicates, personal data, source mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next one.
All but the last return the columns of ``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotegrid.llm import circulant_minhash, cotraining, pattern_packing, pii_bootstrap, poisson_mix
from quotegrid.llm.common import stage
from quotegrid.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    ship(spark)
    model = cotraining.learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotraining.score_quality(docs, model, keep_columns=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, one row of it."""
    ship(spark)
    return circulant_minhash.keep_one(docs, circulant_minhash.near_duplicates(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked; ``n_chars`` follows the new text where it was set."""
    masked = pii_bootstrap.redact(docs)
    return masked.withColumn(
        "n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
    ).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have the same share of characters, in random order."""
    return poisson_mix.mix(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, their tokens and places in sequences of 2048 tokens."""
    ship(spark)
    return pattern_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_cotraining", quality),
    ("minhash_near_dedup", near_dedup),
    ("pii_redaction", personal_data),
    ("source_mix", source_mix),
    ("pattern_packing", packing),
]
#: SQL can express neither the classifier nor the tokenizer; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
