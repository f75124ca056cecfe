"""The corpus pipeline, stage by stage, on its own inputs."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quotegrid.llm.common import stage
from tests.llm.test_operators import DOC, ODD, brute_components, plain_spans


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, sf), name)
        out.append(docs)
    return out


def test_order_and_columns(stages):
    assert [n.split("_")[0] for n, _ in corpus_pipeline.STAGES] == ["quality", "minhash", "pii", "source", "pattern"]
    for df in stages[:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_quality_keeps_clean_documents_and_drops_junk(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    left = {r["doc_id"] for r in stages[1].select("doc_id").collect()}
    by = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good, bad = [i for i, q in by.items() if q == 1], [i for i, q in by.items() if q == 0]
    assert sum(i in left for i in good) >= 0.98 * len(good)
    assert sum(i in left for i in bad) <= 0.1 * len(bad)


def test_dedup_leaves_one_of_each_group(stages):
    docs = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    component, _ = brute_components(docs, 80)
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(i for i, c in component.items() if i == c)


def test_no_personal_data_is_left_and_the_rest_is_unchanged(stages):
    before = {r["doc_id"]: r for r in stages[2].collect()}
    after = {r["doc_id"]: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, row in after.items():
        assert plain_spans(row["text"]) == "" and row["n_chars"] == len(row["text"])
        kept = re.split(r"\[(?:EMAIL|IP|CARD|PHONE)\]", row["text"])
        at = 0
        for part in kept:
            at = before[i]["text"].index(part, at) + len(part)
        if not plain_spans(before[i]["text"]):
            assert row["text"] == before[i]["text"]


def test_mix_repeats_whole_documents(stages):
    known = {tuple(r) for r in stages[3].collect()}
    mixed = [tuple(r) for r in stages[4].collect()]
    assert set(mixed) <= known and 0.7 * len(known) < len(mixed) < 1.4 * len(known)


def test_packing_takes_every_copy(stages):
    copies = {r["doc_id"]: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    firsts = {r["doc_id"]: r["count"] for r in stages[5].where("piece = 0").groupBy("doc_id").count().collect()}
    assert copies == firsts
    full = stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n > 2048 or n <> end").count() == 0


def test_stages_take_odd_rows_and_empty_tables(spark, sf):
    odd = spark.createDataFrame(ODD, DOC)
    for docs in (odd, odd.limit(0)):
        for k, (name, apply) in enumerate(corpus_pipeline.STAGES):
            out = stage(apply(spark, docs, sf), name)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == odd.columns
            out.count()
            docs = out


def test_stages_take_columns_of_any_name(spark, sf):
    names = ["copy", "shuffle_key", "__id", "__n", "__hash", "__key", "__t", "__digest", "__spans", "doc", "key", "row", "id", "group", "component_id"]
    odd = spark.createDataFrame(ODD, DOC).withColumns({n: F.lit(n) for n in names})
    docs = odd
    for k, (name, apply) in enumerate(corpus_pipeline.STAGES):
        out = stage(apply(spark, docs, sf), name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == odd.columns and out.where(" or ".join(f"`{n}` <> '{n}'" for n in names)).count() == 0
        assert out.count() > 0
        docs = out
