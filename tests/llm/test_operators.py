"""The training-data operators against brute force, and the defined results of odd rows."""

import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotegrid.llm import (
    bm25_packing,
    bpe_count,
    circulant_minhash,
    collision_ann,
    common,
    cotraining,
    lang_ecoc,
    pattern_packing,
    pii_bootstrap,
    poisson_mix,
    son_phrases,
    sorted_projection,
    url_reputation,
)
from quotegrid.llm.queries import ORACLE, QUERIES, URL_RULES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, score string, piece string"
LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
ODD = [
    (1, "the cat sat on the mat and then it ran away", "en", "a", 43, "k", "s", "p"),
    (1, "the cat sat on the mat and then it ran away", "en", "a", 43, "k", "s", "p"),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, "k", "s", "p"),
    (4, " \n\t ", None, "b", 4, "k", "s", "p"),
    (5, LONG, "en", None, len(LONG), "k", "s", "p"),
    (None, "the cat sat on the mat and then it ran away", "en", "a", 43, "k", "s", "p"),
    (6, "word", "de", "b", 4, "k", "s", "p"),
    (7, "word", "de", "b", None, "k", "s", "p"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    from tools.check import compare, oracle_connection

    assert compare(spark, oracle_connection(sf), sf, QUERIES[name], ORACLE[name])[1] is None


# ---------------------------------------------------------------- shared helpers
def test_shingles_are_those_of_the_words():
    np.seterr(over="ignore")
    draw = random.Random(3)
    for text in ["", "  ", "one", "a b c d e", "A b a B a b a b", "x" * 5000 + " y", " é\tÉ\x0b z "] + [
        "".join(draw.choice("ab C\n\té ") for _ in range(draw.randint(0, 60))) for _ in range(200)
    ]:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        n = min(5, len(words))
        want = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
        assert len(common.shingle_set(text)) == len(want), text
        assert len(common.word_hashes(text)) == len(words)


def test_components_find_the_smallest_reachable_id(spark):
    draw = random.Random(5)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(200)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {x: find(x) for x in linked}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---------------------------------------------------------------- 1 url reputation
PAGE = "page_id bigint, url string, html string, host string, verdict string"
LABEL = "doc_id bigint, quality int, toxic int"


def test_url_rules_and_odd_urls(spark):
    urls = [
        None, "", "no scheme", "http://WWW.Example.com/en/x?q=/fr/", "https://blog.example.com/en/1", "https://example.com/de/",
        "http://a.net/fr/9#top", "http://a.net/es", "http://net/es/", "http://x.org", "http://x.org?u=http://y.com/", "http://ÄB.com/",
        "://only", "http://1.2.3.4:80/x", "http://user@a.co.uk/", "http://a.co.uk/",
    ]
    pages = spark.createDataFrame([(i, u, None, "h", "v") for i, u in enumerate(urls)] + [(None, urls[3], None, "h", "v")], PAGE)
    got = {r["page_id"]: r for r in rows(url_reputation.judge(pages, spark.createDataFrame([], LABEL), URL_RULES))}
    assert len(got) == len(urls) + 1
    assert [(got[i]["host"], got[i]["path"]) for i in (0, 1, 2, 12)] == [("", "")] * 3 + [("only", "")]
    assert (got[3]["host"], got[3]["path"], got[3]["rule"], got[3]["verdict"]) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (got[4]["rule"], got[4]["verdict"]) == ("example.com/en/", "block")
    assert got[5]["rule"] == "com/" and got[6]["rule"] == "net/fr/" and got[7]["rule"] is None and got[8]["rule"] == "net/es/"
    assert got[10]["host"] == "x.org" and got[11]["host"] == "Äb.com"
    assert got[13]["domain"] == "1.2.3.4" and got[13]["suffix"] == ""
    assert got[14]["domain"] == got[15]["domain"] == "a.co.uk" and got[15]["suffix"] == "co.uk"
    assert all(r["bad_mean"] == 0.5 and r["verdict"] == "allow" for r in got.values() if r["rule"] is None)
    assert url_reputation.judge(spark.createDataFrame([], PAGE), spark.createDataFrame([], LABEL), URL_RULES).count() == 0


def test_reputation_blocks_on_evidence_and_shrinks_without(spark):
    pages, labels, i = [], [], 0
    for host, good, bad in [("bad.one.org", 0, 60), ("new.one.org", 0, 1), ("ok.two.org", 80, 2), ("few.two.org", 0, 1), ("none.two.org", 0, 0)]:
        for k in range(good + bad + 1):
            pages.append((i, f"http://{host}/{k}", None, "h", "v"))
            if k < good + bad:
                labels.append((i, 1 if k < good else 0, None))
            i += 1
    labels += [(0, 1, 0), (None, 0, 1), (1, None, None)]  # a contradiction counts as bad; null ids and null labels do not
    df = url_reputation.judge(spark.createDataFrame(pages, PAGE), spark.createDataFrame(labels, LABEL))
    by = {r["host"]: r for r in rows(df)}
    assert by["bad.one.org"]["verdict"] == "block" and by["bad.one.org"]["bad"] == 60
    assert {h for h, r in by.items() if r["verdict"] == "block"} <= {"bad.one.org", "new.one.org"}
    assert by["few.two.org"]["bad_mean"] < 0.6 < by["bad.one.org"]["bad_mean"]
    assert by["none.two.org"]["labelled"] == 0 and by["none.two.org"]["bad_mean"] < by["new.one.org"]["bad_mean"]


# ---------------------------------------------------------------- 2 token counts
def random_texts(n, seed=1):
    draw = random.Random(seed)
    letters = "abcXYZ  \n\t\x1c\x1f\x85\xa0 éÉÑñßΣσςİ½²3٣中文🙂é'stve!?#.,—<|>0123"
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(n)] + [
        "<|endoftext|>a<|startoftext|> <|endoftext|>", "ΟΔΟΣ", "aaaa" * 500, "I'LL it's WE'VE", "", " "
    ]


def test_heap_merging_counts_like_the_library():
    library, counter = Tokenizer.from_file(WORDS), bpe_count.MergeCounter(WORDS, cache_words=50)
    for text in random_texts(1500):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_token_counts_of_odd_rows(odd, nothing):
    got = rows(bpe_count.token_counts(odd, WORDS))
    library = Tokenizer.from_file(WORDS)
    assert len(got) == len(ODD)
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in ODD)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert bpe_count.token_counts(nothing, WORDS).count() == 0


# ---------------------------------------------------------------- 3 language
def test_codewords_keep_languages_apart():
    for n in (2, 3, 4, 5, 9, 40):
        code = lang_ecoc.codewords(n).astype(int)
        apart = (code.shape[1] - code @ code.T) // 2
        assert (apart + 10**6 * np.eye(n, dtype=int)).min() >= max(1, code.shape[1] // 4)
        assert all(set(c) == {-1, 1} for c in code.T)


def test_language_of_held_out_documents(spark, sf):
    got = QUERIES["op3_language_ecoc"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert r[1] > 20 and r[0] >= 0.95


def plain_model(docs, buckets, smoothing=0.5):
    """The same weights from a dense matrix of counts."""
    counts = {}
    for text, lang in docs:
        raw = lang_ecoc.letter_bytes(text)
        if lang is not None and raw is not None:
            counts[lang] = counts.get(lang, np.zeros(buckets)) + common.gram_counts(raw, lang_ecoc.ORDERS, buckets)
    languages = sorted(counts)
    c = np.array([counts[x] for x in languages])
    share = (c + smoothing) / (c.sum(axis=1, keepdims=True) + smoothing * buckets)
    code = lang_ecoc.codewords(len(languages))
    one = np.array([share[code[:, k] == 1].mean(axis=0) for k in range(code.shape[1])]).T
    zero = np.array([share[code[:, k] == -1].mean(axis=0) for k in range(code.shape[1])]).T
    weights = np.log(one / zero)
    apart = ((one - zero) * weights).sum(axis=0)
    return lang_ecoc.LanguageModel(languages, code, weights, apart / apart.sum(), 4 / np.abs(share @ weights).mean())


@pytest.mark.parametrize("languages", [4, 9])
def test_language_model_equals_dense_counts(spark, sf, languages, monkeypatch):
    monkeypatch.setattr(lang_ecoc, "HELD", 2)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()]
    if languages > 4:
        docs = [(t, f"{lang}{i % 3}" if lang in ("en", "de") else lang) for i, (t, lang) in enumerate(docs)] + [("tiny xyz", "zz")]
    model, want = lang_ecoc.learn(spark.createDataFrame(docs, "text string, lang string")), plain_model(docs, lang_ecoc.BUCKETS)
    assert model.languages == want.languages and (model.code == want.code).all()
    assert np.allclose(model.weights, want.weights, atol=1e-5) and np.allclose(model.reliability, want.reliability) and math.isclose(model.scale, want.scale, rel_tol=1e-9)
    for text, _ in docs[:60]:
        a, b = model.predict(text, 0.2), want.predict(text, 0.2)
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-4


def test_too_many_languages_are_counted_before_they_are_fetched(spark):
    docs = spark.range(400).select(F.format_string("some words %d", "id").alias("text"), F.format_string("lang %d", "id").alias("lang"))
    with pytest.raises(ValueError, match="400 languages"):
        lang_ecoc.learn(docs, max_languages=399)
    assert len(lang_ecoc.learn(docs, buckets=256).languages) == 400


def test_language_of_odd_rows(spark, odd, nothing):
    model = lang_ecoc.learn(odd.unionByName(odd.limit(0)))
    assert model.languages == ["de", "en"]
    got = rows(lang_ecoc.identify(odd, model))
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert all((by[i]["lang_pred"], by[i]["score"], by[i]["ambiguous"]) == ("und", 0.0, False) for i in (2, 3, 4))
    assert by[5]["lang_pred"] == "en" and by[6]["lang_pred"] in ("de", "en") and by[None] | {"doc_id": 1} == by[1]
    assert all(0 <= r["score"] <= 1 for r in got)
    empty = lang_ecoc.learn(nothing)
    assert {r["lang_pred"] for r in rows(lang_ecoc.identify(odd, empty))} == {"und"}
    one = lang_ecoc.learn(odd.where("lang = 'de'"))
    assert {r["lang_pred"] for r in rows(lang_ecoc.identify(odd, one))} == {"und", "de"}
    assert lang_ecoc.identify(nothing, model).count() == 0
    with pytest.raises(ValueError):
        lang_ecoc.learn(odd, max_languages=1)


# ---------------------------------------------------------------- 4 packing
def test_tokens_are_those_of_the_library():
    library, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), pattern_packing.ByteTokens(RANKS)
    for text in random_texts(1500, 2) + ["a  b", "a \n b", "  ", "\n\nx", "x  y   "]:
        assert own(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def check_plan(histogram, size, plan):
    used, fill = {}, {}
    last = {}
    order = np.lexsort((plan.rank, plan.length))
    for a, b in zip(order, [*order[1:], None]):
        n = int(plan.length[a])
        end = int(plan.rank[b]) if b is not None and plan.length[b] == n else histogram[n]
        used[n] = used.get(n, 0) + end - int(plan.rank[a])
        for s in range(int(plan.sequence[a]), int(plan.sequence[a]) + end - int(plan.rank[a])):
            fill.setdefault(s, []).append((int(plan.offset[a]), n))
        last[n] = end
    assert used == {k: v for k, v in histogram.items() if v}
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    assert len(fill) == plan.sequences


@pytest.mark.parametrize("size,unit,seed", [(64, 4, 1), (64, 1, 2), (100, 7, 3), (16, 16, 4), (128, 8, 5)])
def test_plans_place_every_piece_once(size, unit, seed):
    draw = random.Random(seed)
    for most in (1, 3, 40):
        histogram = {n: draw.randint(0, most) for n in range(1, size + 1)}
        check_plan(histogram, size, pattern_packing.plan_packing(histogram, size, unit))
    check_plan({}, size, pattern_packing.plan_packing({}, size, unit))


def test_packing_against_the_texts(spark, sf, odd, nothing):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs, loose in ((spark.read.parquet(f"{sf}/documents.parquet"), 1.03), (odd, 2)):
        got = rows(pattern_packing.pack(docs, RANKS))
        texts = [(r["doc_id"], [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in docs.collect()]
        want = []
        for doc, ids in texts:
            cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
            want += [(str(doc), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
        sequences = {}
        for r in got:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in sequences.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 2048
        assert len(sequences) <= loose * math.ceil(sum(w[3] for w in want) / 2048)
    assert pattern_packing.pack(nothing, RANKS).count() == 0


# ---------------------------------------------------------------- 5 nearest neighbours
VEC = "vec_id bigint, embedding array<float>, label int, score string, rank string"


def brute_nearest(table, asked, k=10):
    able = [(i, np.array(v, dtype=np.float64)) for i, v in table if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in able:
        if asked(q):
            near = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in able if i != q and len(y) == len(x))
            out[q] = near[:k]
    return out


def test_recall_of_the_nearest(spark, sf):
    draw = np.random.default_rng(2)
    centres = draw.standard_normal((20, 24))
    table = [(i, (centres[i % 20] + 0.4 * draw.standard_normal(24)).astype(np.float32).tolist()) for i in range(2500)]
    frame = spark.createDataFrame([(i, v, 0, "s", "r") for i, v in table], VEC)
    for df, step, data in (
        (collision_ann.nearest(frame, F.col("vec_id") % 50 == 0, block=600), 50, table),
        (QUERIES["op5_collision_counting_neighbours"](spark, sf), 100,
         [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]),
    ):
        want, got = brute_nearest(data, lambda q: q % step == 0), {}
        for r in rows(df):
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
        assert got.keys() == want.keys()
        hits = total = 0
        for q, near in want.items():
            found = [got[q][i + 1] for i in range(len(got[q]))]
            assert found == sorted(found) and len(found) == len(near)
            hits += len({i for _, i in found} & {i for _, i in near})
            total += len(near)
            exact = {i: d for d, i in brute_nearest([(i, v) for i, v in data if i == q or i in {x for _, x in found}], lambda x: x == q)[q]}
            assert all(abs(exact[i] - d) < 1e-12 for d, i in found)
        assert hits / total >= 0.9


def test_neighbours_of_odd_rows(spark):
    table = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
             (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (9, []), (10, [0.5, 0.0]), (None, [1.0, 0.0]), (100, [0.0, 2.0]), (100, [0.0, 2.0])]
    frame = spark.createDataFrame([(i, v, None, "s", "r") for i, v in table], VEC)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(collision_ann.nearest(frame, F.col("vec_id") % 100 == 0))]
    first = sorted(g for g in got if g[0] == 0)
    assert [(g[1], g[2]) for g in first] == [(1, 1), (2, 2), (3, 10), (4, 100), (5, 100)]
    assert first[0][3] == 0.0 and first[2][3] == 0.5
    assert [g[2] for g in sorted(g for g in got if g[0] == 100)] == [10, 0, 1, 2]
    assert collision_ann.nearest(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_no_neighbour_is_lost_beside_very_large_vectors(spark):
    draw = np.random.default_rng(2)
    table = [(i, draw.standard_normal(8).tolist()) for i in range(1, 300)]
    table += [(1000, (1e39 * draw.standard_normal(8)).tolist()), (2000, (1e160 * draw.standard_normal(8)).tolist()), (3000, [1e-170] * 8), (4000, [1.7e308] * 8)]
    frame = spark.createDataFrame(table, "vec_id bigint, embedding array<double>")
    for block in (5000, 40):
        got = {}
        for r in rows(collision_ann.nearest(frame, F.col("vec_id") >= 1000, block=block)):
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert got.keys() == {1000, 2000, 3000, 4000} and all(len(g) == 10 for g in got.values())
        x = dict(table)
        for q in (1000, 2000, 3000):
            for _, i, score in got[q]:
                big = max(abs(a - b) for a, b in zip(x[i], x[q]))
                assert math.isclose(score, big * math.sqrt(sum(((a - b) / big) ** 2 for a, b in zip(x[i], x[q]))), rel_tol=1e-12)
        near = sorted(math.dist(x[i], x[3000]) for i in range(1, 300))[:10]
        assert np.allclose([s for _, _, s in sorted(got[3000])], near)


@pytest.mark.parametrize("confidence", [0.8, 0.93])
def test_any_confidence_is_taken(confidence):
    assert collision_ann._half_width_factor(0.5, confidence, 40) > collision_ann._half_width_factor(0.5, confidence - 0.1, 40)


# ---------------------------------------------------------------- 6 mixing
def test_mix_meets_the_weights(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit("ten chars!").alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").otherwise(None).alias("source"), F.lit(10).alias("n_chars"),
    )
    got = {r["source"]: r["count"] for r in poisson_mix.mix(docs, {"big": 1.0, "mid": 2.0, None: 1.0}).groupBy("source").count().collect()}
    assert abs(got["big"] / 5000 - 1) < 0.06 and abs(got["mid"] / 10000 - 1) < 0.06 and abs(got[None] / 5000 - 1) < 0.06
    again = poisson_mix.mix(docs, {"big": 1.0, "mid": 2.0, None: 1.0}, max_broadcast_values=0)
    assert {r["source"]: r["count"] for r in again.groupBy("source").count().collect()} == got
    few = poisson_mix.mix(docs, {"big": 0.0, "mid": 1.0}, default_weight=0.0)
    assert {r["source"] for r in few.select("source").distinct().collect()} == {"mid"}


def test_counts_invert_the_poisson_distribution(spark):
    rates = spark.createDataFrame([("a", 0.3), ("b", 7.5), ("c", 5000.0)], "source string, rate double")
    for r in poisson_mix.distributions(rates).join(rates, "source").collect():
        k, p = 0, math.exp(-r["rate"]) if r["rate"] < 700 else 0.0
        if r["rate"] < 700:
            total = 0.0
            for got in r["cdf"]:
                total += p
                assert abs(total - got) < 1e-12
                k += 1
                p *= r["rate"] / k
        assert abs(r["cdf"][-1] - 1) < 1e-9 and r["cdf"] == sorted(r["cdf"])
        middle = sum(1 for c in r["cdf"] if c <= 0.5) + r["least"]
        assert abs(middle - r["rate"]) <= 1


def test_mix_draws_documents_without_or_with_a_repeated_id_one_by_one(spark):
    docs = spark.range(9000).select(
        F.when(F.col("id") < 3000, F.lit(None)).when(F.col("id") < 6000, 7).otherwise(F.col("id")).cast("bigint").alias("doc_id"),
        F.format_string("text %05d", F.when(F.col("id") < 1500, 1).otherwise(F.col("id"))).alias("text"), F.lit("en").alias("lang"),
        F.lit("a").alias("source"), F.lit(10).alias("n_chars"),
    )
    got = poisson_mix.mix(docs).cache()
    kind = F.when(F.col("doc_id") == 7, "repeated").when(F.col("doc_id").isNotNull(), "own").when(F.col("text") == "text 00001", "equal").otherwise("none")
    n = {r["kind"]: r["count"] for r in got.groupBy(kind.alias("kind")).count().collect()}
    assert abs(n["repeated"] / 3000 - 1) < 0.1 and abs(n["own"] / 3000 - 1) < 0.1
    assert abs(n["equal"] / 1500 - 1) < 0.1 and abs(n["none"] / 1500 - 1) < 0.1
    assert got.select("shuffle_key").distinct().count() == got.count()


def test_mix_of_odd_rows(odd, nothing):
    got = rows(poisson_mix.mix(odd))
    keep = {(r["doc_id"], r["copy"]) for r in got}
    assert (4, 0) in keep or all(r["doc_id"] != 4 for r in got)
    silent = poisson_mix.mix(odd.where("doc_id in (2, 3)"))  # no characters at all: each once
    assert sorted(r["doc_id"] for r in rows(silent)) == [2, 3]
    assert set(got[0]) == {*odd.columns, "copy", "shuffle_key"}
    assert poisson_mix.mix(nothing).count() == 0
    assert len({r["shuffle_key"] for r in got}) == len(got)  # also equal rows are drawn one by one
    clashing = odd.withColumns({"COPY": F.lit(1), "shuffle_key": F.lit("own"), "__n": F.lit(2), "__id": F.lit(3), "doc": F.lit(4), "key": F.lit(5), "t": F.lit(6)})
    both = rows(poisson_mix.mix(clashing))
    assert len(both) > 0 and set(both[0]) == {*clashing.columns, "copy_", "shuffle_key_"} and {r["shuffle_key"] for r in both} == {"own"}


def test_a_hot_repeated_row_is_drawn_one_by_one(spark):
    docs = spark.range(30_000).select(
        F.lit(7).cast("bigint").alias("doc_id"), F.lit("the same").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(8).alias("n_chars")
    )
    got = poisson_mix.mix(docs).cache()
    assert abs(got.count() / 30_000 - 1) < 0.03 and got.select("shuffle_key").distinct().count() == got.count()
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 1 and max(tasks) < 2 * sum(tasks) / len(tasks)


# ---------------------------------------------------------------- 7 quality
def test_quality_of_labelled_documents(spark, sf):
    got = QUERIES["op7_quality_cotraining"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    r = got.agg(
        F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int")))
    ).first()
    assert r[0] >= 0.98 and r[1] <= 0.1


def test_quality_of_odd_rows(spark, odd, nothing, sf):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (7, None, None), (None, 1, 0), (5, 1, 0), (5, 0, 0)], LABEL)
    for model in (cotraining.learn_quality(odd, labels), cotraining.learn_quality(odd, labels.limit(0)), cotraining.learn_quality(nothing, labels)):
        got = rows(cotraining.score_quality(odd, model))
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
        assert all((r["score"], r["kept"]) == (0.0, False) for r in got if r["doc_id"] in (2, 3, 4))
        assert cotraining.score_quality(odd, model, keep_columns=True).columns == odd.columns
        assert cotraining.score_quality(odd, model, keep_columns=True).count() == sum(r["kept"] for r in got)
        assert cotraining.score_quality(nothing, model).count() == 0
    unlabelled = rows(cotraining.score_quality(odd, cotraining.learn_quality(odd, labels.limit(0))))
    assert all(r["kept"] for r in unlabelled if r["doc_id"] not in (2, 3, 4))


def plain_co_training(docs, labels, rounds, handed, sure):
    """The same fit over lists: everything is scored and sorted in one place."""
    keys = {f"{i}:{hashlib.md5(t.encode()).hexdigest()}": (i, t, lang, source) for i, t, lang, source in docs if i is not None and t and t.strip()}
    given = {}
    for i, q in labels:
        given.setdefault(i, set()).add(q)
    label = {i: float(q.pop()) for i, q in given.items() if len(q) == 1}
    taught = {k: label[v[0]] for k, v in sorted(keys.items()) if v[0] in label}
    pool = {k: v for k, v in keys.items() if v[0] not in label}
    good = sum(taught.values()) / len(taught)
    takes = [{}, {}]

    def seen(view, k):
        _, text, lang, source = keys[k]
        return cotraining.content_view(text) if view == 0 else cotraining.metadata_view(text, lang, source)

    for turn in range(rounds + 1):
        fits = []
        for view in (0, 1):
            rows_ = [(k, y, zlib.crc32(str(keys[k][0]).encode()) % 5 == 0, False) for k, y in taught.items()]
            rows_ += [(k, y, False, True) for k, y in sorted(takes[view].items())]
            x = np.array([seen(view, r[0]) for r in rows_], dtype=np.float32)
            fits.append(cotraining.fit_view(view, x, *(np.array([r[j] for r in rows_]) for j in (1, 2, 3))))
        fitted = cotraining.Fitted([f[0] for f in fits], [f[1] for f in fits], [f[2] for f in fits], fits[0][3])
        if turn == rounds:
            break
        fresh = [{}, {}]
        for view in (0, 1):
            chance = {k: cotraining.chance_of(fitted, view, seen(view, k)) for k in pool if k not in takes[1 - view]}
            for y, n in ((1, max(1, int(handed * good))), (0, max(1, int(handed * (1 - good))))):
                strong = {k: c if y else 1 - c for k, c in chance.items()}
                order = sorted((k for k in strong if strong[k] >= sure), key=lambda k: (-strong[k], k))
                fresh[1 - view].update({k: float(y) for k in order[:n]})
        takes = [takes[v] | fresh[v] for v in (0, 1)]
    n = len(taught)
    return cotraining.combined(fitted, (sum(taught.values()) + 1) / (n + 2)), takes


def test_co_training_equals_the_plain_version(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").select("doc_id", "quality").collect()]
    docs = docs + docs[:3] + [(None, docs[0][1], "en", "x"), (10**6, " ", "en", "x")]
    got = cotraining.learn_quality(
        spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int"),
        rounds=2, handed=8, sure=0.6,
    )
    want, takes = plain_co_training(docs, labels, 2, 8, 0.6)
    assert all(len(t) > 4 for t in takes)
    for a, b in ((got.content, want.content), (got.metadata, want.metadata)):
        assert np.allclose(a, b, atol=2e-3)
    assert np.allclose(got.curves, want.curves, rtol=0.02, atol=0.02) and math.isclose(got.prior, want.prior)
    for _, text, lang, source in docs:
        assert np.allclose(got.score(text, lang, source), want.score(text, lang, source), atol=0.01)


def test_every_unlabelled_document_can_be_handed_over(spark):
    good = ["plain words make a good sentence here. " * 3] * 40
    bad = ["$$$ BUY NOW!!! 0000 >>> CLICK ### " * 3] * 40
    docs = [(i, f"{t} {i}", "en", "s") for i, t in enumerate(good + bad)] + [(1000 + i, f"{bad[0]} {i}", "en", "s") for i in range(900)]
    docs += [(5000, "one plain good sentence that no other says", "en", "s")] * 3
    labels = [(i, int(i < 40)) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    model = cotraining.learn_quality(df, spark.createDataFrame(labels, "doc_id bigint, quality int"), rounds=1, handed=20)
    kept = {r["doc_id"] for r in cotraining.score_quality(df, model).where("kept").collect()}
    assert kept == {*range(40), 5000}


def test_string_ids_and_clashing_columns(spark):
    docs = [(f"d{i}", "good plain words here " * 4 if i % 2 else "!!! 000 $$$ " * 4, "en", "s", "k", "t", 1.0) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id string, text string, lang string, source string, key string, taker string, label double")
    model = cotraining.learn_quality(df, spark.createDataFrame([(f"d{i}", i % 2) for i in range(40)], "doc_id string, quality int"))
    assert {r["doc_id"] for r in cotraining.score_quality(df, model, keep_columns=True).collect()} == {f"d{i}" for i in range(1, 60, 2)}


# ---------------------------------------------------------------- 8 personal data
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def valid(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "card":
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in doubled) % 10 == 0
        return kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in s.split("."))) or (kind == "phone" and 10 <= len(digits) <= 15)

    found = [(m.start(), j, m.end()) for j, k in enumerate(PLAIN) for m in re.finditer(PLAIN[k], text) if valid(k, m.group())]
    return ",".join(f"{list(PLAIN)[j]}:{a}:{b}" for a, j, b in sorted(found))


def test_base_spans_are_those_of_the_plain_expressions(spark):
    draw = random.Random(8)
    parts = ["a@b.c", "a@b.com_x@c.de", "x.y%z+@q-r.s.t", "@", "..", "1.2.3.4", "256.1.1.1", "0001.002.3.04", "1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111",
             "4111-1111-1111-1111-", "79927398713", "12", "+1 (017) 555-7713", "+1 2", "++49 30 12345678.", "é🙂", " ", "\n", "-", "9", "+", "(", ")", "Ab", "_%", "1" * 30]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(700)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii_bootstrap.find(df).select("*", pii_bootstrap.listed(F.col("base")).alias("listed")).collect()}
    for i, text in enumerate(texts):
        want = plain_spans(text or "")
        assert got[i]["listed"] == want, repr(text)
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(p.startswith(k) for p in want.split(",")) for k in PLAIN]


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 200_000, "1" * 200_000, "1 " * 50_000, "12 " * 50_000 + "5,x", "12 5,x " * 20_000, "a." * 100_000, "+1" + "(" * 200_000, "x@" + "a." * 100_000 + "b", "@" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii_bootstrap.find(df).collect()}
    assert got[7]["n_email"] == 1 and sum(r["n_email"] for r in got.values()) == 1


def contexts(spark):
    """Phones after a telling phrase; some are written in a form that the base expressions miss."""
    names = ["plain sea", "far hill", "cold lake"]
    texts = [f"{names[i % 3]} please call us +1 (2{i:02d}) 555-71{i:02d} or not {names[i % 3]}" for i in range(30)]
    texts += [f"then please call us 555-20{i:02d}-9{i:02d} today" for i in range(6)]
    texts += [f"about size is {i}00200300 and version 2.0.{i}" for i in range(10)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), texts


def test_contexts_discover_identifiers(spark):
    df, texts = contexts(spark)
    got = {r["doc_id"]: r for r in rows(pii_bootstrap.find(df))}
    for i in range(30, 36):
        (span,) = got[i]["added"]
        assert texts[i][span["start"] : span["stop"]] == f"555-20{i - 30:02d}-9{i - 30:02d}" and span["rank"] == 3
    assert all(not got[i]["added"] for i in got if not 30 <= i < 36)
    masked = {r["doc_id"]: r["text"] for r in rows(pii_bootstrap.redact(df))}
    assert masked[31] == "then please call us [PHONE] today" and masked[40] == texts[40]
    assert masked[1] == "far hill please call us [PHONE] or not far hill"


def test_spans_of_several_groups_and_long_contexts(spark):
    far = "x" * 70
    texts = [f"{c} please call us +1 (2{i:02d}) 555-71{i:02d}, ok" for i, c in enumerate(["sea", "hill", "lake"] * 8)]
    texts += ["we say call us (555) 123-4567, or", "we say call us 555 123 4567.", "but call us 555.123.4567 ok", "size 12 34 56 78 90 12 of it", "1 2 3 4 5 6 7 8"]
    texts += [f"go {far}a {far}b card 4111 1111 1111 11{i:02d} or {far}a {far}b 4111-1111-1111-1111 end" for i in range(9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    masked = {r["doc_id"]: r["text"] for r in rows(pii_bootstrap.redact(df))}
    assert [masked[i] for i in range(24, 29)] == ["we say call us [PHONE], or", "we say call us [PHONE].", "but call us [PHONE] ok", texts[27], texts[28]]
    tokens = {r["doc_id"]: [m["found"] for m in r["tokens"]] for r in pii_bootstrap.base_spans(df).collect()}
    assert tokens[24] == ["(555) 123-4567,"] and tokens[27] == ["12 34 56 78 90 12"] and tokens[28] == ["1", "2", "3", "4", "5", "6", "7", "8"]


def test_context_words_reach_over_the_match_before(spark):
    df = spark.createDataFrame([(1, "one two 11 22x 33 then 44"), (2, "a 5x b 6x")], "doc_id bigint, text string")
    found = {(r["doc_id"], r["instance"]): r["context"] for r in pii_bootstrap.occurrences(pii_bootstrap.base_spans(df)).collect()}
    assert found == {(1, "11"): "one two", (1, "22x"): "two 11", (1, "33"): "11 22x", (1, "44"): "33 then", (2, "5x"): "a", (2, "6x"): "5x b"}


def test_personal_data_beside_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x a@b.cd", "i", "h", "s", "d")], "doc_id bigint, text string, __id string, __hash string, __spans string, doc string")
    (r,) = rows(pii_bootstrap.redact(df))
    assert r == {"doc_id": 1, "text": "x [EMAIL]", "__id": "i", "__hash": "h", "__spans": "s", "doc": "d"}


def test_personal_data_of_odd_rows(spark, odd, nothing):
    got = rows(pii_bootstrap.find(odd))
    assert len(got) == len(ODD) and all(not r["base"] and not r["added"] for r in got)
    same = sorted(map(repr, (tuple(r) for r in pii_bootstrap.redact(odd).collect())))
    assert same == sorted(map(repr, ODD)) and pii_bootstrap.redact(odd).columns == odd.columns
    twice = spark.createDataFrame([(1, "x a@b.cd 🙂", 1), (1, "x a@b.cd 🙂", 2), (1, "other", 3), (None, "1.2.3.4a@b.cd", 4)], "doc_id bigint, text string, base int")
    assert sorted(r["text"] for r in rows(pii_bootstrap.redact(twice))) == ["[EMAIL]", "other", "x [EMAIL] 🙂", "x [EMAIL] 🙂"]
    assert pii_bootstrap.find(nothing).count() == 0 and pii_bootstrap.redact(nothing).count() == 0


def test_digest_columns(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in rows(QUERIES["op8_pii_bootstrap"](spark, sf)):
        want = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(r["spans"].split(",")) or not want


# ---------------------------------------------------------------- 9 near-duplicate texts
def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_components(docs, per_hundred):
    sets, up = [], {}
    for i, text in docs:
        w = words_of(text)
        n = min(5, len(w))
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()))
        up[i] = i

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            c = len(a & b)
            if c and 100 * c >= per_hundred * (len(a) + len(b) - c):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}, {i: len(s) for i, s in sets}


@pytest.mark.parametrize("per_hundred,block", [(80, 1024), (85, 16)])
def test_near_duplicates_equal_brute_force(spark, per_hundred, block):
    draw = random.Random(per_hundred)
    vocabulary = [f"w{i}" for i in range(4000)]
    docs = []
    for base in range(12):
        words = [draw.choice(vocabulary) for _ in range(draw.choice([4, 30, 120, 400]))]
        for _ in range(draw.choice([1, 2, 8, 40])):
            copy = list(words)
            for _ in range(draw.randint(0, max(1, len(words) // 25))):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            docs.append(" ".join(copy))
    draw.shuffle(docs)
    docs = list(enumerate(docs)) + [(1000, docs[0].upper()), (1001, docs[0].replace(" ", "\n "))]
    want, sizes = brute_components(docs, per_hundred)
    got = rows(circulant_minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), per_hundred, block=block))
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_signatures_estimate_the_similarity():
    np.seterr(over="ignore")
    draw = np.random.default_rng(6)
    for j in (0.5, 0.8, 0.9):
        agree = []
        for _ in range(100):
            u = draw.integers(0, 2**63, 1000, dtype=np.uint64)
            k, half = int(1000 * j), (1000 - int(1000 * j)) // 2
            agree.append((circulant_minhash.signature(u[: k + half]) == circulant_minhash.signature(np.r_[u[:k], u[k + half :]])).mean())
        assert abs(np.mean(agree) - j) < 0.015


def test_near_duplicates_of_odd_rows(odd, nothing):
    got = rows(circulant_minhash.near_duplicates(odd))
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i] == {"doc_id": i, "n_shingles": 0, "component_id": i, "kept": True} for i in (2, 3, 4))
    assert by[7]["component_id"] == 6 and not by[7]["kept"] and by[6]["n_shingles"] == 1
    assert by[None] == {"doc_id": None, "n_shingles": 7, "component_id": None, "kept": True}
    assert by[1]["component_id"] == 1 and by[5]["component_id"] == 5
    one = circulant_minhash.keep_one(odd, circulant_minhash.near_duplicates(odd))
    assert one.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in rows(one)) == ["1", "2", "3", "4", "5", "6", "None"]
    assert circulant_minhash.near_duplicates(nothing).count() == 0


def test_keep_one_tells_texts_of_an_id_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = a + " more"
    table = [(3, a), (5, a), (5, b), (6, near), (7, a), (7, c), (7, c), (8, b), (9, None), (9, c + " x"), (None, a)]
    docs = spark.createDataFrame(table, "doc_id bigint, text string")
    verdict = circulant_minhash.near_duplicates(docs)
    got = rows(circulant_minhash.keep_one(docs, verdict))
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == [("3", a), ("5", b), ("7", c), ("9", ""), ("None", a)]
    seen = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows(verdict))
    assert seen == sorted([
        ("3", "3", True), ("5", "3", False), ("5", "5", True), ("6", "3", False), ("7", "3", False), ("7", "7", True), ("7", "7", True),
        ("8", "5", False), ("9", "9", True), ("9", "7", False), ("None", "None", True),
    ])


def test_a_hot_repeated_row_is_one_class(spark):
    text = " ".join(f"w{i}" for i in range(40))
    near = " ".join(f"w{i}" for i in range(39)) + " other"
    docs = spark.range(20_000).select(F.lit(5).cast("bigint").alias("doc_id"), F.lit(text).alias("text")).unionByName(
        spark.createDataFrame([(3, near), (9, "something else entirely here now")], "doc_id bigint, text string")
    )
    got = circulant_minhash.near_duplicates(docs, per_hundred=80)
    found = {(r["doc_id"], r["component_id"], r["kept"]): r["count"] for r in got.groupBy("doc_id", "component_id", "kept").count().collect()}
    assert found == {(5, 3, False): 20_000, (3, 3, True): 1, (9, 9, True): 1}


# ---------------------------------------------------------------- 10 near-duplicate vectors
def brute_vectors(table, least=0.98):
    links, up = {}, {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    able = {}
    for i, v, label in table:
        up[i] = i
        links[i] = 0
        if label is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v):
            able[i] = (np.array(v, np.float64), label)
    ids = list(able)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            (a, la), (b, lb) = able[i], able[j]
            if la == lb and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return links, {i: find(i) for i in up}


@pytest.mark.parametrize("block", [2048, 32])
def test_near_vectors_equal_brute_force(spark, block):
    draw = np.random.default_rng(9)
    table, i = [], 0
    for group in range(25):
        centre = draw.standard_normal(32)
        for _ in range(int(draw.choice([1, 2, 5, 90]))):
            noise = float(draw.choice([0.05, 0.1, 0.16]))
            table.append((i, (centre + noise * draw.standard_normal(32)).astype(np.float32).tolist(), group % 3))
            i += 1
    links, component = brute_vectors(table)
    frame = spark.createDataFrame([(a, b, c, "s", "r") for a, b, c in table], VEC)
    got = rows(sorted_projection.near_vectors(frame, block=block))
    assert {r["vec_id"]: r["component_id"] for r in got} == component
    assert {r["vec_id"]: r["n_links"] for r in got} == links


def test_near_vectors_of_dense_labels(spark):
    draw = np.random.default_rng(12)

    def off(n):
        x = draw.standard_normal((n, 64))
        x[:, 0] = 0
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    # mean cosine 0.95 in the label; each of the first 100 vectors has one partner at cosine 0.981
    base = off(4000)
    turn = off(100)
    turn -= (turn * base[:100]).sum(axis=1, keepdims=True) * base[:100]
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    near = 1 - 0.019 / 0.05
    x = np.sqrt(0.05) * np.r_[base, near * base[:100] + np.sqrt(1 - near * near) * turn]
    x[:, 0] = np.sqrt(0.95)
    hits = x @ x.T >= 0.98
    np.fill_diagonal(hits, False)
    table = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    frame = spark.createDataFrame(table, "vec_id bigint, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in rows(sorted_projection.near_vectors(frame))}
    joined = [got[4000 + i]["component_id"] == got[i]["component_id"] for i in range(100)]
    assert sum(joined) >= 95
    # links are counted whole wherever passes joined their ends, and there are no others
    want = hits.sum(axis=1)
    assert all(r["n_links"] <= want[i] for i, r in got.items()) and sum(r["n_links"] for r in got.values()) >= 0.95 * want.sum()


def test_copies_are_one_class_and_short_partitions_lose_no_neighbour(spark):
    draw = np.random.default_rng(3)
    base = draw.standard_normal((300, 24))
    table = [(i, v.tolist(), 1) for i, v in enumerate(base)] + [(1000 + i, base[7].tolist(), 1) for i in range(500)]
    table += [(2000 + i, (base[i] + 0.02 * draw.standard_normal(24)).tolist(), 1) for i in range(300)]
    frame = spark.createDataFrame(table, "vec_id bigint, embedding array<double>, label int")
    links, component = brute_vectors(table)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for width in ("3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        try:
            got = {r["vec_id"]: r for r in rows(sorted_projection.near_vectors(frame))}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert {i: r["n_links"] for i, r in got.items()} == links and {i: r["component_id"] for i, r in got.items()} == component


def test_plans_follow_a_labels_size_and_spread():
    assert sorted_projection.plan(10, 1.0, 0.98) == (1, 10)
    few, dense = sorted_projection.plan(5000, 1.0, 0.98), sorted_projection.plan(5000, 0.05, 0.98)
    assert few[0] * few[1] < dense[0] * dense[1] < 5000
    assert sorted_projection.plan(10**6, 0.01, 0.98) == (sorted_projection.FEWEST_PASSES, sorted_projection.WINDOW)
    assert all(p <= sorted_projection.MOST_PASSES and w <= sorted_projection.WIDEST for p, w in (sorted_projection.plan(n, v, 0.98) for n in (100, 10**5, 10**8) for v in (0.03, 0.2, 1.0)))


def test_near_vectors_of_odd_rows(spark):
    table = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1),
             (7, [None, 1.0], 1), (8, [1.0, 0.0, 0.0], 1), (9, [], 1), (10, [1.0, 0.0], None), (11, [1e-30, 0.0], 1), (12, [1e30, 1e28], 1)]
    links, component = brute_vectors([(i, None if i == 11 else v, c) for i, v, c in table if i not in (11, 12)])
    frame = spark.createDataFrame([(a, b, c, "s", "r") for a, b, c in table], VEC)
    got = {r["vec_id"]: r for r in rows(sorted_projection.near_vectors(frame))}
    assert len(got) == len(table)
    assert {i: got[i]["component_id"] for i in range(2, 11)} == {i: component[i] for i in range(2, 11)}
    assert [got[i]["component_id"] for i in (0, 1, 11, 12)] == [0] * 4 and [got[i]["n_links"] for i in (0, 1, 11, 12)] == [3] * 4
    twice = spark.createDataFrame([(1, [1.0, 0.0], 1, "s", "r")] * 2 + [(None, [1.0, 0.0], 1, "s", "r"), (1, None, 1, "s", "r")], VEC)
    assert sorted(str((r["vec_id"], r["n_links"], r["component_id"], r["kept"])) for r in rows(sorted_projection.near_vectors(twice))) == [
        "(1, 0, 1, True)"
    ] * 3 + ["(None, 0, None, True)"]
    assert sorted_projection.near_vectors(frame.limit(0)).count() == 0


def test_unicode_data_is_recent_enough():
    # token counts lower-case and normalise with Python's tables
    assert tuple(map(int, unicodedata.unidata_version.split("."))) >= (14, 0)


def test_stage_tables_are_below_the_shared_folder(spark):
    folder = common.shared_dir(spark)
    assert folder == common.shared_dir(spark)
    df = common.stage(spark.range(3), "shared-folder-test")
    assert df.count() == 3 and all(folder.removeprefix("file:").lstrip("/") in f for f in df.inputFiles())


def test_long_white_space_gives_the_ids_of_the_library():
    library, tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), pattern_packing.ByteTokens(RANKS)
    n = 4096
    mixed = "x" + " " * n + "\n" * n + "y" + "\xa0" * n + "!" + " " * n + "'s" + "\x1c" * n + "<|endoftext|>" + " " * (n - 1) + "z"
    for text in (mixed, " " * n, "\t" * n + "a", "a" + " " * n, " " * (n + 1) + "<|endoftext|>"):
        assert tokens(text) == library.encode(text, add_special_tokens=False).ids
    # all of a run but its last character is one piece, whatever its length
    for n in (1_000_000, 2_000_000, 10_000_000):
        assert tokens("a" + "\n" * n + "b") == tokens("a") + tokens.single.encode_ordinary("\n" * (n - 1)) + tokens("\nb")
        assert tokens(" " * n + "b") == tokens.single.encode_ordinary(" " * (n - 1)) + tokens(" b")


def test_packing_takes_long_white_space(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 1_000_000 + "b"), (2, "\n" * 1_000_000 + "b")], "doc_id bigint, text string")
    out = rows(pattern_packing.pack(docs, RANKS))
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, text in ((1, "a" + " " * 1_000_000 + "b"), (2, "\n" * 1_000_000 + "b")):
        assert sum(r["length"] for r in out if r["doc_id"] == doc_id) == len(want.encode(text, add_special_tokens=False).ids) + 1


def test_repeated_rows_are_ranked_in_many_tasks(spark):
    docs = spark.range(30_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("the same few words").alias("text"))
    out = pattern_packing.pack(docs, RANKS).cache()
    r = out.agg(F.count("*"), F.sum("length"), F.countDistinct("sequence_id", "offset")).first()
    assert r[0] == 30_000 and r[2] == 30_000
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n > 2048 or n <> end").count() == 0 and full.count() <= r[1] / 2048 + 120


def test_operators_take_columns_of_any_name(spark, odd):
    names = ["copy", "shuffle_key", "__id", "__n", "__hash", "__key", "row", "salt", "lang_pred", "shard", "t1", "item", "x", "h", "size", "word"]
    wide = odd.withColumns({n: F.lit(n) for n in names})
    same = lambda f: sorted(map(repr, f(wide).collect())) == sorted(map(repr, f(odd).collect()))
    assert same(lambda d: bpe_count.token_counts(d, WORDS))
    assert same(lambda d: lang_ecoc.identify(d, lang_ecoc.learn(d)))
    assert same(lambda d: pattern_packing.pack(d, RANKS).groupBy("doc_id", "piece", "ids_crc32").count())
    assert same(lambda d: cotraining.score_quality(d, cotraining.QualityModel(None, None)))
    assert same(lambda d: pii_bootstrap.find(d)) and same(lambda d: circulant_minhash.near_duplicates(d))
    assert same(lambda d: bm25_packing.pack(d, RANKS).groupBy("doc_id").agg(F.sum("length"))) and same(lambda d: son_phrases.collocations(d, support=2))
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0], 1) for i in range(12)], "vec_id bigint, embedding array<double>, label int")
    more = vectors.withColumns({n: F.lit(n) for n in ["members", "component", "h1", "vec", "turn", "width", "block", "is_query"]})
    for f in (sorted_projection.near_vectors, lambda d: collision_ann.nearest(d, F.col("vec_id") % 5 == 0)):
        assert sorted(map(repr, f(vectors).collect())) == sorted(map(repr, f(more).collect()))
