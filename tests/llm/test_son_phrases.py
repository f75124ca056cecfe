"""Collocations against counting every run of words."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from quotegrid.llm import son_phrases

DOC = "doc_id bigint, text string, lang string, score string, n bigint, shard string, ws string"


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def brute(docs, support, limit):
    """{lang: rows} by plain counting, Python integers and sorted lists."""
    f, n = {}, Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = {}
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= support}
        longest = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longest[p[i : i + m]] = max(longest[p[i : i + m]], a)
        rows = []
        for p, a in found.items():
            if p in longest and 100 * longest[p] >= 80 * a:
                continue
            score, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            rows.append((" ".join(p), a, count[p[:k]], count[p[k:]], n[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out[lang] = [(i + 1, *r) for i, r in enumerate(rows[:limit])]
    return {k: v for k, v in out.items() if v}


def mined(spark, docs, support, limit):
    df = spark.createDataFrame([(i, t, lang, "s", 1, "x", "w") for i, t, lang in docs], DOC)
    out = {}
    for r in son_phrases.collocations(df, limit=limit, support=support).orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append((r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]))
    return out


def made(seed, n=120):
    draw = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "a-b", "x\x1cy", "\xa0", "naïve", "new", "york", "city", "zz", "🙂"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!? ", " ; "]
    docs = []
    for i in range(n):
        text = "".join(draw.choice(words) + draw.choice(ends) for _ in range(draw.randint(0, 60)))
        if draw.random() < 0.4:
            text += " in new york city hall,"
        docs.append((i, text, draw.choice(["en", "en", "en", "de", None, "und"])))
    return docs


@pytest.mark.parametrize(("seed", "support", "limit"), [(1, 3, 25), (2, 6, 2000)])
def test_collocations_equal_plain_counts(spark, seed, support, limit):
    docs = made(seed)
    got = mined(spark, docs, support, limit)
    assert got == brute(docs, support, limit) and "en" in got


def test_odd_documents(spark):
    long = " ".join(f"w{i % 50}" for i in range(120_000))
    docs = [(1, None, "en"), (2, "", "en"), (3, " \t\n", None), (4, long, "de"), (5, "y" * 300_000 + " z", "fr"), (None, "a b", "en")]
    docs += [(7, "same row here", "es")] * 40
    assert mined(spark, docs, 30, 2000) == brute(docs, 30, 2000)
    assert mined(spark, [], 30, 2000) == {} and mined(spark, docs[:3], 30, 2000) == {}


def test_ties_at_the_limit_go_by_the_phrase(spark):
    docs = [(i, ". ".join(f"{c}{i} {c}{i}{i}" for c in "abcdef"), "en") for i in range(5)] * 4
    want = brute(docs, 4, 7)
    assert len({r[6] for r in want["en"]}) == 1 and mined(spark, docs, 4, 7) == want


@pytest.mark.parametrize("at_once", [1, 7, 50])
def test_blocks_and_runs_lose_nothing_at_their_edges(monkeypatch, at_once):
    monkeypatch.setattr(son_phrases._blocks, "__defaults__", (5,))
    docs = made(4, 30) + [(99, "one two three four five six seven " * 9, "en")]
    found = {m: Counter() for m in (1, 2, 3, 4)}

    def count(run, shard):
        for m in found:
            for i in run.starts(m):
                found[m][tuple(run.names[j] for j in run.numbers[i : i + m])] += 1

    batch = pd.DataFrame({"lang": "en", "shard": 0, "text": [t for _, t, _ in docs]})
    list(son_phrases._each(count, at_once)(iter([batch])))
    for m, got in found.items():
        want = Counter()
        for _, text, _ in docs:
            for words in pieces(text):
                want.update(tuple(w.encode() for w in words[i : i + m]) for i in range(len(words) - m + 1))
        assert got == want, m


def test_bitmap_holds_all_it_was_given(spark):
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)
    df = spark.createDataFrame(pd.DataFrame({"h": h}))
    for words in (1 << 22, 64):
        bits = son_phrases.bitmap(df, words)
        assert son_phrases.in_bitmap(bits, h.view(np.uint64)).all()
    bits = son_phrases.bitmap(df)
    other = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 20_000).view(np.uint64)
    assert son_phrases.in_bitmap(bits, other).mean() < 0.02
