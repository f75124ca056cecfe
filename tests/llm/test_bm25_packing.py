"""Retrieval packing: whole ids, no padding, and the windows of a plain BM25."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quotegrid.llm import bm25_packing
from quotegrid.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOC = "doc_id bigint, text string, item bigint, ids string, t1 string, length string"


def check(docs, pieces, size=2048):
    """Every id in exactly one piece, checksums right, sequences gapless and full or a power of two long."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for doc_id, text in docs:
        want[(doc_id, *library.encode(text or "", add_special_tokens=False).ids, 1)] += 1
    at_start = {}
    for p in pieces:
        at_start.setdefault((str(p["doc_id"]), p["start"], p["ids_crc32"]), []).append(p)
    for (doc_id, *ids), copies in want.items():
        for _ in range(copies):
            at = 0
            while at < len(ids):
                raw = np.array(ids[at:], dtype="<u4").tobytes()
                found = next(
                    p for (d, s, crc), ps in at_start.items() if d == str(doc_id) and s == at
                    for p in ps if zlib.crc32(raw[: 4 * p["length"]]) == crc and p["doc_tokens"] == len(ids)
                )
                at_start[(str(doc_id), at, found["ids_crc32"])].remove(found)
                at += found["length"]
            assert at == len(ids)
    assert not any(at_start.values())
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == size or at <= size and at & (at - 1) == 0
    return sequences


def packed(spark, docs, **options):
    df = spark.createDataFrame([(i, t, 1, "i", "t", "l") for i, t in docs], DOC)
    return [r.asDict() for r in bm25_packing.pack(df, RANKS, **options).collect()]


def test_pieces_hold_all_ids_of_the_tables_texts(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    pieces = [r.asDict() for r in QUERIES["op11_bm25_packing"](spark, sf).collect()]
    sequences = check(docs, pieces)
    assert sum(sum(n for _, n in s) == 2048 for s in sequences.values()) > 0.5 * len(sequences)


def test_odd_documents(spark):
    long = " ".join(f"word{i % 97}" for i in range(20_000))
    docs = [(1, None), (2, ""), (3, " \n"), (4, long), (None, "no id"), (None, None), (5, "<|endoftext|> é")] + [(6, "the same row")] * 700
    check(docs, packed(spark, docs))
    check(docs, packed(spark, docs, shard=5))
    check([(i, None) for i in range(9000)], packed(spark, [(i, None) for i in range(9000)], shard=16))
    assert packed(spark, []) == [] and [p["length"] for p in packed(spark, [(1, None)])] == [1]


def plain_windows(texts, size):
    """Windows of one shard as lists of (document, from, to), by dictionaries."""
    n, mean = len(texts), sum(map(len, texts)) / len(texts)
    df = Counter(t for ids in texts for t in set(ids))
    idf = {t: math.log1p((n - d + 0.5) / (d + 0.5)) for t, d in df.items()}

    def weights(ids):
        norm = 1.2 * (0.25 + 0.75 * len(ids) / mean)
        return {t: idf[t] * c * 2.2 / (c + norm) for t, c in Counter(ids).items()}

    weight = [weights(ids) for ids in texts]
    used, windows, seed = [0] * n, [], None
    while sum(map(len, texts)) - sum(used) >= size:
        if seed is None:
            seed = next(k for k in range(n) if used[k] < len(texts[k]))
        score = [round(sum(weight[k].get(t, 0) for t in set(texts[seed])), 9) for k in range(n)]
        window, free, following = [], size, None
        for k in [seed] + [k for k in sorted(range(n), key=lambda k: (-score[k], k)) if k != seed and used[k] < len(texts[k])]:
            take = min(free, len(texts[k]) - used[k])
            window.append((k, used[k], used[k] + take))
            used[k] += take
            free -= take
            following = k if used[k] < len(texts[k]) else following
            if not free:
                break
        windows.append(window)
        seed = following
    return windows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_are_those_of_plain_bm25(seed):
    draw = random.Random(seed)
    topics = [[draw.randint(0, 4000) for _ in range(30)] for _ in range(6)]
    texts = [[draw.choice(draw.choice(topics) if draw.random() < 0.2 else topics[k % 6]) for _ in range(draw.randint(1, 60))] for k in range(80)]
    df = Counter(t for ids in texts for t in set(ids))
    idf = np.zeros(bm25_packing.VOCABULARY)
    for t, d in df.items():
        idf[t] = math.log1p((len(texts) - d + 0.5) / (d + 0.5))
    stats = bm25_packing.Statistics(idf, sum(map(len, texts)) / len(texts))
    items = [bm25_packing.Item(k, len(ids), 0, np.array(ids, dtype="<u2")) for k, ids in enumerate(texts)]
    windows, rest = bm25_packing.fill(items, stats, 100)
    want = plain_windows(texts, 100)
    assert [[(i.doc_id, lo, hi) for i, lo, hi in w] for w in windows] == want
    assert sum(i.left for i in rest) == sum(map(len, texts)) - 100 * len(windows)


def test_statistics_cover_all_items(spark):
    docs = [(i, "alpha beta" if i % 3 else "gamma " * (1 + i)) for i in range(50)]
    df = spark.createDataFrame([(i, t, 1, "i", "t", "l") for i, t in docs], DOC)
    fields = "item bigint, doc_id bigint, doc_tokens bigint, start bigint, length bigint, ids_crc32 bigint, ids binary"
    items = df.select("doc_id", "text").mapInPandas(bm25_packing._items(RANKS, 2048, 1), fields)
    stats = bm25_packing.statistics(items)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [[*library.encode(t, add_special_tokens=False).ids, 1] for _, t in docs]
    assert stats.mean_length == sum(map(len, ids)) / 50
    for t, d in Counter(t for x in ids for t in set(x)).items():
        assert math.isclose(stats.idf[t], math.log1p((50 - d + 0.5) / (d + 0.5)))
