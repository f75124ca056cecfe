"""The conversation trie against a walk over whole prefixes."""

import hashlib
import random
import zlib

import pytest

from quotegrid.llm import prefix_trie

TURN = "conv_id bigint, turn bigint, role string, text string, depth string, n bigint, block string, x1 string"


def brute(rows):
    """Nodes as (conv_id, depth, parent, members, children, leaves, saved, ends), by dictionaries of whole prefixes."""
    own = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        if conv is not None:
            own.setdefault(conv, []).append((role or "", text or ""))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {p: set() for p in members}
    for p in members:
        if p:
            children[p[:-1]].add(p)
    out = set()
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) if children[p] else 1
        bytes_ = len(p[-1][1].encode()) if p else 0
        saved[p] = (len(members[p]) - 1) * bytes_ + sum(saved[k] for k in children[p])
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.add((min(m), len(p), parent, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    assert len(out) == len(members)
    return out


def nodes(spark, rows):
    extra = [(c, t, r, x, "d", 1, "b", "y") for c, t, r, x in rows]
    got = prefix_trie.trie(spark.createDataFrame(extra, TURN)).collect()
    return [tuple(r) for r in got]


def made(seed, convs=60):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(2000), convs):
        stem = draw.choice([0, 1])
        for t in range(draw.randint(1, 14)):
            rows.append((c, t * 3, "user" if t % 2 else None, f"é{stem}{t}" if t < 6 or draw.random() < 0.7 else f"own {c} {t}"))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_the_walk(spark, seed):
    rows = made(seed)
    got = nodes(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_a_narrow_sketch_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LARGEST", 64)
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    rows = made(3) + [(3000 + i, t, "user", f"copy {t}") for i in range(200) for t in range(12)]
    assert set(nodes(spark, rows)) == brute(rows)


def test_odd_conversations(spark):
    long = "wörter " * 200_000
    rows = [
        (1, None, "user", "first"), (1, 5, None, None), (1, 7, "user", ""), (None, 1, "user", "lost"), (7, 0, "user", long), (8, 0, "user", long),
        (10, 1, "a", "x"), (10, 2, "a", "y"), (12, 0, "a", "z"), (-4, 0, "a", "minus"),
    ]
    assert set(nodes(spark, rows)) == brute(rows)
    # repeated rows are turns of their own, and equal whatever their order
    again = rows + [(10, 1, "a", "x"), (9000, 0, "q", "r")] + [(9000, 1, "s", "t")] * 500
    assert set(nodes(spark, again)) == brute(again)
    assert nodes(spark, []) == [] and nodes(spark, [(None, 1, "user", "lost")]) == []


def test_one_long_conversation_is_dealt_out(spark):
    rows = [(20, t, "user", f"turn {t % 7}") for t in range(6000)] + [(30, 0, "user", "short")]
    placed = prefix_trie.places(
        spark.createDataFrame([(c, t, t, 0, 1) for c, t, _, _ in rows], "conv_id bigint, turn bigint, t1 bigint, t2 bigint, bytes bigint")
    )
    assert [r["place"] for r in placed.where("conv_id = 20").orderBy("t1").collect()] == list(range(6000))
    got = nodes(spark, rows)
    assert len(got) == 6002 and max(r[1] for r in got) == 6000
