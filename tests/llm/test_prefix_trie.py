"""Tries of conversations against brute force: null turns, texts and roles, ties, repeated rows, long and hot conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sharelens.llm.prefix_trie import conversation_trie, last_turns, list_ranks

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[2] for x in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for x in members:
        if x:
            children[x[:-1]] += 1
    for x, of in members.items():
        worth = (len(of) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        for d in range(len(x) + 1):
            saved[x[:d]] += worth
            leaves[x[:d]] += x not in children
    return sorted(
        (
            min(of), len(x), min(members[x[:-1]]) if x else None, len(of), children[x], leaves[x], saved[x],
            hashlib.sha256(",".join(str(c) for c in sorted(of) if built[c] == x).encode()).hexdigest(),
        )
        for x, of in members.items()
    )


def fixture(seed, convs=150, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in range(-45, convs):
        if rng.random() < 0.15:
            continue
        for turn in range(rng.choice([1, 2, 3, 5, longest])):
            place = None if rng.random() < 0.1 else turn // rng.choice([1, 1, 1, 2])
            text = rng.choice(["a", "a b", "", None, " \t c  d e ", "Ünï 😀 x", f"own {c} {turn}"] if turn > 1 else ["hello", "hi  there"])
            rows.append((c, place, rng.choice(["user", "user", None, ""]), text))
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None), rows[3], rows[3]]
    rows += [(400 + i, 0, "user", "hot") for i in range(300)] + [(777, i, "user", f"w{i} w") for i in range(700)]
    return rows


@pytest.mark.parametrize("seed,stretch,rest", [(1, 2048, 4096), (2, 8, 16), (3, 2, 3)])
def test_equals_brute_force(spark, seed, stretch, rest):
    rows = fixture(seed)
    turns = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("clash").alias(c) for c in ("conv", "depth", "what", "pos", "k", "id", "words", "x1")))
    got = conversation_trie(turns.repartition(5), stretch, rest)
    tour = got.select("enter", "exit").collect()
    assert sorted(x for r in tour for x in r) == list(range(2 * len(tour)))
    out = [tuple(r) for r in got.drop("enter", "exit").collect()]
    assert sorted(out, key=lambda r: (r[0], r[1])) == sorted(brute(rows), key=lambda r: (r[0], r[1]))


def test_empty_table_and_nameless_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_trie(empty).count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
    alone = conversation_trie(spark.createDataFrame([(7, None, None, None)], SCHEMA)).drop("enter", "exit").collect()
    assert sorted(tuple(r) for r in alone) == brute([(7, None, None, None)])


def test_list_ranks_of_a_long_list(spark):
    n = 5000
    order = random.Random(5).sample(range(10 * n), n)
    rows = [((v, v % 3), (order[i + 1], order[i + 1] % 3) if i + 1 < n else None, 1, i % 2, v) for i, v in enumerate(order)]
    pair = "struct<conv:bigint,k:bigint>"
    ranks = list_ranks(spark.createDataFrame(rows, f"id {pair}, to {pair}, w0 bigint, w1 bigint, w2 bigint"), rest=100).collect()
    assert len(ranks) == n
    want, sums = {}, (0, 0, 0)
    for v, _, *w in rows:
        want[v] = sums
        sums = tuple(a + b for a, b in zip(sums, w, strict=True))
    assert {tuple(r["id"]): (r["w0"], r["w1"], r["w2"]) for r in ranks} == want


def test_last_turns(spark):
    turns = spark.createDataFrame([(21, 0, "user", "a b"), (21, 1, "bot", "c"), (23, 0, "user", "a b")], SCHEMA)
    nodes = spark.createDataFrame([(21, 0), (21, 1), (21, 2)], "conv_id bigint, depth bigint")
    got = sorted(tuple(r) for r in last_turns(nodes, turns, ["turn"]).collect())
    assert got == [(21, 1, "user", "a b"), (21, 2, "bot", "c")]
