"""Fingerprints, bit-sliced comparison and components against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sharelens.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, "One", "One two", "one two THREE", "x " * 9000, "Ñandú ß a\x0bb c d e f g"])
def test_fingerprint(text):
    hashes = simhash.shingle_hashes(text)
    assert simhash.fingerprint(simhash.bit_counts(hashes), len(hashes)) == brute_fingerprint(text)


def test_hash_is_sparks(spark):
    text = "the ñandú of some long shingle that exceeds thirty-two bytes"
    assert spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first().h % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_within_counts_every_distance(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 500).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in base], np.uint64)
    flags = simhash.within(iter(simhash.bit_planes(flips)), radius)
    assert (simhash.flags_of(flags, 500) == (np.bitwise_count(flips) <= radius)).all()


def test_block_is_abandoned():
    seen = []
    planes = (seen.append(k) or np.full(4, ~np.uint64(0)) for k in range(64))
    assert simhash.within(planes) is None and len(seen) == 8


def test_masks_cover_three_errors():
    masks = simhash.masks()
    rng = np.random.default_rng(0)
    for _ in range(500):
        flip = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(flip & m == 0 for m in masks)


def brute_components(prints):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 3 and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("long_run", [simhash.LONG_RUN, 100, 7])
def test_links_close_to_the_right_components(spark, long_run):
    rng = np.random.default_rng(5)
    prints = set()
    for _ in range(60):  # chains and clouds of near values, one cloud larger than a small run
        value = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(int(rng.integers(1, 12))):
            value ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False))
            prints.add(value)
    centre = int(rng.integers(0, 2**63))
    prints |= {centre ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(24) if a != b}
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    pairs = simhash.near_pairs(spark.createDataFrame(signed, "fp bigint").repartition(4), long_run)
    found = {r.node % 2**64: r.root % 2**64 for r in simhash.contract(pairs).collect()}
    want = brute_components(prints)
    groups = lambda of: {frozenset(p for p in prints if of(p) == of(q)) for q in prints}
    assert groups(lambda p: found.get(p, p)) == groups(want.get)
    if long_run > 100:
        assert pairs.count() < 25 * len(prints)  # a spanning forest for each choice of groups, not all pairs


def test_query_like_use(spark):
    text = " ".join(f"w{i}" for i in range(400))
    docs = [(5, text), (3, text), (9, text + " end"), (7, "something else entirely here"), (8, None), (6, " ")]
    rows = {r.doc_id: r for r in simhash.components(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    near = (brute_fingerprint(text) ^ brute_fingerprint(text + " end")).bit_count() <= 3
    assert [rows[i].component_id for i in (5, 3, 7, 8, 6)] == [3, 3, 7, 6, 6] and rows[9].component_id == (3 if near else 9)


def test_an_id_with_two_texts_keeps_only_the_chosen_one(spark):
    one, two = " ".join(f"w{i}" for i in range(400)), " ".join(f"v{i}" for i in range(400))
    docs = [(5, one), (3, two), (5, two), (7, one), (7, one)]
    rows = simhash.keep_one(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(3, two), (5, one)]
