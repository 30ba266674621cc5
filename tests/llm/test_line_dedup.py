"""Repeated lines: the perfect hash, its shards, and documents against brute force."""

import random

import numpy as np
from corpus import edge_docs, rows

from sharelens.llm import line_dedup
from sharelens.llm.line_dedup import PerfectHash, Shard, drop_lines, keep_first_lines

BLANK = " \t\n\x0b\x0c\r"


def brute(docs):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    last = 1 << 80
    holders = {}
    for i, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders.setdefault(k, set()).add(last if i is None else i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        gone = lambda x: len(key(x)) >= 10 and len(holders[key(x)]) > 1 and min(holders[key(x)]) != i
        kept = [x for x in lines if not gone(x)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=repr)


def fixture(n=400):
    rng = random.Random(4)
    common = [f"a common line number {i}" for i in range(60)] + ["größe ñandú", "short", "日本語日本語日本語日", "日本語日本語日本語日本"]
    docs = []
    for i in range(n):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"own line {i} {j}" for j in range(rng.randrange(12))]
        lines += ["The Line Everyone Has  "] * rng.choice([0, 1, 2])
        lines = [rng.choice(["", " ", "\t", "\r"]) + (x.upper() if rng.random() < 0.1 and x.isascii() else x) + rng.choice(["", "\x0b", "\x0c "]) for x in lines]
        docs.append((None if rng.random() < 0.05 else i // 2 if i < 20 else i, "\n".join(lines)))
    return [*docs, docs[5], docs[5], (999, None), (998, ""), (997, "\n\n"), (996, "x" * 200_000 + "\nthe line everyone has")]


def test_perfect_hash_is_minimal_and_rejects_by_fingerprint():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.int64).view(np.uint64))
    hashed = PerfectHash.over(keys)
    assert sorted(hashed.index(keys).tolist()) == list(range(len(keys))) and len(hashed) == len(keys)
    shallow = PerfectHash.over(keys, levels=1)
    assert len(shallow.rest) and sorted(shallow.index(keys).tolist()) == list(range(len(keys)))
    a = np.array([5, 5, 7, -3], np.int64)  # two keys share their first half
    b = np.array([1, 2, 3, 4], np.int64)
    shard = Shard.from_bytes(Shard.over(a, b, np.array([2, 3, 4, 5]), np.array([10, 11, 12, 13])).to_bytes())
    assert [x.tolist() for x in shard.probe(a, b)] == [[2, 3, 4, 5], [10, 11, 12, 13]]
    assert shard.probe(a, b + 10)[0].tolist() == [0, 0, 0, 0]
    assert Shard.over(*[np.zeros(0, np.int64)] * 4).probe(a, b)[0].tolist() == [0, 0, 0, 0]


def test_equals_brute_force(spark):
    docs = fixture()
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)
    assert got(drop_lines(table)) == brute(docs)


def test_awkward_rows_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    plain = [(r[0], r[1]) for r in rows()]
    assert got(drop_lines(edge_docs(spark))) == brute(plain)
    kept = keep_first_lines(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns and kept.count() == len(plain)
    assert sum(r.text is None for r in kept.collect()) == 2
    assert drop_lines(edge_docs(spark).where("false")).count() == 0 and keep_first_lines(edge_docs(spark).where("false")).count() == 0
