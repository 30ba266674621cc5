"""Hard negatives: intervals hold every score, and the rows equal brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sharelens.llm.hard_negatives import Anchors, encode, hard_negatives, mine, rotations

SCHEMA = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize("width,spread", [(64, 256), (1, 3), (70, 5000), (3, 0)])
def test_intervals_hold_every_score(width, spread):
    rng = np.random.default_rng(width)
    x = np.floor(rng.normal(size=(300, width)) * spread).astype(np.int64)
    q = np.concatenate((x[:10], np.floor(rng.normal(size=(20, width)) * 7).astype(np.int64)))
    turns = rotations(width)
    codes, aligned, rest = encode(x, turns)
    anchors = Anchors(np.arange(30), np.zeros(30, int), q, turns)
    low, high = anchors.intervals(slice(0, 30), codes, aligned, rest)
    exact = q @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    if width == 64:  # four codes leave about an eighth of the length
        assert (rest < 0.25 * np.linalg.norm(x, axis=1)).mean() > 0.95


def brute(rows):
    use = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(c is not None and math.isfinite(c) for c in v):
            use.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, label, v in {(a, b, tuple(c)) for a, b, c in use if a % 100 == 0}:
        near = sorted((-dot(v, w), j) for j, other, w in use if other == label and j != i)[:5]
        far = sorted((-dot(v, w), j) for j, other, w in use if other != label)
        for p, j in near:
            inside = [(s, k) for s, k in far if 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(inside, 1)]
    return sorted(out)


def fixture():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(-200, 700):
        v = centres[i % 12] * rng.choice([0.1, 1.0]) + rng.normal(size=16) * 0.4
        rows.append((i, [float(x) for x in v], int(rng.integers(0, 10))))
    rows += [(1000 + i, [0.5] * 16, 3) for i in range(300)]  # one vector very often: ties go by id
    rows += [(2000, None, 1), (2100, [float("nan")] * 16, 1), (2200, [1.0, None], 1), (2300, [float("inf")], 1), (2400, [0.5, 0.25], None), (None, [0.5] * 16, 3)]
    rows += [(2500, [], 3), (2600, [0.5] * 3, 3), (2700, [0.0] * 16, 4), rows[5], rows[200], rows[200]]
    return rows


def plain(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_equals_brute_force_in_any_blocks(spark):
    rows = fixture()
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert len(want) > 100
    assert plain(hard_negatives(table.select("*", F.lit(1).alias("anchor"), F.lit(2).alias("codes"), F.lit(3).alias("position")))) == want
    small = spark.createDataFrame([(i, [int(c) for c in range(i % 5)], i % 3) for i in range(60)], "vec_id bigint, vec array<bigint>, label int")
    assert plain(mine(small, F.col("vec_id") % 10 == 0, block=2)) == plain(mine(small, F.col("vec_id") % 10 == 0))


def test_empty_table_and_no_anchors(spark):
    table = spark.createDataFrame(fixture(), SCHEMA)
    assert hard_negatives(table.where("false")).count() == 0
    assert hard_negatives(table.where("vec_id % 100 <> 0")).count() == 0
