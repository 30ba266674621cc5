"""As-of joins and running values over range partitions against brute force."""

import random

import pytest

from sharelens.operators.asof import asof_join


def brute(left, right, forward):
    out = []
    for i, k, v in left:
        fit = [(w, j) for j, q, w in right if None not in (k, v, q, w) and q == k and (w >= v if forward else w <= v)]
        best = min(fit, key=lambda m: (m[0] if forward else -m[0], m[1]), default=(None, None))
        out.append((i, k, v, best[1]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("partitions", ["1", "13"])
def test_equals_brute_force(spark, forward, partitions):
    rng = random.Random(2)
    key = lambda: rng.choice(["hot"] * 5 + ["a", "b", None])  # noqa: E731  (one key holds most rows)
    left = [(i, key(), rng.choice([None, *range(200)])) for i in range(1200)] + [(5000, "alone", 3)] * 2
    right = [(i, key(), rng.choice([None, *range(0, 200, 7)])) for i in range(300)] + [(9000, "other", 3)]
    shape = "{0} bigint, k string, {1} bigint"
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        a, b = spark.createDataFrame(left, shape.format("i", "v")), spark.createDataFrame(right, shape.format("j", "w"))
        found = asof_join(a, b, ["k"], "v", "w", ["j"], forward).select("l.i", "l.k", "l.v", "r.j").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted((tuple(r) for r in found), key=repr) == brute(left, right, forward)


def test_empty_sides(spark):
    a = spark.createDataFrame([(1, "x", 2)], "i bigint, k string, v bigint")
    b = spark.createDataFrame([], "j bigint, k string, w bigint")
    assert [r.r for r in asof_join(a, b, ["k"], "v", "w", ["j"]).collect()] == [None]
    assert asof_join(a.where("false"), b, ["k"], "v", "w", ["j"]).count() == 0
