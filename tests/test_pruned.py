"""Pruned neighbours: the rows of the complete search, with fewer block products on clustered vectors."""

import numpy as np
import pytest

from sharelens.operators import neighbours


def vectors(spark, clusters, n=600, width=6, noise=0.05):
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(max(1, clusters), width)) * (clusters > 0)
    rows = [(f"v{i:04d}", (centres[i % max(1, clusters)] + rng.normal(size=width) * (noise if clusters else 1)).tolist()) for i in range(n)]
    rows += [(f"same{i:02d}", [1.0] * width) for i in range(40)] + [("zero", [0.0] * width), ("none", None)]
    return spark.createDataFrame(rows, "id string, vec array<double>").repartition(4)


@pytest.mark.parametrize("clusters,block_rows,k", [(0, 100, 5), (12, 60, 3), (12, 4096, 10), (5, 7, 9)])
def test_equals_the_complete_search(spark, clusters, block_rows, k):
    v = vectors(spark, clusters, 600 if block_rows > 7 else 80)
    got = sorted(tuple(r) for r in neighbours.pruned_neighbours(v, k, block_rows).select("c1", "c2", "rank").collect())
    want = sorted(tuple(r) for r in neighbours.nearest_neighbours(v, k).select("c1", "c2", "rank").collect())
    assert got == want


def test_clustered_vectors_leave_most_block_pairs_out(spark):
    balls = neighbours.Balls(vectors(spark, 30, 1500, noise=0.01), 5, 60)
    every = balls.blocks * (balls.blocks - 1)
    assert balls.blocks > 20 and balls.asks.count() < 0.3 * every


def test_few_and_no_rows(spark):
    some = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vec array<double>")
    assert {(r.c1, r.c2) for r in neighbours.pruned_neighbours(some).collect()} == {("a", "b"), ("b", "a")}
    assert neighbours.pruned_neighbours(some.where("false")).count() == 0


def test_a_vector_is_shuffled_once_a_group(spark, monkeypatch):
    """What is shuffled grows with the groups, not with the blocks; several groups and ties between them give the complete search."""
    v = vectors(spark, 0, 300)
    balls = neighbours.Balls(v, 4, 16)
    frame, dealt = type(v), []
    repartition = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols: dealt.append(self) or repartition(self, n, *cols))
    got = neighbours.pruned_neighbours(v, 4, 16, held_rows=100)
    groups = 2 * spark.sparkContext.defaultParallelism
    rows = dealt[0].count()
    assert balls.blocks > 1.5 * groups and rows <= 341 * (groups + 1) < balls.asks.count() * 16 / 2
    got = sorted((r.c1, r.c2, r["rank"]) for r in got.collect())
    assert got == sorted((r.c1, r.c2, r["rank"]) for r in neighbours.nearest_neighbours(v, 4).collect())


def test_a_task_holds_few_products_whatever_the_block(monkeypatch):
    sizes, rounded = [], np.round
    monkeypatch.setattr(np, "round", lambda a, *args, **kw: sizes.append(a.size) or rounded(a, *args, **kw))
    x = np.random.default_rng(0).normal(size=(3000, 4))
    ids = __import__("pyarrow").array([str(i) for i in range(3000)])
    assert sum(len(p[0]) for p in neighbours._against(ids, x, ids, x, 3, True)) == 9000
    assert max(sizes) <= 1 << 20
