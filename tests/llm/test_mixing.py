"""Targets, quotas and the splitting tree."""

import pytest
from corpus import edge_docs, prose
from pyspark.sql import functions as F

from sharelens.llm import mixing


def filled(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Targets by rounds: the excess over a cap goes to the others by weight until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = budget / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in open_}
        for s in above:
            target[s] = float(cap * sizes[s])
            budget -= target[s]
        open_ -= above
    return target


@pytest.mark.parametrize(
    "sizes",
    [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 5, None: 300}, {"é": 7, "z": 0, "A": 9000, "a": 1}, {None: 50}, {"x": 0}],
)
def test_targets(spark, sizes):
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
    assert {r.source: pytest.approx(r.target) for r in rows} == filled(sizes)


def corpus(spark, n=900):
    docs = [(i, prose(1 + i * 37 % 200, i), "big" if i % 3 else f"s{i % 5}") for i in range(n)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string")


def test_quotas_are_met_to_the_word(spark):
    rows = mixing.mix(corpus(spark), block_words=500).collect()
    by_source = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.size == len(prose(1 + r.doc_id * 37 % 200, r.doc_id).split())
        by_source.setdefault(r.source, []).append(r)
    for members in by_source.values():
        assert sum(r.size for r in members) == members[0].source_size
        assert sum(r.taken for r in members) == int(members[0].target)


def test_reruns_and_partitionings_agree(spark):
    docs = corpus(spark, 300)
    runs = [sorted(map(tuple, mixing.mix(d, block_words=200).collect())) for d in (docs, docs.repartition(7), docs.coalesce(1))]
    assert runs[0] == runs[1] == runs[2]


def test_tree_keeps_every_instance_and_splits_evenly(spark):
    blocks = spark.range(400).select(
        F.concat(F.lit("s"), F.col("id") % 3).alias("source"), "id", F.lit(1).cast("bigint").alias("passes"), (F.col("id") % 2).alias("drawn")
    ).withColumnRenamed("id", "block")
    rows = mixing.split(blocks, levels=3).collect()
    assert len({(r.source, r.block, r.turn) for r in rows}) == len(rows) == 600
    counts = [sum(r.shard == k for r in rows) for k in range(8)]
    assert sum(counts) == 600 and max(counts) - min(counts) <= 1
    shares = [sum(r.shard == k and r.source == "s0" for r in rows) for k in range(8)]
    assert 201 == sum(shares) and len(set(shares)) > 1 and all(10 <= s <= 42 for s in shares)


def test_shards_hold_what_is_taken(spark):
    docs = corpus(spark, 300)
    taken = {r.doc_id: r.taken for r in mixing.mix(docs, block_words=200).collect()}
    placed = mixing.shuffled_shards(docs, block_words=200).groupBy("doc_id").agg(F.sum("words").alias("n")).collect()
    assert {r.doc_id: r.n for r in placed} == {i: n for i, n in taken.items() if n}


def test_hot_source_is_many_blocks(spark):
    placed = mixing.mix(corpus(spark), block_words=500).where("source = 'big'").groupBy("block").count().collect()
    assert len(placed) > 50 and max(r["count"] for r in placed) < 40


def test_null_and_repeated_rows(spark):
    rows = mixing.mix(edge_docs(spark)).collect()
    assert sum(r.doc_id == 8 for r in rows) == 2 and all(r.taken == 0 for r in rows if r.size == 0)
    for source in {r.source for r in rows}:
        members = [r for r in rows if r.source == source]
        assert sum(r.taken for r in members) == int(members[0].target)
