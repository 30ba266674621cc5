"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Everything here is DataFrame work. Documents get a position in a seeded permutation of their source
(a digest of the id), which also deals them into blocks of about equal size, so a hot source is many
blocks. The quota of a source, in words, is drawn from the front of its permuted blocks; the last
block, and in it the last document, is taken in part, so that the quota is met to the word. The drawn
blocks then go down a binary tree: at each node the block instances of all sources are ranked by a
seeded digest and half of them go left. Such a draw without replacement splits the node's per-source
quotas by the multivariate hypergeometric distribution, and no instance is lost or doubled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharelens.llm.common import small, text_of, words_of
from sharelens.session import settle

#: Bits of a permutation key; blocks use the upper half, so block numbers fit a long product.
KEY_BITS, BLOCK_BITS = 60, 30


def _digest(*parts: Column) -> Column:
    """60 bits of an MD5 over the parts as a long that is never negative."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, KEY_BITS // 4), 16, 10).cast("long")


def _tag(source: Column) -> Column:
    """A source as text that tells null from any name."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def measure(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size in words, and the permutation key; one pass over the texts."""
    # rows without an id are told apart by their text, so they do not share one block
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none:"), F.xxhash64("text").cast("string")))
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.size(words_of(text_of())).cast("long").alias("size"),
        _digest(F.lit(f"{seed}:"), name).alias("key"),
        F.xxhash64("text").alias("tie"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """source, source_size -> the same with ``target``: ``share`` of all sizes by weight, none above ``cap`` times its size.

    Filling by weight until none is above its cap has a closed form: in ascending order of cap per
    weight, sources are capped until the level of the others no longer exceeds the next one's cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "place")
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") - 1) % len(weights) + 1))
        .withColumn("limit", (F.lit(cap) * F.col("source_size")).cast("double"))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("open", F.sum("weight").over(rest))
        .withColumn(
            "left",
            F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        )
        .withColumn("fits", F.col("left") * F.col("weight") <= F.col("limit") * F.col("open"))
    )
    first = F.min(F.when(F.col("fits"), F.struct("ratio", "place", "left", "open"))).over(everything)
    filled = ranked.withColumn("level", first)
    above = F.struct("ratio", "place") >= F.struct("level.ratio", "level.place")
    target = F.when(above, F.col("level.left") * F.col("weight") / F.col("level.open")).otherwise(F.col("limit"))
    return filled.select("source", "source_size", F.least(target, F.col("limit")).alias("target"))


def sources_of(rows: DataFrame, block_words: int, max_blocks: int, **weighing) -> DataFrame:
    """One row per source: target, whole passes, words of the last pass, number of blocks."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    goal, size = F.floor("target"), F.greatest(F.col("source_size"), F.lit(1))
    per_block = F.greatest(F.lit(block_words).cast("double"), total / max_blocks)
    return targets(sizes, **weighing).select(
        "source",
        "source_size",
        "target",
        F.floor(goal / size).cast("long").alias("passes"),
        (goal % size).cast("long").alias("rest"),
        F.greatest(F.ceil(F.col("source_size") / per_block), F.lit(1)).cast("long").alias("blocks"),
    )


def in_blocks(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """The measured rows with their source's plan and the block that their key falls into."""
    plan = small(sources, 100_000).withColumnRenamed("source", "of")
    block = F.shiftright(F.shiftright("key", KEY_BITS - BLOCK_BITS) * F.col("blocks"), BLOCK_BITS)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", block).drop("of", "blocks")


def draw(placed: DataFrame) -> DataFrame:
    """Per block: its words and how many of them the last pass takes, from the front of the permuted blocks."""
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.groupBy("source", "block", "passes", "rest")
        .agg(F.sum("size").alias("words"))
        .withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .withColumn("drawn", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("start"))))
        .select("source", "block", "passes", "words", "drawn")
    )


def split(blocks: DataFrame, levels: int, seed: str = "mix") -> DataFrame:
    """Instances (source, block, turn) with the output shard that the tree gives them.

    A node ranks its instances in one task; the number of instances is bounded by the blocks, of
    which there are at most ``max_blocks`` and one per source.
    """
    turns = F.col("passes") + F.when(F.col("drawn") > 0, 1).otherwise(0)
    tree = blocks.where(turns > 0).select(
        "source", "block", F.explode(F.sequence(F.lit(1).cast("long"), turns)).alias("turn"), F.lit(0).alias("shard")
    )
    for level in range(levels):
        draw_key = _digest(
            F.lit(f"{seed}:{level}:"),
            F.col("block").cast("string"),
            F.lit(":"),
            F.col("turn").cast("string"),
            F.lit(":"),
            _tag(F.col("source")),
        )
        node = Window.partitionBy("shard")
        rank = F.row_number().over(node.orderBy("draw", F.col("source").asc_nulls_last(), "block", "turn"))
        tree = (
            tree.withColumn("draw", draw_key)
            .withColumn("rank", rank)
            .withColumn("n", F.count(F.lit(1)).over(node))
            .withColumn("shard", F.col("shard") * 2 + F.when(F.col("rank") * 2 <= F.col("n") + level % 2, 0).otherwise(1))
            .select("source", "block", "turn", "shard")
        )
    return tree


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    levels: int = 4,
    block_words: int = 50_000,
    max_blocks: int = 1 << 20,
    seed: str = "mix",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, shards, block, key.

    ``taken`` counts words, repeats included: the whole passes over its source and what the last,
    partial pass takes. ``shards`` lists, pass by pass, which of the ``2 ** levels`` output shards
    gets the document; it is empty where nothing is taken of its block. ``block_words`` is the size of
    a block as long as there are no more than ``max_blocks``; beyond that blocks grow.

    Null text: size 0. Null source: a source of its own, last in order. Null id: all such rows get one
    key and are told apart by size and text. Repeated rows count as often as they occur. An empty
    table gives an empty result. Other columns of ``docs`` are ignored.
    """
    rows = settle(measure(docs, seed))
    sources = settle(sources_of(rows, block_words, max_blocks, weights=weights, share=share, cap=cap))
    placed = in_blocks(rows, sources)
    blocks = settle(draw(placed))
    shards = (
        split(blocks, levels, seed)
        .groupBy("source", "block")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "shard"))), lambda x: x["shard"]).alias("shards"))
    )
    known = blocks.select(F.col("source").alias("of"), F.col("block").alias("at"), "words", "drawn")
    dealt = shards.select(F.col("source").alias("of2"), F.col("block").alias("at2"), "shards")
    known = known.join(dealt, F.col("of").eqNullSafe(F.col("of2")) & (F.col("at") == F.col("at2")), "left").drop("of2", "at2")
    known = small(settle(known), 200_000)
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))
    inside = Window.partitionBy("source", "block").orderBy("key", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("drawn") - F.col("start")))
    return (
        placed.withColumn("start", start)
        .join(known, same)
        .withColumn("taken", (F.col("passes") * F.col("size") + part).cast("long"))
        .withColumn("shards", F.coalesce("shards", F.array().cast("array<int>")))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "shards", "block", "key")
    )


def shuffled_shards(docs: DataFrame, levels: int = 4, seed: str = "mix", **how) -> DataFrame:
    """The mix itself: one row per document and pass with its shard, words to take and place in the shard's order.

    Write it with ``repartition("shard", "bucket").sortWithinPartitions("shard", "place")``: ``bucket``
    spreads a large shard over tasks, ``place`` shuffles locally.
    """
    taken = mix(docs, levels=levels, seed=seed, **how)
    whole = F.col("turn") * F.col("size") <= F.col("taken")
    each = taken.select("*", F.posexplode("shards").alias("pass", "shard")).withColumn("turn", F.col("pass") + 1)
    words = F.when(whole, F.col("size")).otherwise(F.greatest(F.lit(0), F.col("taken") - F.col("pass") * F.col("size")))
    return (
        each.withColumn("words", words)
        .where("words > 0")
        .withColumn("place", F.xxhash64(F.lit(seed), "key", "turn"))
        .withColumn("bucket", F.pmod(F.col("place"), F.lit(64)))
        .select("doc_id", "source", "shard", "bucket", "place", "turn", "words")
    )


def mix_sql(levels: int = 4, block_words: int = 50_000, max_blocks: int = 1 << 20, seed: str = "mix") -> str:
    """The rows of the query in DuckDB's SQL, block plan and splitting tree included."""
    digest = "CAST(('0x' || left(md5({}), 15)) AS BIGINT)"
    steps = []
    for level in range(levels):
        parts = f"'{seed}:{level}:' || block || ':' || turn || ':' || CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END"
        order = f"{digest.format(parts)}, source NULLS LAST, block, turn"
        steps.append(
            f"tree{level + 1} AS (SELECT source, block, turn, shard * 2 + CASE WHEN 2 * row_number() OVER (PARTITION BY shard ORDER BY {order})"
            f" <= count(*) OVER (PARTITION BY shard) + {level % 2} THEN 0 ELSE 1 END AS shard FROM tree{level})"
        )
    return f"""
WITH measured AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size,
         {digest.format(f"'{seed}:' || doc_id")} AS key FROM documents),
sized AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM measured GROUP BY source),
weighed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized),
ratios AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, CAST(2 * source_size AS DOUBLE) AS lim FROM weighed),
levels AS (
  SELECT *, lim / weight AS ratio,
         sum(weight) OVER (ORDER BY lim / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         1.5 * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over
  FROM ratios),
level AS (SELECT ratio AS r, place AS p, left_over AS l, open AS o FROM levels WHERE left_over * weight <= lim * open ORDER BY ratio, place LIMIT 1),
filled AS (SELECT source, source_size, least(lim, CASE WHEN (ratio, place) >= (r, p) THEN l * weight / o ELSE lim END) AS target FROM levels, level),
plan AS (
  SELECT source, source_size, target, CAST(floor(target) AS BIGINT) // greatest(source_size, 1) AS passes,
         CAST(floor(target) AS BIGINT) % greatest(source_size, 1) AS rest,
         greatest(CAST(ceil(source_size / greatest({block_words}.0, (SELECT sum(source_size) FROM filled) / {max_blocks})) AS BIGINT), 1) AS blocks FROM filled),
placed AS (
  SELECT m.*, p.source_size, p.target, p.passes, p.rest, ((m.key >> 30) * p.blocks) >> 30 AS block
  FROM measured m JOIN plan p ON m.source IS NOT DISTINCT FROM p.source),
summed AS (SELECT source, block, passes, rest, CAST(sum(size) AS BIGINT) AS words FROM placed GROUP BY ALL),
drawn AS (
  SELECT *, greatest(0, least(words, rest - coalesce(sum(words) OVER (PARTITION BY source ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS drawn
  FROM summed),
tree0 AS (SELECT source, block, unnest(range(1, passes + CASE WHEN drawn > 0 THEN 2 ELSE 1 END)) AS turn, 0 AS shard FROM drawn),
{", ".join(steps)},
dealt AS (SELECT source, block, string_agg(shard, ',' ORDER BY turn) AS shards FROM tree{levels} GROUP BY ALL),
ordered AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM placed)
SELECT o.doc_id, CAST(o.size AS BIGINT) AS size, o.source_size, o.target,
       CAST(o.passes * o.size + greatest(0, least(o.size, o.rest - o.before)) AS BIGINT) AS taken, coalesce(d.shards, '') AS shards
FROM ordered o LEFT JOIN dealt d ON o.source IS NOT DISTINCT FROM d.source AND o.block = d.block
"""
