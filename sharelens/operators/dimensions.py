"""Social dimensions from seed pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sharelens.functions.vectors import difference, product_with, unit, vector_sums
from sharelens.operators.neighbours import nearest_neighbours
from sharelens.operators.vectors import vector_width
from sharelens.session import collect_bounded, hint_small, settle

Seeds = dict[str, list[tuple[str, str]]]

_DIGITS = 12
DIMENSION_SCHEMA = (
    "name string, seeds array<struct<l:string,r:string>>, vec array<double>, "
    "left_comms array<string>, right_comms array<string>"
)


def one_dimension_per_pair(names: list[str], pairs: list[tuple[str, str]]) -> Seeds:
    return {name: [pair] for name, pair in zip(names, pairs)}


def _seed_matrix(vectors: DataFrame, seeds: Seeds) -> np.ndarray:
    wanted = sorted({c for pairs in seeds.values() for pair in pairs for c in pair})
    rows = collect_bounded(
        vectors.where(F.col("id").isin(wanted)).select("id", "vec"), len(wanted), "seed vectors"
    )
    known = {r["id"]: np.array(r["vec"], dtype=float) for r in rows}
    missing = [c for c in wanted if c not in known]
    if missing:
        raise KeyError(f"seeds without a vector: {missing}")
    return np.array([known[r] - known[l] for pairs in seeds.values() for l, r in pairs])


def seed_similarity(pairs: DataFrame, vectors: DataFrame, seeds: Seeds) -> DataFrame:
    """``dim, c1, c2, similarity``: edge direction against the best seed direction.

    (v2 - v1) . s equals v2.s - v1.s, so each vector meets the few seed
    directions once and only those products travel through the edge joins.
    """
    product = product_with(_seed_matrix(vectors, seeds))
    ends = vectors.where(F.col("vec").isNotNull()).select("id", product("vec").alias("p"))
    left = ends.select(F.col("id").alias("c1"), F.col("p").alias("p1"))
    right = ends.select(F.col("id").alias("c2"), F.col("p").alias("p2"))
    edges = pairs.select("c1", "c2").join(left, "c1").join(right, "c2")
    edges = edges.select("c1", "c2", difference("p2", "p1").alias("d"))
    per_dim, start = [], 1
    for name, seed_pairs in seeds.items():
        best = F.array_max(F.slice("d", start, len(seed_pairs)))
        per_dim.append(
            F.struct(F.lit(name).alias("dim"), F.round(best, _DIGITS).alias("similarity"))
        )
        start += len(seed_pairs)
    return edges.select("c1", "c2", F.inline(F.array(*per_dim))).select(
        "dim", "c1", "c2", "similarity"
    )


def pick_disjoint(edges: DataFrame, taken: DataFrame, wanted: DataFrame, compat: bool = False) -> DataFrame:
    """``dim, c1, c2, place``: the edges that one walk from the most similar edge down would pick, each community at most once per dimension.

    ``edges`` are ``dim, c1, c2, similarity``, ``taken`` the communities (``dim, node``) that no edge may touch, ``wanted`` the number of picks
    (``dim, n``). An edge that is the best one at both of its ends is picked by the walk whatever happens elsewhere; so all of those are
    picked at once, edges that touch them go, and the rest is looked at again. Edges worse than a dimension's n-th pick go too, since
    picks are never undone. No edge leaves the executors, and all dimensions share the rounds.
    """
    order = F.struct((-F.col("similarity")).alias("s"), "c1", "c2")
    left = edges.where("c1 <> c2").select("dim", "c1", "c2", order.alias("o"))
    if compat:
        worst = edges.groupBy("dim").agg(F.min(F.struct("similarity", "c1", "c2")).alias("w"))
        last = worst.select("dim", F.explode(F.array("w.c1", "w.c2")).alias("node"))
        taken = taken.select("dim", "node").union(last)
    wanted = hint_small(settle(wanted.where("n > 0").select(F.col("dim").alias("_d"), "n")))
    left = left.join(wanted, F.col("dim") == F.col("_d"), "left_semi")
    gone, picked = settle(taken.select("dim", "node").distinct()), None
    while True:
        side = hint_small(gone.select(F.col("dim").alias("_d"), F.col("node").alias("_n")))
        for end in ("c1", "c2"):
            left = left.join(side, (F.col("dim") == F.col("_d")) & (F.col(end) == F.col("_n")), "left_anti")
        if picked is not None:
            full = picked.join(wanted, F.col("dim") == F.col("_d")).where("place = n").select(F.col("dim").alias("_d"), F.col("o").alias("_o"))
            left = left.join(hint_small(settle(full)), F.col("dim") == F.col("_d"), "left").where("_o is null or o < _o").select("dim", "c1", "c2", "o")
        left = settle(left)
        if left.isEmpty():
            break
        ends = left.select("dim", F.explode(F.array("c1", "c2")).alias("node"), "o")
        best = ends.groupBy("dim", "node").agg(F.min("o").alias("o"))
        now = settle(best.groupBy("dim", "o").count().where("count = 2").select("dim", "o"))
        every = now if picked is None else now.union(picked.select("dim", "o"))
        first = every.withColumn("place", F.row_number().over(Window.partitionBy("dim").orderBy("o")))
        # no more picks than wanted are kept, so what is ranked stays small
        limit = first.join(wanted, F.col("dim") == F.col("_d")).where("place <= n").select("dim", "o", "place")
        picked, gone = settle(limit), now.select("dim", F.explode(F.array("o.c1", "o.c2")).alias("node"))
    if picked is None:
        return left.select("dim", "c1", "c2", F.lit(0).alias("place"))
    return picked.select("dim", "o.c1", "o.c2", "place")


def dimensions_from_seeds(
    vectors: DataFrame, seeds: Seeds, pairs: DataFrame | None = None, k: int = 10, size: int = 10, compat: bool = False
) -> DataFrame:
    """Seed directions plus the most similar disjoint neighbour directions, summed.

    Returns ``name, seeds, vec, left_comms, right_comms``; ``size`` directions
    per dimension, seeds included and first.
    """
    if pairs is None:
        pairs = nearest_neighbours(vectors, k)
    spark = vectors.sparkSession
    edges = settle(seed_similarity(pairs, vectors, seeds))
    # the seeds are the caller's own list
    given = spark.createDataFrame([(n, i, l, r) for n, found in seeds.items() for i, (l, r) in enumerate(found)], "dim string, place int, c1 string, c2 string")
    taken = given.select("dim", F.explode(F.array("c1", "c2")).alias("node"))
    wanted = spark.createDataFrame([(n, size - len(found)) for n, found in seeds.items()], "dim string, n int")
    picks = pick_disjoint(edges, taken, wanted, compat)
    chosen = given.where(F.col("place") < size).select("dim", F.lit(0).alias("part"), "place", "c1", "c2")
    chosen = settle(chosen.union(picks.select("dim", F.lit(1).alias("part"), "place", "c1", "c2")))
    # two rows per direction
    ends = chosen.select(F.col("dim").alias("name"), F.explode(F.array(F.struct(F.col("c1").alias("id"), F.lit(-1.0).alias("sign")), F.struct(F.col("c2").alias("id"), F.lit(1.0).alias("sign")))).alias("e"))
    joined = vectors.join(hint_small(settle(ends.select("name", "e.id", "e.sign"))), "id")
    sums = vector_sums(joined, ["name"], vector_width(vectors), weight=F.col("sign"))
    listed = chosen.groupBy(F.col("dim").alias("name")).agg(F.array_sort(F.collect_list(F.struct("part", "place", "c1", "c2"))).alias("all"))
    kept = F.transform(F.filter("all", lambda x: x["part"] == 0), lambda x: F.struct(x["c1"].alias("l"), x["c2"].alias("r")))
    labels = listed.select(
        "name", kept.alias("seeds"), F.transform("all", lambda x: x["c1"]).alias("left_comms"), F.transform("all", lambda x: x["c2"]).alias("right_comms")
    )
    return sums.join(labels, "name").select("name", "seeds", "vec", "left_comms", "right_comms")


def rename_stored(stored: DataFrame) -> DataFrame:
    """Accept the older ``negative_comms`` / ``positive_comms`` column names."""
    return stored.withColumnsRenamed(
        {"negative_comms": "left_comms", "positive_comms": "right_comms"}
    )


def rebuild_dimensions(stored: DataFrame, vectors: DataFrame, width: int | None = None, strict: bool = False) -> DataFrame:
    """Stored dimensions in another embedding: ``name, vec`` (unit).

    Mean of right minus left vectors over the pairs, or of right plus left for ``*_neutral``; only the
    direction matters, so sums replace the mean. A pair with an end that has no vector, or no
    partner because the lists differ in length, is left out as a whole; ``strict`` refuses it.
    """
    pairs = rename_stored(stored).select("name", F.explode(F.arrays_zip("left_comms", "right_comms")).alias("pair"))
    pairs = settle(pairs.select("name", F.col("pair.left_comms").alias("l"), F.col("pair.right_comms").alias("r")))
    known = vectors.where(F.col("vec").isNotNull()).select("id", "vec")
    left = known.select(F.col("id").alias("l"), F.col("vec").alias("__l"))
    right = known.select(F.col("id").alias("r"), F.col("vec").alias("__r"))
    joined = settle(left.join(hint_small(pairs), "l").join(right, "r"))
    if strict and joined.count() < pairs.count():
        raise KeyError("a dimension has a pair without a vector")
    sign = F.when(F.col("name").endswith("_neutral"), 1.0).otherwise(-1.0)
    edges = joined.select("name", F.zip_with("__r", F.transform("__l", lambda x: x * sign), lambda a, b: a + b).alias("vec"))
    width = width or vector_width(vectors)
    return vector_sums(edges, ["name"], width, weight=F.lit(1.0)).select("name", unit("vec").alias("vec"))
