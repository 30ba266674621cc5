"""Host vectors, scores and similarities."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharelens.functions import vectors as V
from sharelens.session import collect_bounded

MAX_DIMENSIONS = 10_000
#: Community vectors in one broadcast (75 MB at a width of 64), and broadcasts that an executor holds at a time.
SLICE_ROWS, MAX_SLICES = 1 << 17, 16


def vector_width(vectors: DataFrame, vec: str = "vec") -> int:
    row = vectors.where(F.col(vec).isNotNull()).select(F.size(vec)).first()
    if row is None:
        raise ValueError("no vectors")
    return row[0]


def normalise(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    return vectors.withColumn(vec, V.unit(vec))


def host_vectors(counts: DataFrame, community_vectors: DataFrame, width: int | None = None) -> DataFrame:
    """Unit count-weighted mean of community vectors per host: ``host, vec``.

    Communities without a vector drop out of the inner join. The mean's divisor
    cancels in the normalisation, so sums are enough. The counts, a few bytes a row, are
    dealt by host first, and the vectors come to them in broadcasts of ``SLICE_ROWS``: what is
    summed is never shuffled, and a task sums the hosts of its partition only. More vectors
    than ``MAX_SLICES`` broadcasts hold are joined by shuffle.
    """
    width = width or vector_width(community_vectors)
    vectors = community_vectors.select(F.col("id").alias("subreddit"), "vec")
    slices = max(1, math.ceil(vectors.count() / SLICE_ROWS))
    if slices > MAX_SLICES:
        joined = counts.join(vectors, "subreddit")
    else:
        joined = _with_vectors(counts.repartition("host"), vectors, slices)
    return normalise(V.vector_sums(joined, ["host"], width, weight=F.col("count")))


def _with_vectors(counts: DataFrame, vectors: DataFrame, slices: int) -> DataFrame:
    """The inner join on ``subreddit`` with every slice of the vectors broadcast; a community is in one slice only."""
    if slices == 1:
        return counts.join(F.broadcast(vectors), "subreddit")
    number = F.pmod(F.xxhash64("subreddit"), F.lit(slices))
    joined = counts
    for i in range(slices):
        part = vectors.where(number == i).select(F.col("subreddit").alias("_s"), F.col("vec").alias(f"_v{i}"), F.lit(True).alias(f"_in{i}"))
        joined = joined.join(F.broadcast(part), F.col("subreddit") == F.col("_s"), "left").drop("_s")
    found = joined.where(F.coalesce(*[f"_in{i}" for i in range(slices)]))
    return found.select("subreddit", *[c for c in counts.columns if c != "subreddit"], F.coalesce(*[f"_v{i}" for i in range(slices)]).alias("vec"))


def mean_vectors(vectors: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """Mean vector and size per key."""
    width = width or vector_width(vectors)
    sums = V.vector_sums(vectors, [key], width, others=[F.count(F.lit(1)).alias("size")])
    return sums.withColumn(
        "vec",
        F.zip_with("vec", F.array_repeat(F.col("size"), F.size("vec")), lambda x, n: x / n),
    )


def _dimension_matrix(dims: DataFrame, normalised: bool) -> tuple[list[str], np.ndarray]:
    rows = collect_bounded(dims.select("name", "vec").orderBy("name"), MAX_DIMENSIONS, "dimensions")
    matrix = np.array([r["vec"] for r in rows], dtype=float)
    if normalised:
        matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    return [r["name"] for r in rows], matrix


def score(vectors: DataFrame, dims: DataFrame, normalised: bool = True) -> DataFrame:
    """Long scores ``id, dim, score``: dot product with each (unit) dimension.

    Dimensions are few and go to the tasks as one matrix; vectors stream past it
    in Arrow batches and never shuffle.
    """
    names, matrix = _dimension_matrix(dims, normalised)
    products = vectors.where(F.col("vec").isNotNull()).select(
        "id", V.product_with(matrix)("vec").alias("scores")
    )
    pairs = F.arrays_zip(
        F.array(*[F.lit(n) for n in names]).alias("dim"), F.col("scores").alias("score")
    )
    return products.select("id", F.inline(pairs).alias("dim", "score"))


def score_wide(vectors: DataFrame, dims: DataFrame, normalised: bool = True) -> DataFrame:
    """One column per dimension, keyed by ``id``."""
    names, matrix = _dimension_matrix(dims, normalised)
    products = vectors.select("id", V.product_with(matrix)("vec").alias("scores"))
    return products.select(
        "id", *[F.get("scores", F.lit(i)).alias(n) for i, n in enumerate(names)]
    )


def widen_scores(scores: DataFrame, names: list[str]) -> DataFrame:
    return scores.groupBy("id").pivot("dim", names).agg(F.max("score"))


def cosine_to_one(vectors: DataFrame, vector: list[float]) -> DataFrame:
    """``id, cosine`` of every vector against one."""
    target = np.asarray(vector, dtype=float)
    target = target / np.linalg.norm(target)
    return vectors.select(
        "id", F.get(V.product_with(target[None, :])(V.unit("vec")), F.lit(0)).alias("cosine")
    )


def random_vector(width: int, seed: int) -> list[float]:
    """A random unit direction (normal components, normalised)."""
    vec = np.random.default_rng(seed).normal(size=width)
    return (vec / np.linalg.norm(vec)).tolist()


def random_dimension(spark, name: str, width: int, seed: int) -> DataFrame:
    return spark.createDataFrame([(name, random_vector(width, seed))], "name string, vec array<double>")


def pool_tokens(
    token_vectors: DataFrame,
    layers: list[int],
    width: int | None = None,
    targets: DataFrame | None = None,
) -> DataFrame:
    """Text vectors: layers summed per token, averaged over tokens, normalised.

    ``token_vectors`` is ``doc, layer, token, vec``. With ``targets`` of
    ``doc, token`` only those tokens count (the one-word form).
    """
    width = width or vector_width(token_vectors)
    rows = token_vectors.where(F.col("layer").isin(layers))
    if targets is not None:
        rows = rows.join(targets.select("doc", "token"), ["doc", "token"], "left_semi")
    # every token has each layer once, so one layer counts the tokens
    one_layer = F.count_if(F.col("layer") == layers[0]).alias("tokens")
    pooled = V.vector_sums(rows, ["doc"], width, others=[one_layer])
    return pooled.select(
        "doc",
        "tokens",
        F.zip_with("vec", F.array_repeat(F.col("tokens"), F.size("vec")), lambda x, n: x / n).alias(
            "mean_vec"
        ),
    ).select("doc", "tokens", "mean_vec", V.unit("mean_vec").alias("vec"))


def word_position(text: str, word: str):
    """0-based position of a word among the space-separated words of a text column."""
    return F.array_position(F.split(F.col(text), " "), word) - 1
