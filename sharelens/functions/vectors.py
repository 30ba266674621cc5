"""Expressions on ``array<double>`` vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(vec), F.lit(0.0), lambda acc, x: acc + x * x))


def unit(vec: Column | str) -> Column:
    """L2-normalised vector; NULL for a zero vector."""
    vec = _col(vec)
    # array_repeat holds the norm once per row; inside a lambda it would be
    # recomputed for every position.
    length = F.array_repeat(F.nullif(norm(vec), F.lit(0.0)), F.size(vec))
    scaled = F.zip_with(vec, length, lambda x, n: x / n)
    return F.when(norm(vec) > 0, scaled)


def difference(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x - y)


def vector_columns(vec: Column | str, width: int, fmt: str = "_{}") -> list[Column]:
    """Wide form: one column per position."""
    vec = _col(vec)
    return [F.get(vec, F.lit(i)).alias(fmt.format(i)) for i in range(width)]


def product_with(matrix: np.ndarray):
    """Arrow UDF ``vec -> [vec . row for row in matrix]`` for a small right side."""
    right = np.ascontiguousarray(np.asarray(matrix, dtype=float).T)
    count = right.shape[1]

    @F.arrow_udf("array<double>")
    def product(vec: pa.Array) -> pa.Array:
        present = np.asarray(vec.is_valid())
        flat = vec.flatten().to_numpy(zero_copy_only=False)
        values = flat.reshape(int(present.sum()), right.shape[0]) @ right
        offsets = np.concatenate([[0], np.cumsum(present * count)]).astype(np.int32)
        return pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(values.ravel()), mask=pa.array(~present)
        )

    return product


def vector_sums(
    df: DataFrame,
    keys: list[str],
    width: int,
    vec: str = "vec",
    weight: Column | None = None,
    others: list[Column] | None = None,
) -> DataFrame:
    """Weighted per-position sums by key.

    One ``sum`` per position keeps the buffer a flat row: map-side partial sums,
    one vector per key and task in the shuffle, and no (key, position) explosion.
    """
    source, factor = df, ""
    if weight is not None:
        source, factor = df.withColumn("__weight", weight), " * __weight"
    sums = [F.expr(f"sum(get(`{vec}`, {i}){factor}) AS __{i}") for i in range(width)]
    grouped = source.groupBy(*keys).agg(*sums, *(others or []))
    kept = [c for c in grouped.columns if not c.startswith("__")]
    positions = ", ".join(f"__{i}" for i in range(width))
    return grouped.select(*kept, F.expr(f"array({positions})").alias(vec))
