"""Exact nearest neighbours by cosine, block against block."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sharelens.functions.vectors import difference, unit
from sharelens.session import collect_bounded, hint_small, settle

_DIGITS = 12  # similarities equal to this precision are ties, broken by id
#: Bounds of what every task gets of a metric index: pivots, and a few numbers a block.
MAX_PIVOTS, MAX_BLOCKS = 4096, 1_000_000
_CELLS = 1 << 20  # products held at a time inside a task
_HELD = 1 << 17  # rows that a task of the pruned search holds: 64 MB at a width of 64


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("vec").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


def _best_columns(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k largest per row, ties to the left."""
    k = min(k, sims.shape[1])
    low = -sims
    low.partition(k - 1, axis=1)
    kth = -low[:, k - 1 : k]
    del low
    above = sims > kth
    level = sims == kth
    room = k - above.sum(axis=1, keepdims=True)
    keep = (above | (level & (level.cumsum(axis=1, dtype=np.int32) <= room))) & (sims > -np.inf)
    return np.nonzero(keep)


def _against(ids, left, other_ids, right, k, same):
    strip = max(1, _CELLS // max(1, len(right)))
    for start in range(0, len(left), strip):
        sims = left[start : start + strip] @ right.T
        np.round(sims, _DIGITS, out=sims)
        if same:
            rows = np.arange(len(sims))
            sims[rows, rows + start] = -np.inf
        r, c = _best_columns(sims, k)
        yield ids.take(pa.array(r + start)), other_ids.take(pa.array(c)), pa.array(sims[r, c])


def nearest_neighbours(
    vectors: DataFrame, k: int = 10, block_rows: int = 8192, count: int | None = None
) -> DataFrame:
    """``c1, c2, similarity, rank``: the k best others of every id, self excluded.

    Ids hash into blocks of about ``block_rows``. Each unordered block pair is
    one task that serves both of its blocks, so n^2/2 products run as dense
    matrix strips, and a task hands on only its k best per id. Memory per task
    depends on the block size, not on n; larger blocks mean fewer copies of the
    vectors and fewer candidates in the final ranking. Exactness costs n^2/2
    products, and each vector is copied once per block; small tables still get
    enough blocks to keep all cores busy.
    """
    count = vectors.count() if count is None else count
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    # enough pairs of blocks for all cores, but no block so small that its task is all overhead
    spread = min(math.ceil(math.sqrt(2 * parallel)), math.ceil(count / 256))
    blocks = max(1, spread, math.ceil(count / block_rows))
    tagged = (
        vectors.where(F.col("vec").isNotNull())
        .select("id", unit("vec").alias("vec"))
        .where(F.col("vec").isNotNull())
        .withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    )
    cells = tagged.withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    ).select(
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "block",
        "id",
        "vec",
    )

    schema = pa.schema([("c1", pa.string()), ("c2", pa.string()), ("similarity", pa.float64())])

    def cell(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        of_low = np.asarray(table["block"]) == low
        a = table.filter(pa.array(of_low))
        a_ids, a_vecs = a["id"].combine_chunks(), _matrix(a)
        parts = []
        if low == high:
            parts.extend(_against(a_ids, a_vecs, a_ids, a_vecs, k, True))
        elif of_low.any() and not of_low.all():
            b = table.filter(pa.array(~of_low))
            b_ids, b_vecs = b["id"].combine_chunks(), _matrix(b)
            parts.extend(_against(a_ids, a_vecs, b_ids, b_vecs, k, False))
            parts.extend(_against(b_ids, b_vecs, a_ids, a_vecs, k, False))
        batches = [pa.record_batch(list(p), schema=schema) for p in parts]
        return pa.Table.from_batches(batches, schema=schema)

    found = cells.groupBy("low", "high").applyInArrow(
        cell, "c1 string, c2 string, similarity double"
    )
    best = Window.partitionBy("c1").orderBy(F.desc("similarity"), "c2")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class Balls:
    """Unit vectors dealt into balls, as blocks for :func:`pruned_neighbours`.

    Pivots are the vectors with the smallest hashes, a bounded number that every task gets; a vector belongs to its nearest pivot. Balls with
    more than ``block_rows`` rows are cut into several blocks. ``packed`` has one row a block (block, ids, flat, reach), ``own`` the k best of
    every id inside its block, ``rows`` a row a vector (block, id, reach, vec), and ``asks`` the pairs (block, other) of blocks that may hold a better one: by the triangle
    inequality two vectors are at least the angle of their pivots less both radii apart, and ``reach`` is the angle of an id's k-th best.
    """

    def __init__(self, vectors: DataFrame, k: int, block_rows: int, pivots: int | None = None):
        units = settle(vectors.select("id", unit("vec").alias("vec")).where(F.col("vec").isNotNull()))
        n = units.count()
        pivots = min(MAX_PIVOTS, pivots or max(1, math.ceil(2 * n / block_rows)))
        middle = np.array([r["vec"] for r in units.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()], dtype=float)

        def assign(batches):
            for batch in batches:
                if batch.num_rows:
                    near = _matrix(pa.Table.from_batches([batch])) @ middle.T
                    best = near.argmax(axis=1)
                    angle = np.arccos(np.clip(near[np.arange(len(best)), best], -1, 1))
                    yield pa.record_batch([*batch.columns, pa.array(best.astype(np.int32)), pa.array(angle)], ["id", "vec", "pivot", "angle"])

        assigned = settle(units.mapInArrow(assign, "id string, vec array<double>, pivot int, angle double"))
        parts = assigned.groupBy(F.col("pivot").alias("_p")).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("parts"))
        salted = assigned.join(F.broadcast(parts), F.col("pivot") == F.col("_p"))  # one row a pivot
        block = (F.col("pivot") * F.lit(1 << 32) + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block")
        grouped = salted.groupBy(block).agg(F.max("angle").alias("radius"), F.sort_array(F.collect_list(F.struct("id", "vec"))).alias("rows"))
        grouped = grouped.select("block", "radius", F.transform("rows", lambda r: r["id"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["vec"])).alias("flat"))

        def inside(batches):
            for batch in batches:
                for block, radius, ids, flat in zip(*batch.columns, strict=True):
                    names, x = ids.values, flat.values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                    found = list(_against(names, x, names, x, k, True)) if len(names) > 1 else []
                    c1, c2, value = (pa.concat_arrays([f[i] for f in found]) if found else names[:0] for i in range(3))
                    reach = np.full(len(names), np.pi)
                    if len(names) > k:
                        sims = value.to_numpy(zero_copy_only=False).reshape(len(names), k)
                        reach = np.arccos(np.clip(sims.min(axis=1), -1, 1))
                    columns = [pa.array([v], t) for v, t in ((block.as_py(), pa.int64()), (radius.as_py(), pa.float64()))]
                    lists = [names, flat.values, pa.array(reach), c1, c2, value.cast(pa.float64()) if found else pa.array([], pa.float64())]
                    columns += [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "radius", "ids", "flat", "reach", "c1", "c2", "similarity"])

        schema = "block bigint, radius double, ids array<string>, flat array<double>, reach array<double>, c1 array<string>, c2 array<string>, similarity array<double>"
        self.packed = settle(grouped.mapInArrow(inside, schema))
        one = F.explode(F.arrays_zip("c1", "c2", "similarity")).alias("x")
        self.own = self.packed.select(one).select("x.c1", "x.c2", "x.similarity")
        width = F.lit(middle.shape[1] if len(middle) else 1)
        each = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.slice("flat", i * width + 1, width))
        row = F.explode(F.arrays_zip(F.col("ids").alias("id"), "reach", each.alias("vec"))).alias("x")
        self.rows = self.packed.select("block", row).select("block", "x.id", "x.reach", "x.vec")
        short = self.packed.select("block", "radius", F.array_max("reach").alias("reach"), F.size("ids").alias("n"))
        found = collect_bounded(short.orderBy("block"), MAX_BLOCKS, "blocks")
        blocks, radius, reach, sizes = (np.array([r[c] for r in found]) for c in ("block", "radius", "reach", "n"))
        self.blocks, self.numbers, self.sizes, self.radius, self.middle = len(blocks), blocks, sizes, radius, middle

        def partners(batches):
            for batch in batches:
                for block in batch.column("block").to_pylist():
                    i = int(np.searchsorted(blocks, block))
                    apart = np.arccos(np.clip(middle[blocks >> 32] @ middle[block >> 32], -1, 1)) - radius - radius[i]
                    near = np.flatnonzero((apart <= reach[i] + 1e-6) & (blocks != block))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(near), block)), pa.array(blocks[near]), pa.array(apart[near])], ["block", "other", "apart"]
                    )

        self.asks = self.packed.select("block").mapInArrow(partners, "block bigint, other bigint, apart double")


def _offer(best: list, ids: np.ndarray, y: np.ndarray, k: int, apart: float) -> None:
    """Lets the rows ``best`` (their x, k-th similarity, similarities, ids) keep what is better of ``ids``, which are in order; ties go to the smaller id."""
    x, least, kept, names = best
    wanted = np.flatnonzero(np.arccos(np.clip(least, -1, 1)) + 1e-6 >= apart)
    strip = max(1, _CELLS // max(1, len(ids)))
    for start in range(0, len(wanted), strip):
        rows = wanted[start : start + strip]
        sims = x[rows] @ y.T
        r, c = np.nonzero(sims >= least[rows, None] - 1e-11)
        v = np.round(sims[r, c], _DIGITS)
        order = np.lexsort((c, -v, r))
        r, c, v = r[order], c[order], v[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        r, c, v, place = (a[place < k] for a in (r, c, v, place))
        touched, at = np.unique(r, return_inverse=True)
        if not len(touched):
            continue
        new, new_names = np.full((len(touched), k), -np.inf), np.full((len(touched), k), None, object)
        new[at, place], new_names[at, place] = v, ids[c]
        at = rows[touched]
        both, both_names = np.hstack([kept[at], new]), np.hstack([names[at], new_names])
        order = np.argsort(-both, axis=1, kind="stable")
        both, both_names = np.take_along_axis(both, order, 1), np.take_along_axis(both_names, order, 1)
        for i in np.flatnonzero(((both[:, 1:] == both[:, :-1]) & (both[:, 1:] > -np.inf)).any(axis=1)):
            real = int((both[i] > -np.inf).sum())
            pairs = zip(both[i, :real], both_names[i, :real], strict=True)
            both_names[i, :real] = [p[1] for p in sorted(pairs, key=lambda p: (-p[0], p[1] is not None, p[1] or ""))]
        kept[at], names[at] = both[:, :k], both_names[:, :k]
        least[at] = np.maximum(least[at], both[:, k - 1])


def pruned_neighbours(vectors: DataFrame, k: int = 10, block_rows: int = 4096, pivots: int | None = None, held_rows: int = _HELD) -> DataFrame:
    """The rows of :func:`nearest_neighbours`, without the block pairs that cannot hold a better neighbour.

    Exact: a pair of blocks is left out only where the triangle inequality on angles rules it out, and within a pair only ids whose k-th best
    is farther than the blocks are apart are multiplied. What is saved depends on how clustered the vectors are; without clusters
    every pair is looked at from both sides, and ``nearest_neighbours`` does half the work.

    Blocks are dealt into groups, two for each core or as many as ``held_rows`` rows a group need. A task holds the rows of its group and the
    k best of each, and the blocks that any of them asks for pass by in order, so a vector is shuffled once a group and not once a pair
    of blocks, and an id hands on k rows in all.
    """
    balls = Balls(vectors, k, block_rows, pivots)
    spark = vectors.sparkSession
    n = max(1, int(balls.sizes.sum()))
    groups = max(1, min(balls.blocks, max(2 * spark.sparkContext.defaultParallelism, math.ceil(n / held_rows))))
    before = np.cumsum(balls.sizes) - balls.sizes
    of = [(int(b), int(p) * groups // n) for b, p in zip(balls.numbers, before, strict=True)]
    dealt = hint_small(settle(spark.createDataFrame(of, "block bigint, grp int")), MAX_BLOCKS)
    asked = balls.asks.join(dealt, "block").select(F.col("other").alias("block"), "grp").distinct()
    left = balls.rows.join(dealt, "block").select("grp", F.lit(0).alias("kind"), "block", "id", "reach", "vec")
    right = balls.rows.join(hint_small(settle(asked), MAX_BLOCKS), "block").select("grp", F.lit(1).alias("kind"), "block", "id", F.lit(0.0).alias("reach"), "vec")
    # more partitions than groups, so that few of them meet in one
    stream = left.union(right).repartition(8 * groups, "grp").sortWithinPartitions("grp", "kind", "block", "id")
    numbers, radius, middle = balls.numbers, balls.radius, balls.middle
    schema = pa.schema([("c1", pa.string()), ("c2", pa.string()), ("similarity", pa.float64())])

    def result(held):
        for _, ids, (_, _, kept, names) in held:
            r, c = np.nonzero(kept > -np.inf)
            yield pa.record_batch([pa.array(ids[r], pa.string()), pa.array(names[r, c], pa.string()), pa.array(kept[r, c])], schema=schema)

    def meet(batches):
        group, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("grp", "kind", "block")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(edges, edges[1:], strict=False):
                part = batch.slice(start, stop - start)
                number, kind, block = keys[:, start].tolist()
                if number != group:
                    yield from result(held)
                    group, held = number, []
                ids, x = part.column("id").to_numpy(zero_copy_only=False), _matrix(pa.Table.from_batches([part]))
                if kind == 0:
                    least = np.cos(part.column("reach").to_numpy()) - 1e-9
                    held.append((block, ids, [x, least, np.full((len(ids), k), -np.inf), np.full((len(ids), k), None, object)]))
                    continue
                j = int(np.searchsorted(numbers, block))
                for own, _, best in held:
                    if own != block:
                        angle = np.arccos(np.clip(middle[own >> 32] @ middle[block >> 32], -1, 1))
                        _offer(best, ids, x, k, angle - radius[int(np.searchsorted(numbers, own))] - radius[j])
        yield from result(held)

    met = stream.mapInArrow(meet, "c1 string, c2 string, similarity double")
    best = Window.partitionBy("c1").orderBy(F.desc("similarity"), "c2")
    return balls.own.union(met).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def directions(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Edge vectors ``c1, c2, dvec`` with ``dvec = vec(c2) - vec(c1)``."""
    ends = vectors.select("id", "vec")
    left = ends.select(F.col("id").alias("c1"), F.col("vec").alias("__v1"))
    right = ends.select(F.col("id").alias("c2"), F.col("vec").alias("__v2"))
    joined = pairs.select("c1", "c2").join(left, "c1").join(right, "c2")
    return joined.select("c1", "c2", difference("__v2", "__v1").alias("dvec"))
