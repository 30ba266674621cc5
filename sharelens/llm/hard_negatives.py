"""Hard negatives found by rotated one-bit codes with exact integer scores for what the codes cannot decide.

Every vector is rotated and kept as a few one-bit codes: the signs of the rotated vector, of what they leave, and so on, each under
a rotation of its own. Stored with a code are its alignment (the product of vector and unit code) and at the end the length of the residual.
An anchor is rotated likewise and quantised to bit planes, so its product with a code is a sum of popcounts. The products of all codes,
weighted by alignments, estimate the score; by Cauchy-Schwarz the score is off by at most the residual's length times the anchor's
(plus the quantisation's bound). Only vectors whose interval can still reach the result are scored, in integers.

Anchors go in blocks of bounded size against all vectors; a task hands on its own best rows per anchor (or per positive), which
are ranked once more. Nothing is sampled or capped; the intervals only decide what is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharelens.operators.positions import with_position
from sharelens.session import collect_bounded, scratch_path, settle

#: Largest size of a scaled component: scores of 64 of them stay below 2^62.
MOST = 1 << 28
LEVELS, PLANES, SEED = 4, 8, 42
#: Anchors of one pass, and of one strip of a task's work.
BLOCK, STRIP = 4096, 128
VECTOR = "vec_id bigint, label int, vec binary, codes binary, aligned binary, rest double"


# ---------------------------------------------------------------- codes


def rotations(width: int, levels: int = LEVELS, seed: int = SEED) -> np.ndarray:
    """One random orthogonal matrix per level; the same for the same width everywhere."""
    rng = np.random.default_rng([seed, width])
    return np.stack([np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(levels)])


def packed_signs(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as uint64 words."""
    packed = np.packbits(signs, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view("<u8")


def encode(x: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (n, levels, words), alignments (n, levels) and residual lengths (n) of the rows of ``x``."""
    width = max(1, x.shape[1])
    rest, codes, aligned = x.astype(float), [], []
    for turn in turns:
        rotated = rest @ turn
        signs = rotated >= 0
        along = np.abs(rotated).sum(axis=1) / np.sqrt(width)  # the product with the unit code
        rest = (rotated - np.where(signs, 1.0, -1.0) * (along / np.sqrt(width))[:, None]) @ turn.T
        codes.append(packed_signs(signs))
        aligned.append(along)
    return np.stack(codes, axis=1), np.stack(aligned, axis=1), np.linalg.norm(rest, axis=1)


class Anchors:
    """A block of anchors: integer vectors, and per level the rotated anchor quantised to bit planes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, turns: np.ndarray):
        self.ids, self.labels, self.x, self.turns = ids, labels, x, turns
        self.lengths = np.linalg.norm(x.astype(float), axis=1)
        self.levels = []
        for turn in turns:
            rotated = x.astype(float) @ turn
            low = rotated.min(axis=1, initial=0.0)
            step = np.maximum((rotated.max(axis=1, initial=0.0) - low) / ((1 << PLANES) - 1), 1e-30)
            units = np.rint((rotated - low[:, None]) / step[:, None]).astype(np.int64)
            lost = np.abs(rotated - low[:, None] - units * step[:, None]).sum(axis=1)
            planes = np.stack([packed_signs((units >> p & 1).astype(bool)) for p in range(PLANES)], axis=1)
            self.levels.append((low, step, planes, units.sum(axis=1), lost))

    def products(self, level: int, rows: slice, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of anchors with the unit codes of one level, and how far off they can be.

        With units u and signs s = 2 b - 1 the product of low + step u with s is
        low (2 |b| - width) + step (2 <u, b> - sum u), and <u, b> is a sum of popcounts over the planes of u.
        """
        low, step, planes, total, lost = (v[rows] for v in self.levels[level])
        width = max(1, self.x.shape[1])
        inner = np.zeros((len(low), len(codes)), np.int32)
        for p in range(PLANES):
            for word in range(codes.shape[1]):
                inner += np.bitwise_count(planes[:, p, word, None] & codes[None, :, word]).astype(np.int32) << p
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        value = low[:, None] * (2 * ones - width)[None, :] + step[:, None] * (2 * inner - total[:, None])
        return value / np.sqrt(width), lost / np.sqrt(width)

    def intervals(self, rows: slice, codes: np.ndarray, aligned: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible score of each anchor of ``rows`` with each vector."""
        n = len(self.ids[rows])
        about, off = np.zeros((n, len(rest))), self.lengths[rows][:, None] * rest[None, :]
        for level in range(len(self.turns)):
            value, lost = self.products(level, rows, codes[:, level])
            about += value * aligned[None, :, level]
            off += lost[:, None] * aligned[None, :, level]
        off = off * (1 + 1e-9) + 1e-6 + 1e-9 * np.abs(about)  # rounding
        return about - off, about + off


def scores(q: np.ndarray, x: np.ndarray, rows: np.ndarray, columns: np.ndarray, piece: int = 1 << 16) -> np.ndarray:
    """Integer products of the paired rows."""
    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), piece):
        part = slice(at, at + piece)
        out[part] = np.einsum("ij,ij->i", q[rows[part]], x[columns[part]])
    return out


def kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity where a row has fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each group by falling score and rising id."""
    order = np.lexsort((ids, -score, group))
    sorted_groups = group[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_groups[1:] != sorted_groups[:-1]))) if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < k]


# ---------------------------------------------------------------- Spark


def relabelled(label: Column, vec_id: Column) -> Column:
    """Where the id is divisible by 7, the next of ten labels."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def usable(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, vec (array of bigint): the rows that take part, components scaled and floored."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= MOST / scale)
    numbers = F.col("embedding").cast("array<double>")
    rows = embeddings.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall(numbers, fits))
    return rows.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"), F.transform(numbers, lambda x: F.floor(x * scale)).alias("vec")
    )


def matrix(column: pa.Array, width: int, kind: str = "<i4") -> np.ndarray:
    """Binary vectors as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1) if width else np.zeros((len(column), 0), kind)


def coded(rows: DataFrame, width: int, levels: int = LEVELS) -> DataFrame:
    """The rows with their codes, alignments and residual lengths; shorter vectors are filled up with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = rotations(width, levels)
        for batch in batches:
            vec = batch.column("vec")
            lengths = np.diff(vec.offsets.to_numpy())
            x = np.zeros((batch.num_rows, width), np.int64)
            x[np.arange(width)[None, :] < lengths[:, None]] = vec.flatten().to_numpy(zero_copy_only=False)
            codes, aligned, rest = encode(x, turns)
            as_rows = lambda m, kind: pa.array([r.tobytes() for r in np.ascontiguousarray(m.reshape(len(m), -1)).astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), as_rows(x, "<i4"), as_rows(codes, "<u8"), as_rows(aligned, "<f8"), pa.array(rest)],
                ["vec_id", "label", "vec", "codes", "aligned", "rest"],
            )

    return rows.mapInArrow(run, VECTOR)


def opened(batch: pa.RecordBatch, width: int, levels: int):
    """ids, labels, integer vectors, codes, alignments and residual lengths of a batch."""
    n = batch.num_rows
    codes = matrix(batch.column("codes"), width, "<u8").reshape(n, levels, -1)
    aligned = matrix(batch.column("aligned"), 1, "<f8").reshape(n, levels)
    vectors = matrix(batch.column("vec"), width).astype(np.int64)
    return batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), vectors, codes, aligned, batch.column("rest").to_numpy()


def best_positives(vectors: DataFrame, anchors: Anchors, k: int, levels: int) -> DataFrame:
    """anchor (its number in the block), id, score: each task's first k other rows of the anchor's label."""
    width = anchors.x.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, x, codes, aligned, rest = opened(batch, width, levels)
            parts = []
            # an anchor only meets its own label, so the strips go label by label
            for label in np.unique(labels):
                own, asked = np.flatnonzero(labels == label), np.flatnonzero(anchors.labels == label)
                for at in range(0, len(asked), STRIP):
                    rows = asked[at : at + STRIP]
                    low, high = anchors.intervals(rows, codes[own], aligned[own], rest[own])
                    other = anchors.ids[rows][:, None] != ids[own][None, :]
                    least = kth_largest(np.where(other, low, -np.inf), k)
                    r, c = np.nonzero(other & (high >= least[:, None]))
                    value = scores(anchors.x, x, rows[r], own[c])
                    take = first_of_each(r, value, ids[own[c]], k)
                    parts.append((rows[r[take]], ids[own[c[take]]], value[take]))
            for numbers, found, value in parts:
                yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), pa.array(found), pa.array(value)], ["anchor", "id", "score"])

    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    found = vectors.mapInArrow(run, "anchor int, id bigint, score bigint")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def best_negatives(
    vectors: DataFrame, anchors: Anchors, number: np.ndarray, positive_id: np.ndarray, positive: np.ndarray, k: int, levels: int
) -> DataFrame:
    """The contract's rows of a block: each pair's first k rows of another label inside its window of scores.

    ``number``, ``positive_id`` and ``positive`` are the anchor's number, the positive and its score of each pair, ordered by anchor.
    """
    width = anchors.x.shape[1]
    edges = np.searchsorted(number, np.arange(len(anchors.ids) + 1))
    # 30 p <= 100 n <= 90 p as bounds of n, rounded inwards
    least, most = -(-30 * positive // 100), 90 * positive // 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, x, codes, aligned, rest = opened(batch, width, levels)
            for at in range(0, len(anchors.ids), STRIP):
                rows = slice(at, min(at + STRIP, len(anchors.ids)))
                pairs = np.arange(edges[rows.start], edges[rows.stop])
                pairs = pairs[least[pairs] <= most[pairs]]
                if not len(pairs):
                    continue
                low, high = anchors.intervals(rows, codes, aligned, rest)
                apart = anchors.labels[rows][:, None] != labels[None, :]
                low, high = np.where(apart, low, -np.inf), np.where(apart, high, -np.inf)
                wanted = np.zeros_like(apart)
                masks = []
                for pair in pairs.tolist():
                    r = number[pair] - at
                    inside = (low[r] >= least[pair]) & (high[r] <= most[pair])
                    sure = low[r][inside]
                    floor = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else -np.inf
                    maybe = (high[r] >= max(least[pair], floor)) & (low[r] <= most[pair]) & apart[r]
                    wanted[r] |= maybe
                    masks.append((pair, r, maybe))
                r, c = np.nonzero(wanted)
                exact = np.zeros(wanted.shape, np.int64)
                exact[r, c] = scores(anchors.x, x, r + at, c)
                group, column = [], []
                for pair, r, maybe in masks:
                    c = np.flatnonzero(maybe)
                    c = c[(exact[r, c] >= least[pair]) & (exact[r, c] <= most[pair])]
                    group.append(np.full(len(c), pair))
                    column.append(c)
                group, column = np.concatenate(group), np.concatenate(column)
                value = exact[number[group] - at, column]
                take = first_of_each(group, value, ids[column], k)
                of = group[take]
                columns = [of.astype(np.int32), anchors.ids[number[of]], positive_id[of], positive[of], ids[column[take]], value[take]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pair", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    order = Window.partitionBy("pair").orderBy(F.desc("negative_score"), "negative_id")
    found = vectors.mapInArrow(
        run, "pair int, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    )
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, levels: int = LEVELS, block: int = BLOCK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over rows (vec_id, label, vec of integers).

    An anchor's positives are its first other rows of the same label by falling score and rising vec_id; a pair's negatives the first rows of
    another label whose score is between 30 and 90 per cent of the positive's. Rows that repeat a vec_id are rows of their own, but no
    anchor is its own positive; anchors that are equal in all three columns are one. Vectors may differ in length (missing components
    are 0) or have none. Anchors without positives, and pairs without negatives, give no row; so does an empty table.
    """
    spark = rows.sparkSession
    width = rows.agg(F.coalesce(F.max(F.size("vec")), F.lit(0))).first()[0]
    vectors = settle(coded(rows, width, levels))
    # the order is total: equal rows are one
    anchors = with_position(vectors.where(is_anchor).select("vec_id", "label", "vec").distinct(), ["vec_id", "label", "vec"])
    blocks = anchors.agg(F.max(F.floor(F.col("position") / block))).first()[0]
    path = scratch_path(spark, "negatives")
    turns = rotations(width, levels)
    for number in range(0 if blocks is None else blocks + 1):
        own = anchors.where(F.col("position").between(number * block, (number + 1) * block - 1))
        chosen = collect_bounded(own.orderBy("position"), block, "anchors of a block")
        x = matrix(pa.array([bytes(r["vec"]) for r in chosen], pa.binary()), width).astype(np.int64)
        asked = Anchors(np.array([r["vec_id"] for r in chosen], np.int64), np.array([r["label"] for r in chosen], np.int64), x, turns)
        pairs = collect_bounded(best_positives(vectors, asked, positives, levels).orderBy("anchor", "place"), positives * block, "positives of a block")
        columns = [np.array([r[c] for r in pairs], np.int64) for c in ("anchor", "id", "score")]
        best_negatives(vectors, asked, *columns, negatives, levels).write.mode("append").parquet(path)
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return spark.createDataFrame([], schema) if blocks is None else spark.read.schema(schema).parquet(path)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 100.

    Rows with a null id, label or vector, a null or non-finite component, or one beyond 2^20 in size (its scores need not fit a long)
    take no part. Where vec_id is divisible by 7 the label is moved on by one of ten. Other columns are ignored. See :func:`mine`.
    """
    rows = usable(embeddings).withColumn("label", relabelled(F.col("label"), F.col("vec_id")))
    return mine(rows, F.col("vec_id") % 100 == 0)


def negatives_sql() -> str:
    """The query's rows in DuckDB's SQL."""
    return """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM (SELECT * FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda t: t[1] * t[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INT) AS rank,
  s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT * FROM n WHERE rank <= 10"""
