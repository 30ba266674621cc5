"""Host vectors, scores, neighbours and dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sharelens.functions.vectors import vector_columns
from sharelens.operators import dimensions as dims
from sharelens.operators import links, neighbours
from sharelens.operators import vectors as ops
from sharelens.plans.registry import query
from sharelens.plans.views import SEEDS, TOP_HOSTS, WIDTH, Views, long_vector, rounded


def host_vectors_of(v: Views, top: int | None = TOP_HOSTS):
    """Vectors of the most posted hosts, or of all."""
    counts = v.host_counts()
    if top is not None:
        counts = links.counts_of_top_hosts(counts, top)
    return ops.host_vectors(counts, v.vectors().select("id", "vec"), WIDTH)


@query(
    "host_vectors",
    """
    SELECT host, pos, round(v, 6) + 0.0 AS value FROM (
        SELECT host, unnest(vec) AS v, unnest(range(len(vec))) AS pos FROM host_vectors_v)""",
)
def host_vectors(v: Views):
    return long_vector(host_vectors_of(v), "host")


@query(
    "normalised_vectors",
    """
    SELECT id, unnest(range(len(vec))) AS pos,
           unnest(list_transform(vec, lambda x: round(x / sqrt(list_inner_product(vec, vec)), 6) + 0.0)) AS value
    FROM vectors_v""",
)
def normalised_vectors(v: Views):
    return long_vector(ops.normalise(v.vectors()), "id")


@query("score_long", "SELECT id, dim, round(score, 6) + 0.0 AS score FROM scores_v")
def score_long(v: Views):
    return rounded(v.scores(), "score")


@query(
    "score_wide",
    """
    SELECT id, max(CASE WHEN dim = 'age' THEN round(score, 6) + 0.0 END) AS age,
           max(CASE WHEN dim = 'gender' THEN round(score, 6) + 0.0 END) AS gender,
           max(CASE WHEN dim = 'partisan' THEN round(score, 6) + 0.0 END) AS partisan,
           max(CASE WHEN dim = 'partisan_neutral' THEN round(score, 6) + 0.0 END) AS partisan_neutral
    FROM scores_v GROUP BY id""",
)
def score_wide(v: Views):
    return rounded(v.scores_wide(), "age", "gender", "partisan", "partisan_neutral")


@query(
    "score_nonorm",
    """
    SELECT v.id, s.name AS dim, round(list_inner_product(v.vec, list_transform(range(1, 65),
           lambda i: b.vec[i] - a.vec[i])), 6) + 0.0 AS score
    FROM vectors_v v CROSS JOIN dimension_seeds_v s JOIN vectors_v a ON a.id = s.l JOIN vectors_v b ON b.id = s.r
    WHERE s.sign < 0""",
)
def score_nonorm(v: Views):
    pairs = [("age", "s1", "s2"), ("gender", "s3", "s4"), ("partisan", "s5", "s6")]
    seeds = v.spark.createDataFrame(pairs, "name string, c1 string, c2 string")
    edges = neighbours.directions(F.broadcast(seeds), v.vectors())
    raw = edges.join(F.broadcast(seeds), ["c1", "c2"]).select("name", F.col("dvec").alias("vec"))
    return rounded(ops.score(v.vectors(), raw, normalised=False), "score")


@query(
    "cosine_to_one",
    """
    SELECT v.id, round(list_inner_product(v.vec, t.vec) / sqrt(list_inner_product(v.vec, v.vec)
           * list_inner_product(t.vec, t.vec)), 6) + 0.0 AS cosine
    FROM vectors_v v, (SELECT vec FROM vectors_v WHERE id = 's1') t""",
)
def cosine_to_one(v: Views):
    target = v.vectors().where("id = 's1'").first()["vec"]
    return rounded(ops.cosine_to_one(v.vectors(), target), "cosine")


@query(
    "vector_columns",
    """
    SELECT id, """
    + ", ".join(f"round(vec[{i + 1}], 6) + 0.0 AS _{i}" for i in range(WIDTH))
    + " FROM vectors_v",
)
def wide_vectors(v: Views):
    wide = v.vectors().select("id", *vector_columns("vec", WIDTH))
    return rounded(wide, *wide.columns[1:])


@query("knn_pairs", "SELECT c1, c2, rank, round(similarity, 6) + 0.0 AS similarity FROM knn_v")
def knn_pairs(v: Views):
    pairs = neighbours.nearest_neighbours(v.vectors(), 10)
    return rounded(pairs.select("c1", "c2", "rank", "similarity"), "similarity")


@query("knn_pruned", "SELECT c1, c2, rank, round(similarity, 6) + 0.0 AS similarity FROM knn_v")
def knn_pruned(v: Views):
    pairs = neighbours.pruned_neighbours(v.vectors(), 10)
    return rounded(pairs.select("c1", "c2", "rank", "similarity"), "similarity")


@query(
    "directions",
    """
    SELECT c1, c2, unnest(range(64)) AS pos,
           unnest(list_transform(range(1, 65), lambda i: round(b.vec[i] - a.vec[i], 6) + 0.0)) AS value
    FROM knn_v k JOIN vectors_v a ON a.id = k.c1 JOIN vectors_v b ON b.id = k.c2""",
)
def directions(v: Views):
    pairs = neighbours.nearest_neighbours(v.vectors(), 10)
    return long_vector(neighbours.directions(pairs, v.vectors()), "c1", "c2", vec="dvec")


_SEED_ROWS = ", ".join(
    f"('{name}', {i}, '{l}', '{r}')" for name, pairs in SEEDS.items() for i, (l, r) in enumerate(pairs)
)
_SEED_SIMILARITY = f"""
    SELECT s.name AS dim, e.c1, e.c2, round(max(list_inner_product(e.d, s.d)), 12) + 0.0 AS similarity FROM
        (SELECT c1, c2, list_transform(range(1, 65), lambda i: b.vec[i] - a.vec[i]) AS d
         FROM knn_v k JOIN vectors_v a ON a.id = k.c1 JOIN vectors_v b ON b.id = k.c2) e
    CROSS JOIN
        (SELECT name, list_transform(range(1, 65), lambda i: b.vec[i] - a.vec[i]) AS d
         FROM (VALUES {_SEED_ROWS}) t(name, i, l, r) JOIN vectors_v a ON a.id = t.l JOIN vectors_v b ON b.id = t.r) s
    GROUP BY 1, 2, 3"""


@query("seed_similarity", f"SELECT dim, c1, c2, round(similarity, 6) + 0.0 AS similarity FROM ({_SEED_SIMILARITY})")
def seed_similarity(v: Views):
    pairs = neighbours.nearest_neighbours(v.vectors(), 10)
    return rounded(dims.seed_similarity(pairs, v.vectors(), SEEDS), "similarity")


# the greedy walk as a recursion: the next pick is the best edge free of picked communities
_ARRAYS = ", ".join(
    "('{}', [{}], {})".format(n, ", ".join(f"'{c}'" for p in pairs for c in p), len(pairs))
    for n, pairs in SEEDS.items()
)
_PICKS = f"""
    edges_v AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY dim ORDER BY similarity DESC, c1, c2) AS r FROM ({_SEED_SIMILARITY})),
    picks_v AS (
        SELECT name AS dim, banned, n, CAST(NULL AS VARCHAR) AS c1, CAST(NULL AS VARCHAR) AS c2
        FROM (VALUES {_ARRAYS}) t(name, banned, n)
        UNION ALL
        SELECT dim, list_concat(banned, [b.c1, b.c2]), n + 1, b.c1, b.c2 FROM (
            SELECT p.dim, any_value(p.banned) AS banned, any_value(p.n) AS n,
                   arg_min({{'c1': e.c1, 'c2': e.c2}}, e.r) AS b
            FROM picks_v p JOIN edges_v e ON e.dim = p.dim AND NOT list_contains(p.banned, e.c1)
                 AND NOT list_contains(p.banned, e.c2) WHERE p.n < 10 GROUP BY p.dim)),
    chosen_v AS (
        SELECT name AS dim, i AS pos, l, r FROM (VALUES {_SEED_ROWS}) t(name, i, l, r)
        UNION ALL SELECT dim, n - 1, c1, c2 FROM picks_v WHERE c1 IS NOT NULL)"""

_MEMBERS_SQL = "SELECT dim, pos, l AS left_comm, r AS right_comm FROM chosen_v"
_DIMENSION_SQL = """SELECT dim, unnest(range(64)) AS pos, unnest(vec) AS value FROM (
        SELECT dim, list_transform(range(1, 65), lambda i: round(list_sum(list_transform(d, lambda x: x[i])), 6) + 0.0) AS vec
        FROM (SELECT c.dim, list(list_transform(range(1, 65), lambda i: b.vec[i] - a.vec[i])) AS d
              FROM chosen_v c JOIN vectors_v a ON a.id = c.l JOIN vectors_v b ON b.id = c.r GROUP BY c.dim))"""


@query("dimension_members", _MEMBERS_SQL, _PICKS)
def dimension_members(v: Views):
    built = dims.dimensions_from_seeds(v.vectors().select("id", "vec"), SEEDS)
    pairs = F.arrays_zip("left_comms", "right_comms")
    return built.select(F.col("name").alias("dim"), F.posexplode(pairs).alias("pos", "pair")).select(
        "dim", "pos", F.col("pair.left_comms").alias("left_comm"), F.col("pair.right_comms").alias("right_comm")
    )


@query("dimension_from_seeds", _DIMENSION_SQL, _PICKS)
def dimension_from_seeds(v: Views):
    built = dims.dimensions_from_seeds(v.vectors().select("id", "vec"), SEEDS)
    return long_vector(built.withColumnRenamed("name", "dim"), "dim")


@query(
    "copycat_dimension",
    "SELECT dim, unnest(range(64)) AS pos, unnest(list_transform(vec, lambda x: round(x, 6) + 0.0)) AS value FROM dimensions_v",
)
def copycat_dimension(v: Views):
    return long_vector(v.dimensions().withColumnRenamed("name", "dim"), "dim")


_PAIRS = [("wide", ["s1", "s3", "nowhere", "s9"], ["s2", "s4", "s6"]), ("one_neutral", ["s5", "u_10"], ["s6", "s7"])]
_PAIR_ROWS = ", ".join(f"('{n}', '{a}', '{b}')" for n, left, right in _PAIRS for a, b in zip(left, right, strict=False))


@query(
    "rebuilt_pairs",
    f"""
    SELECT dim, unnest(range(64)) AS pos, unnest(list_transform(vec, lambda x: round(x / sqrt(list_inner_product(vec, vec)), 6) + 0.0)) AS value
    FROM (SELECT dim, list(v ORDER BY pos) AS vec FROM (
        SELECT p.dim, pos, avg(CASE WHEN p.dim LIKE '%neutral' THEN b.vec[pos] + a.vec[pos] ELSE b.vec[pos] - a.vec[pos] END) AS v
        FROM (VALUES {_PAIR_ROWS}) p(dim, l, r) JOIN vectors_v a ON a.id = p.l JOIN vectors_v b ON b.id = p.r, unnest(range(1, 65)) t(pos)
        GROUP BY p.dim, pos) GROUP BY dim)""",
)
def rebuilt_pairs(v: Views):
    """Several pairs, one with an end that has no vector, one list longer than the other."""
    stored = v.spark.createDataFrame(_PAIRS, "name string, left_comms array<string>, right_comms array<string>")
    return long_vector(dims.rebuild_dimensions(stored, v.vectors(), WIDTH).withColumnRenamed("name", "dim"), "dim")


@query(
    "random_dimension",
    f"""
    SELECT id, 'random' AS dim, round(list_inner_product(vec, {ops.random_vector(WIDTH, 42)}::DOUBLE[]), 6) + 0.0 AS score
    FROM vectors_v""",
)
def random_dimension(v: Views):
    dim = ops.random_dimension(v.spark, "random", WIDTH, 42)
    return rounded(ops.score(v.vectors(), dim), "score")


@query(
    "pooled_text_vectors",
    """
    SELECT doc, tokens, pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc)), 6) + 0.0 AS value FROM (
        SELECT doc, pos, sum(v * 14) / count(*) AS v, count(*) AS tokens FROM (
            SELECT vec_id // 10 AS doc, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS pos FROM embeddings)
        GROUP BY doc, pos)""",
)
def pooled_text_vectors(v: Views):
    return long_vector(ops.pool_tokens(v.token_vectors(), [2, 3, 4, 5], WIDTH), "doc", "tokens")


@query(
    "pooled_word_vectors",
    """
    SELECT doc, tokens, pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc)), 6) + 0.0 AS value FROM (
        SELECT doc, pos, sum(v * 14) / count(*) AS v, count(*) AS tokens FROM (
            SELECT vec_id // 10 AS doc, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS pos
            FROM embeddings WHERE vec_id % 10 IN ((vec_id // 10) % 7, (vec_id // 10) % 7 + 1))
        GROUP BY doc, pos)""",
)
def pooled_word_vectors(v: Views):
    docs = v.embeddings.select((F.col("vec_id") / 10).cast("bigint").alias("doc")).distinct()
    targets = docs.select("doc", F.explode(F.array(*[(F.col("doc") % 7 + i).cast("int") for i in (0, 1)])).alias("token"))
    return long_vector(ops.pool_tokens(v.token_vectors(), [2, 3, 4, 5], WIDTH, targets), "doc", "tokens")
