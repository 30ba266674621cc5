import math

import numpy as np
import pytest

from sharelens.functions import vectors as V
from sharelens.operators import clusters, dimensions, neighbours
from sharelens.operators import vectors as ops


def table(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], "id string, vec array<double>")


def random_vectors(spark, n, width=6, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, width))
    return table(spark, [(f"v{i:03d}", row) for i, row in enumerate(x)]), x


def test_unit(spark):
    df = table(spark, [("a", [3, 4]), ("z", [0, 0])])
    found = {r.id: r.u for r in df.select("id", V.unit("vec").alias("u")).collect()}
    assert found["a"] == pytest.approx([0.6, 0.8]) and found["z"] is None


def test_product_keeps_nulls(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("n", None), ("b", [0.0, 1.0])], "id string, vec array<double>")
    product = V.product_with(np.array([[1.0, 1.0], [2.0, 0.0], [0.0, 5.0]]))
    found = {r.id: r.p for r in df.select("id", product("vec").alias("p")).collect()}
    assert found == {"a": [3.0, 2.0, 10.0], "n": None, "b": [1.0, 0.0, 5.0]}


def test_host_vector_is_weighted_mean(spark):
    counts = spark.createDataFrame(
        [("h", "s1", 3), ("h", "s2", 1), ("g", "s1", 2), ("g", "unknown", 9)], "host string, subreddit string, count bigint"
    )
    found = {r.host: r.vec for r in ops.host_vectors(counts, table(spark, [("s1", [1, 0]), ("s2", [0, 1])])).collect()}
    assert found["h"] == pytest.approx([3 / math.sqrt(10), 1 / math.sqrt(10)])
    assert found["g"] == pytest.approx([1, 0])


def test_scores(spark):
    vectors = table(spark, [("a", [3, 4]), ("b", [0, 2])])
    dims = spark.createDataFrame([("d", [2.0, 0.0]), ("e", [0.0, 1.0])], "name string, vec array<double>")
    rows = {(r.id, r.dim): r.score for r in ops.score(vectors, dims).collect()}
    assert rows == {("a", "d"): 3.0, ("a", "e"): 4.0, ("b", "d"): 0.0, ("b", "e"): 2.0}
    raw = {(r.id, r.dim): r.score for r in ops.score(vectors, dims, normalised=False).collect()}
    assert raw["a", "d"] == 6.0
    wide = ops.widen_scores(ops.score(vectors, dims), ["d", "e"])
    assert {r.id: (r.d, r.e) for r in wide.collect()} == {r.id: (r.d, r.e) for r in ops.score_wide(vectors, dims).collect()}


def test_cosine_and_random_dimension(spark):
    vectors = table(spark, [("a", [3, 4]), ("b", [-4, 3])])
    found = {r.id: r.cosine for r in ops.cosine_to_one(vectors, [6.0, 8.0]).collect()}
    assert found == pytest.approx({"a": 1.0, "b": 0.0})
    vec = ops.random_dimension(spark, "r", 150, 1).first().vec
    assert len(vec) == 150 and math.isclose(sum(x * x for x in vec), 1.0)


def test_neighbours_on_a_circle(spark):
    angles = [2 * math.pi * i / 12 for i in range(12)]
    vectors = table(spark, [(f"p{i:02d}", [math.cos(a), math.sin(a)]) for i, a in enumerate(angles)])
    found = neighbours.nearest_neighbours(vectors, 2, block_rows=3).collect()
    got = {}
    for r in found:
        got.setdefault(int(r.c1[1:]), set()).add(int(r.c2[1:]))
    assert got == {i: {(i - 1) % 12, (i + 1) % 12} for i in range(12)}


@pytest.mark.parametrize("block_rows", [7, 40, 1000])
def test_neighbours_equal_brute_force(spark, block_rows):
    vectors, x = random_vectors(spark, 120)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x @ x.T, 12)
    expected = set()
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-sims[i, j], j))
        expected |= {(f"v{i:03d}", f"v{j:03d}", rank + 1) for rank, j in enumerate(order[:5])}
    found = neighbours.nearest_neighbours(vectors, 5, block_rows)
    assert {(r.c1, r.c2, r["rank"]) for r in found.collect()} == expected


def test_copies_give_exactly_k_rows_by_id(spark):
    """A third of the vectors are equal."""
    rows = [(f"same{i:02d}", [1, 0, 0]) for i in range(20)] + [(f"x{i:02d}", [0.1 * i, 1, i % 3]) for i in range(40)]
    found = neighbours.nearest_neighbours(table(spark, rows), 4, block_rows=8).collect()
    per = {}
    for r in found:
        per.setdefault(r.c1, []).append((r["rank"], r.c2))
    assert all(len(v) == 4 for v in per.values()) and len(per) == 60
    assert [c for _, c in sorted(per["same05"])] == ["same00", "same01", "same02", "same03"]
    assert [c for _, c in sorted(per["same00"])] == ["same01", "same02", "same03", "same04"]


def test_fewer_vectors_than_k(spark):
    found = neighbours.nearest_neighbours(table(spark, [("a", [1, 0]), ("b", [0, 1]), ("z", [0, 0])]), 10).collect()
    assert {(r.c1, r.c2) for r in found} == {("a", "b"), ("b", "a")}


def greedy(vectors, pairs, seeds, size, compat=False):
    """The walk over all edges, edge by edge."""
    seed = np.array([vectors[r] - vectors[l] for l, r in seeds])
    edges = [(round(max(seed @ (vectors[b] - vectors[a])), 12), a, b) for a, b in pairs]
    edges.sort(key=lambda e: (-e[0], e[1], e[2]))
    banned = {c for p in seeds for c in p}
    if compat:
        last = min(edges, key=lambda e: (e[0], e[1], e[2]))
        banned |= {last[1], last[2]}
    picked = list(seeds)
    for _, a, b in edges:
        if len(picked) < size and a not in banned and b not in banned:
            picked.append((a, b))
            banned |= {a, b}
    return picked


@pytest.mark.parametrize("compat", [False, True])
def test_dimensions_equal_a_full_walk(spark, compat):
    vectors, x = random_vectors(spark, 60, seed=4)
    known = {f"v{i:03d}": row for i, row in enumerate(x)}
    pairs = neighbours.nearest_neighbours(vectors, 6)
    edges = [(r.c1, r.c2) for r in pairs.collect()]
    seeds = {"one": [("v000", "v001")], "two": [("v002", "v003"), ("v004", "v005")]}
    built = dimensions.dimensions_from_seeds(vectors, seeds, pairs, size=7, compat=compat)
    for row in built.collect():
        expected = greedy(known, edges, seeds[row.name], 7, compat)
        assert list(zip(row.left_comms, row.right_comms)) == expected
        names = row.left_comms + row.right_comms
        assert len(names) == len(set(names))
        total = sum(known[b] - known[a] for a, b in expected)
        assert row.vec == pytest.approx(total.tolist())


def test_hub_community_is_used_once(spark):
    """Every edge but two touches one hub."""
    vectors = table(spark, [("l", [0, 0]), ("r", [1, 0]), ("hub", [0, 1])] + [(f"x{i}", [i, i % 2]) for i in range(30)])
    edges = [("hub", f"x{i}") for i in range(30)] + [("x1", "x2"), ("x3", "x4")]
    pairs = spark.createDataFrame(edges, "c1 string, c2 string")
    built = dimensions.dimensions_from_seeds(vectors, {"d": [("l", "r")]}, pairs, size=10).first()
    assert list(zip(built.left_comms, built.right_comms)) == [("l", "r"), ("hub", "x29"), ("x1", "x2"), ("x3", "x4")]


def test_missing_seed_is_an_error(spark):
    vectors, _ = random_vectors(spark, 5)
    pairs = neighbours.nearest_neighbours(vectors, 2)
    with pytest.raises(KeyError):
        dimensions.dimensions_from_seeds(vectors, {"d": [("v000", "nope")]}, pairs)


def test_rebuilt_dimensions(spark):
    vectors = table(spark, [("a", [1, 0]), ("b", [0, 1]), ("c", [1, 1]), ("d", [3, 0])])
    stored = spark.createDataFrame(
        [("x", ["a", "b"], ["c", "d"]), ("x_neutral", ["a", "b"], ["c", "d"])],
        "name string, negative_comms array<string>, positive_comms array<string>",
    )
    found = {r.name: r.vec for r in dimensions.rebuild_dimensions(stored, vectors).collect()}
    assert found["x"] == pytest.approx([1.0, 0.0])
    assert found["x_neutral"] == pytest.approx(list(np.array([5, 2]) / math.sqrt(29)))


def test_pooling(spark):
    rows = [(1, l, t, [float(l * t), 1.0]) for l in (1, 2, 3) for t in (0, 1, 2)]
    tokens = spark.createDataFrame(rows, "doc bigint, layer int, token int, vec array<double>")
    row = ops.pool_tokens(tokens, [2, 3]).first()
    assert row.tokens == 3 and row.mean_vec == pytest.approx([5.0, 2.0])
    targets = spark.createDataFrame([(1, 2)], "doc bigint, token int")
    assert ops.pool_tokens(tokens, [2, 3], targets=targets).first().mean_vec == pytest.approx([10.0, 2.0])
    words = spark.createDataFrame([("the cat sat",)], "s string").select(ops.word_position("s", "cat")).first()[0]
    assert words == 1


def test_clusters_of_separated_blobs(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(4) * 10
    rows = [(f"{c}-{i}", centres[c] + rng.normal(scale=0.1, size=4)) for c in range(4) for i in range(25)]
    vectors = table(spark, rows)
    for method in ("ward", "kmeans"):
        found = clusters.cluster_vectors(vectors, 4, method=method).collect()
        labels = {}
        for r in found:
            labels.setdefault(r.id.split("-")[0], set()).add(r.label)
        assert len(found) == 100
        if method == "ward":
            assert all(len(v) == 1 for v in labels.values()) and len(set.union(*labels.values())) == 4


def test_centroids_and_closest(spark):
    vectors = spark.createDataFrame(
        [("a", 0, [1.0, 0.0]), ("b", 0, [3.0, 0.0]), ("c", 1, [0.0, 1.0]), ("d", 1, [1.0, 3.0])],
        "id string, label int, vec array<double>",
    )
    centres = clusters.centroids(vectors)
    assert {r.label: (r.vec, r.size) for r in centres.collect()} == {0: ([2.0, 0.0], 2), 1: ([0.5, 2.0], 2)}
    own = clusters.closest_to_centroid(vectors, centres, cosine=False, all_vecs=False, num=1).collect()
    assert {(r.centre, r.id, round(r.value, 6)) for r in own} == {(0, "a", 1.0), (1, "c", round(math.hypot(0.5, 1), 6))}
    every = clusters.closest_to_centroid(vectors, centres, num=3).collect()
    assert len(every) == 6 and [r.id for r in sorted(every, key=lambda r: (r.centre, r["rank"]))][:2] == ["a", "b"]


def test_vector_columns(spark):
    row = table(spark, [("a", [1, 2])]).select(*V.vector_columns("vec", 3)).first()
    assert row.asDict() == {"_0": 1.0, "_1": 2.0, "_2": None}


def test_name_clusters(spark):
    df = spark.createDataFrame([(0,), (7,)], "label int")
    assert [r.cluster_name for r in clusters.name_clusters(df, {0: "Europe"}).orderBy("label").collect()] == ["Europe", ""]


def test_partition_count_does_not_change_results(spark):
    vectors, _ = random_vectors(spark, 50, seed=9)
    a = neighbours.nearest_neighbours(vectors.repartition(1), 3).collect()
    b = neighbours.nearest_neighbours(vectors.repartition(7), 3, block_rows=9).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.mark.parametrize("slice_rows,most", [(1 << 17, 16), (3, 16), (1, 2)])
def test_host_vectors_are_summed_where_the_hosts_are(spark, monkeypatch, slice_rows, most):
    """Every way of joining gives the same sums; with broadcasts only the narrow counts are shuffled."""
    monkeypatch.setattr(ops, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(ops, "MAX_SLICES", most)
    vectors = [(f"s{i}", [float(i), 1.0, -2.0]) for i in range(7)] + [("s1", [5.0, 0.0, 1.0]), ("s8", None), (None, [1.0, 1.0, 1.0])]
    counts = [("a", "s0", 2), ("a", "s1", 3), ("a", "nowhere", 9), ("b", "s6", 1), ("b", "s8", 4), ("c", "s8", 1), (None, "s2", 1), ("d", None, 1)]
    found = ops.host_vectors(
        spark.createDataFrame(counts, "host string, subreddit string, count bigint"), spark.createDataFrame(vectors, "id string, vec array<double>"), 3
    )
    text = found._jdf.queryExecution().executedPlan().toString()
    assert (text.count("Exchange hashpartitioning") == 1) == (slice_rows > 1)
    by_host = {r.host: r.vec for r in found.collect()}
    sums = {"a": [18.0, 5.0, -7.0], "b": [6.0, 1.0, -2.0], None: [2.0, 1.0, -2.0]}
    assert set(by_host) == {"a", "b", "c", None} and by_host["c"] is None
    for host, want in sums.items():
        assert by_host[host] == pytest.approx((np.array(want) / np.linalg.norm(want)).tolist())
