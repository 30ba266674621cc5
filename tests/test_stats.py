import numpy as np
import pytest
from pyspark.sql import functions as F

from sharelens.operators import positions, stats


def scores(spark, values, dim="d"):
    return spark.createDataFrame([(f"i{k:03d}", dim, float(x)) for k, x in enumerate(values)], "id string, dim string, score double")


def test_z_uses_population_sigma(spark):
    found = [r.z for r in stats.z_scores(scores(spark, [1, 2, 3])).orderBy("id").collect()]
    assert found == pytest.approx([-1.224745, 0, 1.224745], abs=1e-6)
    assert [r.z for r in stats.z_scores(scores(spark, [5, 5])).collect()] == [None, None]


def test_percentiles(spark):
    df = scores(spark, [3, 1, 2, 2]).unionByName(scores(spark, [9, 8], "e"))
    found = {(r.dim, r.id): r.pctl for r in stats.percentiles(df).collect()}
    assert found == {
        ("d", "i001"): 0.0, ("d", "i002"): 25.0, ("d", "i003"): 50.0, ("d", "i000"): 75.0, ("e", "i001"): 0.0, ("e", "i000"): 50.0,
    }


def test_positions_with_a_hot_value(spark):
    """A third of the rows share one value; positions stay a permutation in order."""
    rng = np.random.default_rng(0)
    values = [7] * 1000 + rng.integers(0, 100, 2000).tolist()
    df = spark.createDataFrame([(i, int(v), "a" if i % 3 else "b") for i, v in enumerate(values)], "id int, v int, g string")
    placed = positions.with_position(df.repartition(9), ["v", "id"]).collect()
    expected = {i: p for p, (v, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    assert {r.id: r.position for r in placed} == expected
    grouped = positions.with_position(df, ["v", "id"], ["g"]).collect()
    for g in "ab":
        rows = sorted((r.position, r.v, r.id) for r in grouped if r.g == g)
        assert [p for p, _, _ in rows] == list(range(len(rows)))
        assert [(v, i) for _, v, i in rows] == sorted((v, i) for _, v, i in rows)


def test_null_group_and_slice(spark):
    df = spark.createDataFrame([("a", None), ("b", None), ("c", "x")], "id string, g string")
    placed = positions.with_position(df, ["id"], ["g"])
    assert {r.id: r.position for r in placed.collect()} == {"a": 0, "b": 1, "c": 0}
    assert [r.id for r in positions.slice_positions(positions.with_position(df, ["id"]), 1, 3).orderBy("id").collect()] == ["b", "c"]


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_quantile_interpolates(spark, q):
    values = np.random.default_rng(3).normal(size=37)
    df = spark.createDataFrame([(float(x),) for x in values], "x double")
    assert positions.exact_quantile(df, "x", q).first()[0] == pytest.approx(np.quantile(values, q))


def test_histogram_closes_last_bin(spark):
    values = np.random.default_rng(1).normal(size=500)
    found = {r.bin: r["count"] for r in stats.histogram(scores(spark, values), 20).collect()}
    expected, edges = np.histogram(values, bins=20)
    assert found == {i: n for i, n in enumerate(expected) if n}


def test_densities_match_numpy_and_keep_empty_bins(spark):
    values = np.random.default_rng(2).normal(size=300)
    df = scores(spark, values)
    clustering = df.select("id", (F.substring("id", 4, 1).cast("int") % 2).alias("cluster_id")).withColumn("cluster_name", F.lit("c"))
    found = stats.densities(stats.clustered(df, clustering)).collect()
    edges = np.linspace(values.min(), values.max(), 40)
    for c in (0, 1):
        own = [v for i, v in enumerate(values) if (i % 10) % 2 == c]
        expected, _ = np.histogram(own, bins=edges, density=True)
        rows = sorted((r.bin, r.density) for r in found if r.cluster_id == c)
        assert [b for b, _ in rows] == list(range(39))
        assert [d for _, d in rows] == pytest.approx(expected.tolist())


def test_exemplars(spark):
    found = {r.step: r.id for r in stats.exemplars(scores(spark, [0, 1, 2]), 5).collect()}
    assert found == {0: "i000", 1: "i001", 2: "i001", 3: "i002", 4: "i002"}


def test_exemplars_equal_a_walk(spark):
    values = np.random.default_rng(5).normal(size=200)
    order = np.sort(values)
    found = {r.step: r.score for r in stats.exemplars(scores(spark, values)).collect()}
    thresholds = np.linspace(values.min(), values.max(), 20)
    assert found == {i: order[np.argmax(order >= t)] for i, t in enumerate(thresholds)}


def test_top_bottom_and_outliers(spark):
    df = scores(spark, [5, 1, 1, 9, 3])
    rows = {(r.side, r["rank"]): r.id for r in stats.top_bottom(df, 2).collect()}
    assert rows == {("lowest", 1): "i001", ("lowest", 2): "i002", ("highest", 1): "i003", ("highest", 2): "i000"}
    assert [r.id for r in stats.outliers(scores(spark, [0] * 20 + [50])).collect()] == ["i020"]


def clusters_of(spark, names):
    rows = [(f"i{k:03d}", k % 2, n) for k, n in enumerate(names)]
    return spark.createDataFrame(rows, "id string, cluster_id int, cluster_name string")


def test_cluster_tables(spark):
    df = scores(spark, [1, 2, 3, 4], "age")
    members = stats.clustered(df, clusters_of(spark, ["x", "y", "x", "y"]))
    assert {r.cluster_name: r.mean_score for r in stats.cluster_means(members).collect()} == {"x": 2.0, "y": 3.0}
    m = {r.cluster_name: r for r in stats.cluster_moments(members, df).collect()}
    assert m["x"].variance == 2.0 and m["x"]["count"] == 2 and m["x"].mean_z == pytest.approx(-0.5 / np.std([1, 2, 3, 4]))
    e = {r.cluster_id: (r.minimum_id, r.maximum_id) for r in stats.cluster_extremes(members).collect()}
    assert e == {0: ("i000", "i002"), 1: ("i001", "i003")}


def test_skews(spark):
    df = scores(spark, range(10), "age_b")
    clustering = clusters_of(spark, ["lo"] * 4 + ["hi"] * 6)
    rows = {r.cluster: r for r in stats.skews(df, clustering).collect()}
    assert rows["lo"].word == "young" and rows["lo"].frac == 50.0 and rows["lo"].pctl == 20
    assert rows["lo"].desc == "lo communities skew young (50% are below the 20th percentile)"
    assert rows["hi"].word == "old" and rows["hi"].frac == pytest.approx(100 / 6)
    assert [r.cluster for r in stats.skews(df, clustering, pairs=[("hi", "age_b")]).collect()] == ["hi"]
    both = stats.bimodality(stats.clustered(stats.percentiles(df), clustering))
    assert {r.cluster_name: r.frac for r in both.collect()} == {"lo": 50.0, "hi": pytest.approx(100 / 6)}


def test_politics_categories(spark):
    rows = [(f"i{k}", float(k), k / 10) for k in range(10)]
    wide = spark.createDataFrame(rows, "id string, partisan double, partisan_neutral double")
    z = lambda k: (k - 4.5) / np.std(range(10))
    cut = {"partisan": 0.15}
    ids = lambda c, **o: {r.id for r in stats.politics_subset(wide, "partisan", c, cutoffs=o.get("cutoffs", cut)).collect()}
    assert ids("all") == {f"i{k}" for k in range(2, 10)}
    assert ids("right") == {f"i{k}" for k in range(10) if z(k) >= 1}
    assert ids("left") == {f"i{k}" for k in range(2, 10) if z(k) <= -1}
    assert ids("center") == {f"i{k}" for k in range(2, 10) if -1 < z(k) < 1}
    assert ids("all_unfiltered") == {f"i{k}" for k in range(10)}
    assert ids("all", cutoffs={}) == {"i9"}
    absolute = stats.politics_subset(wide, "partisan", "all", True, cut, view="scores")
    assert min(r.partisan_dimen for r in absolute.collect()) >= 0 and spark.table("scores").count() == 8
    with pytest.raises(ValueError):
        stats.politics_subset(wide, "partisan", "other")


def test_extremes_table_falls_back_to_age(spark):
    df = scores(spark, range(20), "gender").unionByName(scores(spark, range(0, 40, 2), "age"))
    words = spark.createDataFrame([("retard", 1.0), ("ban", 9.0), ("w", 5.0)], "word string, age double")
    ban = spark.createDataFrame([("ban",)], "word string")
    found = stats.extremes_table(df, words, "gender", 2, ban).collect()
    assert {r.item for r in found if r.type == "community"} == {"i000", "i001", "i018", "i019"}
    found_words = [(r.item, r.score) for r in found if r.type == "word"]
    assert {w for w, _ in found_words} == {"r-tard", "w"}
    mean, sd = np.mean(range(0, 40, 2)), np.std(range(0, 40, 2))
    assert dict(found_words)["w"] == pytest.approx((5 - mean) / sd)


def test_correlation_and_export(spark):
    wide = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 5.9)], "a double, b double")
    assert stats.dimension_correlation(wide, "a", "b").first()[0] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 5.9])[0, 1])
    df = scores(spark, [1, 2], "edginess")
    out = stats.export_scores(df, clusters_of(spark, ["x", "y", "z"]), ["edginess"])
    assert out.columns == ["id", "cluster_name", "edgy_pctl", "edgy_raw"]
    assert {r.id: r.edgy_pctl for r in out.collect()} == {"i000": 0.0, "i001": 50.0, "i002": None}
    marked = stats.marked_items(scores(spark, [1, 2, 3]), spark.createDataFrame([("i002",), ("i000",)], "id string"))
    assert [r.id for r in marked.collect()] == ["i000", "i002"]
