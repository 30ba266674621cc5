"""Inputs that the registered queries' tables never hold."""

import html
import os
import random
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from html.entities import html5
from pyspark.sql import functions as F

from sharelens import session
from sharelens.functions import text as T
from sharelens.operators import activity, clusters, dimensions, links, neighbours, positions, stats

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_communities_with_missing_bins_stay_whole(spark):
    rows = [("large", 2, 0.5, 100)] + [("middle", b, 0.2, 50) for b in activity.BINS] + [("small", 0, 1.0, 5)]
    cells = spark.createDataFrame(rows, "subreddit string, bin2 int, subreddit_avg_frac_bin2 double, total_comments long").withColumn("dimen", F.lit("d"))
    found = {r.subreddit: r for r in activity.echo_communities(cells, "d", 2).collect()}
    assert set(found) == {"large", "middle"}
    assert found["large"]["2"] == 0.5 and found["large"]["0"] is None and found["large"].avg_bin == 1.0
    assert found["middle"].avg_bin == pytest.approx(0.0) and found["middle"]["-2"] == 0.2


@pytest.mark.parametrize("partitions", [1, 7])
def test_closest_with_zero_vectors_and_missing_labels(spark, partitions):
    rows = [("a", 1, [1.0, 0.0]), ("b", None, [0.0, 1.0]), ("z", 1, [0.0, 0.0]), ("y", None, [0.0, 0.0]), ("n", 1, None)]
    vectors = spark.createDataFrame(rows, "id string, label int, vec array<double>").repartition(partitions)
    centres = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0]), (None, [1.0, 0.0])], "label int, vec array<double>")
    found = clusters.closest_to_centroid(vectors, centres).collect()
    assert [(r.centre, r.id, r.label) for r in sorted(found, key=lambda r: r["rank"])] == [(1, "a", 1), (1, "b", None)]
    own = clusters.closest_to_centroid(vectors, centres, cosine=False, all_vecs=False).collect()
    assert [(r.id, r.value) for r in sorted(own, key=lambda r: r["rank"])] == [("a", 1.0), ("z", pytest.approx(2**0.5))]


def test_rebuilt_dimension_uses_complete_pairs_only(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("d", [-1.0, 0.0])], "id string, vec array<double>")
    schema = "name string, left_comms array<string>, right_comms array<string>"
    stored = spark.createDataFrame([("x", ["c", "d"], ["a", "b"]), ("uneven", ["a", "b"], ["d"])], schema)
    found = {r.name: r.vec for r in dimensions.rebuild_dimensions(stored, vectors, 2).collect()}
    assert found["x"] == pytest.approx([0.5**0.5, 0.5**0.5]) and found["uneven"] == pytest.approx([-1.0, 0.0])
    with pytest.raises(KeyError):
        dimensions.rebuild_dimensions(stored, vectors, 2, strict=True)


def test_quantile_of_a_hot_value(spark):
    values = [0.5] * 4000 + [float(i) for i in range(1000)] + [None] * 10
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    known = [v for v in values if v is not None]
    for q in (0.0, 0.3, 0.81, 0.9, 0.9999, 1.0):
        assert positions.exact_quantile(df, "x", q).first()["quantile"] == pytest.approx(np.quantile(known, q))
    assert positions.exact_quantile(df.where("x > 5000"), "x", 0.5).first()["quantile"] is None


def test_hot_value_is_one_row_after_counting(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(positions, "settle", lambda df: seen.append(df.count()) or session.settle(df))
    df = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, 7.0).otherwise(F.col("id").cast("double")).alias("x"))
    positions.exact_quantile(df, "x", 0.5).collect()
    assert seen[0] == 10_001 - (1 if 7 % 3 == 0 else 0)


def test_many_dimensions(spark):
    scores = spark.range(4500).select(
        F.concat(F.lit("i"), (F.col("id") % 3).cast("string")).alias("id"),
        F.concat(F.lit("d"), F.floor(F.col("id") / 3).cast("string")).alias("dim"),
        (F.col("id") * 1.0).alias("score"),
    )
    assert stats.z_scores(scores).groupBy("dim").agg(F.sum("z").alias("s")).where("abs(s) > 1e-9").count() == 0
    assert stats.percentiles(scores).where("pctl = 0").count() == 1500


def test_picks_in_rounds_equal_one_walk(spark):
    rng = random.Random(4)
    rows = {(f"d{i}", f"c{rng.randint(0, 40)}", f"c{rng.randint(0, 40)}"): round(rng.random(), 2) for i in range(30) for _ in range(200)}
    edges = spark.createDataFrame([(*k, s) for k, s in rows.items()], "dim string, c1 string, c2 string, similarity double")
    taken = spark.createDataFrame([(f"d{i}", f"c{j}") for i in range(30) for j in (1, i)], "dim string, node string")
    wanted = spark.createDataFrame([(f"d{i}", i % 13) for i in range(30)], "dim string, n int")
    want = []
    for i in range(30):
        used, found = {"c1", f"c{i}"}, 0
        for (_, a, b), _ in sorted(((k, s) for k, s in rows.items() if k[0] == f"d{i}"), key=lambda e: (-e[1], e[0])):
            if found < i % 13 and a != b and a not in used and b not in used:
                used |= {a, b}
                found += 1
                want.append((f"d{i}", a, b, found))
    assert sorted(map(tuple, dimensions.pick_disjoint(edges, taken, wanted).collect())) == sorted(want)
    assert dimensions.pick_disjoint(edges.where("false"), taken, wanted).count() == 0


def test_neighbours_use_several_blocks(spark):
    rng = np.random.default_rng(0)
    vectors = spark.createDataFrame([(f"v{i}", rng.normal(size=4).tolist()) for i in range(600)], "id string, vec array<double>")
    one = sorted(map(tuple, neighbours.nearest_neighbours(vectors, 3).collect()))
    other = sorted(map(tuple, neighbours.nearest_neighbours(vectors, 3, block_rows=50).collect()))
    assert one == other and len(one) == 1800


def test_ward_is_exact_for_few_rows(spark):
    points = [(f"p{i}", [float(x)]) for i, x in enumerate((0, 1, 10, 11, 12, 50))]
    found = {r.id: r.label for r in clusters.cluster_vectors(spark.createDataFrame(points, "id string, vec array<double>"), 3).collect()}
    groups = {frozenset(k for k in found if found[k] == v) for v in found.values()}
    assert groups == {frozenset({"p0", "p1"}), frozenset({"p2", "p3", "p4"}), frozenset({"p5"})}


def test_pair_limit_with_null_keys(spark):
    rows = [("a", "h", "s")] * 3 + [("a", "h", "t")] * 2 + [(None, "h", "s")] * 6 + [("b", None, "s"), ("b", "g", "s")]
    comments = spark.createDataFrame(rows, "author string, host string, subreddit string")
    found = {(r.host, r.subreddit): r["count"] for r in links.host_sub_counts(comments, 6).collect()}
    assert found == {("h", "s"): 3, ("h", "t"): 2, (None, "s"): 1, ("g", "s"): 1}


def random_texts(count: int) -> list[str]:
    rng = random.Random(1)
    pieces = ["a", "word", "long-hyphen-ated", "x--y", "-", "--", "a-b", "  ", " ", "\t", "\n", "é-è", "1-2", "...", "x" * 40, "y" * 140, "z-" * 70, "ab-c", "日本", "\r"]
    texts = ["".join(rng.choice(pieces) + rng.choice(("", " ")) for _ in range(rng.randint(0, 60))) for _ in range(count)]
    return texts + [" " * k + w for k in (0, 129, 130, 131, 400) for w in ("a", "b" * 131, "d e", "")]


@pytest.mark.parametrize("width", [130, 20])
def test_first_line_breaks_like_textwrap(spark, width):
    texts = random_texts(400)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.first_line(F.col("t"), width).alias("line"))
    wrapped = [(textwrap.wrap(t, width) or [""])[0] for t in texts]
    assert [r.line for r in df.orderBy("i").collect()] == [w if w == t else w + "..." for w, t in zip(wrapped, texts, strict=True)]


def test_character_references(spark):
    rng = random.Random(2)
    texts = ["&" + rng.choice(list(html5)) for _ in range(200)]
    texts += "&amp &am &notit; &#x27; &#39 &#0; &#128; &#x80 &#xD800; &#x110000; &#99999999999999999999; &#11; &#xFDD0; &#x1F600; &; && &#; &#x; &zzz; &AMPx &#129; &#xFFFE;".split()
    texts += ["a &lt;b&gt; &amp;amp; c", "", "no reference"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.unescape_html(F.col("t")).alias("x"))
    assert [r.x for r in df.orderBy("i").collect()] == [html.unescape(t) for t in texts]


def test_no_python_udf_in_text_functions(spark):
    df = spark.createDataFrame([("a",)], "t string").select(T.first_line(F.col("t")), T.unescape_html(F.col("t")))
    assert "Python" not in df._jdf.queryExecution().toString()


def test_task_functions_need_no_package_on_the_executor(tmp_path):
    """What a task runs is unpickled and called in a process that cannot import this package."""
    from pyspark import cloudpickle

    def task(batch):
        return neighbours._matrix(batch).sum()

    (tmp_path / "task").write_bytes(cloudpickle.dumps(task))
    code = """
import pickle, sys, pyarrow as pa
try:
    import sharelens
    sys.exit("the package is on the path")
except ImportError:
    pass
task = pickle.load(open("task", "rb"))
print("SUM", task(pa.table({"vec": [[1.0, 2.0], [3.0, 4.0]]})))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "SUM 10.0" in out.stdout, out.stderr[-2000:]


def test_clean_removes_settled_and_scratch_files(spark):
    kept = session.settle(spark.range(10))
    path = session.scratch_path(spark, "probe")
    spark.range(3).write.parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    assert kept.count() == 10 and files.exists(root)
    session.clean(spark)
    assert not files.exists(root)
    assert session.settle(spark.range(5)).count() == 5


def test_cluster_session_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "local-cluster[2,1,1024]"

    class Fake:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        session.checkpoint_root(Fake())
