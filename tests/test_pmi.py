import math

import pytest

from sharelens.operators import clusters, pmi, report


def test_pmi_values(spark):
    rows = [("c1", "x", 3), ("c1", "y", 1), ("c2", "x", 1), ("c2", "y", 3)]
    df = spark.createDataFrame(rows, "labels string, word string, count bigint")
    found = {(r.labels, r.word): r.pmi for r in pmi.pmi(df, "labels", "word").collect()}
    assert found["c1", "x"] == pytest.approx(math.log(1.5)) and found["c1", "y"] == pytest.approx(math.log(0.5))


def test_user_pages_count_but_do_not_show(spark):
    rows = [("c1", "a", 2), ("c2", "a", 2), ("c1", "blu_ray", 4)]
    df = spark.createDataFrame(rows, "labels string, subreddit string, count bigint")
    found = pmi.pmi(df, "labels", "subreddit").collect()
    assert {r.subreddit for r in found} == {"a"}
    row = next(r for r in found if r.labels == "c1")
    assert row.pmi == pytest.approx(math.log(8 * 2 / (6 * 4))) and row.labels_count == 6


def test_joint_weighted_pmi_is_not_negative(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.randint(0, 3), f"w{rng.randint(0, 9)}", rng.randint(1, 50)) for _ in range(200)]
    found = pmi.pmi(spark.createDataFrame(rows, "c int, w string, count bigint"), "c", "w").collect()
    assert sum(r["count"] * r.pmi for r in found) >= 0


def test_word_floor_only_hides(spark):
    text = "aa " * 500 + "bb " * 499
    texts = spark.createDataFrame([(0, text), (1, "cc")], "cluster int, body string")
    found = pmi.word_pmi(pmi.word_counts(texts, stop_words=[]), floor=500).collect()
    assert [(r.word, r.n_c) for r in found] == [("aa", 999)]
    assert found[0].pmi == pytest.approx(math.log(1000 * 500 / (999 * 500)))


def test_word_counts_filters(spark):
    texts = spark.createDataFrame([(0, "The cat at cat.com saw été and x9 dog")], "cluster int, body string")
    vocabulary = spark.createDataFrame([("cat",), ("dog",), ("saw",)], "word string")
    found = pmi.word_counts(texts, vocabulary=vocabulary).collect()
    assert {r.word: r.n_wc for r in found} == {"cat": 1, "dog": 1, "saw": 1}
    everything = pmi.word_counts(texts, stop_words=[], latin_only=False).collect()
    assert {r.word for r in everything} == {"the", "cat", "at", "saw", "été", "and", "x9", "dog"}


def test_top_lists(spark):
    rows = [(0, f"s{i:02d}", i * 100, 20 - i) for i in range(20)]
    df = spark.createDataFrame(rows, "labels int, subreddit string, subreddit_count int, pmi int").selectExpr(
        "labels", "subreddit", "subreddit_count", "cast(pmi as double) as pmi"
    )
    by_pmi = pmi.top_communities_by_pmi(df, floor=1000).orderBy("rank").collect()
    assert [r.subreddit for r in by_pmi] == [f"s{i}" for i in range(11, 20)]
    by_posts = pmi.top_communities_by_posts(df, floor=3.0, n=2).orderBy("rank").collect()
    assert [r.subreddit for r in by_posts] == ["s16", "s15"]


def test_report_is_padded(spark):
    hosts = spark.createDataFrame([(0, f"h{i}", 10 - i) for i in range(3)], "labels int, host string, count bigint")
    section = report.section(clusters.top_hosts_per_cluster(hosts), "hosts", "labels", "host", "count")
    table = report.cluster_report(spark.createDataFrame([(0,)], "cluster int"), [section])
    rows = {(r.section, r["rank"]): (r.item, r.v1) for r in table.collect()}
    assert len(rows) == 60
    assert [rows["hosts", i][0] for i in range(1, 11)] == ["h0", "h1", "h2"] + ["N/A"] * 7
    sizes = spark.createDataFrame([(0, "Europe", 3)], "cluster int, cluster_name string, size bigint")
    text = report.report_text(table, sizes).first().text
    assert text.startswith("----------Cluster: 0 (Desc: Europe), Size: 3----------\nTop PMI with post threshold:\n1 - Subreddit: N/A, PMI: N/A")
    assert "Most posted sites:\n1 - Host: h0, Post Count: 10\n" in text and "4 - Host: N/A, Post Count: N/A\n" in text
