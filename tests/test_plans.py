"""What the physical plans must and must not contain."""

import re

import pytest

from sharelens.operators import links, neighbours, pmi
from sharelens.operators import vectors as ops
from sharelens.plans.catalog import QUERIES
from sharelens.plans.views import Views

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"cluster_hosts", "cluster_hosts_kmeans"}))
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_needed_columns_only(spark):
    text = plan(links.host_sub_counts(Views(spark, SF_DIR).comments(), None))
    read = " ".join(re.findall(r"ReadSchema: struct<([^>]*)", text))
    assert "l_partkey" in read and "l_extendedprice" not in read and "o_totalprice" not in read


READS_ONCE = {
    "lineitem": "host_sub_counts host_leaning activity_share month_matrix lagged_pairs lag12_stats cohort_matrix election_diff "
    "county_results echo_community echo_cells cluster_report",
    "documents": "extremes_table glossary_names",
}


@pytest.mark.parametrize("table, name", [(t, n) for t, names in READS_ONCE.items() for n in names.split()])
def test_raw_tables_are_read_once(spark, monkeypatch, table, name):
    plans, checkpoint = [], type(spark.range(1)).checkpoint

    def watched(df, *args, **kwargs):
        plans.append(plan(df))
        return checkpoint(df, *args, **kwargs)

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", watched)
    plans.append(plan(QUERIES[name](spark, SF_DIR)))
    assert sum(text.count(f"/{table}.parquet]") for text in plans) == 1


def test_filters_reach_the_scan(spark):
    text = plan(QUERIES["adhoc_query"](spark, SF_DIR))
    assert "l_quantity,40.0)" in text and "EqualTo(l_returnfl" in text


def test_counting_happens_before_the_shuffle(spark):
    comments = Views(spark, SF_DIR).comments()
    text = plan(links.pair_counts(comments))
    assert text.index("Exchange") < text.index("partial_count")


def test_heavy_pairs_do_not_shuffle_the_rows(spark):
    comments = Views(spark, SF_DIR).comments()
    text = plan(links.drop_heavy_pairs(comments, links.heavy_pairs(comments, 2)))
    assert "LeftAnti" in text and "Exchange hashpartitioning" not in text


def test_top_lists_are_cut_before_the_shuffle(spark):
    rows = spark.createDataFrame([(0, "a", 1.0, 5)], "labels int, subreddit string, pmi double, subreddit_count int")
    text = plan(pmi.top_communities_by_pmi(rows, floor=1))
    assert text.count("WindowGroupLimit") == 2
    vectors = Views(spark, SF_DIR).vectors()
    assert "WindowGroupLimit" in plan(neighbours.nearest_neighbours(vectors, 3))


def test_scoring_does_not_shuffle(spark):
    v = Views(spark, SF_DIR)
    assert "Exchange" not in plan(ops.score(v.vectors(), v.dimensions()))


def test_token_stream_is_counted_in_the_same_stage(spark):
    documents = Views(spark, SF_DIR).documents.selectExpr("lang as cluster", "text as body")
    text = plan(pmi.word_counts(documents, stop_words=["the"]))
    assert text.count("Exchange") == 1 and "partial_count" in text


def test_cluster_hosts_uses_the_operators_own_micro(monkeypatch):
    from sharelens.plans import cluster_queries

    asked = {}
    monkeypatch.setattr(cluster_queries, "host_vectors_of", lambda v, n: type("T", (), {"withColumnRenamed": lambda self, a, b: self})())
    monkeypatch.setattr(cluster_queries.clusters, "cluster_vectors", lambda hosts, **how: asked.update(how))
    cluster_queries.cluster_hosts(None)
    assert asked == {"clusters": 20}
