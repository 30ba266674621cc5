import math

import numpy as np
import pytest

from sharelens.operators import activity as ops


def test_month_range_is_text_and_exclusive(spark):
    df = spark.createDataFrame([("2011-12",), ("2012-01",), ("2018-12",), ("2019-01",)], "month string")
    assert [r.month for r in ops.month_range(df, "2012", "2019").orderBy("month").collect()] == ["2012-01", "2018-12"]


def activity(spark):
    rows = [
        ("a", "2015-01", 1, 10), ("a", "2015-01", 3, 20), ("b", "2015-01", 2, 30), ("c", "2015-02", 5, 5), ("x", "2015-02", 5, 95),
    ]
    return spark.createDataFrame(rows, "subreddit string, month string, last_month_user_bin int, num_comments bigint")


def scores(spark):
    return spark.createDataFrame([("a", 0.0), ("b", 5.0), ("c", 10.0)], "id string, score double")


def test_monthly_counts_keep_unscored(spark):
    found = {(r.subreddit, r.month): (r.num_comments, r.partisan) for r in ops.monthly_counts(activity(spark), scores(spark)).collect()}
    assert found["a", "2015-01"] == (30, 0.0) and found["x", "2015-02"] == (95, None)


def test_shares_sum_to_one_per_month(spark):
    found = ops.activity_shares(activity(spark), scores(spark), bins=2).collect()
    rows = {(r.month, r.user_bin, r.partisan): r.share for r in found}
    assert rows["2015-01", 1, 1] == pytest.approx(1 / 6)
    assert rows["2015-01", 2, 1] == pytest.approx(2 / 6)  # user bin 3 counts as 2
    assert rows["2015-01", 2, 2] == pytest.approx(3 / 6)
    assert rows["2015-02", 5, 3] == 1.0  # unscored community left out, maximum in the top bin
    for month in ("2015-01", "2015-02"):
        assert sum(s for (m, u, _), s in rows.items() if m == month and u) == pytest.approx(1)
        assert sum(s for (m, u, _), s in rows.items() if m == month and not u) == pytest.approx(1)


def test_extreme_shares_exclude_unscored(spark):
    found = {r.month: r for r in ops.extreme_shares(activity(spark), scores(spark), (-1.0, 1.0)).collect()}
    z = (np.array([0, 5, 10]) - 5) / np.std([0, 5, 10])
    assert z[0] < -1 and z[2] > 1
    assert found["2015-01"].share_0 == 0.5 and found["2015-01"].total_extreme == 0.5
    assert found["2015-02"].share_2 == 1.0


def test_echo_cells(spark):
    cells = spark.createDataFrame(
        [("p", -2, -2, 0.7), ("p", -2, 0, 0.3), ("q", 0, 0, 1.0)], "dimen string, bin1 int, bin2 int, bin1_avg_frac_bin2 double"
    )
    sizes = spark.createDataFrame([("p", -2, 30), ("p", 0, 10), ("q", 0, 5)], "dimen string, bin int, total_comments bigint")
    shares = ops.bin_shares(sizes, "p").collect()
    assert [(r.bin, r.pct) for r in shares] == [(-2, 0.75), (-1, None), (0, 0.25), (1, None), (2, None)]
    found = ops.echo_cells(cells, sizes, "p")
    assert found.count() == 25
    wide = ops.echo_matrix(found).collect()
    assert wide[0]["-2"] == 0.7 and wide[4]["2"] == 0.0
    assert ops.max_deviation(found).first()[0] == pytest.approx(0.3 - 0.25)


def test_echo_communities_limit_and_order(spark):
    rows = [("p", s, b, f, n) for s, n in (("big", 100), ("mid", 50), ("low", 1)) for b, f in ((-2, 0.0), (-1, 0.0), (0, 0.5), (1, 0.0), (2, 0.5))]
    rows = [(d, s, b, (1 - f if s == "mid" and b in (-2, 2) else f), n) for d, s, b, f, n in rows]
    df = spark.createDataFrame(rows, "dimen string, subreddit string, bin2 int, subreddit_avg_frac_bin2 double, total_comments bigint")
    found = ops.echo_communities(df, "p", communities=2).collect()
    assert [(r.subreddit, r.avg_bin) for r in found] == [("mid", -1.0), ("big", 1.0)]


def months(n):
    return [f"{2012 + i // 12:04d}-{i % 12 + 1:02d}" for i in range(n)]


def test_lag_twelve(spark):
    names = months(14)
    rows = [(a, b, float(i + j)) for i, a in enumerate(names) for j, b in enumerate(names)]
    df = spark.createDataFrame(rows, "m1 string, m2 string, proportion_over double")
    assert {(r.m1, r.m2) for r in ops.lagged_pairs(df).collect()} == {("2012-01", "2013-01"), ("2012-02", "2013-02")}
    row = ops.lag_statistics(df, before="2013-02").first()
    assert (row.early_min, row.early_max, row.peak, row.peak_m1, row.peak_m2) == (12.0, 12.0, 14.0, "2012-02", "2013-02")


def test_matrix_finds_columns_and_fills(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0)], "m1 string, m2 string, v double")
    assert [tuple(r) for r in ops.matrix(df, "m1", "m2", "v", fill=0.0).collect()] == [("a", 1.0, 0.0), ("b", 0.0, 2.0)]


def test_series(spark):
    rows = [(m, c, float(i)) for i, m in enumerate(["2012-01", "2013-01", "2014-01"]) for c in ("all", "left")]
    rows += [("2015-01", "all", 0.5), ("2019-05", "all", 99.0)]
    df = spark.createDataFrame(rows, "month string, category string, avg_abs_z double")
    wide = ops.category_series(df, "avg_abs_z")
    assert wide.columns == ["month", "all", "center", "left", "right"] and wide.count() == 4
    row = ops.series_statistics(wide, before="2014").first()
    assert (row.early_min, row.early_max, row.peak_month, row.peak, row.after_peak_min) == (0.0, 1.0, "2014-01", 2.0, 0.5)
    hidden = ops.category_series(df, "avg_abs_z", hide="all")
    assert {r["all"] for r in hidden.collect()} == {None}


def test_curves_and_explained(spark):
    df = spark.createDataFrame([("a", "b", 0.1, 0.2)], "m1 string, m2 string, `0.5` double, `1.0` double")
    assert {(r.threshold, r.value) for r in ops.threshold_curves(df).collect()} == {(0.5, 0.1), (1.0, 0.2)}
    years = spark.createDataFrame([(2015, 1.0, 2.0, 3.0), (2016, 4.0, 5.0, 6.0)], "year int, actual double, static_new double, static_old double")
    assert ops.explained_polarization(years, 2016).first().asDict() == {"year": 2016, "actual": 4.0, "static_new": 5.0, "static_old": 6.0}
    cohorts = spark.createDataFrame([("2013-01", "2012", 1.5), ("2011-01", "2011", 9.0)], "month string, first_year string, avg_abs_z_score double")
    assert [tuple(r) for r in ops.cohort_matrix(cohorts).collect()] == [("2013-01", 1.5)]


def test_for_list_keeps_order(spark):
    df = spark.createDataFrame([("2012-02", 1.0)], "month string, v double")
    assert [tuple(r) for r in ops.for_list(df, "month", ["2012-03", "2012-02"]).collect()] == [("2012-03", None), ("2012-02", 1.0)]
    assert math.isclose(ops.for_list(df, "month", ["2012-02"]).first().v, 1.0)
