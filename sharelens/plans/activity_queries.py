"""Activity, echo chambers and polarization tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sharelens.operators import activity as ops
from sharelens.plans.registry import query
from sharelens.plans.views import Views, rounded
from sharelens.session import settle
from sharelens.sources.dumps import _months

AFTER, BEFORE, EARLY = "1996", "2001", "1999"
MONTHS = _months("1996-01", "2000-12")


@query(
    "sub_month_counts",
    """
    SELECT a.subreddit, month, CAST(sum(num_comments) AS BIGINT) AS num_comments, round(any_value(s.score), 6) + 0.0 AS partisan
    FROM activity_v a LEFT JOIN scores_v s ON s.id = a.subreddit AND s.dim = 'partisan' GROUP BY 1, 2""",
)
def sub_month_counts(v: Views):
    return rounded(ops.monthly_counts(v.activity(), v.scores("partisan")), "partisan")


def _share_sql(edges: str) -> str:
    return f"""
    (SELECT month, CASE WHEN last_month_user_bin = 3 THEN 2 ELSE last_month_user_bin END AS user_bin,
               len(list_filter(e.edges, lambda x: x <= s.score)) AS partisan, sum(num_comments) AS n
               FROM activity_v a JOIN scores_v s ON s.id = a.subreddit AND s.dim = 'partisan'
               CROSS JOIN (SELECT {edges} AS edges FROM moments_v WHERE dim = 'partisan') e GROUP BY ALL)"""


def _shares(name: str, edges: str) -> str:
    rows = _share_sql(edges)
    return f"""
    SELECT '{name}' AS mode, month, user_bin, partisan, round(n / total, 6) AS share FROM (
        SELECT *, sum(n) OVER (PARTITION BY month) AS total FROM {rows})
    UNION ALL
    SELECT '{name}', month, 0, partisan, round(sum(n) / any_value(total), 6) FROM (
        SELECT *, sum(n) OVER (PARTITION BY month) AS total FROM {rows}) GROUP BY month, partisan"""


_EVEN = "list_transform(range(31), lambda i: CASE WHEN i = 30 THEN high ELSE low + i * ((high - low) / 30.0) END)"


@query("activity_share", _shares("bins", _EVEN) + " UNION ALL " + _shares("fractions", "[mean - 2 * sd, mean + 2 * sd]"))
def activity_share(v: Views):
    activity, scores = settle(v.activity()), settle(v.scores("partisan"))  # both modes read them
    bins = ops.activity_shares(activity, scores).withColumn("mode", F.lit("bins"))
    fractions = ops.activity_shares(activity, scores, fractions=True).withColumn("mode", F.lit("fractions"))
    return rounded(bins.unionByName(fractions), "share")


@query(
    "share_by_month",
    f"""
    SELECT m.month, round(sum(CASE WHEN partisan = 0 THEN n END) / any_value(total), 6) AS "0",
           round(sum(CASE WHEN partisan = 1 THEN n END) / any_value(total), 6) AS "1",
           round(sum(CASE WHEN partisan = 2 THEN n END) / any_value(total), 6) AS "2"
    FROM (SELECT unnest({MONTHS}) AS month) m LEFT JOIN (
        SELECT *, sum(n) OVER (PARTITION BY month) AS total
        FROM {_share_sql("[mean - 2 * sd, mean + 2 * sd]")}) r ON r.month = m.month
    GROUP BY m.month""",
)
def share_by_month(v: Views):
    shares = ops.activity_shares(v.activity(), v.scores("partisan"), fractions=True)
    wide = ops.matrix(shares.where("user_bin = 0"), "month", "partisan", "share", [0, 1, 2])
    return rounded(ops.for_list(wide, "month", MONTHS), "0", "1", "2")


@query(
    "extreme_share",
    """
    SELECT month, round(sum(CASE WHEN z < -1 THEN n ELSE 0 END) / sum(n), 6) AS share_0,
           round(sum(CASE WHEN z >= -1 AND z < 1 THEN n ELSE 0 END) / sum(n), 6) AS share_1,
           round(sum(CASE WHEN z >= 1 THEN n ELSE 0 END) / sum(n), 6) AS share_2,
           round(sum(CASE WHEN z < -1 OR z >= 1 THEN n ELSE 0 END) / sum(n), 6) AS total_extreme
    FROM (SELECT month, z, num_comments AS n FROM activity_v a JOIN community_z_v c ON c.subreddit = a.subreddit) GROUP BY month""",
)
def extreme_share(v: Views):
    found = ops.extreme_shares(v.activity(), v.scores("partisan"), (-1.0, 1.0))
    return rounded(found, "share_0", "share_1", "share_2", "total_extreme")


@query(
    "echo_bins",
    """
    SELECT b.bin, CAST(total_comments AS BIGINT) AS total_comments, round(pct, 6) AS pct
    FROM (VALUES (-2), (-1), (0), (1), (2)) b(bin) LEFT JOIN echo_pct_v p ON p.bin = b.bin""",
)
def echo_bins(v: Views):
    return rounded(ops.bin_shares(v.echo_bin_sizes(), "partisan"), "pct")


_CELLS = """
    SELECT a.bin AS bin1, b.bin AS bin2, coalesce(c.value, 0.0) AS value, p.pct
    FROM (VALUES (-2), (-1), (0), (1), (2)) a(bin) CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) b(bin)
    LEFT JOIN echo_cells_v c ON c.bin1 = a.bin AND c.bin2 = b.bin LEFT JOIN echo_pct_v p ON p.bin = b.bin"""


@query(
    "echo_cells",
    f"SELECT bin1, bin2, round(value, 6) AS value, round(pct, 6) AS pct, round(value - pct, 6) + 0.0 AS deviation FROM ({_CELLS})",
)
def echo_cells(v: Views):
    cells = ops.echo_cells(v.echo_cells(), v.echo_bin_sizes(), "partisan")
    return rounded(cells, "value", "pct", "deviation")


@query(
    "echo_matrix",
    "SELECT bin1, "
    + ", ".join(f'round(max(CASE WHEN bin2 = {b} THEN value END), 6) AS "{b}"' for b in ops.BINS)
    + f" FROM ({_CELLS}) GROUP BY bin1",
)
def echo_matrix(v: Views):
    cells = ops.echo_cells(v.echo_cells(), v.echo_bin_sizes(), "partisan")
    return rounded(ops.echo_matrix(cells), *[str(b) for b in ops.BINS])


@query("echo_max_deviation", f"SELECT round(max(value - pct), 6) + 0.0 AS max_deviation FROM ({_CELLS})")
def echo_max_deviation(v: Views):
    cells = ops.echo_cells(v.echo_cells(), v.echo_bin_sizes(), "partisan")
    return rounded(ops.max_deviation(cells), "max_deviation")


@query(
    "echo_community",
    "SELECT subreddit, "
    + ", ".join(f'round(max(CASE WHEN bin2 = {b} THEN frac END), 6) AS "{b}"' for b in ops.BINS)
    + ", round("
    + " + ".join(f"({b}) * coalesce(max(CASE WHEN bin2 = {b} THEN frac END), 0)" for b in ops.BINS)
    + """, 6) + 0.0 AS avg_bin FROM echo_community_v WHERE subreddit IN (SELECT subreddit FROM echo_community_v
    GROUP BY subreddit ORDER BY max(total_comments) DESC, subreddit LIMIT 25) GROUP BY subreddit""",
)
def echo_community(v: Views):
    found = ops.echo_communities(v.echo_community(), "partisan")
    return rounded(found, *[str(b) for b in ops.BINS], "avg_bin")


_RANGE = f"m1 > '{AFTER}' AND m2 > '{AFTER}' AND m1 < '{BEFORE}' AND m2 < '{BEFORE}'"


def _month_matrix_sql(kind: str, value: str, fill: bool) -> str:
    columns = []
    for m in MONTHS:
        cell = f"round(max(CASE WHEN m2 = '{m}' THEN {value} END), 6) + 0.0"
        columns.append((f"coalesce({cell}, 0.0)" if fill else cell) + f' AS "{m}"')
    return f"SELECT '{kind}' AS kind, m1, {', '.join(columns)} FROM month_pairs_v WHERE {_RANGE} GROUP BY m1"


@query(
    "month_matrix",
    _month_matrix_sql("polprob", "proportion_over", True) + " UNION ALL " + _month_matrix_sql("correlation", "pearson_r", False),
)
def month_matrix(v: Views):
    pairs = ops.month_range(v.month_pairs(), AFTER, BEFORE, ["m1", "m2"])
    polprob = ops.matrix(pairs, "m1", "m2", "proportion_over", MONTHS, fill=0.0)
    correlation = ops.matrix(pairs, "m1", "m2", "pearson_r", MONTHS)
    rows = polprob.withColumn("kind", F.lit("polprob")).unionByName(correlation.withColumn("kind", F.lit("correlation")))
    return rounded(rows, *MONTHS)


_LAGGED = f"""
    (SELECT p.* FROM month_pairs_v p
     JOIN (SELECT m1 AS m, row_number() OVER (ORDER BY m1) AS r FROM (SELECT DISTINCT m1 FROM month_pairs_v WHERE {_RANGE})) a ON a.m = p.m1
     JOIN (SELECT m1 AS m, row_number() OVER (ORDER BY m1) AS r FROM (SELECT DISTINCT m1 FROM month_pairs_v WHERE {_RANGE})) b ON b.m = p.m2
     WHERE b.r - a.r = 12)"""


@query("lagged_pairs", f"SELECT m1, m2, round(proportion_over, 6) AS proportion_over FROM {_LAGGED}")
def lagged_pairs(v: Views):
    pairs = ops.month_range(v.month_pairs(), AFTER, BEFORE, ["m1", "m2"])
    return rounded(ops.lagged_pairs(pairs).select("m1", "m2", "proportion_over"), "proportion_over")


@query(
    "lag12_stats",
    f"""
    SELECT round(min(CASE WHEN m2 < '{EARLY}' THEN proportion_over END), 6) AS early_min,
           round(max(CASE WHEN m2 < '{EARLY}' THEN proportion_over END), 6) AS early_max,
           arg_max(m1, {{'v': proportion_over, 'a': m1, 'b': m2}}) AS peak_m1,
           arg_max(m2, {{'v': proportion_over, 'a': m1, 'b': m2}}) AS peak_m2, round(max(proportion_over), 6) AS peak FROM {_LAGGED}""",
)
def lag12_stats(v: Views):
    pairs = ops.month_range(v.month_pairs(), AFTER, BEFORE, ["m1", "m2"])
    return rounded(ops.lag_statistics(pairs, before=EARLY), "early_min", "early_max", "peak")


@query(
    "ccdf_long",
    """
    SELECT m1, m2, threshold, round(value, 6) AS value FROM (
        SELECT m1, m2, 0.5::DOUBLE AS threshold, t1 AS value FROM month_pairs_v
        UNION ALL SELECT m1, m2, 1.5::DOUBLE, t2 FROM month_pairs_v UNION ALL SELECT m1, m2, 3.5::DOUBLE, t3 FROM month_pairs_v)""",
)
def ccdf_long(v: Views):
    wide = v.month_pairs().drop("pearson_r", "proportion_over")
    return rounded(ops.threshold_curves(wide), "value")


_YEARS = [str(y) for y in range(1995, 2002)]


@query(
    "cohort_matrix",
    "SELECT month, "
    + ", ".join(f"round(max(CASE WHEN first_year = '{y}' THEN avg_abs_z_score END), 6) AS \"{y}\"" for y in _YEARS)
    + f" FROM cohorts_v WHERE month > '{AFTER}' AND month < '{BEFORE}' GROUP BY month",
)
def cohort_matrix(v: Views):
    return rounded(ops.cohort_matrix(v.cohorts(), AFTER, BEFORE, _YEARS), *_YEARS)


def _category_sql(metric: str) -> str:
    cells = ", ".join(
        f"max(CASE WHEN category = '{c}' THEN {metric} END) AS \"{c}\"" for c in ("all", "center", "left", "right")
    )
    return f"SELECT month, {cells} FROM monthly_category_v WHERE month > '{AFTER}' AND month < '{BEFORE}' GROUP BY month"


@query(
    "category_matrix",
    f"""
    SELECT month, round("all", 6) AS "all", round(center, 6) AS center, round("left", 6) AS "left", round("right", 6) AS "right"
    FROM ({_category_sql('avg_abs_z')})""",
)
def category_matrix(v: Views):
    wide = ops.category_series(v.monthly_category(), "avg_abs_z", AFTER, BEFORE)
    return rounded(wide, "all", "center", "left", "right")


@query(
    "category_comments",
    f"""
    SELECT month, CAST(NULL AS DOUBLE) AS "all", center, "left", "right" FROM ({_category_sql('num_comments')})""",
)
def category_comments(v: Views):
    return ops.category_series(v.monthly_category(), "num_comments", AFTER, BEFORE, hide="all")


@query(
    "series_stats",
    f"""
    SELECT round(min(CASE WHEN month < '{EARLY}' THEN "all" END), 6) AS early_min,
           round(max(CASE WHEN month < '{EARLY}' THEN "all" END), 6) AS early_max,
           round(min(CASE WHEN month > p.m THEN "all" END), 6) AS after_peak_min, any_value(p.m) AS peak_month, round(max("all"), 6) AS peak
    FROM ({_category_sql('avg_abs_z')}) s, (SELECT arg_max(month, "all") AS m FROM ({_category_sql('avg_abs_z')})) p""",
)
def series_stats(v: Views):
    wide = ops.category_series(v.monthly_category(), "avg_abs_z", AFTER, BEFORE)
    return rounded(ops.series_statistics(wide, EARLY), "early_min", "early_max", "after_peak_min", "peak")


def _explained(v: Views):
    price = F.col("o_totalprice")
    return v.orders.groupBy(F.year("o_orderdate").alias("year")).agg(
        F.sum(price).alias("actual"),
        F.sum(F.when(F.col("o_orderstatus") == "F", price)).alias("static_new"),
        F.sum(F.when(F.col("o_orderstatus") == "O", price)).alias("static_old"),
    )


_EXPLAINED = """
    SELECT year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS actual,
           round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS static_new,
           round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS static_old FROM orders GROUP BY 1"""


@query("explained_by_year", _EXPLAINED)
def explained_by_year(v: Views):
    return rounded(ops.explained_polarization(_explained(v)), "actual", "static_new", "static_old", digits=2)


@query("explained_one_year", f"SELECT * FROM ({_EXPLAINED}) WHERE year = 1999")
def explained_one_year(v: Views):
    return rounded(ops.explained_polarization(_explained(v), 1999), "actual", "static_new", "static_old", digits=2)
