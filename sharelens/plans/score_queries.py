"""Statistics of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from sharelens.operators import asof, stats
from sharelens.operators.positions import exact_quantile
from sharelens.plans.registry import query
from sharelens.session import settle
from sharelens.plans.views import Views, rounded


@query("score_summary", "SELECT dim, round(low, 6) AS lowest, round(high, 6) AS highest, round(mean, 6) + 0.0 AS mean FROM moments_v")
def score_summary(v: Views):
    return rounded(stats.score_summary(v.scores()), "lowest", "highest", "mean")


@query("zscores", "SELECT id, dim, round(z, 6) + 0.0 AS z FROM z_v")
def zscores(v: Views):
    return rounded(stats.z_scores(v.scores()).select("id", "dim", "z"), "z")


@query(
    "zscore_bins",
    """
    SELECT id, dim, CAST(greatest(-3, least(3, trunc(z))) AS INTEGER) AS z_bin, round(abs(z), 6) AS abs_z FROM z_v""",
)
def zscore_bins(v: Views):
    return rounded(stats.z_bins(v.scores()).select("id", "dim", "z_bin", "abs_z"), "abs_z")


@query("percentile_rank", "SELECT id, dim, round(pctl, 6) AS pctl FROM percentiles_v")
def percentile_rank(v: Views):
    return rounded(stats.percentiles(v.scores()).select("id", "dim", "pctl"), "pctl")


@query(
    "hist100",
    """
    SELECT s.dim, CAST(least(floor((score - low) / ((high - low) / 100.0)), 99) AS INTEGER) AS bin,
           count(*) AS count, round(low + least(floor((score - low) / ((high - low) / 100.0)), 99) * ((high - low) / 100.0), 6) + 0.0 AS bin_left
    FROM scores_v s JOIN moments_v m ON m.dim = s.dim GROUP BY ALL""",
)
def hist100(v: Views):
    return rounded(stats.histogram(v.scores()), "bin_left")


@query(
    "density_by_cluster",
    """
    SELECT g.dim, g.cluster_id, g.bin, round(g.low + (g.bin + 0.5) * g.width, 6) + 0.0 AS midpoint,
           coalesce(c.count, 0) AS count, round(coalesce(c.count, 0) / (g.n * g.width), 6) AS density
    FROM (SELECT n.*, m.low, (m.high - m.low) / 39.0 AS width, b.bin
          FROM (SELECT dim, cluster_id, count(*) AS n FROM members_v GROUP BY 1, 2) n
          JOIN moments_v m ON m.dim = n.dim CROSS JOIN (SELECT unnest(range(39)) AS bin) b) g
    LEFT JOIN (SELECT s.dim, cluster_id, least(floor((score - low) / ((high - low) / 39.0)), 38) AS bin, count(*) AS count
               FROM members_v s JOIN moments_v m ON m.dim = s.dim GROUP BY ALL) c
    ON c.dim = g.dim AND c.cluster_id = g.cluster_id AND c.bin = g.bin""",
)
def density_by_cluster(v: Views):
    members = stats.clustered(v.scores(), v.clustering())
    return rounded(stats.densities(members), "midpoint", "density")


@query(
    "cluster_moments",
    """
    SELECT s.dim, cluster_name, round((avg(score) - any_value(mean)) / any_value(sd), 6) + 0.0 AS mean_z,
           round(var_samp(score), 6) AS variance, count(*) AS count
    FROM members_v s JOIN moments_v m ON m.dim = s.dim GROUP BY 1, 2""",
)
def cluster_moments(v: Views):
    scores = v.scores()
    found = stats.cluster_moments(stats.clustered(scores, v.clustering()), scores)
    return rounded(found, "mean_z", "variance")


@query(
    "cluster_extremes",
    """
    SELECT dim, cluster_id, arg_min(id, {'s': score, 'i': id}) AS minimum_id, round(min(score), 6) + 0.0 AS minimum,
           arg_max(id, {'s': score, 'i': id}) AS maximum_id, round(max(score), 6) + 0.0 AS maximum
    FROM members_v GROUP BY 1, 2""",
)
def cluster_extremes(v: Views):
    found = stats.cluster_extremes(stats.clustered(v.scores(), v.clustering()))
    return rounded(found, "minimum", "maximum")


@query(
    "outliers",
    """
    SELECT s.id, s.dim, round(score, 6) + 0.0 AS score FROM scores_v s JOIN moments_v m ON m.dim = s.dim
    WHERE abs(score - mean) >= 2 * sd""",
)
def outliers(v: Views):
    return rounded(stats.outliers(v.scores()).select("id", "dim", "score"), "score")


@query("cluster_dim_means", "SELECT cluster_name, dim, round(avg(score), 6) + 0.0 AS mean_score FROM members_v GROUP BY 1, 2")
def cluster_dim_means(v: Views):
    return rounded(stats.cluster_means(stats.clustered(v.scores(), v.clustering())), "mean_score")


@query(
    "dim_corr",
    """
    SELECT 'clusters' AS level, round(corr(a, b), 6) AS pearson_r FROM (
        SELECT avg(CASE WHEN dim = 'age' THEN score END) AS a, avg(CASE WHEN dim = 'gender' THEN score END) AS b
        FROM members_v GROUP BY cluster_name)
    UNION ALL
    SELECT 'items', round(corr(a.score, b.score), 6) FROM scores_v a JOIN scores_v b
        ON a.id = b.id AND a.dim = 'age' AND b.dim = 'gender'""",
)
def dim_corr(v: Views):
    wide = v.scores_wide()
    means = (
        wide.join(v.clustering(), "id").groupBy("cluster_name").agg(F.avg("age").alias("age"), F.avg("gender").alias("gender"))
    )
    parts = [("clusters", means), ("items", wide)]
    rows = [stats.dimension_correlation(df, "age", "gender").select(F.lit(n).alias("level"), "pearson_r") for n, df in parts]
    return rounded(rows[0].unionByName(rows[1]), "pearson_r")


_SKEW = """
    SELECT cluster_name AS cluster, dim AS axis, mean_z, CASE WHEN mean_z < 0 THEN
           CASE split_part(dim, '_', 1) WHEN 'age' THEN 'young' WHEN 'gender' THEN 'masculine' ELSE 'left wing' END
           ELSE CASE split_part(dim, '_', 1) WHEN 'age' THEN 'old' WHEN 'gender' THEN 'feminine' ELSE 'right wing' END END AS word,
           CASE WHEN mean_z < 0 THEN below ELSE above END AS frac, CASE WHEN mean_z < 0 THEN 20 ELSE 80 END AS pctl FROM (
        SELECT c.cluster_name, p.dim, avg(z.z) AS mean_z, 100.0 * avg(CASE WHEN pctl < 20 THEN 1.0 ELSE 0.0 END) AS below,
               100.0 * avg(CASE WHEN pctl > 80 THEN 1.0 ELSE 0.0 END) AS above
        FROM percentiles_v p JOIN z_v z ON z.id = p.id AND z.dim = p.dim JOIN clustering_v c ON c.id = p.id GROUP BY 1, 2)"""


@query(
    "cluster_skew",
    f"""
    SELECT cluster, axis, word, round(frac, 6) AS frac, pctl, round(mean_z, 6) + 0.0 AS mean_z,
           cluster || ' communities skew ' || word || ' (' || printf('%.0f', frac) || '% are '
           || CASE WHEN mean_z < 0 THEN 'below' ELSE 'above' END || ' the ' || pctl || 'th percentile)' AS "desc"
    FROM ({_SKEW})""",
)
def cluster_skew(v: Views):
    return rounded(stats.skews(v.scores(), v.clustering()), "frac", "mean_z")


@query(
    "bimodality",
    """
    SELECT cluster_name, dim, round(100.0 * avg(CASE WHEN pctl < 20 OR pctl > 80 THEN 1.0 ELSE 0.0 END), 6) AS frac
    FROM percentiles_v p JOIN clustering_v c ON c.id = p.id GROUP BY 1, 2""",
)
def bimodality(v: Views):
    return rounded(stats.bimodality(stats.clustered(stats.percentiles(v.scores()), v.clustering())), "frac")


@query(
    "neutral_cutoff",
    "SELECT round(quantile_cont(score, 0.9), 6) + 0.0 AS quantile FROM scores_v WHERE dim = 'partisan_neutral'",
)
def neutral_cutoff(v: Views):
    return rounded(exact_quantile(v.scores_wide(), "partisan_neutral", 0.9), "quantile")


_ACTIVE = """
    (SELECT p.id, p.z FROM z_v p JOIN scores_v n ON n.id = p.id AND n.dim = 'partisan_neutral'
     WHERE p.dim = 'partisan' AND n.score > (SELECT quantile_cont(score, 0.9) FROM scores_v WHERE dim = 'partisan_neutral'))"""


@query(
    "politics_subset",
    f"""
    SELECT category, id, round(z, 6) + 0.0 AS partisan_dimen FROM {_ACTIVE},
        (VALUES ('all'), ('left'), ('right'), ('center')) c(category)
    WHERE category = 'all' OR (category = 'left' AND z <= -1) OR (category = 'right' AND z >= 1)
       OR (category = 'center' AND z > -1 AND z < 1)""",
)
def politics_subset(v: Views):
    wide, out = settle(v.scores_wide()), None
    cutoff = stats.neutral_cutoff(wide, "partisan", {})
    for category in ("all", "left", "right", "center"):
        part = stats.politics_subset(wide, "partisan", category, cutoff=cutoff).withColumn("category", F.lit(category))
        out = part if out is None else out.unionByName(part)
    return rounded(out.select("category", "id", "partisan_dimen"), "partisan_dimen")


@query(
    "abs_z_subset",
    f"""
    SELECT 'all_unfiltered' AS category, id, round(abs(z), 6) AS partisan_dimen FROM z_v WHERE dim = 'partisan'
    UNION ALL
    SELECT 'published', p.id, round(abs(p.z), 6) FROM z_v p JOIN scores_v n ON n.id = p.id AND n.dim = 'partisan_neutral'
    WHERE p.dim = 'partisan' AND n.score > 0.1""",
)
def abs_z_subset(v: Views):
    wide = settle(v.scores_wide())
    whole = stats.politics_subset(wide, "partisan", "all_unfiltered", absolute=True, view="scores")
    published = stats.politics_subset(wide, "partisan", "all", absolute=True, cutoffs={"partisan": 0.1})
    rows = whole.withColumn("category", F.lit("all_unfiltered")).unionByName(
        published.withColumn("category", F.lit("published"))
    )
    return rounded(rows, "partisan_dimen")


@query(
    "exemplars_asof",
    """
    SELECT dim, step, round(threshold, 6) + 0.0 AS threshold, arg_min(id, {'s': score, 'i': id}) AS id, round(min(score), 6) + 0.0 AS score
    FROM (SELECT s.dim, t.step, CASE WHEN t.step = 19 THEN m.high ELSE m.low + t.step * ((m.high - m.low) / 19.0) END AS threshold, s.id, s.score
          FROM scores_v s JOIN moments_v m ON m.dim = s.dim CROSS JOIN (SELECT unnest(range(20)) AS step) t)
    WHERE score >= threshold GROUP BY 1, 2, threshold""",
)
def exemplars_asof(v: Views):
    return rounded(stats.exemplars(v.scores()), "threshold", "score")


@query(
    "next_submission",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, o_orderkey, CAST(o_orderdate AS DATE) AS next_date
    FROM lineitem ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2)
    ON l_suppkey = o_custkey AND l_shipdate <= o_orderdate""",
)
def next_submission(v: Views):
    """For every comment the first submission of the same number at or after it."""
    lines = v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("k"), "l_shipdate")
    orders = v.orders.select(F.col("o_custkey").alias("k"), "o_orderdate", "o_orderkey")
    found = asof.asof_join(lines, orders, ["k"], "l_shipdate", "o_orderdate", ["o_orderkey"])
    return found.select("l.l_orderkey", "l.l_linenumber", "l.l_partkey", "r.o_orderkey", F.to_date("r.o_orderdate").alias("next_date"))


@query(
    "top_bottom",
    """
    SELECT dim, side, rank, id, round(score, 6) + 0.0 AS score FROM (
        SELECT *, 'lowest' AS side, row_number() OVER (PARTITION BY dim ORDER BY score, id) AS rank FROM scores_v
        UNION ALL
        SELECT *, 'highest', row_number() OVER (PARTITION BY dim ORDER BY score DESC, id) FROM scores_v) WHERE rank <= 50""",
)
def top_bottom(v: Views):
    return rounded(stats.top_bottom(v.scores(), 50), "score")


def _extremes_sql(dim: str, word_dim: str) -> str:
    ranked = "(row_number() OVER (ORDER BY {c}, {k}) <= 8 OR row_number() OVER (ORDER BY {c} DESC, {k}) <= 8)"
    redacted = "regexp_replace(regexp_replace(regexp_replace(word, 'n.gger', 'n-gger', 'g'), 'f.ggot', 'f-ggot', 'g'), 'r.tard', 'r-tard', 'g')"
    return f"""
    SELECT '{dim}' AS dim, item, type, round(score, 6) + 0.0 AS score FROM (
        SELECT id AS item, 'community' AS type, z AS score, {ranked.format(c="score", k="id")} AS keep FROM z_v WHERE dim = '{dim}'
        UNION ALL
        SELECT {redacted}, 'word', ({word_dim} - m.mean) / m.sd, {ranked.format(c=word_dim, k="word")}
        FROM words_scored_v, (SELECT * FROM moments_v WHERE dim = '{word_dim}') m
        WHERE word NOT IN ('the', 'and')) WHERE keep"""


@query("extremes_table", _extremes_sql("partisan", "partisan") + " UNION ALL " + _extremes_sql("gender", "age"))
def extremes_table(v: Views):
    scores, words = v.scores(), v.words_scored()
    ban = v.spark.createDataFrame([("the",), ("and",)], "word string")
    parts = [
        stats.extremes_table(scores, words, dim, 8, ban).select(F.lit(dim).alias("dim"), "item", "type", "score")
        for dim in ("partisan", "gender")
    ]
    return rounded(parts[0].unionByName(parts[1]), "score")


@query("marked_names", "SELECT id, dim, round(z, 6) + 0.0 AS z FROM z_v WHERE id IN ('s1', 's2', 's5', 's6', 's17')")
def marked_names(v: Views):
    names = v.spark.createDataFrame([("s1",), ("s2",), ("s5",), ("s6",), ("s17",)], "id string")
    return rounded(stats.marked_items(v.scores(), names).select("id", "dim", "z"), "z")


@query(
    "export_scores",
    """
    SELECT c.id, c.cluster_name, round(a.pctl, 6) AS age_pctl, round(a.score, 6) + 0.0 AS age_raw,
           round(p.pctl, 6) AS partisan_pctl, round(p.score, 6) + 0.0 AS partisan_raw
    FROM clustering_v c LEFT JOIN percentiles_v a ON a.id = c.id AND a.dim = 'age'
    LEFT JOIN percentiles_v p ON p.id = c.id AND p.dim = 'partisan'""",
)
def export_scores(v: Views):
    out = stats.export_scores(v.scores(), v.clustering(), ["age", "partisan"])
    return rounded(out, "age_pctl", "age_raw", "partisan_pctl", "partisan_raw")
