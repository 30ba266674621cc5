"""One query from comments to the hosts with the highest score on a dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharelens.operators import links, stats
from sharelens.operators import vectors as ops
from sharelens.plans.registry import query
from sharelens.plans.views import PAIR_LIMIT, WIDTH, Views, rounded
from sharelens.session import settle


def host_leaning(v: Views) -> DataFrame:
    """Hosts at both ends of the partisan dimension, from raw comments."""
    counts = settle(links.host_sub_counts(links.drop_site_hosts(v.comments()), PAIR_LIMIT))
    top = links.counts_of_top_hosts(counts, 10_000)
    hosts = ops.host_vectors(top, v.vectors().select("id", "vec"), WIDTH).withColumnRenamed("host", "id")
    scores = ops.score(hosts, v.dimensions().where(F.col("name") == "partisan"))
    return rounded(stats.top_bottom(scores, 20), "score")


@query(
    "host_leaning",
    """
    SELECT 'partisan' AS dim, side, rank, host AS id, round(score, 6) + 0.0 AS score FROM (
        SELECT host, score, 'lowest' AS side, row_number() OVER (ORDER BY score, host) AS rank FROM scored
        UNION ALL
        SELECT host, score, 'highest', row_number() OVER (ORDER BY score DESC, host) FROM scored) WHERE rank <= 20""",
    """
    counted AS (SELECT host, subreddit, count(*) AS count FROM posts_v
                WHERE host NOT IN ('reddit.com', 'old.reddit.com', 'new.reddit.com') GROUP BY 1, 2),
    kept AS (SELECT host FROM counted GROUP BY host ORDER BY sum(count) DESC, host LIMIT 10000),
    summed AS (SELECT host, pos, sum(v * count) AS v FROM (
        SELECT c.host, c.count, unnest(e.vec) AS v, unnest(range(64)) AS pos FROM counted c JOIN kept k ON k.host = c.host
        JOIN vectors_v e ON e.id = c.subreddit) GROUP BY 1, 2),
    host_vecs AS (SELECT host, list(v ORDER BY pos) AS vec FROM summed GROUP BY host),
    scored AS (SELECT host, list_inner_product(h.vec, d.vec) / sqrt(list_inner_product(h.vec, h.vec)) AS score
               FROM host_vecs h, dimensions_v d WHERE d.dim = 'partisan')""",
)
def _host_leaning(v: Views) -> DataFrame:
    return host_leaning(v)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_leaning(Views(spark, sf_dir))
