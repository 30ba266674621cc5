"""Links, hosts and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sharelens.functions import text as T
from sharelens.operators import links, membership
from sharelens.plans.registry import query
from sharelens.plans.views import HOST_FLOOR, PAIR_LIMIT, TOP_HOSTS, Views
from sharelens.session import collect_bounded, scratch_path, settle
from sharelens.sinks import stores
from sharelens.streaming import kept_counts

POST_COLUMNS = ["author", "subreddit", "host", "url", "id", "score"]


@query("author_host_filter", "SELECT author, subreddit, host, url, id, score FROM posts_v")
def author_host_filter(v: Views):
    comments = v.comments().select(POST_COLUMNS)
    return links.drop_heavy_pairs(comments, links.heavy_pairs(comments, PAIR_LIMIT))


@query("bucketed_posts", "SELECT author, subreddit, host, url, id, score FROM posts_v")
def bucketed_posts(v: Views):
    path = scratch_path(v.spark, "posts")
    name = "posts_" + path.rsplit("-", 1)[-1]
    stored = stores.write_bucketed(v.comments().select(POST_COLUMNS), name, path, ["author", "host"], 16)
    return stores.light_posts(stored, PAIR_LIMIT)


@query("kept_host_counts", "SELECT host, subreddit, count(*) AS count FROM posts_v GROUP BY host, subreddit")
def kept_host_counts(v: Views):
    """Year by year, one of them twice."""
    path = scratch_path(v.spark, "kept")
    comments = settle(v.comments().select("author", "host", "subreddit", F.substring("month", 1, 4).alias("year")))
    years = [r["year"] for r in collect_bounded(comments.select("year").distinct().orderBy("year"), 100, "years")]
    for year in [*years, years[0]]:
        kept_counts.replace_parts(comments.where(F.col("year") == year), path, F.col("year"))
    return kept_counts.kept_counts(v.spark, path, PAIR_LIMIT)


@query(
    "host_totals",
    "SELECT host, CAST(sum(n) AS BIGINT) AS sum_count FROM light_pairs_v GROUP BY host ORDER BY 2 DESC, 1",
)
def host_totals(v: Views):
    return links.ranked_hosts(links.host_totals(v.comments(), PAIR_LIMIT))


@query(
    "host_totals_floor",
    f"""
    SELECT p.author, p.subreddit, p.host, p.url, p.id, p.score, l.labels
    FROM posts_v p JOIN host_labels_v l ON l.host = p.host
    WHERE p.host NOT IN ('reddit.com', 'old.reddit.com', 'new.reddit.com')
      AND p.host IN (SELECT 'p' || p_partkey || '.com' FROM part WHERE p_size > 5)
      AND p.host IN (SELECT host FROM light_pairs_v GROUP BY host HAVING sum(n) > {HOST_FLOOR})""",
)
def host_totals_floor(v: Views):
    allowed = v.part.where("p_size > 5").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".com")).alias("host")
    )
    meta = v.host_labels().select("host", "labels")
    return links.select_link_posts(
        v.comments().select(POST_COLUMNS), meta, allowed, PAIR_LIMIT, HOST_FLOOR
    ).select(*POST_COLUMNS, "labels")


@query(
    "long_host_list",
    """
    SELECT host, count(*) AS posts, CAST(sum(score) AS BIGINT) AS score FROM comments_v
    WHERE host IN (SELECT 'p' || p_partkey || '.com' FROM part WHERE p_size > 5) GROUP BY host""",
)
def long_host_list(v: Views):
    """The allow-list through the Bloom filter, whatever its length."""
    allowed = v.part.where("p_size > 5").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".com")).alias("host")
    )
    listed = membership.keep_listed(v.comments().select("host", "score"), allowed, "host", 0)
    return listed.groupBy("host").agg(F.count(F.lit(1)).alias("posts"), F.sum("score").alias("score"))


@query("host_sub_counts", "SELECT host, subreddit, count(*) AS count FROM posts_v GROUP BY host, subreddit")
def host_sub_counts(v: Views):
    return links.host_sub_counts(v.comments(), PAIR_LIMIT)


@query(
    "top_host_counts",
    """
    SELECT c.host, c.subreddit, c.count FROM host_sub_counts_v c JOIN top_hosts_v t ON t.host = c.host""",
)
def top_host_counts(v: Views):
    return links.counts_of_top_hosts(v.host_counts(), TOP_HOSTS).select(
        "host", "subreddit", "count"
    )


@query("page_hosts", f"SELECT page_id, regexp_extract(url, '{T.HOST_PATTERN}', 3) AS host FROM pages")
def page_hosts(v: Views):
    return links.with_host(v.pages.select("page_id", "url")).select("page_id", "host")


# RE2 has no lookahead, so the SQL consumes what the pattern only looks at
_URL_SQL = T.URL_PATTERN.replace("(?=[", "(?:[").replace("'", "''")


@query(
    "extract_links",
    f"""
    SELECT page_id, regexp_extract(body, '{_URL_SQL}', 1) AS url, regexp_extract(body, '{_URL_SQL}', 2) AS compat_url
    FROM (SELECT page_id, 'see ' || url || ' now' AS body FROM pages)
    WHERE body LIKE '%http://%' OR body LIKE '%https://%'""",
)
def extract_links(v: Views):
    body = F.concat(F.lit("see "), "url", F.lit(" now"))
    texts = v.pages.select("page_id", body.alias("body"))
    found = links.link_comments(texts)
    return found.select("page_id", "url", T.extract_url(F.col("body"), compat=True).alias("compat_url"))


@query(
    "all_page_links",
    f"""
    SELECT page_id, unnest(regexp_extract_all(html, '{_URL_SQL}', 1)) AS url FROM pages""",
)
def all_page_links(v: Views):
    return v.pages.select("page_id", F.explode(T.extract_all_urls(F.col("html"))).alias("url"))
