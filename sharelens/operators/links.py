"""From comments to host x community counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sharelens.functions.text import SITE_HOSTS, extract_host, extract_url, has_link
from sharelens.operators.membership import keep_listed
from sharelens.session import settle, settle_small

MAX_BROADCAST_PAIRS = 1_000_000


def link_comments(comments: DataFrame, body: str = "body", compat: bool = False) -> DataFrame:
    """Comments that hold a link, with the first URL of the body as ``url``."""
    return comments.where(has_link(F.col(body))).withColumn(
        "url", extract_url(F.col(body), compat)
    )


def with_host(comments: DataFrame, url: str = "url", normalize: bool = False) -> DataFrame:
    return comments.withColumn("host", extract_host(F.col(url), normalize))


def pair_counts(comments: DataFrame) -> DataFrame:
    """Posts per (author, host)."""
    return comments.groupBy("author", "host").agg(F.count(F.lit(1)).alias("count"))


def light_pairs(comments: DataFrame, pair_limit: int = 20) -> DataFrame:
    """(author, host) pairs with fewer than ``pair_limit`` posts."""
    return pair_counts(comments).where(F.col("count") < pair_limit)


def heavy_pairs(comments: DataFrame, pair_limit: int = 20) -> DataFrame:
    return pair_counts(comments).where(F.col("count") >= pair_limit).drop("count")


def drop_heavy_pairs(df: DataFrame, heavy: DataFrame) -> DataFrame:
    """Rows whose (author, host) is not heavy, NULL keys matched as values.

    Each heavy pair stands for at least ``pair_limit`` posts, so this side is
    far smaller than the rows. It is settled and counted: a short list is
    broadcast and the rows do not move; otherwise Spark joins by shuffle and
    splits a hot pair on the row side.
    """
    return _without(df, settle_small(heavy, MAX_BROADCAST_PAIRS))


def _without(df: DataFrame, heavy: DataFrame) -> DataFrame:
    heavy = heavy.select(F.col("author").alias("__a"), F.col("host").alias("__h"))
    same = F.col("author").eqNullSafe(F.col("__a")) & F.col("host").eqNullSafe(F.col("__h"))
    return df.join(heavy, same, "left_anti")


def host_totals(comments: DataFrame, pair_limit: int = 20) -> DataFrame:
    """Posts per host over the light pairs."""
    return light_pairs(comments, pair_limit).groupBy("host").agg(
        F.sum("count").alias("sum_count")
    )


def ranked_hosts(totals: DataFrame) -> DataFrame:
    return totals.orderBy(F.desc("sum_count"), "host")


def drop_site_hosts(df: DataFrame) -> DataFrame:
    """Without the site's own hosts; a NULL host goes too."""
    return df.where(~F.col("host").isin(SITE_HOSTS))


def keep_hosts(df: DataFrame, hosts: DataFrame, max_broadcast: int = 100_000) -> DataFrame:
    """Rows whose host is listed. A short list is broadcast after it was counted, a longer one becomes a Bloom filter first."""
    return keep_listed(df, hosts, "host", max_broadcast)


def select_link_posts(
    comments: DataFrame,
    host_meta: DataFrame | None = None,
    allowed: DataFrame | None = None,
    pair_limit: int = 20,
    host_floor: int = 200,
) -> DataFrame:
    """Posts that survive the pair limit, the allow-list, the site filter and the host floor.

    Site filter and allow-list depend on the host alone, so they come before the pair counts: the hottest
    hosts are never counted or shuffled. Reads ``comments`` twice, once for the counts; hosts that have
    enough posts are all allowed, so the second pass need not look at the allow-list again.
    """
    # filters are not moved below a generator, so a host that is cut out of a URL is cut out once a row
    # and not once for every mention of it in the filters
    comments = comments.withColumn("host", F.explode(F.array("host")))
    posts = every = drop_site_hosts(comments)
    if allowed is not None:
        posts = keep_hosts(posts, allowed)
    pairs = settle(pair_counts(posts))
    light = pairs.where(F.col("count") < pair_limit).groupBy("host").agg(F.sum("count").alias("total"))
    enough = light.where(F.col("total") > host_floor).select("host")
    heavy = pairs.where(F.col("count") >= pair_limit).drop("count")
    posts = _without(keep_hosts(every, enough), settle_small(heavy, MAX_BROADCAST_PAIRS))
    if host_meta is not None:
        posts = posts.join(host_meta, "host")
    return posts


def host_sub_counts(comments: DataFrame, pair_limit: int | None = 20) -> DataFrame:
    """``host, subreddit, count`` over posts of light pairs; one pass over ``comments``, one plan for every size.

    Rows are counted by (author, host, subreddit) where they are read; a window adds up the few rows that
    are left of each pair, so even a pair with a third of all posts is no more than its communities. Filter
    hosts before, not after.
    """
    if pair_limit is None:
        return comments.groupBy("host", "subreddit").agg(F.count(F.lit(1)).alias("count"))
    return counts_of_light_pairs(comments.groupBy("author", "host", "subreddit").agg(F.count(F.lit(1)).alias("n")), pair_limit)


def counts_of_light_pairs(counted: DataFrame, pair_limit: int | None) -> DataFrame:
    """``host, subreddit, count`` from counts ``n`` by (author, host, subreddit), pairs of (author, host) at the limit left out."""
    if pair_limit is None:
        return counted.groupBy("host", "subreddit").agg(F.sum("n").alias("count"))
    of_pair = F.sum("n").over(Window.partitionBy("author", "host"))
    light = counted.withColumn("of_pair", of_pair).where(F.col("of_pair") < pair_limit)
    return light.groupBy("host", "subreddit").agg(F.sum("n").alias("count"))


def host_post_totals(counts: DataFrame) -> DataFrame:
    """Posts per host from ``host, subreddit, count``."""
    return counts.groupBy("host").agg(F.sum("count").alias("sum_count"))


def top_hosts(counts: DataFrame, limit: int = 10_000) -> DataFrame:
    """The ``limit`` most posted hosts, ties by name."""
    return ranked_hosts(host_post_totals(counts)).limit(limit)


def counts_of_top_hosts(counts: DataFrame, limit: int = 10_000) -> DataFrame:
    """Counts of the most posted hosts; reads ``counts`` twice, so pass a stored table."""
    return keep_hosts(counts, top_hosts(counts, limit))
