"""Pointwise mutual information of communities or words with clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sharelens.functions.text import english_stop_words, remove_urls, tokens
from sharelens.session import settle


def pmi(counts: DataFrame, x: str, y: str, count: str = "count") -> DataFrame:
    """``x, y, count, x_count, y_count, pmi`` with natural logarithm.

    Marginals come from the pair table, which is already reduced, by grouped
    sums; a window per label would hold a large label in one task. Communities
    whose name contains ``u_`` leave the result but stay in the totals.
    """
    # read four times below: settled, so that the rows behind it are read once
    xy = settle(counts.groupBy(x, y).agg(F.sum(count).alias("count")))
    x_total = xy.groupBy(x).agg(F.sum("count").alias(f"{x}_count"))
    y_total = xy.groupBy(y).agg(F.sum("count").alias(f"{y}_count"))
    n = xy.agg(F.sum("count").cast("double")).scalar()
    out = xy.join(x_total, x).join(y_total, y)
    out = out.withColumn(
        "pmi", F.log(n * F.col("count") / (F.col(f"{x}_count").cast("double") * F.col(f"{y}_count")))
    )
    if "subreddit" in (x, y):
        out = out.where(~F.col("subreddit").contains("u_"))
    return out.select(x, y, "count", f"{x}_count", f"{y}_count", "pmi")


def top_per_cluster(df: DataFrame, cluster: str, order: list, n: int = 10) -> DataFrame:
    """First ``n`` rows per cluster; Spark cuts each task to ``n`` before the shuffle."""
    window = Window.partitionBy(cluster).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def top_communities_by_pmi(pairs: DataFrame, cluster: str = "labels", floor: int = 1_000, n: int = 10) -> DataFrame:
    kept = pairs.where(F.col("subreddit_count") > floor)
    return top_per_cluster(kept, cluster, [F.desc("pmi"), "subreddit"], n)


def top_communities_by_posts(pairs: DataFrame, cluster: str = "labels", floor: float = 3.0, n: int = 10) -> DataFrame:
    kept = pairs.where(F.col("pmi") > floor)
    return top_per_cluster(kept, cluster, [F.desc("subreddit_count"), "subreddit"], n)


def word_counts(
    texts: DataFrame,
    cluster: str = "cluster",
    text: str = "body",
    stop_words: list[str] | None = None,
    vocabulary: DataFrame | None = None,
    latin_only: bool = True,
) -> DataFrame:
    """``cluster, word, n_wc`` for all clusters in one job.

    Filters that look at one word run on the token stream, before the map-side
    counting; the vocabulary join sees only the counted words.
    """
    if stop_words is None:
        stop_words = english_stop_words(texts.sparkSession)
    found = tokens(remove_urls(F.col(text)), latin_only)
    words = texts.select(cluster, F.explode(found).alias("word"))
    if stop_words:
        words = words.where(~F.col("word").isin(list(stop_words)))
    counted = words.groupBy(cluster, "word").agg(F.count(F.lit(1)).alias("n_wc"))
    if vocabulary is not None:
        counted = counted.join(vocabulary.select("word"), "word", "left_semi")
    return counted.select(cluster, "word", "n_wc")


def word_pmi(counted: DataFrame, cluster: str = "cluster", floor: int = 500) -> DataFrame:
    """``cluster, word, n_wc, n_w, n_c, pmi``; the floor on n_w only hides rows."""
    counted = settle(counted)  # read four times; the texts behind it only once
    n_c = counted.groupBy(cluster).agg(F.sum("n_wc").alias("n_c"))
    n_w = counted.groupBy("word").agg(F.sum("n_wc").alias("n_w")).where(F.col("n_w") >= floor)
    n = counted.agg(F.sum("n_wc").cast("double")).scalar()
    joined = counted.join(n_w, "word").join(n_c, cluster)
    value = F.log(n * F.col("n_wc") / (F.col("n_c").cast("double") * F.col("n_w")))
    return joined.select(cluster, "word", "n_wc", "n_w", "n_c", value.alias("pmi"))


def top_words_by_pmi(words: DataFrame, cluster: str = "cluster", floor: int = 10_000, n: int = 10) -> DataFrame:
    kept = words.where(F.col("n_wc") > floor)
    return top_per_cluster(kept, cluster, [F.desc("pmi"), "word"], n)


def top_words_by_count(words: DataFrame, cluster: str = "cluster", floor: float = 3.0, n: int = 10) -> DataFrame:
    kept = words.where(F.col("pmi") > floor)
    return top_per_cluster(kept, cluster, [F.desc("n_wc"), "word"], n)
