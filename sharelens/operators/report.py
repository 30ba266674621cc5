"""Cluster report: top communities, hosts, closest hosts and words of each cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharelens.session import settle_small

SECTIONS = {
    "pmi": "Top PMI with post threshold:",
    "posts": "Top Subreddits with PMI threshold:",
    "hosts": "Most posted sites:",
    "closest": "Hosts with closest cosine similarity to centroid:",
    "word_pmi": "Top 10 PMI words with count in cluster threshold:",
    "word_count": "Top 10 Count words with PMI in cluster threshold:",
}


def section(df: DataFrame, name: str, cluster: str, item: str, v1: str, v2: str | None = None) -> DataFrame:
    """A ranked table as report rows ``cluster, section, rank, item, v1, v2``."""
    second = F.col(v2).cast("double") if v2 else F.lit(None).cast("double")
    return df.select(
        F.col(cluster).cast("int").alias("cluster"),
        F.lit(name).alias("section"),
        F.col("rank").cast("int").alias("rank"),
        F.col(item).alias("item"),
        F.col(v1).cast("double").alias("v1"),
        second.alias("v2"),
    )


def cluster_report(clusters: DataFrame, sections: list[DataFrame], n: int = 10) -> DataFrame:
    """All sections in long form, padded with ``N/A`` to ``n`` ranks each.

    ``clusters`` has one row per ``cluster``; the sections are top-n tables, so
    everything here is clusters x sections x n rows.
    """
    rows = sections[0]
    for part in sections[1:]:
        rows = rows.unionByName(part)
    names = F.array(*[F.lit(s) for s in SECTIONS])
    grid = (
        clusters.select(F.col("cluster").cast("int").alias("cluster"))
        .select("cluster", F.explode(names).alias("section"))
        .select("cluster", "section", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rank"))
    )
    joined = grid.join(rows, ["cluster", "section", "rank"], "left")
    return joined.select(
        "cluster", "section", "rank", F.coalesce("item", F.lit("N/A")).alias("item"), "v1", "v2"
    )


def _number(value: Column) -> Column:
    """A count as it is, anything else with six digits; missing values as ``N/A``."""
    return F.when(value.isNull(), "N/A").otherwise(F.format_string("%.6f", value))


def report_text(report: DataFrame, sizes: DataFrame) -> DataFrame:
    """``cluster, text``: one block per cluster; ``sizes`` has ``cluster, cluster_name, size``."""
    count = lambda c: F.coalesce(F.col(c).cast("bigint").cast("string"), F.lit("N/A"))
    rank = F.concat(F.col("rank").cast("string"), F.lit(" - "))
    line = (
        F.when(F.col("section") == "pmi", F.concat(rank, F.lit("Subreddit: "), "item", F.lit(", PMI: "), _number(F.col("v1")), F.lit(", Subreddit count: "), count("v2")))
        .when(F.col("section") == "posts", F.concat(rank, F.lit("Subreddit: "), "item", F.lit(", Subreddit count: "), count("v1"), F.lit(", PMI: "), _number(F.col("v2"))))
        .when(F.col("section") == "hosts", F.concat(rank, F.lit("Host: "), "item", F.lit(", Post Count: "), count("v1")))
        .when(F.col("section") == "closest", F.concat(rank, F.lit("Host: "), "item", F.lit(", Label: "), count("v1"), F.lit(", Distance: "), _number(F.col("v2"))))
        .when(F.col("section") == "word_pmi", F.concat(rank, F.lit("Word: "), "item", F.lit(", PMI to cluster: "), _number(F.col("v1")), F.lit(", Count in cluster: "), count("v2")))
        .otherwise(F.concat(rank, F.lit("Word: "), "item", F.lit(", Count in cluster: "), count("v1"), F.lit(", PMI in cluster: "), _number(F.col("v2"))))
    )
    order = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    titles = F.create_map(*[F.lit(x) for item in SECTIONS.items() for x in item])
    titled = F.when(F.col("rank") == 1, F.concat(titles[F.col("section")], F.lit("\n"), line)).otherwise(line)
    blocks = report.groupBy("cluster").agg(
        F.array_sort(F.collect_list(F.struct(order.alias("o"), "rank", titled.alias("line")))).alias("rows")
    )
    head = F.format_string(
        "----------Cluster: %d (Desc: %s), Size: %d----------\n", "cluster", F.coalesce("cluster_name", F.lit("N/A")), "size"
    )
    return blocks.join(settle_small(sizes), "cluster").select(
        "cluster",
        F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("text"),
    )
