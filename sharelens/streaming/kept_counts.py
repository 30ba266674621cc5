"""Counts that are kept up to date while files arrive.

What is stored are partial counts by (author, host, community), one partition folder for each part of the input (a month, a dump file). Importing a part
replaces its folder, so a part that comes twice changes nothing, and partial counts add up in any order. The pair limit
holds over all parts at once, therefore it is applied when the counts are read, to sums, never to a part alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sharelens.operators.links import counts_of_light_pairs
from sharelens.sinks.writers import replace_months

PARTS = "author string, host string, subreddit string, n bigint, part string"


def replace_parts(comments: DataFrame, path: str, part: Column) -> None:
    """Counts ``comments`` (author, host, subreddit) by ``part`` and replaces the folders of the parts that occur in them."""
    counted = comments.withColumn("part", part).groupBy("part", "author", "host", "subreddit").agg(F.count(F.lit(1)).alias("n"))
    # a part's rows lie in as many files as tasks; few, since they are counted
    replace_months(counted.select("author", "host", "subreddit", "n", "part"), path, "part")


def kept_counts(spark: SparkSession, path: str, pair_limit: int | None = 20) -> DataFrame:
    """``host, subreddit, count`` over all imported parts, pairs of (author, host) at the limit left out: what one batch run over all comments gives."""
    parts = spark.read.schema(PARTS).parquet(path)
    return counts_of_light_pairs(parts.groupBy("author", "host", "subreddit").agg(F.sum("n").alias("n")), pair_limit)


def keep_counting(comments: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Imports the files of a stream of comments (author, host, subreddit, part) that arrived since the last run, then stops.

    ``part`` names the file (``_metadata.file_name``), so a batch that is tried again, or a file that is delivered again, replaces its own
    counts. A file must not be split over batches, which file streams never do.
    """

    def keep(batch: DataFrame, _: int) -> None:
        replace_parts(batch, path, F.col("part"))

    return comments.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
