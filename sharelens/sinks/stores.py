"""Tables stored by bucket, so that later counts and joins on the bucket columns need no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Stores ``df`` as an external table of ``buckets`` sorted files by the hash of ``keys`` and returns it.

    One shuffle by the same hash comes first, so every task writes one file. Choose the number so that a bucket fits a task at the size
    to come: 100 TB in 100,000 buckets is 1 GB each. A single key is never split; where one pair may hold more than that, use ``host_sub_counts``.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def light_posts(stored: DataFrame, pair_limit: int = 20) -> DataFrame:
    """Posts of light pairs from a table bucketed by (author, host): pairs are counted where they lie, and no row moves.

    A window over the bucket columns counts and joins back in one; NULL keys match as values.
    """
    of_pair = F.count(F.lit(1)).over(Window.partitionBy("author", "host"))
    return stored.withColumn("__n", of_pair).where(F.col("__n") < pair_limit).drop("__n")
