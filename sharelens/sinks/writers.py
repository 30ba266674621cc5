"""Writing tables, embeddings, dimensions and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_table(df: DataFrame, path: str) -> None:
    """Append parquet; running twice duplicates rows."""
    df.write.mode("append").parquet(path)


def replace_months(df: DataFrame, path: str, column: str = "month") -> None:
    """Write months as partitions and replace only those present, so a rerun is safe."""
    df.write.mode("overwrite").partitionBy(column).option("partitionOverwriteMode", "dynamic").parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", header).option("escape", '"').csv(path)


def write_embedding(embedding: DataFrame, vectors_path: str, meta_path: str, order_by: str = "id") -> None:
    """Vectors TSV without header and metadata TSV, both in ``order_by`` order.

    The order is total, so the concatenated part files of both folders line up
    row by row whatever the partition bounds are.
    """
    vectors = embedding.select(
        order_by, F.array_join(F.transform("vec", lambda x: x.cast("string")), "\t").alias("value")
    )
    vectors.orderBy(order_by).select("value").write.mode("overwrite").text(vectors_path)
    write_csv(embedding.drop("vec").orderBy(order_by), meta_path, sep="\t")


def save_dimension(dimension: DataFrame, path: str) -> None:
    """Add rows to the dimension table."""
    dimension.write.mode("append").parquet(path)


def save_word_pmi(words: DataFrame, path: str, cluster: str = "cluster") -> None:
    """``cluster, word, pmi, count`` with the count inside the cluster."""
    words.select(cluster, "word", "pmi", F.col("n_wc").alias("count")).write.mode("overwrite").parquet(path)


def save_clustering(clustering: DataFrame, path: str) -> None:
    write_csv(
        clustering.select(F.col("id").alias("host"), "cluster_id", "cluster_name").orderBy("host"), path
    )


def save_names(names: DataFrame, path: str) -> None:
    """Distinct names, one per line."""
    names.select("id").distinct().write.mode("overwrite").text(path)


def save_report(blocks: DataFrame, path: str) -> None:
    """Report text blocks in cluster order."""
    blocks.orderBy("cluster").select("text").write.mode("overwrite").text(path)


def export_source_data(tables: dict[str, DataFrame], folder: str, name: str) -> None:
    """One CSV folder per figure table."""
    for key, df in tables.items():
        write_csv(df, f"{folder}/{name}_{key}.csv")
