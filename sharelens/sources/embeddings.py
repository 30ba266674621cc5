"""Embeddings and dimensions on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharelens.functions.vectors import unit
from sharelens.operators.dimensions import rename_stored
from sharelens.session import settle_small
from sharelens.sources.files import add_row_number, read_csv


def not_nsfw(meta: DataFrame, column: str = "over18") -> DataFrame:
    return meta.where(F.lower(F.col(column).cast("string")) == "false")


def load_embedding(
    spark: SparkSession,
    vectors_path: str,
    meta_path: str,
    meta_schema: str,
    id_column: str,
    normalised: bool = True,
    filter_nsfw: bool = False,
) -> DataFrame:
    """Vectors TSV (no header) and metadata TSV, matched by row position.

    Returns ``id, vec`` and the other metadata columns. Both files get an
    explicit row number and meet in an equi-join.
    """
    vectors = add_row_number(spark.read.text(vectors_path)).select(
        "row", F.transform(F.split("value", "\t"), lambda x: x.cast("double")).alias("vec")
    )
    meta = add_row_number(read_csv(spark, meta_path, meta_schema, sep="\t"))
    if filter_nsfw:
        meta = not_nsfw(meta)
    out = meta.join(vectors, "row").drop("row").withColumnRenamed(id_column, "id")
    if normalised:
        out = out.withColumn("vec", unit("vec"))
    rest = [c for c in out.columns if c not in ("id", "vec")]
    return out.select("id", "vec", *rest)


def load_dimensions(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Stored dimensions, optionally only the listed ones in list order.

    A list entry may carry a folder; its last part is the name.
    """
    dims = rename_stored(spark.read.parquet(path))
    if names is None:
        return dims
    listed = [(i, n.strip().split("/")[-1]) for i, n in enumerate(names)]
    wanted = spark.createDataFrame(listed, "ord int, name string")
    return dims.join(settle_small(wanted), "name").orderBy("ord").drop("ord")


def load_word_pmi(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
