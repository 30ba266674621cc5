"""Delimited files whose row order matters, and plain table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sharelens.session import settle, settle_small


class Tables:
    """Parquet tables below a folder, registered as views and remembered by name."""

    def __init__(self, spark: SparkSession, root: str, suffix: str = ".parquet", cache: bool = False):
        self.spark, self.root, self.suffix, self.cache = spark, root.rstrip("/"), suffix, cache
        self._loaded: dict[str, DataFrame] = {}

    def load(self, name: str) -> DataFrame:
        if name not in self._loaded:
            df = self.spark.read.parquet(f"{self.root}/{name}{self.suffix}")
            if self.cache:
                df = df.cache()
            df.createOrReplaceTempView(name)
            self._loaded[name] = df
        return self._loaded[name]

    def release(self) -> None:
        for name, df in self._loaded.items():
            if self.cache:
                df.unpersist()
            self.spark.catalog.dropTempView(name)
        self._loaded.clear()


def read_csv(spark: SparkSession, paths: list[str] | str, schema: str, sep: str = ",", **options) -> DataFrame:
    """CSV with a header and an explicit schema."""
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("escape", '"')
    return reader.options(**options).csv(paths)


def add_row_number(df: DataFrame, name: str = "row") -> DataFrame:
    """0-based row number over the files in path order.

    ``df`` is a fresh file scan. One settled numbering gives both the rows' ids and the offsets of their
    blocks, so it does not matter how Spark packs blocks into tasks. The offsets have one row per file block.
    """
    marked = settle(
        df.withColumns(
            {
                "__path": F.col("_metadata.file_path"),
                "__start": F.col("_metadata.file_block_start"),
                "__id": F.monotonically_increasing_id(),
            }
        )
    )
    blocks = marked.groupBy("__path", "__start").agg(
        F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    before = Window.orderBy("__path", "__start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "__path", "__start", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift")
    )
    placed = marked.join(settle_small(offsets), ["__path", "__start"])
    return placed.select(*df.columns, (F.col("__id") + F.col("__shift")).alias(name))


def read_csv_below(
    spark: SparkSession, path: str, columns: list[str], header_row: int, encoding: str = "UTF-8", sep: str = ","
) -> DataFrame:
    """CSV whose header is not on the first line; columns are named by the caller."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.schema(schema).option("encoding", encoding).option("sep", sep).option("escape", '"').csv(path)
    return add_row_number(raw, "__row").where(F.col("__row") > header_row).drop("__row")


def read_transposed(spark: SparkSession, path: str, columns: list[str], encoding: str = "UTF-8") -> DataFrame:
    """Two-row CSV (labels, values) turned into ``label, value`` rows."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = add_row_number(
        spark.read.schema(schema).option("encoding", encoding).option("escape", '"').csv(path), "__row"
    ).where(F.col("__row") > 0)
    long = rows.unpivot(["__row"], [f"`{c}`" for c in columns], "code", "cell")
    return long.groupBy("code").agg(
        F.max(F.when(F.col("__row") == 1, F.col("cell"))).alias("label"),
        F.max(F.when(F.col("__row") == 2, F.col("cell"))).alias("value"),
    )


def read_names(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Name lists, one name per line."""
    return spark.read.text(paths).select(F.nullif(F.trim("value"), F.lit("")).alias("id")).where("id is not null")


def load_clustering(spark: SparkSession, path: str) -> DataFrame:
    """``id, cluster_id, cluster_name`` from a CSV keyed by host."""
    df = read_csv(spark, path, "host string, cluster_id int, cluster_name string")
    return df.withColumnRenamed("host", "id")


def query_data(
    df: DataFrame,
    where: str,
    limit: int | None = None,
    select: str = "*",
    sample: bool = False,
    seed: int | None = None,
    key: str | None = None,
    order_by: list[str] | None = None,
) -> DataFrame:
    """Ad-hoc query: predicate, columns, optional limit and 5 % sample.

    With ``key``, an expression that tells rows apart, the sample is decided by a digest of it, so it is
    the same on every run and engine; ``order_by``, if total, makes a limit reproducible as well.
    """
    if sample and key is not None:
        df = df.where(F.conv(F.substring(F.md5(F.expr(key)), 1, 8), 16, 10).cast("bigint") < F.lit(int(0.05 * 2**32)))
    elif sample:
        df = df.sample(False, 0.05, seed)
    if order_by:
        df = df.orderBy(*order_by) if limit is not None else df
    df = df.where(where).selectExpr(select) if select == "*" else df.where(where).select(F.expr(f"struct({select}) as s")).select("s.*")
    return df if limit is None else df.limit(limit)
