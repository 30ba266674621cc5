"""Incremental dump import: the batch projections over a file stream.

Monthly files arrive as batches; a file stream with ``availableNow`` imports
each new file once and remembers it in its checkpoint, so a rerun after a lost
driver neither skips nor repeats a month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sharelens.sources.dumps import SCHEMAS, project_comments, project_submissions


def stream_dump(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    raw = spark.readStream.schema(SCHEMAS[kind]).option("encoding", "UTF-8").json(folder)
    return project_comments(raw) if kind == "comments" else project_submissions(raw)


def import_new_files(spark: SparkSession, folder: str, kind: str, table: str, checkpoint: str) -> StreamingQuery:
    """Append the files that arrived since the last run, then stop."""
    writer = stream_dump(spark, folder, kind).writeStream.format("parquet").outputMode("append")
    return (
        writer.option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
