"""What several corpus operators share: words, stable keys, held-out folds, counted broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space between words, as a character class for Java's and DuckDB's patterns.
SPACE = r"[\x20\x09-\x0D]"


def text_of(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; -1 where there is no id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts, F.lit(-1))


def small(settled: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a settled table that was counted; a larger one keeps Spark's shuffle join."""
    return F.broadcast(settled) if settled.count() <= rows else settled


def packed(docs: DataFrame, *names: str | Column) -> DataFrame:
    """``docs`` as one struct column ``doc`` next to the named columns, so that no other name can clash."""
    fields = (F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(docs.columns))
    return docs.select(F.struct(*fields).alias("doc"), *names)


def unpacked(df: DataFrame, columns: list[str], changed: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """The columns that ``packed`` put away, each passed through its function in ``changed`` if it has one."""
    same = lambda x: x
    return df.select(*((changed or {}).get(c, same)(F.col(f"doc.d{i}")).alias(c) for i, c in enumerate(columns)))


def per_batch(
    df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], dict], piece_bytes: int = 8 << 20
) -> DataFrame:
    """``mapInArrow`` over pieces of about ``piece_bytes``, so that long texts do not add up in a worker.

    ``work`` gets a record batch and returns the columns of its result by name. A single row
    larger than the piece is a piece of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * piece_bytes // max(batch.nbytes, piece_bytes))
            for start in range(0, batch.num_rows, rows):
                out = work(batch.slice(start, rows))
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c) for c in out.values()], list(out)
                )

    return df.mapInArrow(run, schema)


def learnable(labels: DataFrame, label: str, parts: int, held: int) -> DataFrame:
    """Labels one may learn from, one row per document (``_id``, ``label``); of repeated labels the largest counts.

    Rows whose fold is ``held`` and rows without id or label take no part.
    """
    known = labels.select("doc_id", label).where(F.col(label).isin(0, 1) & ~fold(F.col("doc_id"), parts).isin(held, -1))
    return known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).alias("label"))


def class_counts(known: DataFrame) -> tuple[int, int]:
    """How many documents have label 0 and label 1."""
    return tuple(known.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first())


def labelled_sample(docs: DataFrame, known: DataFrame, counts: tuple[int, int], per_class: int) -> DataFrame:
    """Texts and labels to learn from: (text, label), at most ``per_class`` documents of each label.

    Documents with the smallest id hashes are taken, so reruns agree. A threshold on the hash, a little
    above what the counts ask for, comes first: the ranking sees about as many rows as it keeps, however
    many labels there are. The sample is bounded, hence its broadcast.
    """
    place = F.shiftrightunsigned(F.xxhash64("_id"), 11) / F.lit(float(1 << 53))
    near = [min(1.0, (1.2 * per_class + 50) / max(1, n)) for n in counts]
    few = known.withColumn("_place", place).where(F.col("_place") <= F.when(F.col("label") == 1, near[1]).otherwise(near[0]))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("_place", "_id"))
    chosen = few.withColumn("_rank", rank).where(F.col("_rank") <= per_class).select("_id", "label")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(text_of().alias("text"), "label")
