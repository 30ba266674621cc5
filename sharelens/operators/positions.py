"""Exact positions in a total order without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharelens.session import settle, settle_small

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def with_position(
    df: DataFrame,
    order_by: Sequence[Column | str],
    group_by: Sequence[str] = (),
    name: str = "position",
) -> DataFrame:
    """Add the 0-based position of each row in ``order_by``, per group if given.

    ``order_by`` must be total (end it with a unique key). Rows are range-
    partitioned on group and order, so a hot group or a score shared by a third
    of the rows still spreads over many tasks. The numbering is checkpointed
    because both the rows and their offsets read it.
    """
    group_by = list(group_by)
    keys = [*group_by, *order_by]
    numbered = settle(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("__row", F.monotonically_increasing_id())
    )
    numbered = numbered.withColumn("__part", F.shiftright("__row", _ROW_BITS))

    # one row per (group, partition): bounded by groups + partitions
    blocks = numbered.groupBy(*group_by, "__part").agg(
        F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__count")
    )
    before = Window.partitionBy(*group_by).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = blocks.select(
        *[F.col(c).alias(f"__g_{c}") for c in group_by],
        F.col("__part").alias("__p"),
        (F.coalesce(F.sum("__count").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
    )
    same = F.col("__part") == F.col("__p")
    for c in group_by:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    placed = numbered.join(settle_small(offsets), same)
    return placed.select(*df.columns, (F.col("__row") + F.col("__shift")).alias(name))


def slice_positions(df: DataFrame, start: int, end: int | None = None, name: str = "position") -> DataFrame:
    """Rows whose explicit position lies in [start, end); without an end all from ``start`` on."""
    rows = df.where(F.col(name) >= start)
    return rows if end is None else rows.where(F.col(name) < end)


def exact_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One row ``(quantile)``: linear interpolation between the two nearest ranks.

    Equal values are counted first, map-side, so a value that a third of the rows share is one row from then on.
    Distinct values are range-partitioned; ranks add up counts inside a range and over the ranges before it.
    """
    values = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    counted = settle(
        values.groupBy("x").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("x").withColumn("part", F.spark_partition_id())
    )
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.groupBy(F.col("part").alias("p")).agg(F.sum("n").alias("n"))
    offsets = parts.select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(settle_small(offsets), F.col("part") == F.col("p"))
    total = counted.agg(F.sum("n")).scalar()
    ranked = ranked.withColumn("first", F.col("first") + F.col("shift")).withColumn("h", (total - 1) * F.lit(float(q)))
    holds = lambda rank: (F.col("first") <= rank) & (rank < F.col("first") + F.col("n"))
    low, high = F.floor("h"), F.ceil("h")
    return ranked.where(holds(low) | holds(high)).agg(
        (F.min("x") + (F.max("x") - F.min("x")) * (F.max("h") - F.floor(F.max("h")))).alias("quantile")
    )
