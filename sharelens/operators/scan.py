"""Running values over a global order, carried across the borders of range partitions.

A window runs all rows of one key through one task. Here rows are range-partitioned and sorted on key and order, so a key that
holds a third of all rows spreads over many tasks: each partition is summed up in one small value, the driver folds those (one a
partition) into what every partition inherits, and a second pass over the stored partitions runs with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharelens.session import collect_bounded, settle

Batches = Iterator[pa.RecordBatch]
MAX_PARTITIONS = 1_000_000


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str | Column] | None,
    summarise: Callable[[Batches], Any],
    combine: Callable[[Any, Any], Any],
    run: Callable[[Batches, Any, Any], Batches],
    schema: str,
) -> DataFrame:
    """``run`` over every partition of ``df`` in the order of ``keys``, with what the partitions before it leave.

    ``summarise`` gets the batches of a partition, ``combine`` the value carried so far (None at first) and a partition's summary,
    ``run`` the batches, the value carried into the partition and the summary of the next partition that has rows (None for the last).
    Without ``keys`` the rows are taken as they lie in their partitions (the result of a scan before). The order must be total up to equal rows. The sorted rows are checkpointed, since both passes read them; summaries must stay small.
    """
    ordered = df if keys is None else df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = settle(ordered.withColumn("__part", F.spark_partition_id()))

    def rows_of(batches: Batches, seen: list[int]) -> Batches:
        for batch in batches:
            if batch.num_rows:
                if not seen:
                    seen.append(batch.column("__part")[0].as_py())
                yield batch

    def sum_up(batches: Batches) -> Batches:
        seen: list[int] = []
        value = summarise(rows_of(batches, seen))
        if seen:
            yield pa.RecordBatch.from_pydict({"part": pa.array(seen, pa.int32()), "value": pa.array([cloudpickle.dumps(value)], pa.binary())})

    found = collect_bounded(placed.mapInArrow(sum_up, "part int, value binary"), MAX_PARTITIONS, "partitions")
    values = {r["part"]: cloudpickle.loads(bytes(r["value"])) for r in found}
    before, after, carry = {}, {}, None
    for part in sorted(values):
        before[part] = carry
        carry = combine(carry, values[part])
    for part, follower in zip(sorted(values), sorted(values)[1:], strict=False):
        after[part] = values[follower]

    def go(batches: Batches) -> Batches:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part = first.column("__part")[0].as_py()

        def all_of() -> Batches:
            yield first
            yield from (b for b in batches if b.num_rows)

        yield from run(all_of(), before[part], after.get(part))

    return placed.mapInArrow(go, schema)
