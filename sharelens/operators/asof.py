"""As-of joins of two large tables: the first row of the other side at or after (or the last at or before) each row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharelens.operators.scan import ordered_scan


def _starts(batch: pa.RecordBatch, names: list[str], key: tuple) -> tuple[np.ndarray, tuple]:
    """Whether a row's key differs from that of the row before it (``key`` for the first), and the last row's key."""
    change = np.zeros(batch.num_rows, bool)
    now = tuple(batch.column(c)[0].as_py() for c in names)
    change[0] = now != key
    for c in names:
        a, b = batch.column(c)[1:], batch.column(c)[:-1]
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
        change[1:] |= ~(same | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False)))
    return change, tuple(batch.column(c)[-1].as_py() for c in names)


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, tie: Sequence[str], forward: bool = True
) -> DataFrame:
    """Every row of ``left`` as struct ``l`` and, as struct ``r``, its match in ``right`` (null if there is none).

    The match has equal ``by`` columns and the smallest ``right_on`` at or after ``left_on`` (``forward``), or the largest at or before it; of equal
    ones that with the smallest ``tie`` columns. Null keys and null values match nothing. Both tables are sorted into one order over range
    partitions, in which every match lies before its rows, and the last row of ``right`` is carried across the borders: a key with a third
    of the rows spreads over as many tasks as any other rows, and nothing is joined or gathered by key.
    """
    by, tie = list(by), list(tie)
    keys = [f"k{i}" for i in range(len(by))]
    ties = [f"t{i}" for i in range(len(tie))]
    pack = lambda df: F.struct(*(F.col(f"`{c}`") for c in df.columns))
    columns = lambda on: [*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.col(on).alias("value")]
    known = F.col("value").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    asked = left.select(*columns(left_on), pack(left).alias("l")).withColumn("turn", F.lit(1))
    served = right.select(*columns(right_on), *(F.col(t).alias(n) for t, n in zip(tie, ties, strict=True)), pack(right).alias("r"))
    both = served.where(known).withColumn("turn", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    both = both.select(*keys, "value", "turn", *ties, "l", "r", (F.col("value").isNotNull() & F.col("l").isNotNull()).alias("asks"))
    # the match is the last row of the other side so far, so among equal ones the smallest comes last
    order = [*keys, F.desc("value") if forward else F.asc("value"), "turn", *(F.desc(t) for t in ties)]

    def last_rows(batch, key, held):
        """For each row the place of the last row of ``right`` with its key in the batch, -1 for the one held, -2 for none."""
        change, after = _starts(batch, keys, key)
        place = np.arange(batch.num_rows)
        serves = batch.column("turn").to_numpy() == 0
        begun = np.maximum.accumulate(np.where(change, place, -1))
        seen = np.maximum.accumulate(np.where(serves, place, -1))
        match = np.where(seen >= np.maximum(begun, 0), seen, -2)
        if held is not None:
            match[(begun < 0) & (seen < 0)] = -1
        end = int(match[-1])
        return match, after, batch.column("r")[end : end + 1] if end >= 0 else held if end == -1 else None

    def summarise(batches):
        first, key, held = None, (), None
        for batch in batches:
            first = tuple(batch.column(c)[0].as_py() for c in keys) if first is None else first
            _, after, held = last_rows(batch, key, held)
            key = after
        return first, key, pa.concat_arrays([held]) if held is not None else None

    def combine(carry, value):
        first, key, held = value
        # a partition of one key without a row of the other side hands on what came before
        return (first, key, carry[2]) if held is None and carry and carry[1] == first == key else value

    def run(batches, before, after):
        _, key, held = before or (None, (), None)
        for batch in batches:
            match, key, now = last_rows(batch, key, held)
            r = batch.column("r")
            pool = pa.concat_arrays([r, held]) if held is not None else r
            ask = np.flatnonzero(batch.column("turn").to_numpy() == 1)
            known = batch.column("asks").take(pa.array(ask)).to_numpy(zero_copy_only=False)
            at = np.where(match[ask] == -1, batch.num_rows, match[ask])
            found = pool.take(pa.array(at, mask=(at == -2) | ~known))
            held = now
            yield pa.RecordBatch.from_arrays([batch.column("l").take(pa.array(ask)), found], ["l", "r"])

    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    return ordered_scan(both, order, summarise, combine, run, f"l {kinds['l']}, r {kinds['r']}")
