"""Shared helpers that decide what may leave the executors, and where lineage is cut."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref
from collections.abc import MutableMapping

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


class _Kept(weakref.WeakKeyDictionary):
    """What the driver keeps for itself: a task gets it empty, since sessions and tables cannot be pickled."""

    def __reduce__(self):
        return _Kept, ()


#: Folders that this process made below the checkpoint folder, by session; removed by :func:`clean`.
_made: MutableMapping[SparkSession, set[str]] = _Kept()
#: Folders of stored tables.
_stores: MutableMapping[DataFrame, str] = _Kept()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver may do without the setting: any other
    would lose a machine-local path with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="sharelens-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages re-read the files instead of recomputing lineage."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(spark))
        _made.setdefault(spark, set()).add(context.getCheckpointDir())
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder for one run's files."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark, set()).add(path)
    return path


#: Removes the shuffle files of a query as soon as it has ended; else they stay until the driver collects its garbage.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet to a scratch folder and read back; the shuffle files of that go when it is written.

    Unlike a settled table it is compressed, and its size estimate is that of its files, not a product of all that it was joined from.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _stores[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes the files of stored tables that nothing reads any more."""
    for table in tables:
        spark, path = table.sparkSession, _stores.pop(table)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _made.get(spark, set()).discard(path)


def clean(spark: SparkSession) -> None:
    """Removes the settled tables and scratch files of a session; results built on them are gone too.

    Runs by itself when the process ends. Long sessions set
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` to drop settled tables as soon as nothing refers to them.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in sorted(_made.pop(spark, ())):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    # the next settled table needs its folder again
    if spark.sparkContext.getCheckpointDir() is not None:
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
        _made.setdefault(spark, set()).add(spark.sparkContext.getCheckpointDir())


@atexit.register
def _clean_all() -> None:
    for spark in list(_made):
        try:
            if spark.sparkContext._jsc is not None:
                clean(spark)
                place = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir() or "/nowhere")
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001  (the JVM may be gone already)
            return


def collect_bounded(df: DataFrame, limit: int, what: str) -> list[Row]:
    """Rows of a table that is small by nature; refuses instead of flooding the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows


def hint_small(settled: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint for a settled or stored table that was counted; a larger side keeps Spark's shuffle join."""
    return F.broadcast(settled) if settled.count() <= max_rows else settled


def settle_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Settles a side of a join, so that counting it does not run its plan again, and hints it if it is small."""
    return hint_small(settle(df), max_rows)
