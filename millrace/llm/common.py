"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_folder, write_released

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows with whole texts that a Python task gets at once.
BATCH_ROWS = 1000
#: What staged() wrote within the innermost scratch(); nothing is noted, or ever removed, outside one.
_PATHS: ContextVar[list[str] | None] = ContextVar("paths", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: see session.shared_folder()."""
    return shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write a table to the shared folder as Parquet and read it back: computed once, safe from lost executors. release:
    what was shuffled for it is removed at once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    write_released(df, path) if release else df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    if (paths := _PATHS.get()) is not None:
        paths.append(path)
    return held


def completed(spark: SparkSession, path: str) -> bool:
    """Whether a job that wrote to a folder came to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Remove, at the end, the tables that staged() wrote within; for whoever has written the result elsewhere by then.

    Tables staged before, or by another thread or an outer scratch(), stay: results that are held unread don't depend on who
    else is at work. A run that fails removes its tables too.
    """
    paths: list[str] = []
    mark = _PATHS.set(paths)
    try:
        yield paths
    finally:
        _PATHS.reset(mark)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def join_by_hot_key(rows: DataFrame, classes: DataFrame, key: str, copies: str = "copies") -> DataFrame:
    """rows joined to classes (one row per key, copies: its number of rows): keys with over a thousandth of all rows, less
    than a thousand keys, by a broadcast, so that no task gets all rows of one; the others by key."""
    hot = classes.where(F.col(copies) > F.lit(rows.count() / 1000))
    few = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(few, key, "left_anti").join(classes.join(few, key, "left_anti"), key))


def small_batches(df: DataFrame) -> DataFrame:
    """The same table, in a session that hands Python at most BATCH_ROWS rows at a time: whole texts take much memory."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(col):
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")
