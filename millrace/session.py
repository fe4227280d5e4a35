"""Sessions and tables."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "millrace", **conf: str) -> SparkSession:
    """The session in place, or a new one that keeps time in UTC and re-plans at run time."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def state_of(df: DataFrame) -> str:
    """A digest of the files that a table is read from: their places, sizes and times."""
    file = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    files = df.select(file.alias("h")).distinct().agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{files.n} {files.x} {files.s}".encode()).hexdigest()[:24]


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer splits than there are cores, dealt out over the cores: a file of one row group is
    one task otherwise. Such a table is smaller than the cores' splits together; larger ones are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the session names, made the context's own.

    Where none is named, a temporary one on a single machine (tests); on a cluster driver and executors would write
    to different disks, so that is refused.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path and not sc.master.startswith("local"):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    path = path or tempfile.mkdtemp(prefix="spark-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """A table written to the shared folder and read back: computed once, and Spark knows its true size, so that what is
    small is broadcast, however large the estimate for the joins that made it. release: what was shuffled for it is removed at once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    write_released(df, path) if release else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's setting by which an execution removes its shuffle files when it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_released(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "errorifexists", **options: str) -> None:
    """Write a table as Parquet and remove what was shuffled for it: otherwise that stays until the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(RELEASE, "false")
    conf.set(RELEASE, "true")
    try:
        df.write.options(**options).parquet(path, mode, list(by) or None)
    finally:
        conf.set(RELEASE, before)
