"""Versions of a folder: what each holds is a small JSON file, and one rename makes the next version."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from millrace.errors import require


def hadoop_file(spark: SparkSession, path: str):
    """(file system, path) of a path, as Hadoop names them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def told(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """The newest version of a folder, or the one asked for, and what it holds; version 0 where nothing was written."""
    fs, at = hadoop_file(spark, f"{path}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    known = sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and n[0] != ".")
    version = version if version is not None else (known[-1] if known else 0)
    require(version == 0 or version in known, "SEARCH_INDEX_NOT_FOUND", "no such version of the index", version=version)
    return version, json.loads(spark.read.text(f"{path}/versions/{version:09d}.json", wholetext=True).first()[0]) if version else {}


def switch(spark: SparkSession, path: str, version: int, holds: dict) -> None:
    """Make a version by one rename; an error if another writer has made it meanwhile."""
    fs, done = hadoop_file(spark, f"{path}/versions/{version:09d}.json")
    _, part = hadoop_file(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(json.dumps(holds).encode()))
    out.close()
    if fs.exists(done) or not fs.rename(part, done):
        fs.delete(part, False)
        require(False, "SEARCH_INDEX_REBUILD_FAILED", "another writer has made this version", version=version)
