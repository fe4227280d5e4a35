"""Result archives (ZIP): checked before anything is read."""

from __future__ import annotations

import io
import json
import stat
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ArchiveLimits:
    members: int = 10_000
    member_bytes: int = 256 << 20
    total_bytes: int = 1 << 30
    ratio: int = 200


def archive_fault(info: list[zipfile.ZipInfo], limits: ArchiveLimits) -> str | None:
    """Why an archive is refused, or None."""
    if len(info) > limits.members:
        return "too many members"
    total = 0
    for m in info:
        path = PurePosixPath(m.filename.replace("\\", "/"))
        if not m.filename or path.is_absolute() or ".." in path.parts or ":" in (path.parts[0] if path.parts else ""):
            return "path leaves the archive"
        if stat.S_ISLNK(m.external_attr >> 16):
            return "symbolic link"
        if m.flag_bits & 1:
            return "encrypted"
        if m.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            return "unsupported compression"
        if m.file_size > limits.member_bytes:
            return "member too large"
        if m.file_size > limits.ratio * max(1, m.compress_size):
            return "compression ratio too high"
        total += m.file_size
    return "archive too large" if total > limits.total_bytes else None


def member_kind(name: str) -> str:
    low = name.lower()
    base = low.rpartition("/")[2]
    if base == "full.md":
        return "markdown"
    if base.endswith("content_list.json"):
        return "content_list"
    if base.endswith("middle.json") or base == "layout.json":
        return "layout_json"
    if base.endswith("model.json"):
        return "model_json"
    return "image" if "images" in low.split("/")[:-1] else "other"


def archive_members(files: DataFrame, id_col: str = "path", content_col: str = "content", limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """Rows (id, name, kind, size, depth, text, error): the members that matter of each archive, read where the file is.

    A refused or broken archive is one row with its error. JSON and Markdown are decoded (UTF-8, a mark taken off);
    images are named only.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = _members(key, raw, limits)
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("id", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("depth", pa.int32()), ("text", pa.string()), ("error", pa.string())]))

    slim = files.select(F.col(id_col).cast("string").alias("id"), F.col(content_col).alias("content"))
    return slim.mapInArrow(read, "id string, name string, kind string, size long, depth int, text string, error string")


def _members(key: str, raw: bytes | None, limits: ArchiveLimits) -> list[dict]:
    empty = {"id": key, "name": None, "kind": None, "size": None, "depth": None, "text": None, "error": None}
    try:
        with zipfile.ZipFile(io.BytesIO(raw or b"")) as archive:
            info = archive.infolist()
            fault = archive_fault(info, limits)
            if fault:
                return [empty | {"error": fault}]
            rows = []
            for m in info:
                kind = member_kind(m.filename)
                if m.is_dir() or kind == "other":
                    continue
                text = None if kind == "image" else archive.read(m).decode("utf-8-sig")
                if kind == "content_list" and not _is_objects(text):
                    return [empty | {"error": "content list is not a list of objects"}]
                rows.append({"id": key, "name": m.filename, "kind": kind, "size": m.file_size, "depth": m.filename.count("/"), "text": text, "error": None})
            return rows
    except (zipfile.BadZipFile, UnicodeDecodeError, ValueError, OSError) as e:
        return [empty | {"error": f"unreadable: {type(e).__name__}"}]


def _is_objects(text: str) -> bool:
    held = json.loads(text)
    return isinstance(held, list) and all(isinstance(x, dict) for x in held)


def picked(members: DataFrame) -> DataFrame:
    """Of each archive and kind the member of least depth, then of the first name; images all."""
    order = W.partitionBy("id", "kind").orderBy("depth", "name")
    return members.where("error is null").withColumn("_r", F.row_number().over(order)).where((F.col("_r") == 1) | (F.col("kind") == "image")).drop("_r")


def file_types(members: DataFrame) -> DataFrame:
    return members.where("error is null").groupBy("id").agg(F.sort_array(F.collect_set("kind")).alias("file_types"))
