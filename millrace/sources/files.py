"""Uploaded files: reading, checking, decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import UPLOAD_EXTENSIONS, UPLOAD_MAX_BYTES
from millrace.functions.text import strip
from millrace.schemas import PLACEHOLDER_EXTENSIONS, TEXT_EXTENSIONS


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, filename, file_size, content binary) of the files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("file_size"), "content")


def extension_of(filename: Column, file_type: Column | None = None) -> Column:
    """The file type, or else the name's suffix: trimmed, lower-case, with its dot; empty if there is none."""
    suffix = F.regexp_extract(F.coalesce(filename, F.lit("")), r"(?s)[^/.]+(\.[^./\\]+)$", 1)
    named = F.lower(strip(F.coalesce(F.nullif(file_type, F.lit("")), suffix) if file_type is not None else suffix))
    return F.when((named != "") & ~named.startswith("."), F.concat(F.lit("."), named)).otherwise(named)


def upload_faults(files: DataFrame, filename_col: str = "filename", size_col: str = "file_size", most: int = UPLOAD_MAX_BYTES, content_types: Sequence[str] = ()) -> DataFrame:
    """Files with extension and reject_reason (an error code, or null).

    Where content types are named, a file's content_type, if it has one, must be among them, its parameters apart.
    """
    ext = extension_of(F.col(filename_col))
    reason = F.when(~ext.isin(*UPLOAD_EXTENSIONS), "INVALID_FILE_TYPE")
    if content_types:
        said = F.lower(strip(F.substring_index("content_type", ";", 1)))
        reason = reason.when((F.col("content_type") != "") & ~said.isin(*content_types), "INVALID_FILE_TYPE")
    reason = reason.when(F.col(size_col) > most, "FILE_TOO_LARGE")
    return files.withColumns({"extension": ext, "reject_reason": reason})


def uploaded(files: DataFrame, at: Column, id_col: Column | None = None) -> DataFrame:
    """Document rows for accepted files: hash, object key raw/YYYY/MM/<id><ext>, status uploaded. Ids are the hash unless given."""
    digest = F.sha2("content", 256)
    key = id_col if id_col is not None else digest
    ok = upload_faults(files).where("reject_reason is null")
    return ok.select(
        key.alias("id"), F.col("filename").alias("original_filename"), F.expr("substring(extension, 2)").alias("file_type"), F.col("file_size"), digest.alias("file_hash"),
        F.concat(F.lit("raw/"), F.date_format(at, "yyyy/MM"), F.lit("/"), key, F.col("extension")).alias("object_key"), F.lit("uploaded").alias("process_status"), at.alias("created_at"), "content",
    )


def parsed_texts(files: DataFrame, filename_col: str = "filename", content_col: str = "content", parser: str = "SimpleParser") -> DataFrame:
    """Files with source_type, placeholder and text.

    Text kinds are decoded as UTF-8, bad bytes replaced, a byte order mark kept; CSV stays text. Other known kinds get a
    short placeholder of five lines. Unknown kinds have no text and source_type.
    """
    ext = extension_of(F.col(filename_col))
    of = lambda m: F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), ext)
    raw = F.col(content_col)
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.make_valid_utf8(raw.cast("string")))
    other = of(PLACEHOLDER_EXTENSIONS)
    #: Fixed value: the placeholder's lines.
    note = F.concat_ws("\n", F.concat(F.lit("原始文件名："), F.col(filename_col)), F.concat(F.lit("文件类型："), F.coalesce(F.nullif(ext, F.lit("")), F.lit("unknown"))), F.lit(f"parser_name：{parser}"), F.concat(F.lit("source_type："), other), F.lit("当前为轻量解析占位，后续由 MinerU 替换。"))
    kind = of(TEXT_EXTENSIONS)
    return files.withColumns({"extension": ext, "source_type": F.coalesce(kind, other), "placeholder": other.isNotNull(), "text": F.when(kind.isNotNull(), text).when(other.isNotNull(), note)})
