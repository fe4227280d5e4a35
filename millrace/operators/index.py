"""Index tables: payload, eligibility, refresh, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.errors import require
from millrace.functions.text import exact_terms
from millrace.operators.embedding import eligible

#: Fixed value: the format of times in the index.
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def syncable(documents: DataFrame, chunks: DataFrame, model: str, dim: int, document_id: str | None = None) -> DataFrame:
    """Chunks that may be searched, with their document's name."""
    rows = chunks.where(eligible(model, dim))
    if document_id is not None:
        rows = rows.where(F.col("document_id") == document_id)
    names = documents.select(F.col("id").alias("document_id"), "original_filename", "process_status")
    return rows.join(names, "document_id")


def payload(rows: DataFrame) -> DataFrame:
    """What the index holds of a chunk: its fields, the content for each analyzer, its dictionary terms, ISO times."""
    when = lambda c: F.date_format(c, ISO) if c in rows.columns else F.lit(None).cast("string")
    metadata = F.coalesce(F.col("source_metadata").cast("string"), F.lit("{}")) if "source_metadata" in rows.columns else F.lit("{}")
    return rows.select(
        F.col("id").cast("string").alias("chunk_id"), F.col("document_id").cast("string"), "original_filename", "process_status", "chunk_index", "content", F.col("content").alias("content_max"),
        F.col("content").alias("content_smart"), exact_terms(F.col("content")).alias("exact_terms"), "chunk_type", "page_start", "page_end", "section_title", metadata.alias("source_metadata"),
        "embedding", "embedding_model", "embedding_dim", "embedding_status", when("created_at").alias("created_at"), when("updated_at").alias("updated_at"),
    )


def upserted(index: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The index with rows put in by key; nothing goes."""
    return index.join(rows.select(key), key, "left_anti").unionByName(rows)


def replaced(index: DataFrame, rows: DataFrame, documents: DataFrame) -> DataFrame:
    """The index with all that it has of the documents (document_id) gone and rows put in."""
    return index.join(documents.select("document_id").distinct(), "document_id", "left_anti").unionByName(rows)


def write_index(spark: SparkSession, rows: DataFrame, folder: str, buckets: int = 64) -> None:
    """Write rows as Parquet, a directory for each hash bucket of document_id; buckets without rows stay as they are.

    So a document's rebuild rewrites one bucket: give it the whole bucket's rows (replaced()).
    """
    old = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def ensure_index(spark: SparkSession, name: str, alias: str, schema: StructType, dim: int) -> dict:
    """The catalog table of an index, made if there is none, and a view as its alias; what was there and what was made.

    A table of other fields, types or vector lengths is an error and stays as it is.
    """
    there = spark.catalog.tableExists(name)
    if there:
        check_mapping(spark.table(name), dim)
    else:
        spark.createDataFrame([], schema).write.saveAsTable(name)
    aliased = spark.catalog.tableExists(alias)
    if not aliased:
        spark.sql(f"CREATE VIEW {alias} AS SELECT * FROM {name}")
    return {"index_name": name, "alias": alias, "created": not there, "exists": there, "alias_created": not aliased, "mapping_status": "matched" if there else "created"}


def check_mapping(stored: DataFrame, dim: int) -> None:
    """The stored table has the fields that searches need, of the types they need, and vectors of dim numbers."""
    needed = {"chunk_id": "string", "document_id": "string", "content": "string", "embedding_model": "string", "embedding_dim": "int", "embedding_status": "string"}
    have = dict(stored.dtypes)
    bad = {k: have.get(k) for k, v in needed.items() if have.get(k) != v}
    bad |= {} if have.get("embedding") in ("array<float>", "array<double>") else {"embedding": have.get("embedding")}
    require(not bad, "SEARCH_INDEX_MAPPING_MISMATCH", "stored index has other fields", fields=bad)
    require(stored.where(F.size("embedding") != dim).isEmpty(), "SEARCH_INDEX_MAPPING_MISMATCH", "stored index has vectors of other length", dim=dim)


def drift(source: DataFrame, index: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: chunks in the source, in the index, missing from the index, stale in it."""
    s, i = source.select(key).distinct().withColumn("s", F.lit(1)), index.select(key).distinct().withColumn("i", F.lit(1))
    both = s.join(i, key, "full_outer")
    return both.agg(F.count("s").alias("n_source"), F.count("i").alias("n_index"), F.count_if(F.col("i").isNull()).alias("n_missing"), F.count_if(F.col("s").isNull()).alias("n_stale"))
