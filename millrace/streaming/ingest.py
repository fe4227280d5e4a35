"""Streaming ingestion: new files become chunks and index rows, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.config import WindowChunking
from millrace.operators.chunking import window_chunks
from millrace.operators.document_table import open_table, replace_documents


def read_documents(spark: SparkSession, folder: str, schema, per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def distinct_documents(stream: DataFrame, time_col: str, within: str, key: str) -> DataFrame:
    """The first of rows with an equal key that arrive within a time span; the state stays as small as the span."""
    return stream.withWatermark(time_col, within).dropDuplicatesWithinWatermark([key])


def ingest(stream: DataFrame, folder: str, checkpoint: str, settings: WindowChunking = WindowChunking(), id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Append chunks of a stream of documents to a Parquet folder, exactly once (the file sink commits per batch)."""
    chunks = window_chunks(stream, settings, id_col, text_col)
    return chunks.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def refresh(stream: DataFrame, path: str, checkpoint: str, name: str, settings: WindowChunking = WindowChunking(), id_col: str = "doc_id", text_col: str = "text", revision_col: str = "revision") -> StreamingQuery:
    """Each batch of a stream of documents replaces their chunks in a table of documents (open_table(spark, path)).

    Rows are documents with a revision; a null text takes a document's chunks away. A batch is one commit, made by a rename that
    also notes its number under the stream's name: when it is run again after a failure, before or after the rename, no
    chunk is lost or there twice. The greatest revision stands in whatever order they come.
    """

    def put(batch: DataFrame, number: int) -> None:
        replace_documents(open_table(batch.sparkSession, path), batch, lambda docs: window_chunks(docs, settings, id_col, text_col), id_col, revision_col, name, number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
