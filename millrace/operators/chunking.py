"""Fixed-window chunks and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import WindowChunking
from millrace.functions.text import is_blank
from millrace.schemas import EMBEDDING_STATUSES


def window_chunks(docs: DataFrame, settings: WindowChunking = WindowChunking(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (document_id, chunk_index, content, char_start, char_end, character_count, token_count).

    Windows of settings.size code points, settings.step apart, untrimmed; the last one ends with the text. Null and
    blank texts give none. A narrow projection: each row makes its own chunks, no shuffle.
    """
    text, n = F.col(text_col), F.length(text_col)
    last = F.ceil(F.greatest(n - settings.size, F.lit(0)) / settings.step).cast("int")
    rows = docs.where(~is_blank(text)).select(F.col(id_col).alias("document_id"), text.alias("whole"), n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    start = (F.col("chunk_index") * settings.step).cast("int")
    count = F.least(F.lit(settings.size), F.col("n") - start)  # without the content: who asks for lengths cuts no text
    rows = rows.select("document_id", "chunk_index", F.substring("whole", start + 1, F.lit(settings.size)).alias("content"), start.alias("char_start"), count.alias("character_count"))
    tokens = F.greatest(F.lit(1), F.ceil(F.col("character_count") / 4)).cast("int")  # token_estimate() of the content
    return rows.select("document_id", "chunk_index", "content", "char_start", (F.col("char_start") + F.col("character_count")).alias("char_end"), "character_count", tokens.alias("token_count"))


def chunk_stats(chunks: DataFrame, *by: str, length: Column | None = None) -> DataFrame:
    """Count, total, least, most and average length of chunks; all 0 where there is none and by is empty."""
    n = F.coalesce(length if length is not None else F.col("character_count"), F.length("content"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return chunks.groupBy(*by).agg(
        F.count("*").alias("chunk_count"), zero(F.sum(n)).cast("long").alias("total_chars"), zero(F.min(n)).cast("long").alias("min_chars"),
        zero(F.max(n)).cast("long").alias("max_chars"), zero(F.avg(n)).cast("double").alias("avg_chars"),
    )


def embedding_status(chunks: DataFrame, id_col: str = "document_id", model_col: str = "embedding_model", dim_col: str = "embedding_dim") -> DataFrame:
    """Per document: chunks of each known status (0 where none), and the sorted distinct models and dimensions."""
    counts = [F.count_if(F.col("embedding_status") == s).alias(s) for s in EMBEDDING_STATUSES]
    return chunks.groupBy(id_col).agg(
        F.count("*").alias("total"), *counts, F.sort_array(F.collect_set(F.nullif(F.col(model_col), F.lit("")))).alias("models"), F.sort_array(F.collect_set(dim_col)).alias("dims")
    )


def new_chunk_rows(chunks: DataFrame, run_col: str | None = None) -> DataFrame:
    """Chunks as they are stored first: an id made of document, run and index, no embedding yet."""
    run = F.col(run_col) if run_col else F.lit("")
    return chunks.withColumns({
        "id": F.sha2(F.concat_ws("\n", F.col("document_id").cast("string"), run, F.col("chunk_index").cast("string")), 256), "embedding": F.lit(None).cast("array<float>"),
        "embedding_model": F.lit(None).cast("string"), "embedding_dim": F.lit(None).cast("int"), "embedding_status": F.lit("not_started"),
    })
