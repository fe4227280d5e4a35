"""Registered queries over blocks of a layout: lines of documents as what a parser would make of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import BlockChunking
from millrace.operators.block_chunking import assembled_chunks, fragments, lineage, linked, prepared_blocks
from millrace.operators.blocks import first_assets, run_totals
from millrace.operators.chunking import new_chunk_rows
from millrace.plans.queries import _conversation_blocks
from millrace.session import spread, stored, table


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a block: short ones are titles, others by turns tables, formulas, images, headers,
    lists and texts, some of these with Markdown besides. Five lines make a page, and every second block reaches into the next."""
    docs = spread(table(spark, sf_dir, "documents"))
    lines = docs.select(F.col("doc_id"), F.col("doc_id").cast("string").alias("document_id"), F.lit("r").alias("parse_run_id"), F.posexplode(F.split("text", "\n")).alias("block_index", "line"))
    line, case, short = F.col("line"), (F.col("doc_id") + F.col("block_index")) % 8, F.length("line") < 60
    kind = F.when(short, "title").otherwise(F.element_at(F.array(*[F.lit(k) for k in ("table", "formula", "image", "header", "list", "text", "text", "text")]), (case + 1).cast("int")))
    page = F.floor(F.col("block_index") / 5).cast("int") + 1
    none = F.lit(None).cast("string")
    return lines.withColumn("block_type", kind).select(
        "document_id", "parse_run_id", "block_index", F.concat(F.lit("b"), F.col("block_index").cast("string")).alias("block_key"), "block_type", page.alias("page_start"), (page + F.col("block_index") % 2).alias("page_end"),
        F.when((F.col("block_type") != "formula") | (F.col("doc_id") % 2 == 1), line).alias("text"),
        F.when(F.col("block_type") == "table", F.concat(F.lit("| "), line, F.lit(" |"))).when(~short & (case == 5), F.concat(F.lit("* "), line)).alias("markdown"), none.alias("html"),
        F.when(F.col("block_type") == "formula", line).alias("latex"), F.when(F.col("block_type") == "image", F.concat(F.lit("Figure "), F.col("block_index").cast("string"))).alias("caption"),
        F.array().cast("array<string>").alias("section_path"), F.when(F.col("block_type") == "image", F.array(F.concat(F.col("block_index").cast("string"), F.lit(".png")))).otherwise(F.array().cast("array<string>")).alias("asset_keys"),
    )


def layout_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = prepared_blocks(layout_blocks(spark, sf_dir))
    held = assembled_chunks(fragments(prepared), prepared)
    joined = lambda c: F.array_join(c, "|").alias(c)
    return held.select("document_id", "chunk_index", "content", "page_start", "page_end", "section_title", "chunk_type", "content_format", joined("block_keys"), joined("block_types"), joined("asset_keys"), "token_count")


def layout_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of chunks, as they are stored, to blocks."""
    prepared = prepared_blocks(layout_blocks(spark, sf_dir))
    parts = stored(fragments(prepared), "fragments")  # read by both
    held = assembled_chunks(parts, prepared)
    links = linked(lineage(parts), new_chunk_rows(held, "parse_run_id"))
    return links.select("document_id", "chunk_id", "block_index", F.col("block_order").cast("int").alias("block_order"), "error")


def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one table, a line a row, split where it is too long."""
    settings = BlockChunking(max_table_chars=1500, keep_table_intact=False)
    docs = spread(table(spark, sf_dir, "documents"))
    none = F.lit(None).cast("string")
    blocks = docs.select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit("r").alias("parse_run_id"), F.lit(0).alias("block_index"), F.lit("b0").alias("block_key"), F.lit(" Table").alias("block_type"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"),
        none.alias("text"), F.col("text").alias("markdown"), none.alias("html"), none.alias("latex"), none.alias("caption"), F.array().cast("array<string>").alias("section_path"), F.array().cast("array<string>").alias("asset_keys"),
    )
    prepared = prepared_blocks(blocks, settings)
    return assembled_chunks(fragments(prepared, settings), prepared).select("document_id", "chunk_index", "content", "chunk_type", "content_format", "token_count")


def block_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversation_blocks(spark, sf_dir).select("document_id", "block_index", "source_metadata")


def parse_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of parse runs, a run a conversation, whose blocks of even pages show an asset."""
    blocks = _conversation_blocks(spark, sf_dir)
    blocks = blocks.withColumn("asset_keys", F.when(F.col("page_start") % 2 == 0, F.array(F.concat("block_type", F.lit(".png")))).otherwise(F.array().cast("array<string>")))
    return run_totals(blocks).select("document_id", "block_count", "asset_count", "page_count", "output_markdown_key", "output_json_key")


def asset_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as assets of their source from three origins: declared, referred to by a block, and files of the result."""
    docs = spread(table(spark, sf_dir, "documents"))
    rows = docs.select(F.col("source").alias("document_id"), F.lit("r").alias("parse_run_id"), F.concat(F.col("n_chars").cast("string"), F.lit(".png")).alias("asset_key"), F.col("doc_id").alias("position"), F.col("lang").alias("caption"), (F.col("doc_id") % 3).alias("_case"))
    sources = [rows.where(F.col("_case") == n).drop("_case") for n in range(3)]
    return first_assets(*sources).select("document_id", "asset_key", "caption", F.col("origin").cast("int").alias("origin"))


QUERIES = {f.__name__: f for f in (layout_chunks, layout_lineage, table_chunks, block_metadata, parse_run_totals, asset_union)}
