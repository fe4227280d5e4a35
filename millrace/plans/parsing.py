"""Parsing as table-to-table plans: documents become chunks, or failures with a reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import BlockChunking, WindowChunking
from millrace.functions.text import is_blank
from millrace.operators.block_chunking import block_chunks
from millrace.operators.blocks import block_faults, normalize_blocks, with_fallback
from millrace.operators.chunking import new_chunk_rows, window_chunks
from millrace.operators.runs import unparsed
from millrace.session import shared_folder
from millrace.sources.archives import archive_members, picked
from millrace.sources.files import parsed_texts


@dataclass(frozen=True)
class Parsed:
    """chunks as new_chunk_rows() makes them; failures (document_id, code, reason); links of chunks to blocks, and the blocks, if there are any."""

    chunks: DataFrame
    failures: DataFrame
    links: DataFrame | None = None
    blocks: DataFrame | None = None


def _failures(rows: DataFrame, code: str, reason) -> DataFrame:
    return rows.select(F.col("id").cast("string").alias("document_id"), F.lit(code).alias("code"), reason.alias("reason"))


def parse_texts(documents: DataFrame, chunked: DataFrame, settings: WindowChunking = WindowChunking()) -> Parsed:
    """Fixed windows of documents (id, filename, content binary) that have no chunks (document_id) yet.

    Those that have, unknown kinds of file, and texts without a word are failures; none stops the others.
    """
    due = unparsed(documents, chunked)
    texts = parsed_texts(due)
    done = documents.join(due.select("id"), "id", "left_anti")
    known = texts.where("source_type is not null and content is not null")
    bad = _failures(done, "DOCUMENT_ALREADY_PARSED", F.lit("chunks exist"))
    bad = bad.unionByName(_failures(texts.where("source_type is null or content is null"), "DOCUMENT_PARSE_FAILED", F.lit("unknown kind of file or no content")))
    bad = bad.unionByName(_failures(known.where(is_blank(F.col("text"))), "DOCUMENT_PARSE_FAILED", F.lit("no text")))
    return Parsed(new_chunk_rows(window_chunks(known, settings, "id", "text")), bad)


def parse_lists(parsed: DataFrame, settings: BlockChunking = BlockChunking(), faults: DataFrame | None = None) -> Parsed:
    """Section-aware chunks of parse results (document_id, parse_run_id, content_list, text, markdown): all of a document or nothing.

    A missing or empty content list becomes one block of the text or Markdown. A document with any fault (an element that is
    no object, text that is no JSON list, nothing at all, or one of faults: document_id, reason) has failures and no chunk,
    link or block. The failures are decided once, by a checkpoint, and everything else is read without their documents, so
    that the outputs agree whatever is computed again.
    """
    shared_folder(parsed.sparkSession)
    parsed = with_fallback(parsed)
    where = F.coalesce(F.concat(F.lit("block "), F.col("block_index").cast("string"), F.lit(": ")), F.lit(""))
    empty = F.coalesce(F.col("content_list"), F.lit("")) == ""
    found = parsed.where(empty).select(F.col("document_id").alias("id"), F.lit("no content list and no Markdown").alias("reason"))
    found = found.unionByName(block_faults(parsed.where(~empty)).select(F.col("document_id").alias("id"), F.concat(where, "error").alias("reason")))
    if faults is not None:
        found = found.unionByName(faults.select(F.col("document_id").alias("id"), "reason"))
    failures = _failures(found, "DOCUMENT_PARSE_FAILED", F.col("reason")).checkpoint()
    refused = failures.select(F.col("document_id").alias("_refused")).distinct()
    sound = parsed.join(refused, F.col("document_id").cast("string") == F.col("_refused"), "left_anti")
    blocks = normalize_blocks(sound)
    chunks, links = block_chunks(blocks, settings)
    return Parsed(new_chunk_rows(chunks, "parse_run_id"), failures, links, blocks)


def parse_archives(archives: DataFrame, settings: BlockChunking = BlockChunking()) -> Parsed:
    """parse_lists() of result archives (id, content binary): their content list, or else their Markdown; an archive with a
    faulty member is refused whole."""
    members = archive_members(archives, "id")
    best = picked(members)
    lists = best.where("kind = 'content_list'").select("id", F.col("text").alias("content_list"))
    whole = best.where("kind = 'markdown'").select("id", "text")
    both = archives.select(F.col("id").cast("string").alias("id")).join(lists, "id", "left").join(whole, "id", "left")
    faults = members.where("error is not null").select(F.col("id").alias("document_id"), F.col("error").alias("reason"))
    both = both.join(faults.select(F.col("document_id").alias("id")), "id", "left_anti")  # their members tell why
    return parse_lists(both.select(F.col("id").alias("document_id"), F.col("id").alias("parse_run_id"), "content_list", "text", F.lit(None).cast("string").alias("markdown")), settings, faults)
