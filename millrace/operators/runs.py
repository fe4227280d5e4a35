"""Parse runs, listings and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.errors import require
from millrace.functions.text import shorten


def latest(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group by an order; a ranking limit, so that Spark prunes before the shuffle."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def activate_runs(runs: DataFrame) -> DataFrame:
    """Runs with is_active: of a document's succeeded runs the one completed last, ties by id."""
    done = F.col("status") == "succeeded"
    last = runs.where(done).groupBy("document_id").agg(F.max(F.struct("completed_at", "id")).alias("m")).select("document_id", F.col("m.id").alias("_id"))
    return runs.drop("is_active").join(last, "document_id", "left").withColumn("is_active", F.coalesce(F.col("id") == F.col("_id"), F.lit(False))).drop("_id")


def run_status(runs: DataFrame) -> DataFrame:
    """Per document its latest run and its latest active one, each by created_at, ties by id."""
    newest = lambda ok: F.max(F.when(ok, F.struct("created_at", "id", "status")))
    held = runs.groupBy("document_id").agg(newest(F.lit(True)).alias("l"), newest(F.col("is_active")).alias("a"), F.count("*").alias("n_runs"))
    return held.select("document_id", "n_runs", F.col("l.id").alias("latest_run_id"), F.col("l.status").alias("latest_status"), F.col("a.id").alias("active_run_id"))


def page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, max_limit: int = 100) -> DataFrame:
    """A page of rows in a total order, each with the number of all rows."""
    require(1 <= limit <= max_limit and offset >= 0, "VECTOR_SEARCH_FAILED", f"limit must be 1 to {max_limit}, offset at least 0")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def unparsed(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that no chunk belongs to: the only ones that may be parsed."""
    return documents.join(chunks.select(F.col("document_id").alias("id")), "id", "left_anti")


def block_summaries(blocks: DataFrame) -> DataFrame:
    """Blocks with long texts cut to 2000 characters (captions 500) and truncated telling so; at most 20 path parts, 200 assets."""
    longs = ("text", "markdown", "html", "latex")
    cut = F.coalesce(F.greatest(*[(F.length(c) > 2000).cast("int") for c in longs], (F.length("caption") > 500).cast("int")), F.lit(0)) > 0
    return blocks.withColumn("truncated", cut).withColumns({c: shorten(F.col(c), 2000) for c in longs} | {"caption": shorten(F.col("caption"), 500), "section_path": F.slice("section_path", 1, 20), "asset_keys": F.slice("asset_keys", 1, 200)})


def severity(statuses: DataFrame) -> DataFrame:
    """The worst of statuses ok, warning, failed."""
    rank = F.when(F.col("status") == "failed", 2).when(F.col("status") == "warning", 1).otherwise(0)
    return statuses.agg(F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("failed")), F.coalesce(F.max(rank), F.lit(0)) + 1).alias("status"))


def page_count(content: DataFrame, col: str = "page_idx") -> DataFrame:
    """One more than the largest page index that isn't negative, per document; null without one."""
    return content.groupBy("document_id").agg((F.max(F.when(F.col(col) >= 0, F.col(col))) + 1).alias("page_count"))
