"""Registered queries over knowledge items, and the search of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import Embedding, Hybrid
from millrace.functions.text import content_hash
from millrace.operators.chunking import window_chunks
from millrace.operators.embedding import HashProvider
from millrace.operators.index import payload, syncable
from millrace.operators.items import created, explicit_selection, review_events, revised, updated
from millrace.operators.knowledge import list_items, revision_chains
from millrace.operators.retrieval import search_chunks
from millrace.operators.runs import page
from millrace.plans.queries import ACTIONS, _chunks_with_vectors, _word
from millrace.session import spread, table

#: What documents are where they play items, by the rest of their id.
STATUSES = ("draft", "rejected", "approved", "deprecated", "pending_review")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an item of its source, in one of five statuses."""
    docs = spread(table(spark, sf_dir, "documents"))
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (F.col("doc_id") % 5 + 1).cast("int"))
    none = F.lit(None).cast("long")
    return docs.select(
        F.col("doc_id").alias("id"), F.lit("process_rule").alias("item_type"), F.col("source").alias("title"), F.col("text").alias("content"), status.alias("status"), none.alias("source_document_id"), F.lit(3).alias("version"),
        content_hash(F.lit("process_rule"), none, F.col("source"), F.col("text")).alias("content_hash"),
    )


def _links(items: DataFrame) -> DataFrame:
    """Each item's links to chunks, none to three."""
    n = F.explode(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), (F.col("id") % 4).cast("int")))
    return items.select(F.col("id").alias("knowledge_item_id"), n.alias("chunk_index")).select("knowledge_item_id", F.concat_ws("-", "knowledge_item_id", "chunk_index").alias("chunk_id"), F.col("knowledge_item_id").alias("document_id"), "chunk_index")


def item_creation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates, some of an unknown type, without content, or in a status that none starts with; every fourth has a
    chunk, some of these missing; labelled documents are items already, toxic ones deprecated."""
    docs = spread(table(spark, sf_dir, "documents"))
    me, none = F.col("doc_id"), F.lit(None).cast("long")
    candidates = docs.select(
        me.alias("id"), me.alias("position"), F.when(me % 11 == 4, "gossip").otherwise("process_rule").alias("item_type"), F.concat(F.lit(" "), "source").alias("title"), F.when(me % 13 == 5, F.lit(" ")).otherwise(F.col("text")).alias("content"),
        F.when(me % 17 == 3, F.lit("approved")).alias("status"), none.alias("source_document_id"), F.lit(None).cast("string").alias("source_filename"),
    )
    chunks = docs.select(me.alias("chunk_id"), (me - me % 2).alias("document_id"), F.lit(0).alias("chunk_index"))
    links = docs.where(me % 4 == 0).select(me.alias("id"), F.when(me % 12 == 8, me + 1_000_000_000).otherwise(me).alias("chunk_id"))
    status = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.when(F.max("toxic") == 1, "deprecated").otherwise("approved").alias("status"))
    hashed = docs.select("doc_id", content_hash(F.lit("process_rule"), none, F.col("source"), F.col("text")).alias("content_hash"))  # no text is joined
    existing = hashed.join(status, "doc_id").select(F.lit("process_rule").alias("item_type"), "content_hash", none.alias("source_document_id"), "status")
    made = created(candidates, links, chunks, docs.select(me.alias("document_id"), F.col("source").alias("original_filename")), existing)
    snap = lambda path: F.get_json_object("snapshot", path)
    versions = made.versions.select(F.col("knowledge_item_id").alias("id"), snap("$.status").alias("status"), snap("$.source_chunk_ids").alias("chunk_ids"))
    fine = made.items.join(versions.drop("status"), "id").select("id", "status", "source_document_id", "source_filename", "content_hash", "chunk_ids", F.lit(None).cast("string").alias("error"))
    text = F.lit(None).cast("string")
    return fine.unionByName(made.refused.select("id", text.alias("status"), none.alias("source_document_id"), text.alias("source_filename"), text.alias("content_hash"), text.alias("chunk_ids"), "error"))


def item_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents' items with a new title, those of quality 1, or content, the toxic ones; some titles are blank and some ids unknown."""
    items = _items(spark, sf_dir)
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    me = F.col("doc_id")
    patches = marks.select(F.when(me % 10 == 9, me + 1_000_000_000).otherwise(me).alias("id"), F.when(me % 7 == 0, " ").otherwise(" new title ").alias("title"), (F.col("q") == 1).alias("set_title"), F.lit("the same").alias("content"), (F.col("t") == 1).alias("set_content"))
    done = updated(items, patches, _links(items), reason="edited")
    fine = done.items.join(done.versions.select(F.col("knowledge_item_id").alias("id"), F.get_json_object("snapshot", "$.title").alias("snapshot_title")), "id")
    text = F.lit(None).cast("string")
    return fine.select("id", "version", "content_hash", "snapshot_title", text.alias("error")).unionByName(done.refused.select("id", F.lit(None).cast("int").alias("version"), text.alias("content_hash"), text.alias("snapshot_title"), "error"))


def item_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions of labelled documents' items with the links that they take over."""
    items = _items(spark, sf_dir)
    wanted = table(spark, sf_dir, "labels").select((F.col("doc_id") + F.when(F.col("doc_id") % 9 == 8, 1_000_000_000).otherwise(0)).alias("id"))
    done = revised(items, wanted, _links(items), F.col("id") + 5_000_000_000)
    n = done.links.groupBy(F.col("knowledge_item_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("chunk_id")), "|").alias("chunk_ids"))
    text = F.lit(None).cast("string")
    fine = done.items.join(n, "id", "left").select("id", "revises_item_id", "status", "version", "chunk_ids", text.alias("error"))
    return fine.unionByName(done.refused.select("id", F.lit(None).cast("long").alias("revises_item_id"), text.alias("status"), F.lit(None).cast("int").alias("version"), text.alias("chunk_ids"), "error"))


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a review of its user's item."""
    e = table(spark, sf_dir, "events")
    actions = e.select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("seq"), _word(ACTIONS, F.col("event_type")).alias("action"))
    items = e.where(F.col("user_id") % 10 != 7).select(F.col("user_id").alias("id")).distinct().withColumn("status", F.lit("draft"))
    held = review_events(items, actions, F.date_trunc("day", F.col("seq.ts")))
    return held.select(F.col("id").alias("user_id"), F.col("seq.event_id").alias("event_id"), "action", "from_status", "to_status", "error")


def revision_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items of which up to fifty revise each other in a row."""
    docs = table(spark, sf_dir, "documents")
    return revision_chains(docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 50 != 0, F.col("doc_id") - 1).alias("revises_item_id")))


def item_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = list_items(_items(spark, sf_dir), item_type="process_rule", status="approved", text="an")
    return page(held.select("id", F.length("content").alias("n_chars")), [F.desc("n_chars"), F.col("id")], limit=20, offset=5)


def explicit_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for 1 to 25 chunks of each labelled document, some of which begin with another document's."""
    docs = spread(table(spark, sf_dir, "documents"))
    chunks = window_chunks(docs).withColumn("id", F.concat_ws("-", "document_id", "chunk_index"))
    me = F.col("doc_id")
    wanted = table(spark, sf_dir, "labels").select(me, F.explode(F.sequence(F.lit(0), (me % 25).cast("int"))).alias("position"))
    chunk = F.when((F.col("position") == 0) & (me % 7 == 0), F.concat((me + 1).cast("string"), F.lit("-0"))).otherwise(F.concat_ws("-", "doc_id", "position"))
    _, told = explicit_selection(wanted.select(me.alias("request_id"), "position", chunk.alias("chunk_id"), F.when(me % 3 == 0, me).alias("document_id")), chunks)
    return told


def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items whose id is divisible by 20 as queries, encoded by the hash embedding, on documents with vectors as chunks."""
    docs, chunks = _chunks_with_vectors(spark, sf_dir)
    texts = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    index = payload(syncable(docs, chunks.drop("content").join(texts, "id"), "m", 64))
    asked = table(spark, sf_dir, "benchmark").where(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("query_id"), "text")
    held = search_chunks(index, asked, HashProvider(64), Embedding("m", 64), Hybrid(limit=20))
    return held.select(
        F.col("query_id").cast("long").alias("query_id"), F.col("position").cast("int").alias("position"), "chunk_id", "document_id", "original_filename", "chunk_index", F.md5("content").alias("content_md5"), "source_metadata", "retrieval_source",
        F.round("keyword_score", 6).alias("keyword_score"), F.round("vector_score", 6).alias("vector_score"), F.col("keyword_rank").cast("int").alias("keyword_rank"), F.col("vector_rank").cast("int").alias("vector_rank"), F.round("hybrid_score", 9).alias("hybrid_score"),
        F.array_join("matched_keywords", "|").alias("keywords"), "embedding_model", "embedding_dim",
    )


QUERIES = {f.__name__: f for f in (item_creation, item_updates, item_revisions, review_log, revision_roots, item_page, explicit_chunks, chunk_search)}
