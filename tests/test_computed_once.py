"""What several steps read is computed once."""

import hashlib

from pyspark.sql import functions as F

from millrace.operators.block_chunking import prepared_blocks
from millrace.operators.chunking import window_chunks
from millrace.operators.embedding import CodePointHashes
from millrace.operators.items import created
from millrace.operators.paging import page_range
from millrace.plans.layout_queries import layout_blocks


def test_prepared_blocks_are_read_not_made_anew(spark):
    plan = prepared_blocks(layout_blocks(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and not any(step in plan for step in ("Window", "Generate", "Exchange"))


def test_a_code_point_at_a_place_is_hashed_once(monkeypatch):
    one, calls = CodePointHashes._one, []
    monkeypatch.setattr(CodePointHashes, "_one", lambda self, i, c: calls.append((i, c)) or one(self, i, c))
    held, text = CodePointHashes(16), "aé𝄞" * 3000 + "z"
    first = held.of(text).tolist()
    assert held.of(text).tolist() == first and len(calls) == len(text) == len(set(calls))
    for i in (0, 1, 2, 4095, 4096, 9000):
        d = hashlib.sha256(f"{i}:{text[i]}".encode()).digest()
        assert first[i] == int.from_bytes(d[:4], "big") % 16 << 9 | (d[4] & 1) << 8 | d[5]
    many = "".join(map(chr, range(500, 900)))
    assert held.of(many).tolist() == [one(held, i, c) for i, c in enumerate(many)]


def test_items_are_decided_by_ids_and_hashes(spark, monkeypatch):
    from millrace.operators import items

    wide, told = [], items.new_and_skipped
    monkeypatch.setattr(items, "new_and_skipped", lambda rows, *a, **k: wide.append(rows) or told(rows, *a, **k))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    none = F.lit(None).cast("string")
    cand = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("position"), F.lit("process_rule").alias("item_type"), F.col("source").alias("title"), F.col("text").alias("content"), none.alias("status"), F.lit(None).cast("long").alias("source_document_id"), none.alias("source_filename"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"))
    held = spark.createDataFrame([], "item_type string, content_hash string, source_document_id long, status string")
    done = created(cand, chunks.select(F.col("chunk_id").alias("id"), "chunk_id"), chunks, chunks.select("document_id", F.lit("f").alias("original_filename")), held)
    assert "content" not in wide[0].columns and done.items.count() + done.refused.count() == docs.count()
    plan = wide[0]._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "Join" not in plan and "sha2" not in plan


def test_a_deep_page_computes_its_order_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x * 7 % 5003

    rows = spark.range(0, 5000, 1, 4).select(counted("id").alias("k"), "id")
    found, before, total = page_range(rows, ["k", "id"], 10, 4000, most=50)
    assert total == 5000 and found.where("k >= 0").count() <= 50 and seen.value == 5000


def test_lengths_of_chunks_cut_no_text(spark):
    docs = spark.createDataFrame([(1, "é" * 2500), (2, "a"), (3, "b" * 1000), (4, "c" * 1001), (5, " "), (6, None)], "doc_id long, text string")
    chunks = window_chunks(docs)
    assert all(r.character_count == len(r.content) == r.char_end - r.char_start for r in chunks.collect()) and chunks.count() == 3 + 1 + 1 + 2
    assert "substring" not in chunks.select("character_count", "token_count", "char_end")._jdf.queryExecution().executedPlan().toString()
