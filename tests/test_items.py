import json

import pytest
from pyspark.sql import functions as F

from millrace.config import Embedding, Extraction, Hybrid
from millrace.errors import EngineError
from millrace.functions.text import json_without_nulls
from millrace.operators.block_chunking import linked, prepared_blocks
from millrace.operators.blocks import first_assets, normalize_blocks, result_file_assets, run_totals, with_fallback
from millrace.operators.context import extraction_system_prompt
from millrace.operators.embedding import HashProvider
from millrace.operators.index import ensure_index
from millrace.operators.items import created, explicit_selection, review_events, revised, updated
from millrace.operators.knowledge import fold_reviews, with_hash
from millrace.operators.retrieval import HIT_FIELDS, encoded_queries, search_chunks
from millrace.plans.rag import EchoModel, Message, Request, generated
from millrace.sources.files import upload_faults

ITEM = "id string, item_type string, title string, content string, status string, source_document_id string, source_filename string"


@pytest.fixture
def held(spark):
    """(items at version 2, links) of one draft, one approved and one rejected item."""
    rows = [("a", "process_rule", "A", "x", "draft", "d1", "f"), ("b", "process_rule", "B", "y", "approved", "d1", "f"), ("c", "process_rule", "C", "z", "rejected", None, None)]
    items = with_hash(spark.createDataFrame(rows, ITEM)).withColumn("version", F.lit(2))
    links = spark.createDataFrame([("b", "k2", "d1", 1), ("b", "k1", "d1", 0)], "knowledge_item_id string, chunk_id string, document_id string, chunk_index int")
    return items, links


def test_created(spark, held):
    rows = [
        ("1", "process_rule", " T ", "text", None, None, None, 1), ("2", "process_rule", "T", " text", "", None, None, 2), ("3", "gossip", "T", "text", None, None, None, 3), ("4", "process_rule", "T", "text", "approved", None, None, 4),
        ("5", "process_rule", "T", None, None, None, None, 5), ("6", "process_rule", "T", "text", " pending_review ", None, None, 6), ("7", "process_rule", "T", "text", None, None, None, 7), ("8", "process_rule", "A", "x", None, "d1", None, 8),
    ]
    cand = spark.createDataFrame(rows, ITEM + ", position int")
    links = spark.createDataFrame([("6", "k1"), ("6", "k2"), ("7", "gone")], "id string, chunk_id string")
    chunks = spark.createDataFrame([("k1", "d1", 0), ("k2", "d1", 1)], "chunk_id string, document_id string, chunk_index int")
    docs = spark.createDataFrame([("d1", "one.md")], "document_id string, original_filename string")
    done = created(cand, links, chunks, docs, held[0], F.lit("2026-01-01").cast("timestamp"))
    assert {(r.id, r.title, r.status, r.version, r.source_document_id, r.source_filename) for r in done.items.collect()} == {("1", "T", "draft", 1, None, None), ("6", "T", "pending_review", 1, "d1", "one.md")}
    code = {"2": "DUPLICATE", "3": "VALIDATION_FAILED", "4": "INVALID_STATUS", "5": "VALIDATION_FAILED", "7": "SOURCE_CHUNK_NOT_FOUND", "8": "DUPLICATE"}
    assert {r.id: r.error for r in done.refused.collect()} == {i: f"KNOWLEDGE_ITEM_{c}" for i, c in code.items()}
    snaps = {r.knowledge_item_id: json.loads(r.snapshot) for r in done.versions.collect()}
    assert snaps["6"]["source_chunk_ids"] == ["k1", "k2"] and snaps["1"]["source_chunk_ids"] == [] and snaps["1"]["source_document_id"] is None and done.links.count() == 2
    none = created(cand.limit(0), links, chunks, docs, held[0])
    assert none.items.count() == none.refused.count() == none.links.count() == 0


def test_updated(spark, held):
    items, links = held
    kind = "id string, title string, set_title boolean, content string, set_content boolean"
    patches = spark.createDataFrame([("a", " A2 ", True, None, False), ("b", "x", True, None, None), ("c", " ", True, "q", True), ("zz", "x", True, "y", True)], kind)
    done = updated(items, patches, links, reason="r")
    assert [(r.id, r.title, r.content, r.version) for r in done.items.collect()] == [("a", "A2", "x", 3)] and json.loads(done.versions.first().snapshot)["title"] == "A2"
    assert {r.id: r.error[15:] for r in done.refused.collect()} == {"b": "INVALID_STATUS", "c": "VALIDATION_FAILED", "zz": "NOT_FOUND"}
    taken = updated(items.withColumn("source_document_id", F.lit(None).cast("string")), spark.createDataFrame([("a", "B", True, "y", True)], kind), links)
    free = updated(with_hash(items.withColumn("source_document_id", F.lit(None).cast("string"))), spark.createDataFrame([("a", "N", True, "n", True), ("c", "N", True, "n", True)], kind), links)
    assert taken.refused.count() == 0 and [r.id for r in free.items.collect()] == ["a"] and [(r.id, r.error) for r in free.refused.collect()] == [("c", "KNOWLEDGE_ITEM_DUPLICATE")]
    told = spark.createDataFrame([("a", "d9", "nine.md", None), ("c", None, None, "KNOWLEDGE_ITEM_SOURCE_CHUNK_NOT_FOUND")], "id string, document_id string, filename string, error string")
    moved = updated(items, spark.createDataFrame([("a", None, False, None, False), ("c", None, False, None, False)], kind), links, sources=told)
    assert [(r.id, r.source_document_id, r.source_filename) for r in moved.items.collect()] == [("a", "d9", "nine.md")] and [r.id for r in moved.refused.collect()] == ["c"]


def test_revised(spark, held):
    items, links = held
    done = revised(items, spark.createDataFrame([("a",), ("b",), ("b",), ("q",)], "id string"), links, F.concat("id", F.lit("'")))
    assert [(r.id, r.revises_item_id, r.status, r.version, r.title) for r in done.items.collect()] == [("b'", "b", "draft", 1, "B")]
    assert json.loads(done.versions.first().snapshot)["source_chunk_ids"] == ["k1", "k2"] and {r.knowledge_item_id for r in done.links.collect()} == {"b'"}
    assert {r.id: r.error[15:] for r in done.refused.collect()} == {"a": "INVALID_TRANSITION", "q": "NOT_FOUND"}


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_review_events(spark, width):
    """Equal to the actions one by one, and to the statuses that the fold ends in, however the actions fall into spans."""
    steps = ["submit", "approve", "deprecate", "submit", "reject", "submit", "approve", "fly", None, "deprecate"]
    actions = spark.createDataFrame([(i, n, steps[(n * (i + 1)) % len(steps)]) for i in range(6) for n in range(12)], "id int, seq int, action string")
    items = spark.createDataFrame([(i, s) for i, s in enumerate(["draft", "approved", "rejected", "pending_review", "deprecated"])], "id int, status string")
    span = F.floor(F.col("seq") / width)
    got = review_events(items, actions, span).orderBy("id", "seq").collect()
    moves = {("submit", "draft"): "pending_review", ("submit", "rejected"): "pending_review", ("approve", "pending_review"): "approved", ("reject", "pending_review"): "rejected", ("deprecate", "approved"): "deprecated"}
    want, last = [], {}
    for i, s in [(r.id, r.status) for r in items.collect()]:
        for n in range(12):
            a = steps[(n * (i + 1)) % len(steps)]
            to = moves.get((a, s))
            want.append((i, n, a, s, to, None if to else "KNOWLEDGE_ITEM_INVALID_TRANSITION"))
            s = to or s
        last[i] = s
    assert [tuple(r) for r in got if r.id < 5] == want and {r.error for r in got if r.id == 5} == {"KNOWLEDGE_ITEM_NOT_FOUND"} and len(got) == 72
    assert {r.id: r.status for r in fold_reviews(items, actions, span).collect()} == last
    assert review_events(items, actions.limit(0)).count() == 0


def test_explicit_selection(spark):
    chunks = spark.createDataFrame([(f"d{d}-{n}", f"d{d}", n, "x" * 10) for d in range(3) for n in range(5)], "id string, document_id string, chunk_index int, content string")
    asked = {1: (["d0-3", "d0-1"], None), 2: (["d0-0", "d1-0"], None), 3: (["d0-0", "no"], None), 4: (["d0-0"], "d1"), 5: (["d2-0"], "d2"), 6: ([f"d0-{n}" for n in range(4)], None), 7: ([f"d1-{n}" for n in range(3)], None)}
    df = spark.createDataFrame([(r, p, c, d) for r, (cs, d) in asked.items() for p, c in enumerate(cs)], "request_id int, position int, chunk_id string, document_id string")
    rows, told = explicit_selection(df, chunks, Extraction(max_chunks=3, max_chars=25))
    bad = "KNOWLEDGE_ITEM_CONFIG_INVALID"
    assert {r.request_id: r.error for r in told.collect()} == {1: None, 2: bad, 3: "KNOWLEDGE_ITEM_SOURCE_CHUNK_NOT_FOUND", 4: bad, 5: None, 6: bad, 7: bad}
    assert [r.chunk_id for r in rows.collect()] == ["d0-3", "d0-1", "d2-0"]


def test_extraction_settings():
    for wrong in ({"mode": "all"}, {"item_types": ()}, {"item_types": ("gossip",)}, {"default_status": "approved"}, {"max_chunks": 51}):
        with pytest.raises(EngineError):
            Extraction(**wrong)
    assert Extraction(mode=" Chunks ").with_max_chunks(3).max_chunks == 3 and Extraction().with_max_chunks(None).max_chunks == 20
    with pytest.raises(EngineError):
        Extraction(max_chunks=5).with_max_chunks(6)
    assert "process_rule." in extraction_system_prompt(("process_rule",)) and len(extraction_system_prompt().split("\n")) == 13


def test_generated():
    ask = Request((Message("user", "q"),), json_mode=True)
    assert generated(EchoModel('{"items": []}'), ask) == '{"items": []}' and generated(EchoModel("x"), Request((Message("user", "q"),))) == "x"
    plain = EchoModel("{}")
    plain.json_mode = False
    for model, code in ((EchoModel("no"), "LLM_JSON_INVALID"), (EchoModel(" "), "LLM_EMPTY_CONTENT"), (plain, "LLM_PARAMETER_UNSUPPORTED")):
        with pytest.raises(EngineError) as e:
            generated(model, ask)
        assert e.value.code == code


INDEX = "chunk_id string, document_id string, original_filename string, chunk_index int, content string, source_metadata string, exact_terms array<string>, embedding array<double>, embedding_model string, embedding_dim int, embedding_status string"


def test_index_search(spark):
    near = HashProvider(8).encode_query("riser")
    row = lambda i, d, text, m="m", s="embedded", v=near: (i, d, f"{d}.md", 0, text, "{}", ["HT250"] if "HT250" in text else [], v, m, 8, s)
    index = spark.createDataFrame([row("1", "a", "riser HT250"), row("2", "b", "other", v=[-x for x in near]), row("3", "a", "riser", m="n"), row("4", "a", "riser", s="embed_failed")], INDEX)
    asked = spark.createDataFrame([(1, " riser "), (2, "  ")], "query_id long, text string")
    got = search_chunks(index, asked, HashProvider(8), Embedding("m", 8), Hybrid(limit=5)).orderBy("position").collect()
    assert [(r.query_id, r.chunk_id, r.retrieval_source) for r in got] == [("1", "1", "both"), ("1", "2", "vector")] and got[0].matched_keywords == ["riser"] and got[0].asDict().keys() == {"query_id", "position", *HIT_FIELDS}
    assert [r.chunk_id for r in search_chunks(index, asked, HashProvider(8), Embedding("m", 8), document_id="b").collect()] == ["2"]
    assert search_chunks(index.limit(0), asked, HashProvider(8), Embedding("m", 8)).count() == 0
    assert [r.embedding for r in encoded_queries(asked, HashProvider(4), 8).collect()] == [None, None]


def test_ensure_index(spark, tmp_path):
    schema = spark.createDataFrame([], INDEX).schema
    spark.sql(f"CREATE DATABASE IF NOT EXISTS held LOCATION '{tmp_path}/db'")
    try:
        first, second = (ensure_index(spark, "held.chunks", "held.search", schema, 8) for _ in range(2))
        assert first["created"] and first["alias_created"] and first["mapping_status"] == "created" and not second["created"] and not second["alias_created"] and second["mapping_status"] == "matched"
        assert spark.table("held.search").count() == 0
        spark.sql("DROP TABLE held.chunks")
        ensure_index(spark, "held.chunks", "held.search", spark.createDataFrame([], "chunk_id int").schema, 8)
        with pytest.raises(EngineError):
            ensure_index(spark, "held.chunks", "held.search", schema, 8)
    finally:
        spark.sql("DROP DATABASE held CASCADE")


def test_json_without_nulls(spark):
    deep = {"a": None, "b": [1, None, {"c": None, "d": "x,null,\"y\":null"}, [None]], "null": "null", "e": {"f": None}, "g": None}
    lists = [[None, 1, None], [None], [], [1, [None, None, 2], None], ["null", None, "a\\"], None, 5]
    clean = lambda v: {k: clean(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else [clean(x) for x in v if x is not None] if isinstance(v, list) else v
    values = [deep, *lists]
    df = spark.createDataFrame([(i, json.dumps(v, separators=(",", ":"))) for i, v in enumerate(values) if v is not None], "i int, x string")
    assert {r.i: json.loads(r.y) for r in df.select("i", json_without_nulls(F.col("x")).alias("y")).collect()} == {i: clean(v) for i, v in enumerate(values) if v is not None}


def test_block_metadata_and_fallback(spark):
    raw = [
        {"type": "heading", "level": 2, "text": "T", "id": " k ", "rotation": 90, "language": " en ", "secret": "no", "sub_type": ["x"], "confidence": True},
        {"text": "b", "bbox": [1, None, 2], "page_start": None, "page_number": "7", "asset_keys": ["a.png"], "confidence": "0.5"},
        {"type": "text", "text": "c", "bbox": 5, "page_number": None, "page": 3, "score": 0.25},
    ]
    kind = "document_id string, parse_run_id string, content_list string, text string, markdown string"
    df = with_fallback(spark.createDataFrame([("d", "r", json.dumps(raw), "t", None), ("e", "r", "[]", "only", "# only"), ("f", "r", None, None, ""), ("g", "r", "nope", "t", "m")], kind))
    held = normalize_blocks(df)
    got = {(r.document_id, r.block_index): r for r in held.collect()}
    assert sorted(got) == [("d", 0), ("d", 1), ("d", 2), ("e", 0)] and (got["e", 0].text, got["e", 0].markdown) == ("only", "# only")
    meta = {k: json.loads(r.source_metadata) for k, r in got.items()}
    assert meta["d", 0] == {"original_type": "heading", "mineru_block_id": "k", "heading_level": 2, "rotation": 90, "language": "en", "confidence": True}
    assert meta["d", 1] == {"original_type": "unknown", "confidence": "0.5", "asset_keys": ["parsed-assets/d/r/a.png"]}
    assert [(got["d", i].page_start, got["d", i].bbox, got["d", i].confidence) for i in range(3)] == [(None, None, None), (7, "[1,2]", 0.5), (None, None, 0.25)]
    totals = {r.document_id: r for r in run_totals(held).collect()}
    assert (totals["d"].block_count, totals["d"].asset_count, totals["d"].page_count, totals["d"].output_json_key) == (3, 1, 7, "parsed-assets/d/r/output.json") and totals["e"].page_count is None


def test_assets_of_several_origins(spark):
    files = spark.createDataFrame([("d", "r", 0, "x/full.md", "MD", "text/markdown", "a/full.md", b"abc"), ("d", "r", 1, "..", None, None, None, None)], "document_id string, parse_run_id string, position int, filename string, file_type string, content_type string, source_path string, content binary")
    got = result_file_assets(files).orderBy("position").collect()
    assert [(r.asset_key, r.asset_type, r.size_bytes) for r in got] == [("parsed-assets/d/r/full.md", "markdown", 3), ("parsed-assets/d/r/result-000001", "other", None)] and json.loads(got[0].source_metadata) == {"origin": "result_file", "result_file_type": "markdown", "source_path": "a/full.md"}
    rows = lambda *xs: spark.createDataFrame([("d", "r", *x) for x in xs], "document_id string, parse_run_id string, asset_key string, position int, caption string")
    assert {(r.asset_key, r.origin, r.caption) for r in first_assets(rows(("k", 2, "b"), ("k", 1, "a")), rows(("k", 0, "z"), ("m", 1, None))).collect()} == {("k", 0, "a"), ("m", 1, None)}


def test_block_views_fall_back_on_metadata(spark):
    kind = "document_id string, parse_run_id string, block_index int, block_type string, text string, markdown string, html string, latex string, caption string, section_path array<string>, asset_keys array<string>, source_metadata string"
    row = lambda i, path, keys, meta: ("d", "r", i, "text", f"t{i}", None, None, None, None, path, keys, meta)
    df = spark.createDataFrame([row(0, [], None, '{"section_path": ["S"], "asset_keys": ["a"]}'), row(1, ["own"], ["b"], '{"section_path": ["S"], "asset_keys": ["a"]}'), row(2, [], [], "junk")], kind)
    assert [(r.section_path, r.asset_keys) for r in prepared_blocks(df).orderBy("block_index").collect()] == [(["S"], ["a"]), (["own"], ["b"]), (["own"], [])]
    links = spark.createDataFrame([("d", "r", 0, 0, 0), ("d", "r", 1, 0, 0)], "document_id string, parse_run_id string, chunk_index int, block_index int, block_order int")
    stored = spark.createDataFrame([("c", "d", "r", 0)], "id string, document_id string, parse_run_id string, chunk_index int")
    assert {r.chunk_index: (r.chunk_id, r.error) for r in linked(links, stored).collect()} == {0: ("c", None), 1: (None, "no such chunk")}


def test_content_types(spark):
    df = spark.createDataFrame([("a.txt", 1, "Text/Plain; charset=x"), ("b.txt", 1, "image/png"), ("c.txt", 1, None)], "filename string, file_size int, content_type string")
    assert {r.filename: r.reject_reason for r in upload_faults(df, content_types=("text/plain",)).collect()} == {"a.txt": None, "b.txt": "INVALID_FILE_TYPE", "c.txt": None}
