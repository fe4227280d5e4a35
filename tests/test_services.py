import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.config import Embedding, Hybrid, Rag
from millrace.errors import EngineError
from millrace.functions.text import TRUNCATED
from millrace.operators.context import broken_citations, context_header, formatted_context, pack_context
from millrace.operators.embedding import HashProvider, provider_of
from millrace.operators.index import check_mapping, drift, payload, replaced, syncable, upserted, write_index
from millrace.operators.knowledge import children, clashes, copied_links, fold_reviews, found_by_id, get_by_id, list_items, mixed_documents, new_and_skipped, resolve_sources, revision_chains, validate_extractions, with_hash
from millrace.operators.messages import conversation_faults, tool_faults
from millrace.operators.retrieval import fuse, parsed_hits, rerank, search_error, vector_topk_batch
from millrace.operators.runs import activate_runs, page, run_status, severity
from millrace.plans.rag import EchoModel, Message, Request, ask, extracted, prompts
from millrace.sources.archives import ArchiveLimits, archive_members, file_types, picked
from millrace.sources.files import extension_of, parsed_texts, read_files, upload_faults, uploaded
from millrace.streaming.ingest import distinct_documents, ingest, read_documents

HITS = "query_id int, id int, score double, rank int"


def test_fusion(spark):
    kw = spark.createDataFrame([(1, 10, 12.0, 1), (1, 11, 9.0, 2)], HITS)
    vec = spark.createDataFrame([(1, 12, 0.9, 1), (1, 10, 0.88, 2)], HITS)
    got = {r.id: r for r in fuse(kw, vec).collect()}
    assert got[10].retrieval_source == "both" and abs(got[10].hybrid_score - (0.5 / 61 + 0.5 / 62)) < 1e-15 and got[10].position == 1
    assert got[11].retrieval_source == "keyword" and got[12].retrieval_source == "vector" and got[12].position == 2
    assert fuse(kw, vec.limit(0), Hybrid(keyword_weight=1.0, vector_weight=0.0)).where("id = 10").first().hybrid_score == 1 / 61
    assert fuse(kw.limit(0), vec.limit(0)).count() == 0
    with pytest.raises(EngineError):
        rerank(kw, True)
    with pytest.raises(EngineError):
        provider_of("none", Embedding())


ITEMS = "query_id int, position int, chunk_id string, document_id string, chunk_index int, original_filename string, retrieval_source string, hybrid_score double, content string"


def fold(items, most):
    """The packing as a loop."""
    used, out = 0, []
    for n, (head, content) in enumerate(items, 1):
        room = most - used - (2 if out else 0) - head
        if room <= 0:
            break
        kept = content if len(content) <= room else TRUNCATED[:room] if room <= 9 else content[: room - 9] + TRUNCATED
        used += (2 if out else 0) + head + len(kept)
        out.append((n, kept, len(content) > room, used))
    return out


@pytest.mark.parametrize("most", [0, 100, 260, 400, 777, 5000])
def test_context(spark, most):
    rng = random.Random(most)
    rows = [(q, i, f"c{i}", "d", i, "f.md", "both", round(rng.random(), 2), None if i == 3 else "冒口补缩" * rng.randint(0, 60)) for q in range(4) for i in range(1, 9)]
    df = spark.createDataFrame(rows, ITEMS)
    got = pack_context(df, Rag(max_chars=most))
    heads = {(r.query_id, r.chunk_id, r.n): len(r.h) for r in df.crossJoin(spark.range(1, 9).withColumnRenamed("id", "n")).withColumn("h", context_header(F.col("n"))).collect()}
    for q in range(4):
        order = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[7], r[1]))
        want = fold([(heads[q, r[2], n], r[8] or "") for n, r in enumerate(order, 1)], most)
        held = got.where(F.col("query_id") == q).orderBy("citation_id").collect()
        assert [(r.citation_id, r.content, r.was_truncated, r.used_chars) for r in held] == want
        assert not want or (sum(len(r.block) for r in held) + 2 * (len(held) - 1) == want[-1][3] <= most)
    assert broken_citations(got).count() == 0


def test_answers(spark):
    df = spark.createDataFrame([(1, 1, "c", "d", 0, "f", "both", 0.5, "text")], ITEMS)
    packed = pack_context(df)
    asked = prompts(packed, spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id int, text string"))
    model = EchoModel("because [1]")
    got = ask(model, asked, packed, 1)
    assert got["answer"] == "because [1]" and got["citations"][0]["chunk_id"] == "c" and "why?" in model.asked[0].messages[1].content
    assert ask(model, asked, packed, 2)["context_status"] == "no_context" and len(model.asked) == 1
    assert formatted_context(packed).first().context.startswith("[1] 来源文件: f\nchunk_index: 0\n")
    for bad in (lambda: Message("robot", "x"), lambda: Request(()), lambda: ask(EchoModel(" "), asked, packed, 1)):
        with pytest.raises(EngineError):
            bad()


GOOD = {"item_type": "process_rule", "title": "T", "content": "C", "confidence": 0.5, "source_chunk_ids": ["c1"]}


def test_extractions(spark):
    case = lambda *items: json.dumps({"items": list(items)})
    data = [
        (case(GOOD), None), (case(), None), ("```json\n" + case(GOOD, GOOD) + "\n```", None), ("nope", "not JSON"), ("[1]", "not an object"), ("{}", "items missing"), ('{"items": 1}', "items is not a list"), (case(1), "item is not an object"),
        (case(GOOD | {"status": "x"}), "forbidden field"), (case(GOOD | {"more": 1}), "unknown field"), (case(GOOD | {"item_type": "gossip"}), "unknown item_type"), (case(GOOD | {"title": "  "}), "title or content missing"),
        (case(GOOD | {"confidence": 2}), "confidence out of range"), (case(GOOD | {"source_chunk_ids": []}), "no source chunks"), (case(GOOD | {"source_chunk_ids": ["zz"]}), "unknown source chunk"), (case(GOOD, GOOD | {"content": ""}), "title or content missing"), (None, "not JSON"),
    ]
    df = spark.createDataFrame([(i, t, ["c1", "c2"]) for i, (t, _) in enumerate(data)], "i int, output string, chunk_ids array<string>")
    got = {r.i: r for r in validate_extractions(df).collect()}
    assert [got[i].error for i in range(len(data))] == [e for _, e in data]
    assert len(got[2].items) == 2 and got[1].items == [] and got[3].items is None and str(got[0]["items"][0].confidence) == "0.5000"
    assert extracted(df).count() == 3
    assert validate_extractions(df, item_types=("defect_cause",)).where("i = 0").first().error == "item_type not allowed"


def test_items(spark):
    cand = spark.createDataFrame([("a", "process_rule", "T", "x", None, 1), ("b", "process_rule", " T ", "x", None, 2), ("c", "process_rule", "T", "x", "d", 3), ("e", "defect_cause", "T", "x", None, 4)], "id string, item_type string, title string, content string, source_document_id string, position int")
    old = with_hash(spark.createDataFrame([("z", "defect_cause", "T", "x", None, "approved"), ("y", "process_rule", "T", "x", "d", "deprecated")], "id string, item_type string, title string, content string, source_document_id string, status string"))
    assert {r.id: r.skipped for r in new_and_skipped(with_hash(cand), old).collect()} == {"a": False, "b": True, "c": False, "e": True}
    items = cand.withColumn("status", F.lit("draft"))
    assert [r.id for r in list_items(items, item_type="process_rule", text="t").orderBy("id").collect()] == ["a", "b", "c"]
    links = spark.createDataFrame([("a", "d1"), ("a", "d2"), ("b", "d1"), ("c", "x")], "knowledge_item_id string, document_id string")
    assert {r.id for r in mixed_documents(items, links).collect()} == {"a", "c"}


def test_revisions(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", None)], "id string, revises_item_id string")
    assert {(r.id, r.root_id, r.depth) for r in revision_chains(df).collect()} == {("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "d", 0)}


def test_reviews(spark):
    items = spark.createDataFrame([("a", "draft"), ("b", "approved"), ("c", "draft")], "id string, status string")
    acts = spark.createDataFrame([("a", 2, "approve"), ("a", 1, "submit"), ("a", 3, "submit"), ("a", 4, "deprecate"), ("b", 1, "reject"), ("b", 2, "fly")], "id string, seq int, action string")
    got = {r.id: tuple(r)[1:] for r in fold_reviews(items, acts).collect()}
    assert got == {"a": ("deprecated", 3, 1, "submit"), "b": ("approved", 0, 2, "reject"), "c": ("draft", 0, 0, None)}


def test_runs(spark):
    df = spark.createDataFrame([("r1", "d", "succeeded", 1, 5), ("r2", "d", "succeeded", 2, 4), ("r3", "d", "failed", 3, 9), ("r4", "e", "running", 1, None)], "id string, document_id string, status string, created_at int, completed_at int")
    active = activate_runs(df)
    assert [r.id for r in active.where("is_active").collect()] == ["r1"]
    assert {tuple(r) for r in run_status(active).collect()} == {("d", 3, "r3", "failed", "r1"), ("e", 1, "r4", "running", None)}
    assert severity(spark.createDataFrame([("ok",), ("warning",)], "status string")).first()[0] == "warning" and severity(df.limit(0).select("status")).first()[0] == "ok"
    assert [(r.id, r.total) for r in page(df, [F.col("id")], 2, 1).collect()] == [("r2", 4), ("r3", 4)]
    with pytest.raises(EngineError):
        page(df, [F.col("id")], 0)


def test_index(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "f.md", "parsed"), ("d2", "g.md", "parsed")], "id string, original_filename string, process_status string")
    kind = "id string, document_id string, chunk_index int, content string, chunk_type string, page_start int, page_end int, section_title string, embedding array<float>, embedding_model string, embedding_dim int, embedding_status string"
    row = lambda i, d, m="m", dim=2, s="embedded", e=(1.0, 0.0): (i, d, 0, "HT250 冒口", "text", 1, 1, None, list(e) if e else None, m, dim, s)
    chunks = spark.createDataFrame([row("1", "d1"), row("2", "d1", m="n"), row("3", "d2", dim=3), row("4", "d2", s="embed_failed"), row("5", "d2", e=None), row("6", "d2")], kind)
    rows = payload(syncable(docs, chunks, "m", 2))
    assert {r.chunk_id for r in rows.collect()} == {"1", "6"} and rows.first().exact_terms == ["HT250", "冒口"] and rows.first().source_metadata == "{}"
    check_mapping(rows, 2)
    with pytest.raises(EngineError):
        check_mapping(rows, 5)
    with pytest.raises(EngineError):
        check_mapping(rows.drop("content"), 2)
    folder = str(tmp_path / "index")
    for _ in range(2):
        write_index(spark, rows, folder, 4)
    assert spark.read.parquet(folder).count() == 2
    old, new = spark.createDataFrame([("1", "d1"), ("9", "d1"), ("8", "d2")], "chunk_id string, document_id string"), spark.createDataFrame([("1", "d1")], "chunk_id string, document_id string")
    assert upserted(old, new).count() == 3 and {r.chunk_id for r in replaced(old, new, new).select("chunk_id").collect()} == {"1", "8"}
    assert tuple(drift(new, old).first()) == (1, 3, 0, 2)


def test_messages(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "user", " "), (1, 3, "system", "x"), (2, 0, "robot", None)], "conv_id int, turn int, role string, text string")
    assert {tuple(r) for r in conversation_faults(df).collect()} == {(1, 4, 0, 1, 1, 1), (2, 1, 1, 1, 0, 0)}
    tools = spark.createDataFrame([(1, 1, "assistant", ["a", "b"], None), (1, 2, "tool", None, "a"), (1, 3, "tool", None, "a"), (1, 4, "tool", None, "zz"), (1, 5, "assistant", ["b"], None), (2, 1, "tool", None, "q"), (2, 2, "assistant", ["q"], None)], "conv_id int, turn int, role string, call_ids array<string>, reply_to string")
    assert {tuple(r) for r in tool_faults(tools).collect()} == {(1, 3, "a", "second reply"), (1, 4, "zz", "reply to no call"), (1, 5, "b", "repeated call id"), (2, 1, "q", "reply before its call")}


def zipped(members, **kw):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members:
            z.writestr(name, body)
    return out.getvalue()


def test_archives(spark):
    good = zipped([("result/full.md", "﻿hi"), ("result/deep/full.md", "no"), ("result/x_content_list.json", "[{}]"), ("result/images/a.png", b"p"), ("notes.txt", "n"), ("layout.json", "{}")])
    link = zipfile.ZipInfo("l")
    link.external_attr = 0o120777 << 16
    data = [("good", good), ("up", zipped([("../x", "y")])), ("link", zipped([(link, "t")])), ("bomb", zipped([("full.md", "a" * 1_000_000)])), ("list", zipped([("a_content_list.json", "[1]")])), ("junk", b"zzz"), ("none", None), ("many", zipped([(f"f{i}", "") for i in range(9)]))]
    got = archive_members(spark.createDataFrame(data, "path string, content binary"), limits=ArchiveLimits(members=8))
    errors = {r.id: r.error for r in got.where("error is not null").collect()}
    assert errors["up"] == "path leaves the archive" and errors["link"] == "symbolic link" and errors["bomb"] == "compression ratio too high" and errors["list"] == "content list is not a list of objects" and errors["many"] == "too many members" and errors["junk"].startswith("unreadable") and errors["none"].startswith("unreadable")
    best = {r.kind: r for r in picked(got).collect()}
    assert best["markdown"].text == "hi" and set(best) == {"markdown", "content_list", "image", "layout_json"} and file_types(got).first().file_types == ["content_list", "image", "layout_json", "markdown"]


def test_files(spark, tmp_path):
    (tmp_path / "a.MD").write_bytes("﻿é".encode())
    (tmp_path / "b.txt").write_bytes(b"x\xffy")
    (tmp_path / "c.exe").write_bytes(b"1")
    (tmp_path / "d.pdf").write_bytes(b"1" * 100)
    files = read_files(spark, str(tmp_path))
    assert {r.filename: r.reject_reason for r in upload_faults(files, most=50).collect()} == {"a.MD": None, "b.txt": None, "c.exe": "INVALID_FILE_TYPE", "d.pdf": "FILE_TOO_LARGE"}
    text = {r.filename: r for r in parsed_texts(files).collect()}
    assert text["a.MD"].text == "﻿é" and text["b.txt"].text == "x�y" and text["c.exe"].text is None and text["d.pdf"].text.split("\n")[0] == "原始文件名：d.pdf" and text["d.pdf"].placeholder
    rows = {r.original_filename: r for r in uploaded(files, F.lit("2026-03-01").cast("timestamp")).collect()}
    assert rows["a.MD"].object_key.startswith("raw/2026/03/") and rows["a.MD"].object_key.endswith(".md") and "c.exe" not in rows
    names = spark.createDataFrame([("a.b.TXT", None), ("noext", "PDF"), (".hidden", None), ("x", " .Md ")], "n string, t string")
    assert [r[0] for r in names.select(extension_of(F.col("n"), F.col("t"))).collect()] == [".txt", ".pdf", "", ".md"]


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a" * 1500), (2, "b")], "doc_id int, text string").write.parquet(src)
    schema = spark.read.parquet(src).schema
    for _ in range(2):  # again: what was taken isn't taken twice
        ingest(read_documents(spark, src, schema), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    spark.createDataFrame([(3, "c")], "doc_id int, text string").write.mode("append").parquet(src)
    ingest(read_documents(spark, src, schema), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    stream = distinct_documents(spark.readStream.format("rate").load(), "timestamp", "1 minute", "value")
    assert stream.isStreaming and HashProvider(2).encode_query("") is not None


def test_long_revision_chains_and_circles(spark):
    data = [(f"i{n}", f"i{n - 1}" if n else None) for n in range(1001)] + [("x", "y"), ("y", "z"), ("z", "x"), ("w", "w"), ("o", "gone")]
    got = {r.id: r for r in revision_chains(spark.createDataFrame(data, "id string, revises_item_id string")).collect()}
    assert len(got) == len(data) and all(got[f"i{n}"].root_id == "i0" and got[f"i{n}"].depth == n for n in range(1001))
    assert all(got[i].root_id is None and got[i].error for i in "xyzw") and (got["o"].root_id, got["o"].depth, got["o"].error) == ("gone", 1, None)
    assert revision_chains(spark.createDataFrame([], "id string, revises_item_id string")).count() == 0


def test_hot_duplicates_stay_where_they_are(spark):
    """A text with half of all rows is joined by a broadcast, the others by key; each group's first row stands."""
    rows = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("item_type"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("h"), (F.col("id") / 4).cast("int"))).alias("content_hash"), F.lit(None).cast("string").alias("source_document_id"), F.lit("draft").alias("status"), F.col("id").alias("position"))
    plan = new_and_skipped(rows, rows.limit(0))
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().toString()
    got = {int(r.id): r.skipped for r in plan.collect()}
    assert len(got) == 4000 and not got[0] and all(got[i] for i in range(2, 4000, 2)) and [got[i] for i in (1, 3, 5, 7)] == [False, True, False, True]
    twins = {r.id: r.duplicate_id for r in clashes(rows, rows).collect()}
    assert len(twins) == 4000 and twins["0"] == "998" and twins["998"] == "0" and twins["1"] == "3" and twins["3"] == "1"


def test_vector_ties_and_repeated_ids(spark, rows):
    v = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(12)] + [(3, [0.0, 1.0]), (20, [0.0, 0.0]), (21, None)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (3, [1.0, 0.0]), (99, [1.0, 0.0])], "query_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.id, r.score) for r in vector_topk_batch(v, asked, 4).collect())
    assert got == [(0, 1, 3, 1.0), (0, 2, 6, 1.0), (0, 3, 9, 1.0), (0, 4, 1, 0.707106781), (3, 1, 0, 1.0), (3, 2, 6, 1.0), (3, 3, 9, 1.0), (3, 4, 1, 0.707106781), (99, 1, 0, 1.0), (99, 2, 3, 1.0), (99, 3, 6, 1.0), (99, 4, 9, 1.0)]


def test_item_sources(spark):
    docs = spark.createDataFrame([("d1", "one.md"), ("d2", "two.md")], "document_id string, original_filename string")
    chunks = spark.createDataFrame([("a", "d1"), ("b", "d1"), ("c", "d2"), ("z", "gone")], "chunk_id string, document_id string")
    items = spark.createDataFrame([(1, None, None), (2, "d1", "own"), (3, None, None), (4, "d2", None), (5, None, None), (6, "no", None), (7, None, None), (8, None, None), (9, "d2", None)], "id int, source_document_id string, source_filename string")
    links = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "c"), (4, "a"), (5, "missing"), (5, "a"), (7, "z")], "id int, chunk_id string")
    got = {r.id: (r.document_id, r.filename, r.error and r.error[15:]) for r in resolve_sources(items, links, chunks, docs).collect()}
    bad = {3: "VALIDATION_FAILED", 4: "VALIDATION_FAILED", 5: "SOURCE_CHUNK_NOT_FOUND", 6: "SOURCE_DOCUMENT_NOT_FOUND", 7: "SOURCE_DOCUMENT_NOT_FOUND"}
    assert got == {1: ("d1", "one.md", None), 2: ("d1", "own", None), 8: (None, None, None), 9: ("d2", "two.md", None)} | {i: (None, None, e) for i, e in bad.items()}


def test_clashes_and_look_up(spark):
    rows = spark.createDataFrame([(1, "t", "h", None, "draft"), (2, "t", "h", None, "deprecated"), (3, "t", "g", None, None), (4, "t", "g", None, "approved"), (5, "t", "g", "d", "draft")], "id int, item_type string, content_hash string, source_document_id string, status string")
    assert {r.id: r.duplicate_id for r in clashes(rows, rows).collect()} == {1: None, 2: 1, 3: 4, 4: 3, 5: None}
    assert get_by_id(rows, 3).content_hash == "g"
    with pytest.raises(EngineError) as e:
        get_by_id(rows, 9, code="KNOWLEDGE_ITEM_NOT_FOUND")
    assert e.value.code == "KNOWLEDGE_ITEM_NOT_FOUND"
    assert {r.id: r.error for r in found_by_id(rows, spark.createDataFrame([(1,), (9,)], "id int")).collect()} == {1: None, 9: "DOCUMENT_NOT_FOUND"}
    links = spark.createDataFrame([("a", "c1"), ("a", "c2"), ("b", "c3")], "knowledge_item_id string, chunk_id string")
    assert [(r.knowledge_item_id, r.chunk_id) for r in copied_links(links, spark.createDataFrame([("n", "a")], "id string, revises_item_id string")).orderBy("chunk_id").collect()] == [("n", "c1"), ("n", "c2")]
    assert [r.chunk_id for r in children(spark.createDataFrame([("a",)], "knowledge_item_id string"), links, "knowledge_item_id", ["chunk_id"]).collect()] == ["c1", "c2"]


def test_engine_hits_and_failures(spark):
    hits = ['{"_id": "i", "_score": 2, "_source": {"chunk_id": "c", "x": 1}}', '{"_id": "i"}', '{"_score": 3, "_source": {"chunk_id": ""}}', "no", None]
    got = parsed_hits(spark.createDataFrame([(h,) for h in hits], "hit string")).collect()
    assert {(r.chunk_id, r.score, r.source) for r in got} == {("c", 2.0, '{"chunk_id":"c","x":1}'), ("i", 0.0, "{}")}
    missing = type("ApiError", (Exception,), {"status_code": 404})()
    assert [search_error(e).code for e in (missing, ValueError("index_not_found_exception"), ConnectionError("x"), TimeoutError(), ValueError("x"))] == ["SEARCH_INDEX_NOT_FOUND"] * 2 + ["SEARCH_ENGINE_UNAVAILABLE"] * 2 + ["HYBRID_SEARCH_FAILED"]
