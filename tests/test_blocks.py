import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.config import BlockChunking
from millrace.operators import block_chunking
from millrace.operators.block_chunking import block_chunks, fragments, numbered_pieces, placement, prepared_blocks, reach, span_ends, split_lines, split_text
from millrace.operators.blocks import asset_type, block_assets, block_faults, duplicate_indexes, element_rows, html_blocks, list_blocks, normalize_blocks, normalize_elements, stored_blocks, with_section_paths

BLOCK = "document_id string, parse_run_id string, block_index int, block_key string, block_type string, page_start int, page_end int, text string, markdown string, html string, latex string, caption string, section_path array<string>, asset_keys array<string>"


def blocks(spark, *items):
    rows = []
    for i, item in enumerate(items):
        kind, text, extra = (*item, {})[:3] if len(item) == 2 else item
        e = {"page_start": None, "page_end": None, "markdown": None, "html": None, "latex": None, "caption": None, "section_path": [], "asset_keys": []} | extra
        rows.append(("d", "r", i, f"b{i}", kind, e["page_start"], e["page_end"], text, e["markdown"], e["html"], e["latex"], e["caption"], e["section_path"], e["asset_keys"]))
    return spark.createDataFrame(rows, BLOCK)


def chunked(spark, settings, *items):
    chunks, links = block_chunks(blocks(spark, *items), settings)
    return chunks.orderBy("chunk_index").collect(), links.orderBy("chunk_index", "block_order").collect()


def test_one_section_is_one_chunk(spark):
    chunks, links = chunked(spark, BlockChunking(), ("title", "Risers"), ("text", "Place them."), ("list", "a\nb"))
    assert len(chunks) == 1 and chunks[0].content == "Risers\n\nPlace them.\n\na\nb" and chunks[0].chunk_type == "text" and chunks[0].section_title == "Risers"
    assert [(r.block_index, r.block_order) for r in links] == [(0, 0), (1, 1), (2, 2)] and chunks[0].token_count == -(-len(chunks[0].content) // 4)


def test_sections_part(spark):
    chunks, _ = chunked(spark, BlockChunking(), ("title", "A"), ("text", "x"), ("title", "B"), ("text", "y"))
    assert [c.content for c in chunks] == ["A\n\nx", "B\n\ny"]


def test_tables_stay_whole(spark):
    table = "| a |\n" * 40
    chunks, _ = chunked(spark, BlockChunking(80, 20, 0), ("text", "before"), ("table", None, {"markdown": table}), ("text", "after"))
    assert [c.chunk_type for c in chunks] == ["text", "table", "text"] and chunks[1].content == table.strip() and chunks[1].content_format == "markdown"
    chunks, _ = chunked(spark, BlockChunking(400, 20, 0), ("title", "T"), ("table", None, {"html": "<table></table>"}), ("text", "after"))
    assert [c.content for c in chunks] == ["T\n\n<table></table>", "after"] and chunks[0].content_format == "mixed" and chunks[0].chunk_type == "table"
    chunks, _ = chunked(spark, BlockChunking(80, 20, 0, 60, keep_table_intact=False), ("table", table))
    assert len(chunks) > 1 and all(len(c.content) <= 60 for c in chunks)


def test_formulas(spark):
    chunks, links = chunked(spark, BlockChunking(500), ("text", "a"), ("formula", None, {"latex": "x^2"}), ("text", "b"))
    assert len(chunks) == 1 and "$$\nx^2\n$$" in chunks[0].content and chunks[0].chunk_type == chunks[0].content_format == "mixed" and len(links) == 3
    chunks, _ = chunked(spark, BlockChunking(60, 20, 10), ("text", "a"), ("formula", None, {"latex": "x" * 90}), ("text", "b"))
    assert len(chunks) == 3 and chunks[1].content == "$$\n" + "x" * 90 + "\n$$"


def test_images_headers_pages(spark):
    chunks, _ = chunked(spark, BlockChunking(), ("image", None, {"caption": "Fig 1", "asset_keys": ["k", "k"]}))
    assert chunks[0].chunk_type == "image_caption" and chunks[0].asset_keys == ["k"]
    chunks, _ = chunked(spark, BlockChunking(), ("header", "h"), ("mystery", "kept"), ("footer", "f"), ("text", "  "))
    assert [c.content for c in chunks] == ["kept"]
    chunks, _ = chunked(spark, BlockChunking(), ("text", "a", {"page_start": 2, "page_end": 2}), ("text", "b", {"page_start": 2, "page_end": 3}), ("text", "c"))
    assert (chunks[0].page_start, chunks[0].page_end) == (2, 3)


def test_long_text_is_split(spark):
    settings = BlockChunking(70, 10, 15)
    text = "\n\n".join(" ".join(f"word{i}{j}" for j in range(12)) for i in range(3))
    chunks, links = chunked(spark, settings, ("text", text))
    assert len(chunks) >= 3 and all(len(c.content) <= 70 for c in chunks) and {r.block_index for r in links} == {0}


@pytest.mark.parametrize("seed", range(5))
def test_splits_keep_all_words(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word", "x" * rng.randint(1, 50), " ", "  ", "\n\n", "\n"]) for _ in range(200))
    settings = BlockChunking(40, 10, 0)
    pieces = split_text(text, settings)
    assert "".join("".join(pieces).split()) == "".join(text.split()) and all(0 < len(p) <= 40 for p in pieces)
    assert "".join("".join(split_lines(text, 40)).split()) == "".join(text.split())


def test_documents_do_not_mix(spark):
    df = spark.createDataFrame([(f"d{d}", f"r{d % 3}", i, f"b{i}", "text", 1, 1, f"t{d}-{i} " * 30, None, None, None, None, [], []) for d in range(30) for i in range(7)], BLOCK)
    chunks, _ = block_chunks(df.repartition(5), BlockChunking(400, 50, 0))
    for r in chunks.collect():
        assert {w.split("-")[0] for w in r.content.split()} == {"t" + r.document_id[1:]}
    assert chunks.groupBy("document_id").count().select("count").distinct().count() == 1 and block_chunks(df.limit(0))[0].count() == 0


RAW = [
    {"type": "heading", "level": 1, "text": " One ", "page_idx": 0},
    {"type": "text", "text": "body", "page": 3, "page_end": 4, "bbox": [1, 2]},
    {"type": "text", "text_level": 3, "text": "Deep"},
    {"type": "heading", "level": 2, "text": "Two"},
    {"type": "list", "list_items": ["a", " ", "b"]},
    {"type": "table", "table_body": "<table></table>", "table_caption": ["c", "c"], "table_footnote": "n", "img_path": "images/t.png"},
    {"type": "table", "table_body": "| a |"},
    {"type": "equation", "text": "x^2", "text_format": "latex"},
    {"type": "figure", "image_caption": ["f"], "asset_keys": ["images/t.png", "../z.png"], "score": 0.5},
    {"type": "custom_type", "content": "what", "section_path": ["own"], "id": "k9"},
    {"type": "page_number", "text": 7},
    "not an object",
]


def test_normalize(spark):
    df = spark.createDataFrame([("d", "r", json.dumps(RAW)), ("e", "r", "{}"), ("f", "r", "nope"), ("g", "r", None)], "document_id string, parse_run_id string, content_list string")
    got = {r.block_index: r for r in normalize_blocks(df).collect()}
    assert sorted(got) == list(range(11))
    assert [got[i].block_type for i in range(11)] == ["title", "text", "title", "title", "list", "table", "table", "formula", "image", "unknown", "footer"]
    assert got[1].section_path == ["One"] and got[2].section_path == ["One", "Deep"] and got[3].section_path == ["One", "Two"] and got[4].section_path == ["One", "Two"] and got[9].section_path == ["own"]
    assert (got[0].page_start, got[0].page_end, got[1].page_start, got[1].page_end, got[1].bbox) == (0, 0, 3, 4, "[1,2]")
    assert got[4].text == "a\nb" and got[5].html == "<table></table>" and got[5].markdown is None and got[5].caption == "c\nn" and got[6].markdown == "| a |" and got[7].text is None and got[7].latex == "x^2"
    assert got[5].asset_keys == ["parsed-assets/d/r/images/t.png"] and got[8].asset_keys[1] == "parsed-assets/d/r/z.png" and got[8].confidence == 0.5 and got[9].block_key == "k9" and got[10].text == "7" and got[0].block_key == "block-000000"
    assets = {r.asset_key: r for r in block_assets(normalize_blocks(df)).collect()}
    assert assets["parsed-assets/d/r/images/t.png"].source_block_key == "block-000008" and len(assets) == 2
    assert duplicate_indexes(normalize_blocks(df)).count() == 0


def test_what_makes_no_block_is_told(spark):
    df = spark.createDataFrame([("d", "r", json.dumps([{"text": "a"}, 5, {"text": "b"}, None])), ("e", "r", "{}"), ("f", "r", "nope"), ("g", "r", None), ("h", "r", "[]")], "document_id string, parse_run_id string, content_list string")
    assert {(r.document_id, r.block_index, r.error) for r in block_faults(df).collect()} == {("d", 1, "block is not an object"), ("d", 3, "block is not an object"), ("e", None, "not a list"), ("f", None, "not JSON"), ("g", None, "not JSON")}


def test_first_declared_asset_wins(spark):
    fields = "document_id string, parse_run_id string, asset_key string, asset_type string, page_number int, caption string, source_block_key string, position int"
    declared = spark.createDataFrame([("d", "r", "k", "other", 9, "z", None, 2), ("d", "r", "k", "image", 1, "a", None, 1)], fields)
    blocks = spark.createDataFrame([("d", "r", 0, ["k", "m"], "table", 3, None, "b0")], "document_id string, parse_run_id string, block_index int, asset_keys array<string>, block_type string, page_start int, caption string, block_key string")
    assert {(r.asset_key, r.asset_type, r.page_number) for r in block_assets(blocks, declared).collect()} == {("k", "image", 1), ("m", "table_image", 3)}


def test_pieces_hold_all_words_in_order():
    """Pieces fit, lose nothing, and repeat only what leads them."""
    rng = random.Random(4)
    for _ in range(150):
        text = "".join(rng.choice(["word ", "a", "\n\n", " ", "longerword", "\n", "x" * 45]) for _ in range(rng.randint(1, 120)))
        settings = BlockChunking(min_chars=5, max_chars=60, overlap=0)
        pieces = split_text(text, settings)
        assert all(0 < len(p) <= 60 and p == p.strip() for p in pieces) and "".join("".join(pieces).split()) == "".join(text.split())
        led = split_text(text, BlockChunking(min_chars=5, max_chars=60, overlap=12))
        assert len(led) == len(pieces) and all(b.endswith(a) and len(b) <= 60 for a, b in zip(pieces, led, strict=True))


def test_asset_types(spark):
    df = spark.createDataFrame([("MD",), ("figure",), ("layout",), ("zip",), (None,)], "t string")
    assert [r[0] for r in df.select(asset_type(F.col("t"))).collect()] == ["markdown", "image", "layout_json", "other", "other"]


def test_html_blocks(spark):
    page = "<html><head><title>x</title></head><body><nav>m</nav><h1>Top &amp; more</h1><p>one<p>two <b>bold</b></p><h2>Sub</h2><ul><li>i</ul><script>var a='<p>'</script></body></html>"
    got = html_blocks(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")).orderBy("block_index").collect()
    assert [(r.block_type, r.text, r.section_path) for r in got] == [("title", "Top & more", ["Top & more"]), ("text", "one", ["Top & more"]), ("text", "two bold", ["Top & more"]), ("title", "Sub", ["Top & more", "Sub"]), ("list", "i", ["Top & more", "Sub"])]


def stack(items):
    """Section paths by one loop: (kind, level, text) in order."""
    path, out = [], []
    for kind, level, text in items:
        if kind == "title" and text is not None:
            path = path[: level - 1] + [text]
        out.append(list(path))
    return out


@pytest.mark.parametrize("span", [1, 2, 5, 4096])
def test_section_paths_over_spans(spark, span):
    rng = random.Random(span)
    docs = {f"d{d}": [(rng.choice(["title", "title", "text"]), rng.randint(1, 6), rng.choice([None, "x", f"t{i}"])) for i in range(40)] for d in range(4)} | {"plain": [("text", 1, "a")] * 7}
    rows = [(d, "r", i, k, lv, t, []) for d, items in docs.items() for i, (k, lv, t) in enumerate(items)]
    df = spark.createDataFrame(rows, "document_id string, parse_run_id string, block_index int, block_type string, level int, text string, own_path array<string>")
    got = {(r.document_id, r.block_index): r.section_path for r in with_section_paths(df, span).collect()}
    assert got == {(d, i): p for d, items in docs.items() for i, p in enumerate(stack(items))}


def test_elements_are_numbered_over_spans(spark):
    df = spark.createDataFrame([(d, "r", i, f"t{i}") for d in ("a", "b") for i in range(0, 60, 3)], "document_id string, parse_run_id string, turn int, text string")
    got = element_rows(df, F.struct(F.lit("text").alias("type"), "text"), F.col("turn"), F.floor(F.col("turn") / 7))
    assert sorted((r.document_id, r.block_index, json.loads(r.j)["text"]) for r in got.withColumn("j", F.to_json("raw")).collect()) == [(d, i, f"t{3 * i}") for d in ("a", "b") for i in range(20)]
    assert normalize_elements(got).where("block_type = 'text'").count() == 40 and element_rows(df.limit(0), F.struct("text"), F.col("turn"), F.lit(0)).count() == 0


def test_stored_blocks_are_listed(spark):
    held = blocks(spark, ("text", "a", {"asset_keys": ["k"]}), ("title", "b"), ("text", "c"))
    stored = stored_blocks(held.withColumn("source_metadata", F.lit('{"n": 1, "asset_keys": ["old"]}')), F.lit("2026-01-01").cast("timestamp"))
    assert [json.loads(r.source_metadata) for r in stored.orderBy("block_index").collect()] == [{"n": 1, "asset_keys": ["k"]}] + [{"n": 1, "asset_keys": ["old"]}] * 2
    assert [(r.block_index, r.total) for r in list_blocks(stored, "d", "r", " TEXT ", limit=1, offset=1).collect()] == [(2, 2)]
    assert list_blocks(stored, "other").count() == 0


def test_spans_make_the_chunks_of_one_pass(monkeypatch):
    """Spans folded from every lead and followed in order number chunks as one pass over all blocks does."""
    rng = random.Random(7)
    for trial in range(60):
        settings = BlockChunking(max_chars=rng.choice([8, 30, 90]), min_chars=2, overlap=0, max_table_chars=12, keep_table_intact=bool(trial % 2), keep_formula_with_context=bool(trial % 3))
        kinds, sections = rng.choice([["text"], ["title", "text", "table", "formula"], ["title", "table"]]), rng.choice([1, 3])
        items = [(i, rng.choice(kinds), "x" * rng.choice([1, 1, 3, 7, 20, 100]), (str(rng.randrange(sections)),)) for i in range(rng.randint(1, 300))]
        far = reach(settings)
        width = far + rng.randint(0, 5)
        state, got = (0, 0, 0), []
        for a in range(0, len(items), width):
            own = items[a : a + width]
            slim = [(how, len(p) if how == "apart" else 1, len(c), k == "title", s) for _, k, c, s in items[a : a + width + far] for how, p in [placement(k, c, settings)]]
            lead, parts, number = state
            got += [(number + c, *rest) for c, *rest in numbered_pieces(own, settings, lead, parts)]
            left = span_ends(slim, len(own), settings.max_chars, far)[lead]
            state = (left[0], left[1], number + left[2])
        assert got == list(numbered_pieces(items, settings))


def test_a_long_document_is_many_tasks(spark, monkeypatch):
    """9000 blocks of one section, and 9000 of changing ones, in spans: equal to one pass, and no task reads a whole document."""
    settings = BlockChunking(60, 10, 0)
    rng = random.Random(3)
    items = [(d, "r", i, rng.choice(["text", "text", "text", "table"]) if d == "mixed" else "text", "w" * rng.choice([1, 5, 20, 80]), [str(i // 50)] if d == "mixed" and i % 50 == 0 else []) for d in ("plain", "mixed") for i in range(9000)]
    df = spark.createDataFrame(items + [("short", "r", 5, "text", "alone", [])], "document_id string, parse_run_id string, block_index int, block_type string, text string, section_path array<string>")
    none = F.lit(None).cast("string")
    df = df.withColumns({"markdown": none, "html": none, "latex": none, "caption": none}).repartition(7)

    def one_pass(doc):
        path, rows = (), []
        for d, _, i, kind, text, own in items:
            if d == doc:
                path = tuple(own) or path
                rows.append((i, kind, text, path))
        return [(doc, "r", *x) for x in numbered_pieces(rows, settings)]

    want = one_pass("plain") + one_pass("mixed") + [("short", "r", 0, 0, 5, "alone")]
    for span in (500, 4096):
        monkeypatch.setattr(block_chunking, "SPAN", span)
        parts = fragments(prepared_blocks(df, settings), settings)
        assert sorted(map(tuple, parts.collect())) == sorted(want)
    monkeypatch.setattr(block_chunking, "SPAN", 500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = fragments(prepared_blocks(df.where("document_id = 'plain'"), settings), settings).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 0.6 * sum(r["count"] for r in tasks)
