import io
import json
import zipfile

from pyspark.sql import functions as F

from millrace.operators.assets import allowed_scalars, asset_contexts, asset_summaries, relative_path, resolve_assets, run_summaries, upload_plan_faults
from millrace.plans.parsing import parse_archives, parse_lists, parse_texts


def test_paths(spark):
    data = [("a/./b//c", "a/b/c"), ("..\\x", None), ("/abs", None), ("C:\\x", None), ("", None), (" images\\A.png ", "images/A.png"), (".", None)]
    got = [r[0] for r in spark.createDataFrame(data, "x string, y string").select(relative_path(F.col("x"))).collect()]
    assert got == [d[1] for d in data]


def test_contexts(spark):
    items = [{"type": "table", "img_path": "out/Images/T.png", "table_caption": ["c"], "table_footnote": "n", "page_idx": 0}, {"type": "image", "img_path": "images/t.png", "page_idx": 4}, {"type": "equation", "img_path": "images\\e.png", "id": "k"}, {"type": "image", "img_path": "other/x.png"}, {"type": "image"}]
    got = {r.image_path: tuple(r)[2:] for r in asset_contexts(spark.createDataFrame([("d", json.dumps(items)), ("e", "1")], "document_id string, content_list string")).collect()}
    assert got == {"images/t.png": ("table_image", 0, "c\nn", "block-000000"), "images/e.png": ("formula_image", None, None, "k")}


def test_resolution(spark):
    assets = spark.createDataFrame([("d", "p/images/a.png", "a.png", "r/images/a.png"), ("d", "p/x/b.png", "b.png", None), ("d", "p/y/b.png", "b.png", None), ("d", "p/c.png", "C.png", "s/images/a.png")], "document_id string, asset_key string, filename string, source_path string")
    refs = spark.createDataFrame([("d", 1, "r/images/a.png", None, "zz"), ("d", 2, "q/images/a.png", None, "zz"), ("d", 3, None, "x/b.png", "zz"), ("d", 4, None, "p/y/b.png", "zz"), ("d", 5, None, None, "q/B.png"), ("d", 6, None, None, "c.PNG"), ("d", 7, None, None, "none"), ("e", 8, None, None, "c.png")], "document_id string, ref_id int, source_path string, asset_key string, filename string")
    got = {r.ref_id: (r.resolved_key, r.error) for r in resolve_assets(refs, assets, F.lit("p")).collect()}
    many, none = (None, "more than one asset matches"), (None, "no asset matches")
    assert got == {1: ("p/images/a.png", None), 2: many, 3: ("p/x/b.png", None), 4: ("p/y/b.png", None), 5: many, 6: ("p/c.png", None), 7: none, 8: none}


def test_plans_and_summaries(spark):
    kind = "document_id string, asset_key string"
    got = upload_plan_faults(spark.createDataFrame([("d", "a"), ("d", "b")], kind), spark.createDataFrame([("d", "a"), ("d", "a"), ("d", "c")], kind))
    assert {tuple(r)[1:] for r in got.collect()} == {("a", "planned twice"), ("b", "not planned"), ("c", "not expected")}
    meta = json.dumps({"width": 3, "origin": 'q"' * 150, "height": [1], "checksum": None, "secret": "x", "task_id": True})
    df = spark.createDataFrame([(meta, "c" * 501, "failed"), (None, None, "succeeded"), ("bad", "c", "failed")], "source_metadata string, caption string, status string")
    first, *rest = asset_summaries(df).collect()
    assert json.loads(first.metadata_summary) == {"width": 3, "origin": ('q"' * 150)[:200]} and first.caption == "c" * 500 + "..." and [r.metadata_summary for r in rest] == ["{}", "{}"]
    runs = run_summaries(df).collect()
    assert json.loads(runs[0].metadata_summary) == {"task_id": True} and [r.failure_status_persisted for r in runs] == [True, None, True] and runs[0].output_json_status == "unavailable"
    assert df.select(allowed_scalars(F.col("source_metadata"), ("status",))).first()[0] == "{}"


def test_texts(spark):
    df = spark.createDataFrame([("a", "a.txt", b"x" * 1500), ("b", "b.exe", b"x"), ("c", "c.md", b"  "), ("d", "d.txt", b"x"), ("e", "e.pdf", b"%"), ("f", "f.txt", None)], "id string, filename string, content binary")
    got = parse_texts(df, spark.createDataFrame([("d",)], "document_id string"))
    assert {(r.document_id, r.code) for r in got.failures.collect()} == {("b", "DOCUMENT_PARSE_FAILED"), ("c", "DOCUMENT_PARSE_FAILED"), ("d", "DOCUMENT_ALREADY_PARSED"), ("f", "DOCUMENT_PARSE_FAILED")}
    rows = got.chunks.collect()
    assert sorted((r.document_id, r.chunk_index) for r in rows) == [("a", 0), ("a", 1), ("e", 0)] and {r.embedding_status for r in rows} == {"not_started"} and len({r.id for r in rows}) == 3


def zipped(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members:
            z.writestr(name, body)
    return out.getvalue()


def test_archives(spark):
    blocks = json.dumps([{"type": "heading", "text": "T"}, {"type": "text", "text": "body"}])
    data = [("a", zipped(("r/x_content_list.json", blocks), ("r/full.md", "ignored"))), ("b", zipped(("full.md", "only this"))), ("c", b"junk"), ("d", zipped(("n.txt", "n")))]
    got = parse_archives(spark.createDataFrame(data, "id string, content binary"))
    assert {(r.document_id, r.content) for r in got.chunks.collect()} == {("a", "T\n\nbody"), ("b", "only this")} and got.links.count() == 3
    assert {r.document_id: r.reason for r in got.failures.collect()} == {"c": "unreadable: BadZipFile", "d": "no content list and no Markdown"}


def test_all_of_a_document_or_nothing(spark):
    """One bad element, or one bad member, and nothing of the document is in any output but the failures."""
    good, bad = [{"type": "text", "text": "one"}, {"type": "text", "text": "three"}], [{"type": "text", "text": "one"}, 7, {"type": "text", "text": "three"}]
    rows = [("a", "r", json.dumps(good), None, None), ("b", "r", json.dumps(bad), "text", None), ("c", "r", None, "text", None), ("d", "r", "[]", None, "# md"), ("e", "r", None, None, None), ("f", "r", "nope", "text", None), ("g", "r", json.dumps({"x": 1}), None, None)]
    got = parse_lists(spark.createDataFrame(rows, "document_id string, parse_run_id string, content_list string, text string, markdown string"))
    failed = {r.document_id: r.reason for r in got.failures.collect()}
    assert failed == {"b": "block 1: block is not an object", "e": "no content list and no Markdown", "f": "not JSON", "g": "not a list"}
    for out in (got.chunks, got.links.join(got.chunks, "chunk_key") if "chunk_key" in got.links.columns and "chunk_key" in got.chunks.columns else got.chunks, got.blocks):
        assert {r.document_id for r in out.select("document_id").collect()} == {"a", "c", "d"}
    assert parse_lists(spark.createDataFrame([], "document_id string, parse_run_id string, content_list string, text string, markdown string")).chunks.count() == 0
    archive = zipped(("r/x_content_list.json", json.dumps(good)), ("../evil.md", "x"))
    whole = parse_archives(spark.createDataFrame([("z", archive)], "id string, content binary"))
    assert whole.chunks.count() == 0 and whole.failures.count() == 1
