"""Blocks from semi-structured parse results (JSON arrays of objects)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import json_text, json_without_nulls, looks_like_html, optional_text, safe_segment, scalar_fields, strip
from millrace.operators.runs import page
from millrace.schemas import ASSET_TYPE_ALIASES, ASSET_TYPES, BLOCK_TYPE_ALIASES, BLOCK_TYPES

#: Caption keys of raw types besides "caption", and keys that name an asset.
CAPTION_KEYS = {
    "image": ("image_caption", "image_footnote"), "figure": ("image_caption", "image_footnote"), "chart": ("chart_caption", "chart_footnote"),
    "table": ("table_caption", "table_footnote"), "code": ("code_caption", "code_footnote"), "algorithm": ("code_caption", "code_footnote"),
}
ASSET_KEYS = ("asset_key", "image_path", "image_key", "img_path")
#: What of a raw block its metadata may show.
BLOCK_METADATA = ("category_id", "confidence", "language", "model_name", "rotation", "sub_type", "text_format")
#: Keys read as text.
TEXT_KEYS = (
    "type", "block_type", "category", "text", "content", "code_body", "text_format", "latex", "formula", "equation", "markdown", "table_markdown", "table_body", "html",
    "block_key", "block_id", "id", "parent_block_key", "parent_block_id", "parent_id", *ASSET_KEYS,
)


def lookup(x: Column, aliases: dict[str, str], known: Sequence[str], other: str) -> Column:
    """A vocabulary word, by way of its aliases, else other."""
    pairs = [F.lit(p) for kv in aliases.items() for p in kv]
    low = F.lower(strip(x))
    named = F.coalesce(F.try_element_at(F.create_map(*pairs), low), low)
    return F.when(named.isin(*known), named).otherwise(other)


def block_type(x: Column) -> Column:
    return lookup(F.coalesce(optional_text(x), F.lit("unknown")), BLOCK_TYPE_ALIASES, BLOCK_TYPES, "unknown")


def asset_type(x: Column) -> Column:
    return lookup(F.coalesce(optional_text(x), F.lit("other")), ASSET_TYPE_ALIASES, ASSET_TYPES, "other")


def raw_text(raw: Column, key: str) -> Column:
    """A key's value as text: trimmed, null if blank or a container."""
    v = F.try_variant_get(raw, f"$.{key}", "string")
    kind = F.schema_of_variant(F.try_variant_get(raw, f"$.{key}", "variant"))
    return F.when(~kind.rlike("^(ARRAY|OBJECT)"), optional_text(v))


def raw_int(raw: Column, key: str) -> Column:
    """A key's value as an int: numbers cut off, numeric text read, booleans not."""
    kind = F.schema_of_variant(F.try_variant_get(raw, f"$.{key}", "variant"))
    number = F.try_variant_get(raw, f"$.{key}", "double")
    text = F.try_variant_get(raw, f"$.{key}", "string")
    return F.when(kind == "BOOLEAN", F.lit(None).cast("int")).when(kind == "STRING", F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast("int"))).otherwise(number.try_cast("int"))


def raw_float(raw: Column, key: str) -> Column:
    """A key's value as a double: numbers and numeric text, booleans and containers not."""
    kind = F.schema_of_variant(F.try_variant_get(raw, f"$.{key}", "variant"))
    return F.when(~kind.rlike("^(ARRAY|OBJECT|BOOLEAN)"), F.try_variant_get(raw, f"$.{key}", "string").try_cast("double"))


def given(raw: Column, key: str) -> Column:
    """Whether a key is there, with null or anything else."""
    return F.try_variant_get(raw, f"$.{key}", "variant").isNotNull()


def raw_texts(raw: Column, key: str) -> Column:
    """A key's value, one or a list, as texts that aren't blank."""
    v = F.try_variant_get(raw, f"$.{key}", "variant")
    many = F.try_variant_get(raw, f"$.{key}", "array<string>")
    one = F.array(F.try_variant_get(raw, f"$.{key}", "string"))
    values = F.when(F.schema_of_variant(v).startswith("ARRAY"), many).when(v.isNotNull() & ~F.schema_of_variant(v).startswith("OBJECT"), one)
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), optional_text), lambda x: x.isNotNull())


def heading_level(raw: Column) -> Column:
    """1 to 6; a missing level and 0 count as 1."""
    level = F.coalesce(*[F.nullif(raw_int(raw, k), F.lit(0)) for k in ("level", "heading_level", "text_level")], F.lit(1))
    return F.least(F.greatest(level, F.lit(1)), F.lit(6))


def asset_key(prefix: Column, value: Column, fallback: Column) -> Column:
    """A key below the prefix, each segment safe; values below it already stay there."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(value, r"\\", "/"), "/"), safe_segment), lambda s: s != "")
    path = F.array_join(parts, "/")
    return F.when(F.startswith(value, prefix), value).otherwise(F.concat(prefix, F.coalesce(F.nullif(path, F.lit("")), fallback)))


def normalize_blocks(parsed: DataFrame, prefix: str = "parsed-assets", json_col: str = "content_list") -> DataFrame:
    """Rows of blocks from parse results (document_id, parse_run_id, content_list JSON text), by normalize_elements().

    Elements that aren't objects, and text that isn't a JSON array, give no block, but a row of block_faults().
    """
    v = F.try_parse_json(F.col(json_col))
    listed = parsed.where(F.schema_of_variant(v).startswith("ARRAY"))
    return normalize_elements(listed.select("document_id", "parse_run_id", F.posexplode(v.cast("array<variant>")).alias("block_index", "raw")), prefix)


def with_fallback(parsed: DataFrame, json_col: str = "content_list", text_col: str = "text", markdown_col: str = "markdown") -> DataFrame:
    """Parse results whose content list is missing or empty, but that have a text or Markdown, with one text element of these."""
    v = F.try_parse_json(F.col(json_col))
    none = F.col(json_col).isNull() | F.coalesce(F.schema_of_variant(v).startswith("ARRAY") & (F.size(F.try_variant_get(v, "$", "array<variant>")) == 0), F.lit(False))
    has = (F.coalesce(F.length(text_col), F.lit(0)) > 0) | (F.coalesce(F.length(markdown_col), F.lit(0)) > 0)
    one = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col(text_col).alias("text"), F.col(markdown_col).alias("markdown"))))
    return parsed.withColumn(json_col, F.when(none & has, one).otherwise(F.col(json_col)))


def element_rows(rows: DataFrame, element: Column, order: Column, span: Column) -> DataFrame:
    """Rows (document_id, parse_run_id, block_index, raw) from rows that hold one element each.

    Elements of a run are numbered from 0 by order. span rises with order: rows are numbered within a span, and the
    spans before it are counted, so that no document is gathered in one task.
    """
    key = ["document_id", "parse_run_id"]
    rows = rows.select(*key, F.parse_json(F.to_json(element)).alias("raw"), order.alias("_order"), span.alias("_span"))
    sizes = rows.groupBy(*key, "_span").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*key).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*key, "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = rows.withColumn("_at", F.row_number().over(W.partitionBy(*key, "_span").orderBy("_order")) - 1).join(starts, [*key, "_span"])
    return numbered.select(*key, (F.col("_start") + F.col("_at")).cast("int").alias("block_index"), "raw")


def normalize_elements(rows: DataFrame, prefix: str = "parsed-assets") -> DataFrame:
    """Rows of blocks from elements (document_id, parse_run_id, block_index, raw VARIANT).

    Types go through the aliases, "text" with a text_level is a title, anything unknown is "unknown". A title's section
    path is the path of headings above it, cut to its level, and itself; others inherit the path unless they name their own.
    """
    raw = F.col("raw")
    rows = rows.where(F.schema_of_variant(raw).startswith("OBJECT"))
    rows = rows.withColumns({f"_t_{k}": raw_text(raw, k) for k in TEXT_KEYS})  # each key is read once
    t = lambda *keys: F.coalesce(*[F.col(f"_t_{k}") for k in keys])
    original = t("type", "block_type", "category")
    low = F.lower(F.coalesce(original, F.lit("unknown")))
    leveled = (low == "text") & F.coalesce(raw_int(raw, "text_level") != 0, F.lit(False))
    rows = rows.withColumns({"original_type": original, "_low": low, "block_type": F.when(leveled, "title").otherwise(block_type(original)), "level": heading_level(raw)})
    low, kind = F.col("_low"), F.col("block_type")
    latex_only = (low == "equation") & t("latex", "formula", "equation").isNull() & (F.lower(t("text_format")) == "latex")
    body = t("text", "content")
    items = F.nullif(F.array_join(raw_texts(raw, "list_items"), "\n"), F.lit(""))
    text = F.when(low == "list", F.coalesce(items, body)).when(low.isin("code", "algorithm"), F.coalesce(t("code_body"), body)).when(latex_only, F.lit(None)).otherwise(body)
    table = t("table_body")
    said = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(raw, f"$.{k}", "variant")) != "VOID", F.lit(False))
    first_page = F.when(said("page_start"), raw_int(raw, "page_start")).when(given(raw, "page_number"), raw_int(raw, "page_number")).when(given(raw, "page"), raw_int(raw, "page")).otherwise(raw_int(raw, "page_idx"))
    captions = raw_texts(raw, "caption")
    for names in sorted(set(CAPTION_KEYS.values())):
        of = [k for k, v in CAPTION_KEYS.items() if v == names]
        more = F.concat(*[raw_texts(raw, n) for n in names])
        captions = F.concat(captions, F.when(low.isin(*of), more).otherwise(F.array().cast("array<string>")))
    refs = F.array_distinct(F.concat(F.array_compact(F.array(*[F.col(f"_t_{k}") for k in ASSET_KEYS])), raw_texts(raw, "asset_keys"), raw_texts(raw, "assets")))
    fallback = F.concat(F.lit("block-"), F.lpad(F.col("block_index").cast("string"), 6, "0"))
    base = F.concat_ws("/", F.lit(prefix), F.col("document_id").cast("string"), F.col("parse_run_id").cast("string"), F.lit(""))
    rows = rows.withColumns({
        "text": text, "block_key": F.coalesce(t("block_key", "block_id", "id"), fallback), "page_start": first_page, "page_end": F.coalesce(raw_int(raw, "page_end"), first_page),
        "markdown": F.when(kind == "table", F.coalesce(t("markdown"), t("table_markdown"), F.when(~looks_like_html(table), table))).otherwise(t("markdown")),
        "html": F.coalesce(t("html"), F.when((kind == "table") & looks_like_html(table), table)),
        "latex": F.coalesce(t("latex", "formula", "equation"), F.when((kind == "formula") & (F.lower(t("text_format")) == "latex"), body)),
        "caption": F.nullif(F.array_join(F.array_distinct(captions), "\n"), F.lit("")), "asset_keys": F.transform(refs, lambda r: asset_key(base, r, fallback)),
        "parent_block_key": t("parent_block_key", "parent_block_id", "parent_id"), "own_path": raw_texts(raw, "section_path"),
        "bbox": F.when(F.schema_of_variant(F.try_variant_get(raw, "$.bbox", "variant")).rlike("^(ARRAY|OBJECT)"), json_without_nulls(F.to_json(F.try_variant_get(raw, "$.bbox", "variant")))),
        "confidence": F.when(said("confidence"), raw_float(raw, "confidence")).otherwise(raw_float(raw, "score")),
    })
    # The keys of source_metadata, as stored rows have them.
    shown = [("original_type", json_text(F.left(F.coalesce("original_type", F.lit("unknown")), F.lit(200)))), ("mineru_block_id", json_text(F.left(t("block_id", "id", "block_key"), F.lit(200)))), ("heading_level", F.when(kind == "title", F.col("level").cast("string")))]
    shown += scalar_fields(raw, BLOCK_METADATA) + [("asset_keys", F.when(F.size("asset_keys") > 0, F.to_json("asset_keys")))]
    rows = rows.withColumn("source_metadata", F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in shown]), F.lit("}")))
    kept = rows.drop("raw", "_low", *[f"_t_{k}" for k in TEXT_KEYS])
    return with_section_paths(kept).drop("own_path", "level")


def block_faults(parsed: DataFrame, json_col: str = "content_list") -> DataFrame:
    """Rows (document_id, parse_run_id, block_index, error) for what normalize_blocks() makes no block of: text that isn't a
    JSON array (block_index is null), and elements that aren't objects, each by its index."""
    v = F.try_parse_json(F.col(json_col))
    listed = F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    rows = parsed.select("document_id", "parse_run_id", v.alias("v"), listed.alias("listed"))
    key = ["document_id", "parse_run_id"]
    whole = rows.where("not listed").select(*key, F.lit(None).cast("int").alias("block_index"), F.when(F.col("v").isNull(), "not JSON").otherwise("not a list").alias("error"))
    each = rows.where("listed").select(*key, F.posexplode(F.col("v").cast("array<variant>")).alias("block_index", "raw"))
    bad = ~F.coalesce(F.schema_of_variant("raw").startswith("OBJECT"), F.lit(False))
    return whole.unionByName(each.where(bad).select(*key, "block_index", F.lit("block is not an object").alias("error")))


def with_section_paths(rows: DataFrame, span_rows: int = 4096) -> DataFrame:
    """section_path by a stack of headings: rows (document_id, parse_run_id, block_index, block_type, level, text, own_path).

    The headings of span_rows blocks are folded together, from every depth that the stack can have before them; a row a span
    then tells each span's first path, and a window in the span carries the last one on.
    """
    key = ["document_id", "parse_run_id"]
    span = [*key, "_span"]
    empty = F.array().cast("array<string>")
    title = (F.col("block_type") == "title") & F.col("text").isNotNull()
    rows = rows.withColumn("_span", F.floor(F.col("block_index") / span_rows).cast("int"))
    heads = rows.groupBy(*span).agg(F.array_sort(F.collect_list(F.when(title, F.struct("block_index", "level", "text")))).alias("t"), F.min("block_index").alias("first"))

    def ends(depth: int) -> Column:
        """What a span leaves of a path of so many headings, and what it adds."""
        start = F.struct(F.lit(depth).alias("keep"), empty.alias("own"))
        return F.aggregate("t", start, lambda a, x: F.struct(F.least(a["keep"], x["level"] - 1).alias("keep"), F.array_append(F.slice(a["own"], F.lit(1), F.greatest(x["level"] - 1 - a["keep"], F.lit(0))), x["text"]).alias("own")))

    def follow(a, x):
        end = x["ends"][F.size(a["path"])]
        entry = F.struct(x["span"].alias("_span"), a["path"].alias("start"))
        return F.struct(F.concat(F.slice(a["path"], F.lit(1), end["keep"]), end["own"]).alias("path"), F.array_append(a["out"], entry).alias("out"))

    listed = heads.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("_span").alias("span"), F.array(*[ends(d) for d in range(7)]).alias("ends")))).alias("s"))
    none = F.struct(empty.alias("path"), F.array().cast("array<struct<_span:int,start:array<string>>>").alias("out"))
    starts = listed.select(*key, F.inline(F.aggregate("s", none, follow, lambda a: a["out"])))

    def push(a, x):
        path = F.array_append(F.slice(a["path"], F.lit(1), x["level"] - 1), x["text"])
        return F.struct(path.alias("path"), F.array_append(a["out"], F.struct(x["block_index"].alias("block_index"), path.alias("title_path"))).alias("out"))

    held = F.struct(F.col("start").alias("path"), F.array().cast("array<struct<block_index:int,title_path:array<string>>>").alias("out"))
    titles = F.aggregate("t", held, push, lambda a: a["out"])
    begins = F.array(F.struct(F.col("first").alias("block_index"), F.lit(None).cast("array<string>").alias("title_path")))
    entries = F.when(F.size("t") == 0, begins).when(F.col("t")[0]["block_index"] == F.col("first"), titles).otherwise(F.concat(begins, titles))
    folded = heads.join(starts, span).select(*span, "first", "start", F.inline(entries)).select(*span, "block_index", "title_path", F.when(F.col("block_index") == F.col("first"), F.col("start")).alias("_start"))
    both = rows.join(folded, [*span, "block_index"], "left")
    upto = W.partitionBy(*span).orderBy("block_index").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.coalesce(F.last("title_path", ignorenulls=True).over(upto), F.last("_start", ignorenulls=True).over(upto), empty)
    path = F.when(title & F.col("title_path").isNotNull(), F.col("title_path")).when(F.size("own_path") > 0, F.col("own_path")).otherwise(last)
    return both.withColumn("section_path", path).drop("title_path", "_start", "_span")


def stored_blocks(blocks: DataFrame, at: Column | None = None) -> DataFrame:
    """The rows of blocks as they are stored: source_metadata (JSON text) takes up asset_keys where there are any, and created_at."""
    keys = F.to_json(F.struct("asset_keys"))
    own = F.col("source_metadata") if "source_metadata" in blocks.columns else F.lit(None).cast("string")
    merged = F.to_json(F.map_concat(F.map_filter(F.from_json(own, "map<string,variant>"), lambda k, v: k != "asset_keys"), F.from_json(keys, "map<string,variant>")))
    held = F.when(F.size("asset_keys") > 0, F.when(own.isNull(), keys).otherwise(merged)).otherwise(F.coalesce(own, F.lit("{}")))
    return blocks.withColumns({"source_metadata": held, "created_at": at if at is not None else F.current_timestamp()}).drop("asset_keys")


def list_blocks(blocks: DataFrame, document_id: str | None = None, parse_run_id: str | None = None, kind: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of stored blocks, the latest first and by index within a run; total counts all that the filters leave."""
    for name, value in (("document_id", document_id), ("parse_run_id", parse_run_id), ("block_type", (kind or "").strip().lower() or None)):
        if value is not None:
            blocks = blocks.where(F.col(name) == value)
    return page(blocks, [F.desc("created_at"), F.col("block_index"), F.col("document_id")], limit=limit, offset=offset)


def block_assets(blocks: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Rows (document_id, parse_run_id, asset_key, asset_type, page_number, caption, source_block_key), a key once a run.

    Declared assets win over references from blocks, the first of a key by position, if they have that column; of several
    blocks that refer to a key the last one speaks.
    """
    kind = F.when(F.col("block_type") == "table", "table_image").when(F.col("block_type") == "formula", "formula_image").otherwise("image")
    refs = blocks.select("document_id", "parse_run_id", "block_index", F.explode("asset_keys").alias("asset_key"), kind.alias("asset_type"), F.col("page_start").alias("page_number"), "caption", F.col("block_key").alias("source_block_key"))
    fields = ["asset_type", "page_number", "caption", "source_block_key"]
    key = ["document_id", "parse_run_id", "asset_key"]
    held = refs.groupBy(*key).agg(F.max_by(F.struct(*fields), "block_index").alias("x")).select(*key, "x.*")
    if declared is None:
        return held
    rest = held.join(declared.select(*key), key, "left_anti")
    order = F.col("position") if "position" in declared.columns else F.struct(*fields)
    first = declared.groupBy(*key).agg(F.min_by(F.struct(*fields), order).alias("x")).select(*key, "x.*")
    return first.unionByName(rest)


def first_assets(*sources: DataFrame) -> DataFrame:
    """Assets of several origins (document_id, parse_run_id, asset_key, position, ...; equal columns), a key once a run: the first
    origin that has it wins (its number is in origin), and there the first by position."""
    key = ["document_id", "parse_run_id", "asset_key"]
    rows = None
    for n, source in enumerate(sources):
        one = source.withColumn("origin", F.lit(n))
        rows = one if rows is None else rows.unionByName(one)
    held = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*held), F.struct("origin", "position")).alias("x")).select(*key, "x.*")


def result_file_assets(files: DataFrame, prefix: str = "parsed-assets") -> DataFrame:
    """Files of a result (document_id, parse_run_id, position, filename, file_type, content_type, source_path, content) as assets."""
    name = F.regexp_extract(F.replace(F.coalesce("filename", F.lit("")), F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    fallback = F.concat(F.lit("result-"), F.lpad(F.col("position").cast("string"), 6, "0"))
    safe = F.coalesce(F.nullif(safe_segment(name), F.lit("")), fallback)
    base = F.concat_ws("/", F.lit(prefix), F.col("document_id").cast("string"), F.col("parse_run_id").cast("string"), F.lit(""))
    kind = asset_type(F.col("file_type"))
    path = F.left(optional_text(F.col("source_path")), F.lit(200))
    meta = F.to_json(F.struct(F.lit("result_file").alias("origin"), kind.alias("result_file_type"), path.alias("source_path")))
    return files.select("document_id", "parse_run_id", asset_key(base, safe, fallback).alias("asset_key"), "position", kind.alias("asset_type"), safe.alias("filename"), F.col("content_type").alias("mime_type"), F.length("content").cast("long").alias("size_bytes"), meta.alias("source_metadata"))


def run_totals(blocks: DataFrame, assets: DataFrame | None = None, prefix: str = "parsed-assets") -> DataFrame:
    """Rows (document_id, parse_run_id, block_count, asset_count, page_count, output keys) of runs; the largest page that a block
    names is their count, and assets are those that blocks refer to unless given."""
    key = ["document_id", "parse_run_id"]
    shown = assets if assets is not None else blocks.select(*key, F.explode("asset_keys").alias("asset_key")).distinct()
    counts = shown.groupBy(*key).agg(F.count("*").alias("asset_count"))
    held = blocks.groupBy(*key).agg(F.count("*").alias("block_count"), F.max(F.greatest("page_start", "page_end")).alias("page_count")).join(counts, key, "left")
    out = lambda name: F.concat_ws("/", F.lit(prefix), F.col("document_id").cast("string"), F.col("parse_run_id").cast("string"), F.lit(name))
    return held.withColumns({"asset_count": F.coalesce("asset_count", F.lit(0)), "output_markdown_key": out("output.md"), "output_json_key": out("output.json")})


def duplicate_indexes(blocks: DataFrame) -> DataFrame:
    """(document_id, parse_run_id, block_index) that occur more than once."""
    return blocks.groupBy("document_id", "parse_run_id", "block_index").count().where("count > 1").drop("count")


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Blocks of web pages, by SQL functions: headings, paragraphs, list items, table rows of the body, in page order.

    Scripts, styles and comments go first; each h1 to h6, p, li, tr opens a block that ends where the next one starts.
    """
    body = F.regexp_replace(F.coalesce(html_col, F.lit("")), r"(?is)<(script|style|head|nav|footer)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", " ")
    parts = F.split(body, r"(?i)(?=<(?:h[1-6]|p|li|tr)\b)")
    rows = pages.select(F.col(id_col).cast("string").alias("document_id"), F.lit("html").alias("parse_run_id"), F.posexplode(parts).alias("block_index", "part"))
    tag = F.lower(F.regexp_extract("part", r"^<([a-zA-Z][a-zA-Z0-9]*)", 1))
    text = F.regexp_replace("part", r"(?is)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    kind = F.when(tag.rlike("^h[1-6]$"), "title").when(tag == "li", "list").when(tag == "tr", "table").otherwise("text")
    level = F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int")).otherwise(1)
    rows = rows.select("document_id", "parse_run_id", "block_index", kind.alias("block_type"), level.alias("level"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"), F.array().cast("array<string>").alias("own_path"))
    rows = rows.where("text <> ''")
    none = F.lit(None).cast("string")
    rows = with_section_paths(rows).drop("own_path", "level")
    return rows.withColumns({
        "block_key": F.concat(F.lit("block-"), F.lpad(F.col("block_index").cast("string"), 6, "0")), "page_start": F.lit(1), "page_end": F.lit(1), "markdown": none, "html": none,
        "latex": none, "caption": none, "asset_keys": F.array().cast("array<string>"),
    })
