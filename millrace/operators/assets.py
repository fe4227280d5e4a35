"""Assets of parse results: paths, contexts, look-up by several keys, plans of uploads, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import scalar_fields, shorten, strip
from millrace.operators.blocks import raw_int, raw_text, raw_texts

#: What summaries may show of metadata.
ASSET_METADATA = ("checksum", "height", "origin", "result_file_type", "width")
RUN_METADATA = ("api_version", "deferred_file_count", "failure_status_persisted", "intermediate_file_count", "parse_mode", "task_id")
OUTPUT_STATUSES = ("saved", "download_deferred", "unavailable")


def relative_path(x: Column) -> Column:
    """A relative path with forward slashes and without empty or "." parts; null if it is absolute, leaves its root, names a
    drive, or is empty."""
    raw = F.replace(strip(x), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(raw, "/"), lambda p: ~p.isin("", "."))
    bad = (raw == "") | raw.startswith("/") | raw.contains("\x00") | F.exists(parts, lambda p: p == "..") | F.coalesce(F.try_element_at(parts, F.lit(1)).endswith(":"), F.lit(False))
    return F.when(~bad, F.nullif(F.array_join(parts, "/"), F.lit("")))


def below_images(path: Column) -> Column:
    """The part of a path from its first folder named images, in either case; null without one."""
    parts = F.split(path, "/")
    at = F.array_position(F.transform(parts, F.lower), "images")
    return F.when(at > 0, F.array_join(F.slice(parts, at.cast("int"), F.size(parts)), "/"))


def base_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def asset_contexts(parsed: DataFrame, json_col: str = "content_list") -> DataFrame:
    """Rows (document_id, image_path, asset_type, page_number, caption, source_block_key): what the first element that shows an image
    says of it. Paths count from images/ on, in lower case; elements without such a path say nothing."""
    raws = F.try_parse_json(F.col(json_col))
    rows = parsed.where(F.schema_of_variant(raws).startswith("ARRAY")).select("document_id", F.posexplode(raws.cast("array<variant>")).alias("i", "raw"))
    raw = F.col("raw")
    kind = F.lower(F.coalesce(raw_text(raw, "type"), F.lit("unknown")))
    none = F.array().cast("array<string>")
    captions = none
    for name in ("image", "chart", "table"):
        captions = F.when(kind == name, F.concat(raw_texts(raw, f"{name}_caption"), raw_texts(raw, f"{name}_footnote"))).otherwise(captions)
    key = F.coalesce(raw_text(raw, "block_key"), raw_text(raw, "block_id"), raw_text(raw, "id"), F.concat(F.lit("block-"), F.lpad(F.col("i").cast("string"), 6, "0")))
    rows = rows.select(
        "document_id", "i", F.lower(below_images(F.replace(raw_text(raw, "img_path"), F.lit("\\"), F.lit("/")))).alias("image_path"), F.when(kind == "equation", "formula_image").when(kind == "table", "table_image").otherwise("image").alias("asset_type"),
        raw_int(raw, "page_idx").alias("page_number"), F.nullif(F.array_join(captions, "\n"), F.lit("")).alias("caption"), key.alias("source_block_key"),
    )
    said = F.min_by(F.struct("asset_type", "page_number", "caption", "source_block_key"), "i")
    return rows.where("image_path is not null").groupBy("document_id", "image_path").agg(said.alias("x")).select("document_id", "image_path", "x.*")


def resolve_assets(refs: DataFrame, assets: DataFrame, prefix: Column) -> DataFrame:
    """The references with resolved_key and error.

    refs: (document_id, ref_id, source_path, asset_key, filename); assets: (document_id, asset_key, filename, source_path).
    A reference is looked up by its source path (as it is, then from images/ on), then by its key below the prefix, then by
    its file's name; the first of these that any asset has decides, and has to be one asset's alone.
    """
    of = assets.select("document_id", relative_path(F.col("asset_key")).alias("key"), relative_path(F.col("filename")).alias("file"), relative_path(F.col("source_path")).alias("path"))
    tier = lambda n, x: F.struct(F.lit(n).alias("tier"), x.alias("name"))
    names = F.array_distinct(F.array(tier(0, F.col("path")), tier(0, below_images(F.col("path"))), tier(1, F.col("key")), tier(2, base_name(F.col("key"))), tier(2, base_name(F.col("file")))))
    index = of.select("document_id", "key", F.explode(names).alias("n")).select("document_id", "key", "n.*").where("name is not null")
    index = index.groupBy("document_id", "tier", "name").agg(F.count_distinct("key").alias("n"), F.min("key").alias("key"))
    path, key = relative_path(F.col("source_path")), relative_path(F.col("asset_key"))
    full = F.when(key.startswith(F.concat(prefix, F.lit("/"))) | (key == prefix), key).otherwise(F.concat(prefix, F.lit("/"), key))
    step = lambda n, t, x: F.struct(F.lit(n).alias("step"), F.lit(t).alias("tier"), x.alias("name"))
    asked = F.array(step(0, 0, path), step(1, 0, below_images(path)), step(2, 1, full), step(3, 2, base_name(relative_path(F.col("filename")))))
    steps = refs.select("document_id", "ref_id", F.explode(asked).alias("a")).select("document_id", "ref_id", "a.*").where("name is not null")
    found = steps.join(index, ["document_id", "tier", "name"]).groupBy("document_id", "ref_id").agg(F.min_by(F.struct("n", "key"), "step").alias("x"))
    held = refs.join(found, ["document_id", "ref_id"], "left")
    error = F.when(F.col("x").isNull(), "no asset matches").when(F.col("x.n") > 1, "more than one asset matches")
    return held.withColumn("error", error).withColumn("resolved_key", F.when(error.isNull(), F.col("x.key"))).drop("x")


def upload_plan_faults(expected: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows (document_id, asset_key, fault): keys expected but not planned, planned but not expected, or planned twice."""
    key = ["document_id", "asset_key"]
    counts = planned.groupBy(*key).agg(F.count("*").alias("n")).join(expected.select(*key).distinct().withColumn("e", F.lit(True)), key, "full_outer")
    fault = F.when(F.col("n").isNull(), "not planned").when(F.col("e").isNull(), "not expected").when(F.col("n") > 1, "planned twice")
    return counts.withColumn("fault", fault).where("fault is not null").select(*key, "fault")


def allowed_scalars(metadata: Column, keys: Sequence[str]) -> Column:
    """JSON text with the scalars that metadata (JSON text) has of keys; texts are cut to 200 characters."""
    fields = scalar_fields(F.try_parse_json(metadata), keys)
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in fields]), F.lit("}"))


def asset_summaries(assets: DataFrame) -> DataFrame:
    return assets.withColumns({"caption": shorten(F.col("caption"), 500), "metadata_summary": allowed_scalars(F.col("source_metadata"), ASSET_METADATA)})


def run_summaries(runs: DataFrame) -> DataFrame:
    """Runs with what may be shown of their metadata; an unknown output status is unavailable, and a failed run's failure
    counts as kept unless the metadata says otherwise."""
    v = F.try_parse_json(F.col("source_metadata"))
    status = lambda k: F.when(F.try_variant_get(v, f"$.{k}", "string").isin(*OUTPUT_STATUSES), F.try_variant_get(v, f"$.{k}", "string")).otherwise("unavailable")
    said = F.try_variant_get(v, "$.failure_status_persisted", "variant")
    kept = F.when(F.schema_of_variant(said) == "BOOLEAN", F.try_variant_get(v, "$.failure_status_persisted", "boolean")).otherwise(F.when(F.col("status") == "failed", F.lit(True)))
    return runs.withColumns({"output_markdown_status": status("output_markdown_status"), "output_json_status": status("output_json_status"), "failure_status_persisted": kept, "metadata_summary": allowed_scalars(F.col("source_metadata"), RUN_METADATA)})
