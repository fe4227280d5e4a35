"""Knowledge items: validation, de-duplication, review workflow, versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.errors import require
from millrace.functions.text import content_hash, is_blank, strip, strip_code_fence
from millrace.functions.vectors import quantize4
from millrace.schemas import ITEM_STATUSES, ITEM_TYPES, TRANSITIONS
from millrace.session import shared_folder

#: The fields that an extracted item may have.
ITEM_FIELDS = ("item_type", "title", "content", "structured_data", "entities", "parameters", "conditions", "confidence", "source_chunk_ids", "source_text")


def validate_extractions(outputs: DataFrame, item_types: Sequence[str] = ITEM_TYPES, text_col: str = "output", chunks_col: str = "chunk_ids") -> DataFrame:
    """One row per model output: the columns of outputs, items (array of structs) and error; one of the two is null.

    A batch is taken or refused as a whole: it has to be a JSON object with a list items of objects without other
    than ITEM_FIELDS, with a known and allowed type, a title and content, a confidence of 0 to 1 or none, and at least
    one source chunk, all of them among the input's (column chunks_col). A code fence around the text is taken off.
    """
    text = strip_code_fence(F.col(text_col))
    rows = outputs.withColumn("_v", F.try_parse_json(text))
    listed = F.try_variant_get("_v", "$.items", "variant")
    rows = rows.withColumn("_items", F.try_variant_get("_v", "$.items", "array<variant>")).withColumn("_list", F.schema_of_variant(listed))
    items = F.coalesce("_items", F.array().cast("array<variant>"))
    get = lambda x, k, t: F.try_variant_get(x, f"$.{k}", t)
    keys = lambda x: F.json_object_keys(F.to_json(x))
    kind = lambda x, k: F.coalesce(F.schema_of_variant(get(x, k, "variant")), F.lit("VOID"))
    ids = lambda x: get(x, "source_chunk_ids", "array<string>")
    allowed = F.coalesce(F.col(chunks_col), F.array().cast("array<string>"))

    def fault(x: Column) -> Column:
        name = strip(get(x, "item_type", "string"))
        confidence = get(x, "confidence", "double")
        return (
            F.when(~F.schema_of_variant(x).startswith("OBJECT"), "item is not an object")
            .when(F.size(F.array_intersect(keys(x), F.array(F.lit("status"), F.lit("approved")))) > 0, "forbidden field")
            .when(F.size(F.array_except(keys(x), F.array(*[F.lit(f) for f in ITEM_FIELDS]))) > 0, "unknown field")
            .when((kind(x, "item_type") != "STRING") | ~F.coalesce(name.isin(*ITEM_TYPES), F.lit(False)), "unknown item_type")
            .when(~name.isin(*item_types), "item_type not allowed")
            .when((kind(x, "title") != "STRING") | is_blank(get(x, "title", "string")) | (kind(x, "content") != "STRING") | is_blank(get(x, "content", "string")), "title or content missing")
            .when(~kind(x, "confidence").isin("VOID") & (confidence.isNull() | ~F.coalesce(confidence.between(0, 1), F.lit(False))), "confidence out of range")
            .when(F.coalesce(F.size(ids(x)), F.lit(0)) < 1, "no source chunks")
            .when(F.size(F.array_except(ids(x), allowed)) > 0, "unknown source chunk")
        )

    faults = F.array_compact(F.transform(items, fault))
    error = (
        F.when(F.col("_v").isNull(), "not JSON").when(~F.schema_of_variant("_v").startswith("OBJECT"), "not an object")
        .when(F.col("_list").isNull(), "items missing").when(~F.col("_list").startswith("ARRAY"), "items is not a list").when(F.size(faults) > 0, faults[0])
    )
    made = F.transform(items, lambda x: F.struct(
        strip(get(x, "item_type", "string")).alias("item_type"), strip(get(x, "title", "string")).alias("title"), strip(get(x, "content", "string")).alias("content"),
        quantize4(get(x, "confidence", "double")).alias("confidence"), ids(x).alias("source_chunk_ids"), get(x, "source_text", "string").alias("source_text"),
    ))
    return rows.withColumn("error", error).withColumn("items", F.when(F.col("error").isNull(), made)).drop("_v", "_items", "_list")


def with_hash(items: DataFrame, type_col: str = "item_type", doc_col: str = "source_document_id", title_col: str = "title", content_col: str = "content") -> DataFrame:
    return items.withColumn("content_hash", content_hash(F.col(type_col), F.col(doc_col), F.col(title_col), F.col(content_col)))


def _with_class(rows: DataFrame, classes: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """rows joined to classes (a row a key, _n: how many rows it has): classes with over a thousandth of all rows, fewer than a
    thousand, by a broadcast, so that their rows stay where they are; the others by key."""
    shared_folder(rows.sparkSession)
    classes = classes.checkpoint()
    total = classes.agg(F.sum("_n")).first()[0] or 0
    hot = classes.where(F.col("_n") > total / 1000)
    few = F.broadcast(hot.select(*key))
    return rows.join(F.broadcast(hot), list(key)).unionByName(rows.join(few, list(key), "left_anti").join(classes.join(few, list(key), "left_anti"), list(key), how)).drop("_n")


def new_and_skipped(candidates: DataFrame, existing: DataFrame, order: Sequence[str] = ("position",)) -> DataFrame:
    """The candidates with skipped: true for all but the first of equal type, hash and document, and for those that a live
    (not deprecated) existing item equals. A null document equals a null one; order tells candidates apart.

    The first of each group comes from an aggregate and is joined back; groups with over a thousandth of all candidates by a
    broadcast, so that a group of any size spreads.
    """
    key = ["item_type", "content_hash", "_doc"]
    doc = F.coalesce(F.col("source_document_id").cast("string"), F.lit("\u0000"))
    rows = candidates.withColumn("_doc", doc)
    live = existing.where(F.coalesce(F.col("status") != "deprecated", F.lit(True))).select("item_type", "content_hash", doc.alias("_doc")).distinct().withColumn("_live", F.lit(True))
    first = rows.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("_n")).join(live, key, "left")
    rows = _with_class(rows, first, key, "inner")
    return rows.withColumn("skipped", (F.struct(*order) != F.col("_first")) | F.col("_live").isNotNull()).drop("_doc", "_first", "_live")


def clashes(changed: DataFrame, existing: DataFrame) -> DataFrame:
    """The changed items with duplicate_id: another live (not deprecated) item of equal type, hash and document, or null.

    An aggregate keeps the smallest and largest id of each group, of which one is another's if any is. Groups with over a
    thousandth of all live items are joined by a broadcast.
    """
    key = ["item_type", "content_hash", "_doc"]
    doc = F.coalesce(F.col("source_document_id").cast("string"), F.lit("\u0000"))
    live = existing.where(F.coalesce(F.col("status") != "deprecated", F.lit(True))).withColumn("_doc", doc)
    held = live.groupBy(*key).agg(F.min("id").alias("_least"), F.max("id").alias("_most"), F.count("*").alias("_n"))
    rows = _with_class(changed.withColumn("_doc", doc), held, key, "left")
    other = F.when(F.col("_least") != F.col("id"), F.col("_least")).when(F.col("_most") != F.col("id"), F.col("_most"))
    return rows.withColumn("duplicate_id", other).drop("_doc", "_least", "_most")


def resolve_sources(items: DataFrame, links: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (id, document_id, filename, error): where each item (id, source_document_id, source_filename) comes from.

    links: (id, chunk_id); chunks: (chunk_id, document_id); documents: (document_id, original_filename). A chunk that is missing, chunks
    of several documents, chunks of another document than the item's, and a missing document are errors; an item without a name takes its document's.
    """
    of = links.join(chunks.select("chunk_id", F.col("document_id").alias("_d"), F.lit(True).alias("_is")), "chunk_id", "left")
    held = of.groupBy("id").agg(F.min("_d").alias("_least"), F.max("_d").alias("_most"), F.count(F.when(F.col("_is").isNull(), 1)).alias("_lost"))
    known = documents.select(F.col("document_id").alias("_k"), F.col("original_filename").alias("_name"))
    told = documents.select(F.col("document_id").alias("source_document_id"), F.lit(True).alias("_told"))
    rows = items.join(held, "id", "left").join(told, "source_document_id", "left").withColumn("_doc", F.coalesce("_least", "source_document_id")).join(known, F.col("_doc") == F.col("_k"), "left")
    own = F.col("source_document_id")
    invalid = (F.col("_least") != F.col("_most")) | (own.isNotNull() & (F.col("_least") != own))
    error = (
        F.when(own.isNotNull() & F.col("_told").isNull(), "KNOWLEDGE_ITEM_SOURCE_DOCUMENT_NOT_FOUND").when(F.col("_lost") > 0, "KNOWLEDGE_ITEM_SOURCE_CHUNK_NOT_FOUND")
        .when(invalid, "KNOWLEDGE_ITEM_VALIDATION_FAILED").when(F.col("_doc").isNotNull() & F.col("_k").isNull(), "KNOWLEDGE_ITEM_SOURCE_DOCUMENT_NOT_FOUND")
    )
    rows = rows.withColumn("error", error)
    fine = F.col("error").isNull()
    return rows.select("id", F.when(fine, F.col("_doc")).alias("document_id"), F.when(fine, F.coalesce("source_filename", "_name")).alias("filename"), "error")


def children(items: DataFrame, rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The rows that belong to items by a key (an item's chunks, versions or reviews), in order."""
    return rows.join(items.select(key), key, "left_semi").orderBy(key, *order)


def copied_links(links: DataFrame, revised: DataFrame) -> DataFrame:
    """The source links of revised items (id, revises_item_id), as those of the revisions."""
    new = revised.select("id", F.col("revises_item_id").alias("knowledge_item_id"))
    return links.join(new, "knowledge_item_id").drop("knowledge_item_id").withColumnRenamed("id", "knowledge_item_id")


def found_by_id(rows: DataFrame, wanted: DataFrame, id_col: str = "id", code: str = "DOCUMENT_NOT_FOUND") -> DataFrame:
    """Wanted ids with their rows; error holds the code where there is none."""
    held = wanted.join(rows.withColumn("_found", F.lit(True)), id_col, "left")
    return held.withColumn("error", F.when(F.col("_found").isNull(), code)).drop("_found")


def get_by_id(rows: DataFrame, value, id_col: str = "id", code: str = "DOCUMENT_NOT_FOUND"):
    """The row of an id; an error of the code if there is none."""
    found = rows.where(F.col(id_col) == F.lit(value)).limit(1).collect()
    require(bool(found), code, "nothing has this id", id=value)
    return found[0]


def fold_reviews(items: DataFrame, actions: DataFrame, span: Column | None = None) -> DataFrame:
    """Rows (id, status, n_applied, n_refused, first_refused): each item's status after its actions, in order.

    items: (id, status); actions: (id, seq, action), seq any ordered type. An action that isn't allowed in the state it
    meets, or is unknown, changes nothing and is counted. The fold goes by spans: span rises with seq (a day of a
    time, say; one span if not given), the actions of a span are folded from every status in their own group, and
    an item's spans are then put one after the other. So what is gathered is a span's actions, then a row a span.
    """
    pairs = [p for a, (starts, to) in TRANSITIONS.items() for s in starts for p in (F.lit(f"{a}:{s}"), F.lit(to))]
    moves = F.create_map(*pairs)
    spans = actions.withColumn("span", span if span is not None else F.lit(0)).groupBy("id", "span").agg(F.array_sort(F.collect_list(F.struct("seq", "action"))).alias("a"))
    start = lambda s: F.struct(s.alias("status"), F.lit(0).alias("ok"), F.lit(0).alias("bad"), F.lit(None).cast("string").alias("first"))

    def apply(acc, x):
        to = F.try_element_at(moves, F.concat(x["action"], F.lit(":"), acc["status"]))
        refused = to.isNull()
        return F.struct(
            F.coalesce(to, acc["status"]).alias("status"), (acc["ok"] + (~refused).cast("int")).alias("ok"), (acc["bad"] + refused.cast("int")).alias("bad"),
            F.coalesce(acc["first"], F.when(refused, x["action"])).alias("first"),
        )

    def follow(acc, x):
        step = F.try_element_at(x["steps"], acc["status"])
        return F.struct(step["status"].alias("status"), (acc["ok"] + step["ok"]).alias("ok"), (acc["bad"] + step["bad"]).alias("bad"), F.coalesce(acc["first"], step["first"]).alias("first"))

    steps = F.create_map(*[x for s in ITEM_STATUSES for x in (F.lit(s), F.aggregate("a", start(F.lit(s)), apply))])
    steps = spans.select("id", "span", steps.alias("steps"))
    listed = steps.groupBy("id").agg(F.collect_list(F.struct("span", "steps")).alias("s"))
    rows = items.join(listed, "id", "left")
    in_order = F.array_sort("s", lambda a, b: F.when(a["span"] < b["span"], -1).when(a["span"] > b["span"], 1).otherwise(0))
    done = F.aggregate(F.coalesce(in_order, F.array().cast(listed.schema["s"].dataType)), start(F.col("status")), follow)
    return rows.select("id", done.alias("d")).select("id", F.col("d.status").alias("status"), F.col("d.ok").alias("n_applied"), F.col("d.bad").alias("n_refused"), F.col("d.first").alias("first_refused"))


def snapshot(row: Sequence[str]) -> Column:
    return F.to_json(F.struct(*row), {"ignoreNullFields": "false"})


def revision_chains(items: DataFrame) -> DataFrame:
    """Rows (id, root_id, depth, error): each item's first ancestor by revises_item_id, and how many revisions lie between.

    Every round doubles the steps that an item has gone, so that the rounds grow with the logarithm of the longest
    chain. A chain longer than there are items runs in a circle: such items have an error and no root. An ancestor that is
    missing is a root.
    """
    shared_folder(items.sparkSession)
    up = F.coalesce("revises_item_id", "id")
    rows = items.select("id", up.alias("to"), (up != F.col("id")).cast("long").alias("depth"), (F.col("revises_item_id") == F.col("id")).alias("own")).checkpoint()
    n, most = rows.count(), rows.agg(F.max("depth")).first()[0] or 0
    while most:
        ahead = rows.select(F.col("id").alias("_id"), F.col("to").alias("_to"), F.col("depth").alias("_depth"))
        moved = rows.join(ahead, F.col("to") == F.col("_id"), "left").select("id", F.coalesce("_to", "to").alias("to"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), "own")
        moved = moved.checkpoint()
        gone = moved.agg(F.max("depth")).first()[0]
        rows = moved
        if gone == most or gone > 2 * n:
            break
        most = gone
    circle = (F.col("depth") >= n) | F.coalesce("own", F.lit(False))
    return rows.select("id", F.when(~circle, F.col("to")).alias("root_id"), F.when(~circle, F.col("depth").cast("int")).alias("depth"), F.when(circle, "KNOWLEDGE_ITEM_REVISION_CYCLE").alias("error"))


def list_items(items: DataFrame, item_type: str | None = None, status: str | None = None, document_id: str | None = None, text: str | None = None) -> DataFrame:
    """Items by up to four filters. text is looked for in title and content in either case; % and _ in it match as LIKE has them."""
    require(status is None or status in ITEM_STATUSES, "KNOWLEDGE_ITEM_INVALID_STATUS", "unknown status", status=status)
    require(item_type is None or item_type in ITEM_TYPES, "KNOWLEDGE_ITEM_VALIDATION_FAILED", "unknown item type", item_type=item_type)
    for name, value in (("item_type", item_type), ("status", status), ("source_document_id", document_id)):
        if value is not None:
            items = items.where(F.col(name) == value)
    if text and text.strip():
        like = f"%{text.strip()}%"
        items = items.where(F.col("title").ilike(like) | F.col("content").ilike(like))
    return items


def chunk_selection(chunks: DataFrame, max_chunks: int, max_chars: int) -> DataFrame:
    """Per document its first max_chunks chunks by index; over_budget where they hold more than max_chars characters."""
    order = W.partitionBy("document_id").orderBy("chunk_index", "id")
    first = chunks.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_chunks).drop("_r")
    return first.withColumn("over_budget", F.sum(F.length("content")).over(W.partitionBy("document_id")) > max_chars)


def ordered_lookup(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows in the order of ids (position, id), positions and ids that no row has)."""
    return ids.join(rows, id_col).orderBy("position"), ids.join(rows, id_col, "left_anti")


def mixed_documents(items: DataFrame, links: DataFrame) -> DataFrame:
    """Item ids whose source chunks (knowledge_item_id, document_id) are of more than one document, or not the item's."""
    held = links.groupBy(F.col("knowledge_item_id").alias("id")).agg(F.count_distinct("document_id").alias("n"), F.min("document_id").alias("d"))
    return items.join(held, "id").where((F.col("n") > 1) | ~F.col("d").eqNullSafe(F.coalesce("source_document_id", "d"))).select("id")
