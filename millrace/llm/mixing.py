"""Mixing sources to target weights, by DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import WORD, staged, word_count

#: Documents a range of a source's hash order holds on average.
RANGE_ROWS = 4_096


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most_epochs: float = 2.0) -> DataFrame:
    """Per source: source, n, source_size, target. sizes: rows (source, n, source_size), one per source.

    Sources by code point, null last, weigh as weights say, in turn. Together they get share times all sizes,
    in proportion to weight, but none more than most_epochs times its own size: the excess goes to the others
    by weight until none is above. That is the level at which sources, in order of size over weight, stop
    being full, found in one pass. Only this table, a row per source, is ordered as a whole.
    """
    if share > most_epochs:
        raise ValueError("the sources can't give that share")
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most_epochs))
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    ranked = (
        sizes.withColumn("w", w).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("before", F.sum("cap").over(by_ratio) - F.col("cap"))
        .withColumn("left", F.sum("w").over(everything) - F.sum("w").over(by_ratio) + F.col("w"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
    )
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))
    return ranked.select("source", "n", "source_size", target.alias("target"))


def hash_key(id_col: Column) -> Column:
    """A hash-random key that any SQL engine can repeat."""
    return F.md5(F.coalesce(id_col.cast("string"), F.lit("")))


def _slim(rows: DataFrame, row: Column, id_: Column, source: Column, text: Column) -> DataFrame:
    return rows.select(row.alias("row_id"), id_.alias("id"), source.cast("string").alias("source"), word_count(text).alias("size"), hash_key(id_).alias("key"), F.xxhash64(text).alias("tie"))


def _placed(slim: DataFrame, weights: Sequence[float], share: float, most_epochs: float, range_rows: int) -> DataFrame:
    """Rows (row_id, id, source, size, key, tie) with source_size, target, the words that come before in the source's order
    (prefix), the whole epochs that the source is taken, and what its budget has left for a last one (rest)."""
    sizes = slim.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most_epochs)
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(range_rows))).cast("long")
    spot = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    dealt = slim.alias("l").join(targets.alias("r"), same).select("l.*", "r.source_size", "r.target", F.floor(spot * ranges / F.lit(4294967296)).cast("long").alias("range"))
    starts = dealt.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.withColumn("start", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    placed = dealt.alias("l").join(starts.alias("r"), same & (F.col("l.range") == F.col("r.range"))).select("l.*", "r.start")
    within = W.partitionBy("source", "range").orderBy("key", F.col("id").asc_nulls_last(), "size", "tie", "row_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    return placed.withColumns({"prefix": F.col("start") + F.sum("size").over(within) - F.col("size"), "epochs": epochs, "rest": budget - epochs * F.col("source_size")})


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most_epochs: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: its id, size, source_size, target, taken (words, repeats counted).

    A source's budget is its target to the nearest word. Whole epochs of the source come first; the rest is
    cut, at the exact word, from its documents in the order of a hash-random key (ties by id, size, then text).
    Order and prefix sums are distributed: each source's keys fall into ranges of about range_rows documents,
    the ranges' sums give each range its start, and a window within a range does the rest, so that a hot
    source spreads over as many tasks as it has ranges. Null texts have size 0 and are taken 0 times; a null
    source is a source; rows repeat freely (equal rows share out their common range in either order); an empty
    table gives no rows. Reruns agree. Texts are read once and never shuffled.
    """
    slim = staged(_slim(docs, F.monotonically_increasing_id(), F.col(id_col), F.col(source_col), F.col(text_col)), "mix")
    placed = _placed(slim, weights, share, most_epochs, range_rows)
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("prefix")))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most_epochs: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mixed corpus, with the columns of docs: a row for every time that mix() takes a document.

    The one document of a source that the budget cuts comes last with the words taken of it, joined by spaces; where
    rows of the same id and text stand there, they share those words evenly, whole words each. Documents without words
    are taken by no budget and go.

    Where the order of a source is cut says of each of its documents how often it is taken; so only ids and sizes are
    ordered, and texts stay where they are: they meet a table of cuts, one row a source.
    """
    slim = staged(_slim(docs, F.monotonically_increasing_id(), F.col(id_col), F.col(source_col), F.col(text_col)), "mix")
    placed = staged(_placed(slim, weights, share, most_epochs, range_rows), "mix-order")
    sources = placed.groupBy("source").agg(F.first("epochs").alias("epochs"))
    at = placed.where("prefix <= rest and rest < prefix + size").select("source", "key", "id", "tie")
    equal = lambda c: F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    cuts = placed.alias("l").join(at.alias("r"), equal("source") & equal("key") & equal("id") & equal("tie")).select("l.*")
    cuts = cuts.groupBy("source", "key", "id", "tie", "size").agg(((F.first("rest") - F.min("prefix")) / F.count("*")).cast("int").alias("words"))
    cuts = sources.alias("l").join(cuts.alias("r"), equal("source"), "left").select("l.source", "l.epochs", *[F.col(f"r.{c}").alias(f"cut_{c}") for c in ("key", "id", "tie", "size", "words")])
    cuts = staged(cuts.coalesce(1), "mix-cuts")

    of = lambda c: F.col(f"__doc.`{c}`")
    rows = docs.select(F.struct(*docs.columns).alias("__doc")).where(of(text_col).rlike(WORD))
    rows = rows.join(cuts, of(source_col).cast("string").eqNullSafe(F.col("source")))
    key = hash_key(of(id_col))
    place = lambda i, size, tie: F.struct(i.isNull().alias("n"), i.alias("i"), size.cast("long").alias("size"), tie.alias("tie"))
    mine, cut = place(of(id_col), word_count(of(text_col)), F.xxhash64(of(text_col))), place(F.col("cut_id"), F.col("cut_size"), F.col("cut_tie"))
    last = (  # words taken in the last epoch: -1 for all
        F.when(F.col("cut_key").isNull(), 0).when(key < F.col("cut_key"), -1).when(key > F.col("cut_key"), 0)
        .when(mine < cut, -1).when(mine == cut, F.col("cut_words")).otherwise(0)
    )
    whole = F.array_repeat(F.lit(-1), F.col("epochs").cast("int"))
    takes = F.explode(F.concat(whole, F.when(last == 0, F.array().cast("array<int>")).otherwise(F.array(last))))
    rows = rows.select("__doc", takes.alias("__words"))
    words = F.col("__words")
    text = F.when(words < 0, of(text_col)).otherwise(F.array_join(F.slice(F.regexp_extract_all(of(text_col), F.lit(WORD), F.lit(0)), 1, F.greatest(words, F.lit(0))), " "))
    return rows.select(*[(text if c == text_col else of(c)).alias(c) for c in docs.columns])
