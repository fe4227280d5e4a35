"""How far apart the vocabularies of sources are, within each language, and by which terms: exact, on integers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import staged

#: Counts of different terms that a task holds before it hands them on.
HELD = 600_000
#: Pairs of sources that a task holds before it hands on their sums; bytes of a long text that are cut into terms at once.
PAIRS_HELD, PIECE = 500_000, 1 << 22
_TERM = re.compile(rb"[a-z\x80-\xff]+")  # of lower-cased bytes: ASCII letters and whatever isn't ASCII


def collapsed(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """Each different text of a language once: (lang, text, copies: an array of source and m, the rows of it there).

    Texts are told apart by SHA-256. Their sources are counted by digest, so that whole texts move once, and not more than one
    copy from each partition that has some: a text with a third of all rows is a row a partition.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(some(lang_col).alias("lang"), some(source_col).alias("source"), some(text_col).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    copies = rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("m")).groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "m")).alias("copies"))
    return rows.select("lang", "digest", "text").dropDuplicates(["lang", "digest"]).join(copies, ["lang", "digest"]).select("lang", F.col("text").cast("binary").alias("text"), "copies")


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in order, some at a time."""
    low, at = raw.lower(), 0
    while at < len(low):
        end = at + PIECE
        while end < len(low) and (low[end] >= 128 or 97 <= low[end] <= 122):
            end += 1
        yield _TERM.findall(low[at:end])
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts: (lang, source, term, n, df), the terms' weighted counts and document frequencies."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            terms = list(n)
            for a in range(0, len(terms), 50_000):
                part = terms[a : a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()), pa.array([n[t] for t in part], pa.int64()), pa.array([df[t] for t in part], pa.int64())],
                    names=["lang", "source", "term", "n", "df"],
                )
        held.clear()

    for batch in batches:
        for lang, text, copies in zip(*batch.columns, strict=True):
            lang, copies = lang.as_py(), copies.as_py()
            pieces = list(terms_of(text.as_py()))
            seen = set().union(*pieces)
            counts = Counter(t for p in pieces for t in p) if any(c["m"] > 1 for c in copies) else None
            for c in copies:
                n, df = held.setdefault((lang, c["source"]), (Counter(), Counter()))
                size -= len(n)
                if c["m"] == 1:
                    for p in pieces:
                        n.update(p)
                    df.update(seen)
                else:
                    for t, k in counts.items():
                        n[t] += k * c["m"]
                        df[t] += c["m"]
                size += len(n)
            if size > HELD:
                yield from flush()
                size = 0
    yield from flush()


def kept_terms(texts: DataFrame, least_documents: int) -> DataFrame:
    """(lang, term, n, found: an array of source and n) for each term in at least so many documents of its language."""
    rows = texts.mapInArrow(_counted, "lang string, source string, term binary, n long, df long")
    by_source = rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("found"))
    return by_term.where(F.col("df") >= least_documents).select("lang", F.col("term").cast("string").alias("term"), "n", "found")


def _share(count: Column, total: Column, terms: Column, smoothing: int, scale: int) -> Column:
    """1 + floor(scale * (count + smoothing) / (total + smoothing * terms)), on exact decimals; null without terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    over = whole(total) + F.lit(smoothing) * whole(terms)
    return F.lit(1).cast("long") + F.call_function("div", F.lit(scale).cast("decimal(10,0)") * (whole(count) + F.lit(smoothing)).cast("decimal(20,0)"), F.nullif(over, F.lit(0).cast("decimal(1,0)")))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of terms with the sources that have them: (lang, a, b, x), x being what a pair's distance over shared terms differs
    by from the sum of what each adds on its own."""
    sums: dict[tuple[str, str, str], int] = {}

    def flush() -> pa.RecordBatch:
        keys = list(sums)
        out = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array(list(sums.values()), pa.int64())], names=["lang", "a", "b", "x"])
        sums.clear()
        return out

    for batch in batches:
        langs = batch["lang"].to_pylist()
        for lang in dict.fromkeys(langs):
            found = batch["found"].filter(pa.array([x == lang for x in langs]))
            flat, lengths = found.flatten(), np.array([len(x) for x in found], np.int64)
            names, source = np.unique(np.array(flat.field("source").to_pylist(), object), return_inverse=True)
            p, b = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("p", "b"))
            ends = np.cumsum(lengths)
            start, end = np.repeat(ends - lengths, lengths), np.repeat(ends, lengths)  # of the term that an entry belongs to
            base = np.zeros(len(names), np.int64)
            base[source] = b
            for one in range(len(names)):
                mine = np.flatnonzero(source == one)
                width = end[mine] - start[mine]
                if not (width > 1).any():
                    continue
                own = np.repeat(mine, width)
                other = np.arange(len(own)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(start[mine], width)
                own, other = own[source[other] > one], other[source[other] > one]
                x = np.abs(p[own] - p[other]) - np.abs(p[own] - b[other]) - np.abs(p[other] - b[own]) + np.abs(b[own] - b[other])
                total = np.zeros(len(names), np.int64)
                np.add.at(total, source[other], x)
                for k in np.flatnonzero(total).tolist():
                    key = (lang, names[one], names[k])
                    sums[key] = sums.get(key, 0) + int(total[k])
                if len(sums) > PAIRS_HELD:
                    yield flush()
    if sums:
        yield flush()


def _alone(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, a, b, x) for each ordered pair: what a's terms add to the distance if b has none of them, beyond all terms' base.

    The sum of |p - b| over a's terms follows from how many of them, and how much of p, lie at or below b's base: running sums
    over a's different values of p, among which the bases are placed.
    """
    values = entries.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("k"))
    steps = values.select("lang", "a", F.col("p").alias("v"), F.lit(0).alias("asks"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("long").alias("own"), "k")
    asked = pairs.select("lang", "a", F.col("b_base").alias("v"), F.lit(1).alias("asks"), "b", F.col("a_base").alias("own"), F.lit(0).cast("long").alias("k"))
    whole, upto = Window.partitionBy("lang", "a"), Window.partitionBy("lang", "a").orderBy("v", "asks").rowsBetween(Window.unboundedPreceding, 0)
    amount = F.col("k") * F.when(F.col("asks") == 0, F.col("v")).otherwise(F.lit(0))
    both = steps.unionByName(asked).withColumns({"k_low": F.sum("k").over(upto), "p_low": F.sum(amount).over(upto), "k_all": F.sum("k").over(whole), "p_all": F.sum(amount).over(whole)})
    apart = F.expr("p_all - 2 * p_low - v * k_all + 2 * v * k_low")
    return both.where("asks = 1").select("lang", "a", "b", (apart - F.col("k_all") * F.abs(F.col("own") - F.col("v"))).alias("x"))


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_documents: int = 30, smoothing: int = 5, scale: int = 1_000_000_000, terms: int = 50) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): for each source of a language the others by distance (part pair), and
    the terms that it uses more than the language does, by how much (part term, the first so many).

    A term is a run of ASCII letters and non-ASCII characters, A-Z in lower case. A language keeps the terms of at least
    least_documents of its documents. The share of a kept term in a source, or in the language, is 1 + floor(scale * (count +
    smoothing) / (N + smoothing * V)): N is all kept terms' count, V their number. Distance: the sum of the differences of shares
    over all kept terms, 0 where there is none. Ranks begin at 1, larger values first, then by the item's bytes.

    Null language, source and text are read as ''. Each row is a document, repeated ones too. A source without a kept term has
    all shares at their base; one that is alone in its language has no pairs. An empty table gives none. Other columns are
    left out. Equal texts are cut into terms once. Pairs are evaluated over the terms that both have; the rest follows from
    running sums. Tasks hold bounded numbers of counts and pairs; the tables of sources and of their pairs are results.
    """
    texts = collapsed(docs, lang_col, source_col, text_col)
    kept = staged(kept_terms(texts, least_documents), "kept-terms")
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(some(lang_col).alias("lang"), some(source_col).alias("source")).distinct()
    found = kept.select("lang", F.explode("found").alias("f")).groupBy("lang", F.col("f.source").alias("source")).agg(F.sum("f.n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("n").alias("lang_total"))
    stats = groups.join(found, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("size", F.lit(0)).alias("size"), "lang_total")
    stats = staged(stats.withColumn("base", F.coalesce(_share(F.lit(0), F.col("total"), F.col("size"), smoothing, scale), F.lit(0))), "sources")

    share = lambda count, total: _share(F.col(count), F.col(total), F.col("size"), smoothing, scale)
    entries = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("found").alias("f")).select("lang", "term", "lang_n", "f.source", "f.n").join(stats, ["lang", "source"])
    entries = staged(entries.select("lang", "source", "term", share("n", "total").alias("p"), share("lang_n", "lang_total").alias("q"), F.col("base").alias("b")), "shares")

    right = stats.select("lang", F.col("source").alias("b"), F.col("base").alias("b_base"))
    pairs = stats.select("lang", F.col("source").alias("a"), "size", F.col("base").alias("a_base")).join(right, "lang").where("a <> b")
    alone = _alone(entries, pairs)
    met = entries.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "b")).alias("found")).where(F.size("found") > 1).select("lang", "found").mapInArrow(_met, "lang string, a string, b string, x long")
    turned = lambda df: df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "x")
    base = pairs.select("lang", "a", "b", (F.col("size") * F.abs(F.col("a_base") - F.col("b_base"))).alias("x"))
    added = base.unionByName(alone).unionByName(turned(alone)).unionByName(met).unionByName(turned(met))
    value = F.sum("x").cast("long").alias("value")
    by_pair = added.groupBy("lang", "a", "b").agg(value).select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    by_term = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return by_pair.select("*", rank).unionByName(by_term.select("*", rank).where(F.col("rank") <= terms))
