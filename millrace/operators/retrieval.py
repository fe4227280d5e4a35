"""Keyword, vector and hybrid retrieval, for one query or a table of queries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.config import Bm25, Embedding, Hybrid
from millrace.errors import EngineError, require
from millrace.functions.analysis import Analyzer, ByRuns, max_word, smart
from millrace.functions.text import is_blank, latin_tokens, matched_keywords, strip
from millrace.functions.vectors import cosine_distance, rrf
from millrace.operators.embedding import EmbeddingProvider, eligible
from millrace.session import stored

#: What a search reads of a chunk, and what it returns.
SOURCE_FIELDS = ("chunk_id", "document_id", "original_filename", "chunk_index", "content", "source_metadata", "exact_terms", "embedding_model", "embedding_dim")
HIT_FIELDS = (
    "chunk_id", "document_id", "original_filename", "chunk_index", "content", "source_metadata", "retrieval_source", "keyword_score", "vector_score",
    "keyword_rank", "vector_rank", "hybrid_score", "matched_keywords", "embedding_model", "embedding_dim",
)


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, term): every token, repeats included."""
    return docs.select(F.col(id_col).alias("id"), F.explode(latin_tokens(F.col(text_col))).alias("term"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, term, tf)."""
    return tokens(docs, id_col, text_col).groupBy("id", "term").agg(F.count("*").alias("tf"))


def term_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (term, df, cf): documents that hold a term, and how often all do together.

    A row is a document, so its distinct tokens and all its tokens are counted as they come: one aggregation by
    term, combined before the shuffle, instead of one by document and term first.
    """
    held = latin_tokens(F.col(text_col))
    once = docs.select(F.explode(F.array_distinct(held)).alias("term"), F.lit(1).alias("d"), F.lit(0).alias("c"))
    each = docs.select(F.explode(held).alias("term"), F.lit(0).alias("d"), F.lit(1).alias("c"))
    return once.unionByName(each).groupBy("term").agg(F.sum("d").alias("df"), F.sum("c").alias("cf"))


def doc_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, dl): tokens of each document, 0 included. Needs no shuffle."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.size(latin_tokens(F.col(text_col))), F.lit(0)).cast("long").alias("dl"))


def bm25(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column, settings: Bm25 = Bm25()) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf / (tf + settings.k1 * (1 - settings.b + settings.b * dl / avgdl))


def keyword_scores(docs: DataFrame, queries: DataFrame, settings: Bm25 = Bm25(), id_col: str = "doc_id", text_col: str = "text", analyzer: Analyzer = latin_tokens) -> DataFrame:
    """Rows (query_id, id, score) of documents that hold a term of the query. queries: (query_id, term) distinct."""
    asked = stored(queries, "asked")
    return scored(term_counts(tokens_of(docs, id_col, text_col, analyzer), asked), asked, settings)


def tokens_of(docs: DataFrame, id_col: str, text_col: str, analyzer: Analyzer) -> DataFrame:
    """Rows (id, first, dl, term, n): every token, n times; of each document one row is first, and may lack a term. Its rows' dl make
    up its length."""
    held = docs.select(F.col(id_col).alias("id"), analyzer(F.col(text_col)).alias("held"))
    rows = held.select("id", F.coalesce(F.size("held"), F.lit(0)).cast("long").alias("dl"), F.posexplode_outer("held").alias("at", "term"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    return rows.select("id", first.alias("first"), F.when(first, F.col("dl")).otherwise(0).alias("dl"), "term", F.lit(1).cast("long").alias("n"))


def term_counts(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (id, docs, dl, held array of (term, tf)), one per id, of the terms asked for, from rows of tokens_of(): stored.

    A text is cut into words once. What isn't asked for goes before it is counted: the terms of a query table are few next to
    the corpus, and Spark broadcasts them while they are small. Counts are combined before the shuffle.
    """
    wanted = stored(asked.select("term").distinct().withColumn("asked", F.lit(True)), "asked-terms")
    rows = rows.join(wanted, "term", "left").where(F.coalesce("asked", F.lit(False)) | F.col("first") | (F.col("dl") > 0))
    term = F.when(F.col("asked"), F.col("term"))
    counts = rows.groupBy("id", term.alias("term")).agg(F.sum("n").alias("tf"), F.sum("dl").alias("dl"), F.count_if("first").alias("docs"))
    listed = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf")))
    return stored(counts.groupBy("id").agg(F.sum("docs").alias("docs"), F.sum("dl").alias("dl"), listed.alias("held")), "term-counts")


def scored(counts: DataFrame, asked: DataFrame, settings: Bm25 = Bm25()) -> DataFrame:
    """Rows (query_id, id, score) from term_counts() and queries (query_id, term). A document's terms are in one row, so that its
    scores are summed where it is read."""
    whole = counts.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.try_divide(F.sum("dl"), F.sum("docs")).alias("avgdl")).first()  # one row
    found = counts.select("id", "dl", F.explode("held").alias("p")).select("id", "dl", "p.term", "p.tf")
    weights = stored(asked.join(found.groupBy("term").agg(F.count("*").alias("df")), "term"), "weights")
    score = bm25(F.col("tf"), F.col("df"), F.col("dl"), F.lit(whole.n), F.lit(whole.avgdl), settings)
    return found.join(weights, "term").groupBy("query_id", "id").agg(F.round(F.sum(score), 9).alias("score"))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text", analyzer: Analyzer = latin_tokens) -> DataFrame:
    return queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(analyzer(F.col(text_col)))).alias("term"))


def ranked(scores: DataFrame, k: int, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """The k best of each query with their rank from 1; ties by id."""
    order = W.partitionBy(*by).orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_field(scores: Sequence[tuple[DataFrame, float]]) -> DataFrame:
    """Rows (query_id, id, score): the best of several fields' scores, each times its boost."""
    all_ = None
    for frame, boost in scores:
        one = frame.select("query_id", "id", (F.col("score") * boost).alias("score"))
        all_ = one if all_ is None else all_.unionByName(one)
    return all_.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def vector_topk(vectors: DataFrame, query: Sequence[float], k: int = 10, predicate: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", max_limit: int = 50) -> DataFrame:
    """The k nearest rows by cosine distance, (id, distance, score): a sort-limit of one projection, ties by id."""
    require(1 <= k <= max_limit, "VECTOR_SEARCH_FAILED", f"limit must be 1 to {max_limit}", limit=k)
    rows = vectors if predicate is None else vectors.where(predicate)
    wanted = F.array(*[F.lit(float(x)) for x in query])
    rows = rows.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.round(cosine_distance(F.col(vec_col), wanted), 9).alias("distance"))
    return rows.where("distance is not null").orderBy("distance", "id").limit(k).withColumn("score", 1 - F.col("distance"))


def vector_topk_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", query_rows: int = 512, block_rows: int = 4096, own_too: bool = False) -> DataFrame:
    """Rows (query_id, id, score, rank): exact cosine top k of every query (query_id, embedding) among all rows, but its own id's unless own_too.

    Rows and queries fall into blocks by a hash; each pair of blocks is one matrix product in one task and gives k
    rows a query, so that what is ranked grows with the blocks, not with the pairs. Vectors of other length than
    the query's, null, zero or with missing numbers match nothing. Scores are rounded to 9 decimals, ties by id.
    """
    usable = lambda c: F.col(c).isNotNull() & ~F.coalesce(F.exists(c, lambda x: x.isNull()), F.lit(False)) & (F.size(c) > 0)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vec_col)).select(F.col(id_col).alias("id"), F.size(vec_col).alias("dim"), F.col(vec_col).cast("array<double>").alias("v"))
    asked = queries.where(usable("embedding")).select(F.col("query_id").alias("id"), F.size("embedding").alias("dim"), F.col("embedding").cast("array<double>").alias("v"))
    n_rows, n_asked = max(1, -(-rows.count() // block_rows)), max(1, -(-asked.count() // query_rows))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("*", F.lit(False).alias("asks"), own(n_rows).alias("block"), every(n_asked).alias("part"))
    right = asked.select("*", F.lit(True).alias("asks"), every(n_rows).alias("block"), own(n_asked).alias("part"))

    def best(group: pa.Table) -> pa.Table:
        asks, dim = group["asks"].to_numpy(), group["dim"][0].as_py()
        x = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        length = np.sqrt((x * x).sum(axis=1))
        length[length == 0] = np.nan
        x = x / length[:, None]
        of, asked = np.flatnonzero(~asks), np.flatnonzero(asks)
        column = group["id"].combine_chunks()
        code = column.dictionary_encode().indices.to_numpy(zero_copy_only=False)  # equal ids, equal codes
        order = pc.sort_indices(column).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))  # ids in order, for ties
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(asked) if len(of) else 0, 128):
            q = asked[at : at + 128]
            score = np.round(x[of] @ x[q].T, 9)
            score[~np.isfinite(score)] = -np.inf
            if not own_too:
                score[code[of][:, None] == code[q][None, :]] = -np.inf
            floor = np.partition(score, max(0, len(of) - k), axis=0)[max(0, len(of) - k)]
            i, j = np.nonzero((score >= floor) & (score > -np.inf))  # ties of the last one too
            by = np.lexsort((place[of[i]], -score[i, j], j))
            i, j = i[by], j[by]
            starts = np.flatnonzero(np.r_[True, j[1:] != j[:-1]]) if len(j) else np.zeros(0, int)
            first = np.arange(len(j)) - np.repeat(starts, np.diff(np.r_[starts, len(j)])) < k
            found.append((q[j[first]], of[i[first]], score[i[first], j[first]]))
        q, i, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"query_id": column.take(pa.array(q)), "id": column.take(pa.array(i)), "score": pa.array(score, pa.float64())})

    kind = left.schema["id"].dataType.simpleString()
    near = left.unionByName(right).groupBy("dim", "part", "block").applyInArrow(best, f"query_id {kind}, id {kind}, score double")
    return ranked(near, k)


def fuse(keyword: DataFrame, vector: DataFrame, settings: Hybrid = Hybrid()) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked lists (query_id, id, score, rank): the best settings.limit of each query.

    A full outer join on (query_id, id); retrieval_source tells which lists a row is in. Order: hybrid score,
    then keyword rank, then vector rank, missing ranks last.
    """
    k = keyword.select("query_id", "id", F.col("score").alias("keyword_score"), F.col("rank").alias("keyword_rank"))
    v = vector.select("query_id", "id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    both = k.join(v, ["query_id", "id"], "full_outer")
    source = F.when(F.col("keyword_rank").isNull(), "vector").when(F.col("vector_rank").isNull(), "keyword").otherwise("both")
    score = rrf(settings.keyword_weight, settings.rrf_k, F.col("keyword_rank")) + rrf(settings.vector_weight, settings.rrf_k, F.col("vector_rank"))
    both = both.withColumns({"retrieval_source": source, "hybrid_score": score})
    order = W.partitionBy("query_id").orderBy(F.desc("hybrid_score"), F.col("keyword_rank").asc_nulls_last(), F.col("vector_rank").asc_nulls_last(), "id")
    return both.withColumn("position", F.row_number().over(order)).where(F.col("position") <= settings.limit)


def hybrid_search(docs: DataFrame, vectors: DataFrame, queries: DataFrame, settings: Hybrid = Hybrid(), id_col: str = "doc_id", text_col: str = "text", vec_id: str = "vec_id", vec_col: str = "embedding", keyword: DataFrame | None = None) -> DataFrame:
    """fuse() of keyword and vector lists for queries (query_id, text, embedding). keyword: a ranked list of the documents, as
    an index gives it; otherwise they are scanned."""
    kw = keyword if keyword is not None else ranked(keyword_scores(docs, query_terms(queries), id_col=id_col, text_col=text_col), settings.keyword_top_k)
    vec = vector_topk_batch(vectors, queries.select("query_id", "embedding"), settings.vector_top_k, vec_id, vec_col)
    return fuse(kw, vec, settings)


def encoded_queries(queries: DataFrame, provider: EmbeddingProvider, dim: int) -> DataFrame:
    """Queries (query_id, text) with embedding as the provider encodes queries; a vector of other than dim numbers is left out,
    and such a query is answered by keywords alone."""

    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        found = [provider.encode_query(t or "") for t in texts]
        return pd.Series([[float(x) for x in v] if len(v) == dim else None for v in found])

    return queries.withColumn("embedding", encode("text"))


@dataclass(frozen=True)
class Field:
    """A column that is searched: how it was cut into words for the index, and what its score counts."""

    column: str
    boost: float
    analyzer: Analyzer = max_word


#: The content is kept for three analyzers, and the best field's score counts.
FIELDS = (Field("content", 3.0), Field("content", 2.0, max_word), Field("content", 1.0, smart))


def multi_field_scores(docs: DataFrame, terms: DataFrame, fields: Sequence[Field] = FIELDS, settings: Bm25 = Bm25(), id_col: str = "doc_id") -> DataFrame:
    """Rows (query_id, id, score): the best of several fields' scores, each times its boost. Of fields with the same column
    and analyzer the one of the largest boost decides, so that it alone is scored. Of a column whose fields are cut by ByRuns
    the runs are counted once, and each distinct run is cut once."""
    most: dict[tuple[str, Analyzer], float] = {}
    for f in fields:
        most[f.column, f.analyzer] = max(f.boost, most.get((f.column, f.analyzer), 0.0))
    asked, runs, scores = stored(terms, "asked"), {}, []
    for (column, analyzer), boost in most.items():
        if isinstance(analyzer, ByRuns):
            key = (column, analyzer.dictionary)
            runs[key] = runs.get(key) or run_counts(docs, id_col, column, analyzer)
            rows = tokens_of_runs(*runs[key], analyzer)
        else:
            rows = tokens_of(docs, id_col, column, analyzer)
        scores.append((scored(term_counts(rows, asked), asked, settings), boost))
    return best_field(scores)


def run_counts(docs: DataFrame, id_col: str, text_col: str, analyzer: ByRuns) -> tuple[DataFrame, DataFrame]:
    """((id, docs, held array of (run, n)), one per id: how often it holds each run of letters; (run): all distinct ones)."""
    held = docs.select(F.col(id_col).alias("id"), analyzer.runs(F.col(text_col)).alias("held"))
    rows = held.select("id", F.posexplode_outer("held").alias("at", "run"))
    counts = rows.groupBy("id", "run").agg(F.count("run").alias("n"), F.count_if(F.coalesce(F.col("at"), F.lit(0)) == 0).alias("docs"))
    counts = stored(counts.groupBy("id").agg(F.sum("docs").alias("docs"), F.collect_list(F.when(F.col("run").isNotNull(), F.struct("run", "n"))).alias("held")), "runs")
    return counts, stored(counts.select(F.explode("held.run").alias("run")).distinct(), "distinct-runs")


def tokens_of_runs(counts: DataFrame, distinct: DataFrame, analyzer: ByRuns) -> DataFrame:
    """As tokens_of(), from run_counts(): each distinct run is cut once, and its words come to documents by a join."""
    cut = distinct.select("run", analyzer(F.col("run")).alias("words"))
    cut = stored(cut.select("run", F.explode("words").alias("term")).groupBy("run", "term").agg(F.count("*").alias("k")), "cut-runs")
    each = counts.select("id", F.explode("held").alias("p")).select("id", "p.run", "p.n").join(cut, "run")
    words = each.select("id", F.lit(False).alias("first"), (F.col("n") * F.col("k")).alias("dl"), "term", (F.col("n") * F.col("k")).alias("n"))
    none = F.lit(0).cast("long")
    return words.unionByName(counts.select("id", F.explode(F.array_repeat(F.lit(True), F.col("docs").cast("int"))).alias("first"), none.alias("dl"), F.lit(None).cast("string").alias("term"), none.alias("n")))


def search_chunks(index: DataFrame, queries: DataFrame, provider: EmbeddingProvider, embedding: Embedding, settings: Hybrid = Hybrid(), fields: Sequence[Field] = FIELDS, document_id: str | None = None) -> DataFrame:
    """Hybrid search of an index (rows as payload() makes them) for queries (query_id, text): query_id, position and 15 columns.

    Both lists come from what may be searched: embedded by that model at that dimension, of that document if one is named. Queries
    are cut into words by smart(), the content by each field's analyzer.
    """
    rows = index.where(eligible(embedding.model, embedding.dim))
    if document_id is not None:
        rows = rows.where(F.col("document_id") == document_id)
    asked = queries.where(~is_blank(F.col("text"))).select(F.col("query_id").cast("string"), strip(F.col("text")).alias("text"))
    asked = encoded_queries(asked, provider, embedding.dim)
    kw = ranked(multi_field_scores(rows, query_terms(asked, analyzer=smart), fields, id_col="chunk_id"), settings.keyword_top_k)
    vec = vector_topk_batch(rows, asked.select("query_id", "embedding"), settings.vector_top_k, "chunk_id", own_too=True)
    hits = fuse(kw, vec, settings).withColumnRenamed("id", "chunk_id")
    held = hits.join(rows.select(*SOURCE_FIELDS), "chunk_id").join(asked.select("query_id", F.col("text").alias("_query")), "query_id")
    return held.withColumn("matched_keywords", matched_keywords(F.col("_query"), F.coalesce("content", F.lit("")), F.col("exact_terms"))).select("query_id", "position", *HIT_FIELDS)


def with_highlights(hits: DataFrame, docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The hits with their content and the query's keywords in it."""
    texts = texts_of(hits, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("content")))
    asked = queries.select("query_id", F.col("text").alias("_query"))
    both = hits.join(texts, "id", "left").join(asked, "query_id")
    return both.withColumn("matched_keywords", matched_keywords(F.col("_query"), F.coalesce("content", F.lit("")))).drop("_query")


def texts_of(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of texts (id, ...) that hits name, found where they lie: hits are few, and no other text is moved."""
    return texts.join(stored(hits.select("id").distinct(), "hit-ids"), "id", "left_semi")


def parsed_hits(hits: DataFrame, json_col: str = "hit") -> DataFrame:
    """The columns of hits with chunk_id, score and source from an engine's hit (JSON text); hits without an id are left out.

    The id is the source's chunk_id, else the hit's own; a missing score is 0.
    """
    v = F.try_parse_json(F.col(json_col))
    text = lambda path: F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))
    rows = hits.withColumns({
        "chunk_id": F.coalesce(text("$._source.chunk_id"), text("$._id")), "score": F.coalesce(F.try_variant_get(v, "$._score", "double"), F.lit(0.0)),
        "source": F.coalesce(F.to_json(F.try_variant_get(v, "$._source", "variant")), F.lit("{}")),
    })
    return rows.where("chunk_id is not null").drop(json_col)


def search_error(failure: Exception) -> EngineError:
    """A search engine's failure as an error with a code: no such index, out of reach, or failed."""
    kind, text = type(failure).__name__, str(failure).lower()
    if getattr(failure, "status_code", None) == 404 or any(t in text for t in ("not_found", "not found")):
        code = "SEARCH_INDEX_NOT_FOUND"
    else:
        code = "SEARCH_ENGINE_UNAVAILABLE" if any(t in kind.lower() for t in ("connection", "timeout")) else "HYBRID_SEARCH_FAILED"
    return EngineError(code, "the search engine failed", {"error_type": kind})


def rerank(hits: DataFrame, enabled: bool = False) -> DataFrame:
    require(not enabled, "RAG_CONFIG_INVALID", "no reranker is configured")
    return hits
