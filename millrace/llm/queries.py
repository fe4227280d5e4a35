"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe_automaton import bpe_round_trip
from millrace.llm.common import table
from millrace.llm.conversation_trie import prefix_trie, turn_rows, with_shared_heads
from millrace.llm.divergence import source_divergence
from millrace.llm.embedding_dedup import embedding_near_duplicates
from millrace.llm.html_text import extract_pages
from millrace.llm.language_id import identify_languages
from millrace.llm.mixing import mix
from millrace.llm.packing import pack_documents
from millrace.llm.secrets import scan_secrets, spans_text
from millrace.llm.simhash import near_duplicates
from millrace.llm.token_count import token_counts
from millrace.llm.topk import exact_topk
from millrace.llm.url_filter import filter_urls
from millrace.session import spread

#: Host and path rules.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents")), width=3)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"), least_cosine=0.93)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return identify_languages(spread(table(spark, sf_dir, "documents")), held_out)


def op6_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return token_counts(spread(table(spark, sf_dir, "documents")), tokenizer or public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spread(table(spark, sf_dir, "pages")))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spread(table(spark, sf_dir, "documents")), weights=(5, 2, 1), share=1.5, most_epochs=2.0)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spread(table(spark, sf_dir, "documents")))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack_documents(spread(table(spark, sf_dir, "documents")), tokenizer or public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


def op11_bpe_automaton(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    found = bpe_round_trip(spread(table(spark, sf_dir, "documents")), tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spread(table(spark, sf_dir, "documents")), least_documents=30, smoothing=5, scale=1_000_000_000, terms=50)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_shared_heads(turn_rows(spread(table(spark, sf_dir, "conversations"))), stride=20, heads=4))


QUERIES = {f.__name__: f for name, f in sorted(globals().items()) if name.startswith("op")}
