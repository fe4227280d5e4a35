import hashlib
import math
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from millrace.config import BlockChunking, Extraction, Hybrid, Rag, WindowChunking
from millrace.errors import EngineError
from millrace.functions.text import (
    TRUNCATED, content_hash, exact_terms, is_blank, json_without_nulls, latin_tokens, looks_like_html, matched_keywords, optional_text, redact_urls, safe_segment, shorten, squeeze, strip, strip_code_fence, truncate,
)
from millrace.functions.vectors import cosine_distance, l2_normalize, quantize4, rrf
from millrace.operators.chunking import chunk_stats, embedding_status, window_chunks
from millrace.operators.embedding import HashProvider, bad_dimensions, embed_chunks, eligible, hash_embeddings

CHARS = [chr(c) for c in [*range(0x20), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x200B, 0xFEFF, 0x41, 0xE9, 0x1F600]]


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).first()[0]


def test_strip_and_squeeze_follow_python(spark):
    data = [(c + "a" + c + c + "b" + c,) for c in CHARS] + [("",), ("\x1c \x1f",), ("x \n y",)]
    for (x,), r in zip(data, spark.createDataFrame(data, "x string").select(strip(F.col("x")).alias("s"), squeeze(F.col("x")).alias("q")).collect(), strict=True):
        assert r.s == x.strip() and r.q == re.sub(r"\s+", " ", x.strip()), [hex(ord(c)) + unicodedata.name(c, "?") for c in x]


def test_exact_terms(spark):
    assert one(spark, "符合 GB/T 标准 ht250 冒口, GJBX 与 xHB", exact_terms) == ["GB/T", "HT250", "冒口"]
    assert one(spark, "", exact_terms) == []


def test_matched_keywords(spark):
    got = spark.createDataFrame([("冒口如何保证热节补缩", "GB/T 下 HT250 冒口设计应保证热节补缩")], "q string, c string").select(matched_keywords(F.col("q"), F.col("c"))).first()[0]
    assert got == ["冒口", "热节", "补缩"]
    got = spark.createDataFrame([("ab AB x-1 z", "AB x-1")], "q string, c string").select(matched_keywords(F.col("q"), F.col("c"), dictionary=())).first()[0]
    assert got == ["ab", "AB", "x-1"]


@pytest.mark.parametrize("n", [-1, 0, 3, 9, 10, 14, 15, 40])
def test_truncate(spark, n):
    text = "冒口补缩abcdefghijk"
    want = "" if n <= 0 else text if len(text) <= n else TRUNCATED[:n] if n <= 9 else text[: n - 9] + TRUNCATED
    assert one(spark, text, lambda x: truncate(x, F.lit(n))) == want


def test_small_text_functions(spark):
    assert one(spark, "a😀b", F.length) == 3
    assert one(spark, " ../we ird/na:me. ", safe_segment) == "we_ird_na_me"
    assert one(spark, "see  http://x.y/z?a=1 and https://b", redact_urls) == "see [URL] and [URL]"
    assert one(spark, "x" * 600, lambda x: F.length(redact_urls(x))) == 500
    assert one(spark, "abcdef", lambda x: shorten(x, 4)) == "abcd..."
    assert one(spark, "```json\n{}\n```", strip_code_fence) == "{}" and one(spark, " {} ", strip_code_fence) == "{}"
    assert one(spark, "Ab-9 é", latin_tokens) == ["ab", "9"]
    want = hashlib.sha256("process_rule\n\nRiser rule.\nPlace risers near hot spots.".encode()).hexdigest()
    row = spark.createDataFrame([("process_rule", None, " Riser  rule. ", "Place risers\nnear hot spots.")], "a string, b string, c string, d string")
    assert row.select(content_hash(*[F.col(c) for c in "abcd"])).first()[0] == want


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1 and abs(got[1]) < 1e-12 and got[2:] == [None, None]
    assert one(spark, [3.0, 4.0], l2_normalize, "array<double>") == [0.6, 0.8] and one(spark, [0.0], l2_normalize, "array<double>") == [0.0]
    assert [float(one(spark, x, quantize4, "double")) for x in (0.12345, 0.12355, 1.0)] == [0.1234, 0.1236, 1.0]
    assert one(spark, 1, lambda x: rrf(0.5, 60, x), "int") == 0.5 / 61 and one(spark, None, lambda x: rrf(0.5, 60, x), "int") == 0


def test_window_chunks(spark):
    df = spark.createDataFrame([(1, "a" * 1200), (2, " \n"), (3, None), (4, "b" * 1000), (5, "😀" * 1001)], "doc_id int, text string")
    got = [(r.document_id, r.chunk_index, r.char_start, r.char_end) for r in window_chunks(df).orderBy("document_id", "chunk_index").collect()]
    assert got == [(1, 0, 0, 1000), (1, 1, 900, 1200), (4, 0, 0, 1000), (5, 0, 0, 1000), (5, 1, 900, 1001)]
    assert tuple(chunk_stats(window_chunks(df.limit(0))).first()) == (0, 0, 0, 0, 0.0)


@pytest.mark.parametrize("size,overlap", [(7, 0), (7, 3), (5, 4), (1, 0)])
def test_window_chunks_follow_the_loop(spark, size, overlap):
    df = spark.createDataFrame([(n, "x" * n) for n in range(1, 40)], "doc_id int, text string")
    want = []
    for n in range(1, 40):
        start = 0
        while True:
            want.append((n, start, min(n, start + size)))
            if start + size >= n:
                break
            start += size - overlap
    got = window_chunks(df, WindowChunking(size, overlap)).orderBy("document_id", "chunk_index").collect()
    assert [(r.document_id, r.char_start, r.char_end) for r in got] == want


def test_settings():
    for bad in ((0, 0), (-1, 0), (100, -1), (100, 100), (100, 101)):
        with pytest.raises(EngineError) as e:
            WindowChunking(*bad)
        assert e.value.code == "DOCUMENT_CHUNK_CONFIG_INVALID"
    for make in (lambda: Hybrid(limit=0), lambda: Hybrid(limit=51), lambda: Hybrid(keyword_weight=0, vector_weight=0), lambda: Hybrid(rrf_k=0), lambda: Hybrid(limit=20, keyword_top_k=10), lambda: BlockChunking(min_chars=2000), lambda: Rag(top_k=0), lambda: Extraction(max_chunks=51)):
        with pytest.raises(EngineError):
            make()


def test_hash_embeddings(spark):
    df = spark.createDataFrame([(1, "abc é😀"), (2, ""), (3, None)], "doc_id int, text string")
    provider = HashProvider(16)
    for r in hash_embeddings(df, 16).collect():
        text = {1: "abc é😀", 2: "", 3: ""}[r.doc_id]
        assert len(r.embedding) == 16 and max(abs(a - b) for a, b in zip(r.embedding, provider.encode_query(text), strict=True)) < 1e-12
        assert math.isclose(sum(x * x for x in r.embedding), 1)


def test_embed_chunks(spark):
    from millrace.config import Embedding

    data = [("a", "text one", None, None, None, "not_started"), ("b", "boom", None, None, None, "embed_failed"), ("c", "kept", [1.0] * 4, "m0", 4, "embedded"), ("d", None, None, None, None, "not_started"), ("e", "busy", None, None, None, "embedding")]
    df = spark.createDataFrame(data, "id string, content string, embedding array<float>, embedding_model string, embedding_dim int, embedding_status string")

    class Fails(HashProvider):
        def encode_documents(self, texts):
            if "boom" in texts:
                raise RuntimeError
            return super().encode_documents(texts)

    got = {r.id: r for r in embed_chunks(df, Fails(4), Embedding("m", 4, batch=1)).collect()}
    assert {k: r.embedding_status for k, r in got.items()} == {"a": "embedded", "b": "embed_failed", "c": "embedded", "d": "embedded", "e": "embedding"}
    assert got["a"].embedding_model == "m" and got["c"].embedding_model == "m0" and got["b"].embedding is None
    done = embed_chunks(df, HashProvider(3), Embedding("m", 4))
    assert {r.embedding_status for r in done.where("id in ('a','b')").collect()} == {"embed_failed"}
    assert bad_dimensions(df, 5).count() == 1 and df.where(eligible("m0", 4)).count() == 1
    status = embedding_status(df.withColumn("document_id", F.lit(1))).first()
    assert (status.not_started, status.embedding, status.embedded, status.embed_failed, status.models, status.dims) == (2, 1, 1, 1, ["m0"], [4])


@pytest.mark.parametrize("fn", [strip, squeeze, is_blank, safe_segment, optional_text, json_without_nulls, strip_code_fence, looks_like_html, redact_urls])
@pytest.mark.parametrize("unit", [" ", "\n", '"', '\\"', "null,", "http://x "])
def test_long_texts_take_time_in_proportion(spark, fn, unit):
    """Two million characters between two others, in seconds: no run is tried from each of its places, and none takes stack."""
    df = spark.range(1).select(F.concat(F.lit("x"), F.repeat(F.lit(unit), 2_000_000 // len(unit)), F.lit("y")).alias("x"))
    began = time.perf_counter()
    df.select(F.length(fn(F.col("x")).cast("string"))).first()
    assert time.perf_counter() - began < 10


def test_ten_megabytes(spark):
    began = time.perf_counter()
    df = spark.range(1).select(F.concat(F.lit(" x"), F.repeat(F.lit(" "), 10_000_000), F.lit("y ")).alias("x"))
    got = df.select(F.length(strip(F.col("x"))).alias("s"), squeeze(F.col("x")).alias("q"), is_blank(F.col("x")).alias("b")).first()
    assert (got.s, got.q, got.b) == (10_000_002, "x y", False)
    deep = spark.range(1).select(F.concat(F.lit('{"k":null,"s":"'), F.repeat(F.lit('\\"null,'), 1_500_000), F.lit('","d":'), F.repeat(F.lit("["), 100_000), F.lit("null"), F.repeat(F.lit("]"), 100_000), F.lit("}")).alias("x"))
    assert deep.select(F.length(json_without_nulls(F.col("x")))).first()[0] == len('{"s":"","d":}') + 1_500_000 * 7 + 200_000
    assert time.perf_counter() - began < 60


def test_blank_texts(spark):
    data = [(None,), ("",), *[(c * n,) for c in CHARS for n in (1, 3)], ("\n\n x",), (" \x1c\n",)]
    for (x,), r in zip(data, spark.createDataFrame(data, "x string").select(is_blank(F.col("x")).alias("b")).collect(), strict=True):
        assert r.b == (not (x or "").strip()), x


def test_fences(spark):
    for text, want in {"```json\n{}\n```": "{}", "```\n\na\n\n```  ": "a", "```json\n```": "```", "```json": "", "```a\nb": "b", "a\n```": "a\n```", "```x\na\n```\nb\n```": "a\n```\nb", "": ""}.items():
        assert one(spark, text, strip_code_fence) == want, text
