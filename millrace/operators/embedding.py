"""Embeddings: a deterministic hash embedding in plain SQL functions, and providers run in batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.config import Embedding
from millrace.errors import require
from millrace.functions.vectors import l2_normalize
from millrace.schemas import EMBEDDABLE


class EmbeddingProvider(Protocol):
    """Documents are encoded as they are; a query may get an instruction first."""

    def encode_documents(self, texts: list[str]) -> list[list[float]]: ...

    def encode_query(self, text: str) -> list[float]: ...


class CodePointHashes:
    """What SHA-256 of "i:c" says of code points c at places i: bucket, sign and weight as one number, computed once, since texts
    have the same few code points at the same places. SLOTS code points and BLOCKS times PLACES places are held, 64 MB at
    most; others are computed as they come."""

    PLACES, SLOTS, BLOCKS = 4096, 128, 32

    def __init__(self, dim: int):
        self.dim, self.n = dim, 0
        self.slot = np.full(0x110000, -1, np.int16)
        self.blocks: dict[int, np.ndarray] = {}

    def of(self, text: str) -> np.ndarray:
        if not text:
            return np.array([self._one(0, "")], np.int64)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.concatenate([self._part(points[at : at + self.PLACES], at) for at in range(0, len(points), self.PLACES)])

    def _part(self, points: np.ndarray, at: int) -> np.ndarray:
        slot = self.slot[points]
        if (slot < 0).any() and self.n < self.SLOTS:
            for p in np.unique(points[slot < 0])[: self.SLOTS - self.n].tolist():
                self.slot[p], self.n = self.n, self.n + 1
            slot = self.slot[points]
        if at not in self.blocks and len(self.blocks) < self.BLOCKS:
            self.blocks[at] = np.full((self.SLOTS, self.PLACES), -1, np.int32)
        table, places = self.blocks.get(at), np.arange(len(points))
        out = np.full(len(points), -1, np.int64) if table is None else np.where(slot < 0, -1, table[slot, places]).astype(np.int64)
        for i in np.flatnonzero(out < 0).tolist():
            out[i] = self._one(at + i, chr(points[i]))
            if table is not None and slot[i] >= 0:
                table[slot[i], i] = out[i]
        return out

    def _one(self, i: int, c: str) -> int:
        h = int.from_bytes(hashlib.sha256(f"{i}:{c}".encode("utf-8", "surrogatepass")).digest()[:6], "big")
        return (h >> 16) % self.dim << 9 | h & 511  # the sign is the lowest bit of the fifth byte


def hash_weights(docs: DataFrame, dim: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, bucket, weight): the un-normalised hash embedding, sparse.

    The code point at place i is hashed as "i:c" (SHA-256); four bytes choose the bucket, the fifth the sign, the sixth
    a weight of 0.5 to 1.5. A null or empty text counts as one empty code point. Texts are summed where they lie, a row a
    bucket; a task hashes each code point at a place once.
    """

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = CodePointHashes(dim)
        for batch in batches:
            rows, buckets, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for row, text in enumerate(batch.column(1)):
                h = hashes.of(text.as_py() or "")
                bucket = h >> 9
                weight = np.where((h >> 8) & 1 == 0, 1.0, -1.0) * (0.5 + (h & 255) / 255)
                found = np.flatnonzero(np.bincount(bucket, minlength=dim))
                rows.append(np.full(len(found), row)), buckets.append(found), sums.append(np.bincount(bucket, weight, dim)[found])
            arrays = [batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(buckets).astype(np.int32)), pa.array(np.concatenate(sums))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "bucket", "w"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(weights, f"id {kind}, bucket int, w double")
    return rows.groupBy("id", "bucket").agg(F.sum("w").alias("weight"))


def hash_embeddings(docs: DataFrame, dim: int, normalize: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, embedding array<double>) of the hash embedding, one per distinct id."""
    held = hash_weights(docs, dim, id_col, text_col).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    dense = held.select("id", dense.alias("embedding"))
    return dense.select(F.col("id").alias(id_col), (l2_normalize(F.col("embedding")) if normalize else F.col("embedding")).alias("embedding"))


class HashProvider:
    """The hash embedding for one text at a time, for queries."""

    def __init__(self, dim: int):
        self.dim = dim

    def encode_query(self, text: str) -> list[float]:
        import math

        out = [0.0] * self.dim
        for i, c in enumerate(text or [""]):
            d = hashlib.sha256(f"{i}:{c}".encode()).digest()
            out[int.from_bytes(d[:4], "big") % self.dim] += (1 if d[4] % 2 == 0 else -1) * (0.5 + d[5] / 255)
        n = math.sqrt(sum(x * x for x in out))
        return [x / n for x in out] if n else out

    def encode_documents(self, texts: list[str]) -> list[list[float]]:
        return [self.encode_query(t) for t in texts]


PROVIDERS = {"hash": lambda settings: HashProvider(settings.dim)}


def provider_of(name: str, settings: Embedding) -> EmbeddingProvider:
    require(name in PROVIDERS, "EMBEDDING_CONFIG_INVALID", "unknown embedding provider", name=name)
    return PROVIDERS[name](settings)


def embed_chunks(chunks: DataFrame, provider: EmbeddingProvider, settings: Embedding) -> DataFrame:
    """The chunks, those not yet embedded or failed with an embedding and status.

    A batch that the provider fails, or answers with other than settings.dim numbers a text, is marked embed_failed and
    keeps no embedding. Others keep what they have. Batches run where the chunks are, no shuffle.
    """
    due = F.col("embedding_status").isin(*EMBEDDABLE)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list = [None] * len(texts)
            wanted = [i for i, t in enumerate(texts) if t is not None]
            for at in range(0, len(wanted), settings.batch):
                part = wanted[at : at + settings.batch]
                try:
                    vectors = provider.encode_documents([texts.iloc[i] for i in part])
                except Exception:  # noqa: BLE001  the provider's failure is the chunk's status
                    continue
                if len(vectors) == len(part) and all(len(v) == settings.dim for v in vectors):
                    for i, v in zip(part, vectors, strict=True):
                        out[i] = [float(x) for x in v]
            yield pd.Series(out)

    held = chunks.withColumn("_due", due).withColumn("_new", encode(F.when(due, F.coalesce("content", F.lit("")))))
    ok = F.col("_new").isNotNull()
    pick = lambda new, old: F.when(F.col("_due"), new).otherwise(F.col(old))
    return held.withColumns({
        "embedding": pick(F.col("_new"), "embedding"), "embedding_model": pick(F.when(ok, F.lit(settings.model)), "embedding_model"),
        "embedding_dim": pick(F.when(ok, F.lit(settings.dim)), "embedding_dim"), "embedding_status": pick(F.when(ok, "embedded").otherwise("embed_failed"), "embedding_status"),
    }).drop("_due", "_new")


def bad_dimensions(chunks: DataFrame, dim: int) -> DataFrame:
    """Embedded chunks whose vector has not dim components."""
    return chunks.where((F.col("embedding_status") == "embedded") & ~F.coalesce(F.size("embedding") == dim, F.lit(False)))


def eligible(model: str, dim: int) -> Column:
    """What a search may return: embedded by that model at that dimension."""
    return (F.col("embedding_status") == "embedded") & (F.col("embedding_model") == model) & (F.col("embedding_dim") == dim) & F.col("embedding").isNotNull()
