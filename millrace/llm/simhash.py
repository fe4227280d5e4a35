"""SimHash near-dedup: fingerprints of word shingles, linked by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import join_by_hot_key, small_batches, staged
from millrace.llm.components import connected_components

#: Fixed value: the largest number of differing bits of a link. The index below is made for it.
MAX_BITS = 2
#: Fingerprints whose probes one task enumerates, about.
PROBED = 50_000
#: The fingerprint falls into quarters of 16 bits.
QUARTER = 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles (XXH64, seed 42), repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    breaks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts = np.concatenate(([0], breaks + 1))
    ends = np.concatenate((breaks, [len(flat)]))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    ends = ends[width - 1 :] if len(words) >= width else ends[-1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a long text in steps of bounded memory
        spans = zip(starts[at : min(n, at + (1 << 16))].tolist(), ends[at : at + (1 << 16)].tolist(), strict=True)
        h = np.array([digest(flat[a:b], 42) for a, b in spans], ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def simhash(text: Column, width: int = 3) -> Column:
    """The fingerprint as a (signed) long. A null text or one without words has fingerprint zero."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return of(text)


def _bits(quarter: int) -> int:
    return ((1 << QUARTER) - 1) << (QUARTER * quarter)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _key(fp: Column, free: int) -> Column:
    """A fingerprint's address in the table that leaves quarter free out; the table's number stands in its place."""
    return fp.bitwiseAND(F.lit(_signed(((1 << 64) - 1) ^ _bits(free))).cast("long")).bitwiseOR(F.lit(_signed((free + 1) << (QUARTER * free))).cast("long"))


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Rows (a, b), a < b, for distinct fingerprints (column fp) that differ in at most MAX_BITS bits.

    Four tables, each keyed by three of the four 16-bit quarters. Two fingerprints that differ in one quarter
    alone share a key of the table without it. Those that differ by a bit in each of quarters i < j meet in the
    table without j, once the bit of quarter i is flipped: so the ball of radius 1 in quarter i is enumerated,
    by the one of the two that has a 0 there. A key fixes 48 bits, so that a table entry holds at most 2^16
    fingerprints whatever the number of copies; full distances are verified in the join.
    """
    fp = F.col("fp")
    keys = F.explode(F.array(*[_key(fp, free) for free in range(4)]))
    exact = fps.select(fp.alias("x"), F.lit(False).alias("flip"), keys.alias("k"))
    flips = []
    for i in range(3):
        for bit in range(QUARTER * i, QUARTER * (i + 1)):
            mask = F.lit(_signed(1 << bit)).cast("long")
            for free in range(i + 1, 4):
                flips.append(F.when(fp.bitwiseAND(mask) == 0, _key(fp.bitwiseOR(mask), free)))
    probes = fps.select(fp.alias("x"), F.lit(True).alias("flip"), F.explode(F.array(*flips)).alias("k")).where("k is not null")
    table = fps.select(fp.alias("y"), keys.alias("key"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= MAX_BITS
    pairs = exact.unionByName(probes).join(table, (F.col("k") == F.col("key")) & near & (F.col("flip") & (F.col("x") != F.col("y")) | (F.col("x") < F.col("y"))))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def fingerprint_classes(fps: DataFrame) -> DataFrame:
    """Rows (fp, root) for distinct fingerprints: those linked by chains share a root."""
    stored = staged(fps.select("fp").distinct(), "fingerprints")
    cores = fps.sparkSession.sparkContext.defaultParallelism
    stored = stored.repartition(max(cores, -(-stored.count() // PROBED)), "fp")  # a few bytes a row become 53 rows
    roots = connected_components(fingerprint_links(stored)).withColumnRenamed("node", "fp")
    return stored.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per document: its id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Fingerprints, not documents, are linked: copies share one, so that a group of copies of any size costs one
    node. Null texts and texts without words have fingerprint zero and link like any other. Documents without
    an id stay, and lend no id to their component (null where none has one). Repeated rows stay.
    """
    hashed = staged(small_batches(docs).select(F.col(id_col).alias("id"), simhash(F.col(text_col), width).alias("fp")), "simhash")
    least = hashed.groupBy("fp").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"))
    roots = fingerprint_classes(hashed).join(least, "fp")
    named = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = staged(roots.join(named, "root").select("fp", "component_id", "copies"), "simhash-classes")
    return join_by_hot_key(hashed, named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest id stays (nulls last)."""
    hashed = staged(small_batches(docs).select(F.monotonically_increasing_id().alias("__row"), simhash(F.col(text_col), width).alias("__fp"), F.struct(*docs.columns).alias("__doc")), "simhash-docs")
    place = hashed.select("__row", F.col("__fp").alias("fp"), F.col(f"__doc.`{id_col}`").alias("id"))
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("__row"))
    least = place.groupBy("fp").agg(F.min(order).alias("first"))
    kept = fingerprint_classes(place).join(least, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.__row").alias("__row"))
    return hashed.join(kept, "__row", "left_semi").select(*[F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])
