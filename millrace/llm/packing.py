"""Best-fit packing into fixed-length sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import small_batches, staged

#: Fixed value: the word pattern of byte-level BPE vocabularies of this kind.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Tasks of a round, at most; beyond it a task evolves several islands, one after the other.
MOST_TASKS = 20_000
#: Sequences filled less than this are taken apart and packed again.
WELL_FILLED = 0.97


@dataclass(frozen=True)
class Genetics:
    """shard_items documents are packed together; each shard is evolved on islands whose elites migrate every round."""

    shard_items: int = 4096
    islands: int = 2
    population: int = 4
    generations: int = 6
    rounds: int = 2
    seed: int = 11


@lru_cache(maxsize=2)
def _encoding(path: str):
    """The vocabulary of a byte-level BPE tokenizer .json, encoded by tiktoken: the same ids as tokenizers', several times faster."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError("a plain byte-level BPE tokenizer is needed")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding("bytes", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)


def document_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32): each document's ids and end_id, cut only if longer than capacity.

    All pieces of a cut document are full but the first, which holds what is left over.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encoding.encode_to_numpy(text.as_py() or "", allowed_special="all"), end_id).astype("<u4")
                n = len(ids)
                first = n if n <= capacity else n % capacity or capacity
                starts = [0, *range(first, n, capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    at.append(i)
                    rows.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            cols = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols], names=["id", "piece", "start", "length", "ids_crc32"])

    slim = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(pieces, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, items: np.ndarray, bins: np.ndarray, room: list[int], capacity: int) -> None:
    """Put items, in the order given, into the fullest bin that has room, or a new one. Changes bins and room."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        if r > 0:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r
    for item, need in zip(items.tolist(), lengths[items].tolist(), strict=True):
        fits = mask >> need
        if fits:
            r = need + (fits & -fits).bit_length() - 1
            same = by_room[r]
            b = same.pop()
            if not same:
                mask &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins[item] = b
        room[b] = r = r - need
        if r:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r


def fills_of(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=lengths).astype(np.int64)


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """(fewer bins, then more of them well filled); smaller is better."""
    fill = fills_of(lengths, bins)
    return int((fill > 0).sum()), -float(((fill / capacity) ** 2).sum())


def refit(lengths: np.ndarray, bins: np.ndarray, out: np.ndarray, capacity: int) -> np.ndarray:
    """Renumber the bins of what is not out, and best-fit what is, longest first (items are in that order)."""
    stay = np.flatnonzero(~out)
    fresh = np.full(len(bins), -1, np.int64)
    names, fresh[stay] = np.unique(bins[stay], return_inverse=True)
    room = (capacity - np.bincount(fresh[stay], weights=lengths[stay], minlength=len(names))).astype(int).tolist()
    best_fit(lengths, np.flatnonzero(out), fresh, room, capacity)
    return fresh


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of a with well-filled whole bins of b.

    Bins of a that hold a document of an injected bin go, so that no document is there twice, and so do the
    emptiest few bins of a (mutation); documents that lose their bin that way are best-fitted.
    """
    fill = fills_of(lengths, b)
    good = np.flatnonzero(fill >= np.quantile(fill[fill > 0], 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.permutation(good)[: max(1, len(good) // 4)]] = True
    injected = chosen[b]
    held = fills_of(lengths, a)
    gone = np.zeros(len(held), bool)
    gone[a[injected]] = True
    gone[np.argsort(held, kind="stable")[: max(1, len(held) // 50)]] = True
    child = np.where(injected, len(held) + b, a)
    return refit(lengths, child, gone[a] & ~injected, capacity)


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, genes: Genetics, seed: list[int]) -> list[np.ndarray]:
    """Generations of one island; ends early where a packing has no more bins than the total length needs."""
    rng = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // capacity)
    rank = lambda p: fitness(lengths, p, capacity)
    population = sorted(population, key=rank)
    if population and rank(population[0])[0] <= least:
        return population[:1]
    while len(population) < genes.population:  # longest first, then less and less strictly so
        noise = rng.random(len(lengths)) * 0.25 * len(population) * max(1, int(lengths.max()))
        bins, room = np.full(len(lengths), -1, np.int64), []
        best_fit(lengths, np.argsort(-lengths - noise, kind="stable"), bins, room, capacity)
        population.append(bins)
        if rank(bins)[0] <= least:
            return [bins]
    population.sort(key=rank)
    for _ in range(genes.generations):
        if rank(population[0])[0] <= least:
            break
        a, b = rng.choice(min(len(population), genes.population), 2, replace=False)
        child = crossover(lengths, population[min(a, b)], population[max(a, b)], capacity, rng)
        population = sorted([*population, child], key=rank)[: genes.population]
    return population[: genes.population]


def _pack(arrays: list[np.ndarray]) -> list[bytes]:
    return [a.astype("<i4").tobytes() for a in arrays]


def _unpack(raw: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(r, "<i4").astype(np.int64) for r in raw]


def pack_items(items: DataFrame, capacity: int, genes: Genetics, level: int) -> DataFrame:
    """Rows (uid, length, shard, bin) for items (uid, length), packed shard by shard.

    Shards are random (a hash of uid), so of nearly equal size whatever the data. Each shard is one row of a table
    with its lengths as bytes; it goes to every island, and a round is one task per shard and island. Between
    rounds the best packing of each island goes to the next island of its ring. The best of all islands stays.
    """
    n = items.count()
    shards = max(1, -(-n // genes.shard_items))
    shard = F.pmod(F.xxhash64("uid", F.lit(genes.seed + level)), F.lit(shards)).cast("int")

    def gather(group: pa.Table) -> pa.Table:
        uid, length = group["uid"].to_numpy(), group["length"].to_numpy()
        order = np.lexsort((uid, -length))
        return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32()), "uids": [uid[order].astype("<i8").tobytes()], "lengths": [length[order].astype("<i4").tobytes()]})

    held = staged(items.select("uid", "length", shard.alias("shard")).groupBy("shard").applyInArrow(gather, "shard int, uids binary, lengths binary"), f"shards-{level}")
    ring = held.select("shard", "lengths", F.explode(F.sequence(F.lit(0), F.lit(genes.islands - 1))).alias("island"), F.array().cast("array<binary>").alias("population"))

    def round_of(step: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    lengths = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
                    seed = [genes.seed, level, step, row["shard"], row["island"]]
                    population = evolve(lengths, _unpack(row["population"]), capacity, genes, seed)
                    yield pa.RecordBatch.from_pylist([row | {"population": _pack(population)}], schema=batch.schema)

        return run

    kind = "shard int, lengths binary, island int, population array<binary>"
    for step in range(genes.rounds):
        slot = F.col("shard") * genes.islands + F.col("island")  # each a task of its own, up to the most that a job should have
        dealt = ring.repartitionByRange(min(shards * genes.islands, MOST_TASKS), slot)
        ring = staged(dealt.mapInArrow(round_of(step), kind), f"islands-{level}-{step}")
        if step + 1 < genes.rounds:
            after = ring.select("shard", F.pmod(F.col("island") + 1, F.lit(genes.islands)).alias("to"), F.slice("population", 1, 1).alias("elite"))
            ring = ring.join(after.withColumnRenamed("to", "island"), ["shard", "island"]).select("shard", "lengths", "island", F.concat("population", "elite").alias("population"))
    best = ring.select("shard", "island", F.col("population")[0].alias("bins"), "lengths")

    def unfold(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["island"])
        lengths = np.frombuffer(rows[0]["lengths"], "<i4").astype(np.int64)
        bins = min((np.frombuffer(r["bins"], "<i4").astype(np.int64) for r in rows), key=lambda b: fitness(lengths, b, capacity))
        uids = np.frombuffer(next(r["uids"] for r in rows), "<i8")
        return pa.table({"uid": uids, "length": lengths, "shard": np.full(len(uids), rows[0]["shard"], np.int64), "bin": bins})

    both = best.join(held.select("shard", "uids"), "shard")
    return both.groupBy("shard").applyInArrow(unfold, "uid long, length long, shard long, bin long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, genes: Genetics = Genetics(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty and hold end_id alone. Repeated ids and rows are packed as rows of their own. An
    empty table gives no rows. Pieces of full length are sequences of their own; the others are packed in
    shards, about shard_items a task and island. Every shard can leave a poorly filled sequence or two: those are taken
    apart and packed again together, level by level, until one shard is left or a level saves less than a sequence
    for each of its shards, which is what dealing them out into shards can cost.
    """
    pieces = document_pieces(docs, path, capacity, end_id, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())
    pieces = staged(pieces, "pieces")
    items = pieces.where(F.col("length") < capacity).select("uid", "length")
    packed, done, level = staged(pack_items(items, capacity, genes, 0), "packed-0"), [], 0
    while True:
        fill = staged(packed.groupBy("shard", "bin").agg(F.sum("length").alias("fill")), f"fill-{level}")
        poor = fill.where(F.col("fill") < WELL_FILLED * capacity).select("shard", "bin")
        shards, n_poor = fill.agg(F.count_distinct("shard"), F.count_if(F.col("fill") < WELL_FILLED * capacity)).first()
        if shards <= 1 or n_poor <= 1:
            done.append(packed.withColumn("level", F.lit(level)))
            break
        left = staged(packed.join(poor, ["shard", "bin"], "left_semi").select("uid", "length"), f"left-{level}")
        again = staged(pack_items(left, capacity, genes, level + 1), f"packed-{level + 1}")
        n_again, n_shards = again.select("shard", "bin").distinct().agg(F.count("*"), F.count_distinct("shard")).first()
        if n_again >= n_poor:
            done.append(packed.withColumn("level", F.lit(level)))
            break
        done.append(packed.join(poor, ["shard", "bin"], "left_anti").withColumn("level", F.lit(level)))
        packed, level = again, level + 1
        if n_poor - n_again < n_shards:
            done.append(packed.withColumn("level", F.lit(level)))
            break
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)

    within = W.partitionBy("level", "shard", "bin").orderBy(F.desc("length"), "uid").rowsBetween(W.unboundedPreceding, W.currentRow)
    number = (F.col("level").cast("long") * (1 << 56) + F.col("shard") * (1 << 24) + F.col("bin")).cast("long")
    placed = placed.select("uid", number.alias("sequence_id"), (F.sum("length").over(within) - F.col("length")).alias("offset"))
    full = pieces.where(F.col("length") >= capacity).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.join(placed.unionByName(full), "uid").select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
