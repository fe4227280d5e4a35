"""Near copies: candidates by an index of wide SimHash fingerprints, then sets of word shingles compared by their Jaccard similarity."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import small_batches, staged
from millrace.llm.components import connected_components

#: Turns of the index in groups of places + 1, by places: of pairs of similarity 0.8 about two in 10^6 share no key of 40
#: groups, and ten in 10^6 none of 80 (places: see places_of()). A group with more places is missed more often.
GROUPS = {2: 40, 3: 80}
#: Nodes that are compared as one block: larger groups fall into chunks of about half this size.
CHUNK_NODES = 2048
#: A pair is compared where it first meets: in the largest group that both have among so many of their largest ones.
FIRST = 16
#: 64-bit words of the fingerprints that pairs are told apart by before they are compared, if both sets have LONG shingles:
#: the statistics of short ones are coarse, and they cost little. The index is made from so many words' sums.
WORDS, LONG, SUMS = 8, 64, 8
_BITS = 26
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_EPS = 1e-9


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes (XXH64, seed 42) of a text's word shingles; one of all words where there are fewer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    breaks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts, ends = [0, *(breaks + 1).tolist()], [*breaks.tolist(), len(flat)]
    n = max(1, len(words) - width + 1)
    ends = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(flat[a:b], 42) for a, b in zip(starts[:n], ends, strict=True)), np.uint64, n))


def signature(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def packed(shingles: np.ndarray) -> bytes:
    """The upper 40 bits of each hash: sets travel, and are compared, by these."""
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def bit_sums(shingles: np.ndarray) -> np.ndarray:
    """SimHash before its bits are decided: for each of 64 * SUMS bits, the hashes that have it less those that lack it."""
    out = np.zeros((SUMS, 64), np.int64)
    for k in range(SUMS):
        h = (shingles + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        for at in range(0, len(h), 1 << 16):  # a long text in steps of bounded memory
            out[k] += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return (2 * out - len(shingles)).ravel()


def wide_fingerprint(sums: np.ndarray) -> list[int]:
    """The SimHash of WORDS times 64 bits, as signed longs: a bit is 1 if it is set in over half the shingles' hashes."""
    return [int.from_bytes(x.tobytes(), "big", signed=True) for x in np.packbits(sums[: 64 * WORDS].reshape(WORDS, 64) > 0, axis=1)]


def most_bits(similarity: float) -> int:
    """So many bits of wide fingerprints differ at most: the mean for sets of the least similarity, whose angle has the
    cosine 2s / (1 + s), and six deviations, beyond which lies one pair in 10^9."""
    p, n = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * WORDS
    return math.ceil(n * p + 6 * math.sqrt(n * p * (1 - p)))


def places_of(docs: int) -> int:
    """So many turns' bits make a key: about 4 documents at most, besides near copies, then share one by chance."""
    return min(max(GROUPS), max(2, math.ceil((math.log2(max(1, docs)) - 2) / 10)))


@functools.cache
def _mixing(turns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of random signs a turn, and two Hadamard matrices whose product is the one for all sums."""
    signs = np.random.RandomState(42).randint(0, 2, (turns, 64 * SUMS)) * 2.0 - 1
    hadamard = lambda k: np.array([[1.0 - 2 * ((i & j).bit_count() & 1) for j in range(k)] for i in range(k)])
    return signs, hadamard(2 * SUMS), hadamard(32)


def most_decided(sums: np.ndarray, turns: int) -> np.ndarray:
    """For each row of bit_sums(), the most decided bit of each turn: its place, and whether it is set.

    In a turn the sums get random signs and are mixed by a Hadamard matrix: these are the sums of a SimHash by other random
    hyperplanes, at the same angles. Two sets of similarity 0.8 share the most decided of 512 bits in a third of the turns,
    unrelated ones in one of 1024. All sums are whole numbers that the type holds, so that every machine finds the same.
    """
    kind = np.float32 if not len(sums) or np.abs(sums).sum(axis=1).max() < 1 << 24 else np.float64
    signs, left, right = (x.astype(kind) for x in _mixing(turns))
    out = np.zeros((len(sums), turns), np.int16)
    for at in range(0, len(sums), 256):
        part = sums[at : at + 256].astype(kind)
        for turn, sign in enumerate(signs):
            mixed = (left @ ((part * sign).reshape(-1, 32) @ right).reshape(-1, 2 * SUMS, 32)).reshape(len(part), -1)
            place = np.abs(mixed).argmax(axis=1)
            out[at : at + 256, turn] = 2 * place + (mixed[np.arange(len(part)), place] > 0)
    return out


def index_keys(decided: np.ndarray, places: int) -> np.ndarray:
    """Keys of the index, of rows of most_decided(): the bits of all turns of a group but one, and which turn that is."""
    bits = decided.astype(np.int64).reshape(len(decided), -1, places + 1)
    groups, keys = np.arange(bits.shape[1]), np.empty_like(bits)
    for out in range(places + 1):
        key = groups * (places + 1) + out
        for turn in range(places + 1):
            key = key if turn == out else (key << 10) | bits[:, :, turn]
        keys[:, :, out] = key
    return keys.reshape(len(decided), decided.shape[1])


def _keyed(places: int):
    """Of rows (node, n, decided) a row (key, node, n) for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node, n = (c.to_numpy(zero_copy_only=False) for c in b.columns[:2])
            keys = index_keys(np.array([np.frombuffer(x, "<i2") for x in b.columns[2].to_pylist()]), places)
            for at in range(0, len(keys), 256):
                part, m = keys[at : at + 256], keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(part.ravel()), pa.array(np.repeat(node[at : at + 256], m)), pa.array(np.repeat(n[at : at + 256], m))], names=["key", "node", "n"])

    return run


def fitting(n: np.ndarray, rows: slice, similarity: float) -> np.ndarray:
    """Which of the nodes with a key in common can be similar to which, by their sizes."""
    x, y = n[rows, None], n[None, :]
    fits = np.minimum(x, y) >= similarity * np.maximum(x, y) - _EPS
    fits[np.arange(len(fits)), np.arange(rows.start, rows.start + len(fits))] = False
    return fits


def _groups(keys: int):
    """Whole groups of rows sorted by their first columns, of record batches: lists of the columns, several groups at a time."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.Table] = []  # of the group that is still open
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            cols = [c.to_numpy() for c in t.columns[:keys]]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            at = int(new[-1]) if len(new) else 0
            if held and any(h[0].as_py() != c[0] for h, c in zip(held[0].columns[:keys], cols, strict=True)):
                yield pa.concat_tables(held)
                held = []
            if at:
                yield pa.concat_tables([*held, t.slice(0, at)])
                held = []
            held.append(t.slice(at))
        if held:
            yield pa.concat_tables(held)

    return of


def _bounds(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where groups begin, and their lengths."""
    starts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)])
    return starts, np.diff(np.r_[starts, len(cols[0])])


def _shared(similarity: float):
    """Of rows (key, node, n) sorted by key: for each key, the nodes that can have a partner, by their sizes; m is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(1)(batches):
            key, node, n = (c.to_numpy() for c in t.columns)
            starts, lengths = _bounds([key])
            two = starts[lengths == 2]
            low, high = np.minimum(n[two], n[two + 1]), np.maximum(n[two], n[two + 1])
            two = two[low >= similarity * high - _EPS]
            rows, m = [two, two + 1], [np.full(2 * len(two), 2)]
            for a, k in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
                at = a + np.arange(k)
                if k <= 2 * CHUNK_NODES:
                    at = at[np.concatenate([fitting(n[a : a + k], slice(b, min(k, b + 512)), similarity).any(axis=1) for b in range(0, k, 512)])]
                rows.append(at), m.append(np.full(len(at), len(at)))
            rows = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(node[rows]), pa.array(np.concatenate(m).astype(np.int64))], names=["key", "node", "m"])

    return run


def _met_before(first: np.ndarray) -> np.ndarray:
    """Which of the nodes share one of their groups in first (-1: none)."""
    named, at, times = np.unique(first, return_inverse=True, return_counts=True)
    told = (times > 1) & (named >= 0)
    place, at = np.cumsum(told) - 1, at.reshape(first.shape)
    has = np.zeros((len(first), int(told.sum())), np.float32)
    i, j = np.nonzero(told[at])
    has[i, place[at[i, j]]] = 1
    return has


def _with_partner(similarity: float, most: int):
    """Of groups of rows (key, lo, hi, part, node, label, n, first, fp) those that another one can be similar to and that it
    hasn't met in an earlier group: whose sizes fit, whose labels differ, and whose fingerprints differ in at most so many
    bits, or that are too short for one. Two parts of a large group meet across only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(3)(batches):
            key, lo, hi, part, node, label, n = (c.to_numpy() for c in t.columns[:7])
            first, bits = (np.array(c.combine_chunks().flatten().to_numpy()).reshape(len(key), -1) for c in t.columns[7:])
            first[np.logical_or.accumulate(first == key[:, None], axis=1)] = -1  # this group and those after it
            bits, short = bits.view(np.uint64), n < LONG
            starts, lengths = _bounds([key, lo, hi])
            keep = np.zeros(len(key), bool)
            two = starts[lengths == 2]
            differ = np.bitwise_count(bits[two] ^ bits[two + 1]).sum(axis=1, dtype=np.int64)
            near = ((differ <= most) | short[two] | short[two + 1]) & (label[two] != label[two + 1]) & ((lo[two] == hi[two]) | (part[two] != part[two + 1]))
            near &= np.minimum(n[two], n[two + 1]) >= similarity * np.maximum(n[two], n[two + 1]) - _EPS
            near &= ~((first[two][:, :, None] == first[two + 1][:, None, :]) & (first[two] >= 0)[:, :, None]).any(axis=(1, 2))
            keep[two[near]] = keep[two[near] + 1] = True
            for a, k in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
                all_ = slice(a, a + k)
                has = _met_before(first[all_])
                for b in range(0, k, 256):
                    rows = slice(a + b, min(a + k, a + b + 256))
                    near = sum(np.bitwise_count(bits[rows, None, w] ^ bits[None, all_, w]).astype(np.int16) for w in range(WORDS)) <= most
                    near |= short[rows, None] | short[None, all_]
                    near &= fitting(n[all_], slice(b, min(k, b + 256)), similarity) & (label[rows, None] != label[None, all_])
                    if lo[a] != hi[a]:
                        near &= part[rows, None] != part[None, all_]
                    if has.shape[1]:
                        near &= has[b : b + 256] @ has.T == 0
                    keep[rows] = near.any(axis=1)
            yield from t.select(["key", "lo", "hi", "part", "node", "label"]).filter(pa.array(keep)).to_batches()

    return run


def _forest(similarity: float):
    """Over rows (key, lo, hi, part, label, shingles) sorted by group: links (a, b) of labels that connect what is similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        out: list[tuple[int, int]] = []

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        def compare(parts: list[int], nodes: list[int], sets: list[np.ndarray], cross: bool) -> None:
            order = np.argsort([len(s) for s in sets], kind="stable")
            sizes = np.array([len(sets[i]) for i in order])
            tops = np.array([find(nodes[i]) for i in order], np.int64)
            side = np.array([parts[i] for i in order])
            ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
            ends = np.cumsum(sizes)
            holders = np.repeat(np.arange(len(order)), sizes)[np.argsort(ids, kind="stable")]  # of each shingle, ascending
            until = np.cumsum(np.bincount(ids))
            for k in range(1, len(order)):
                at = int(np.searchsorted(sizes[:k], similarity * sizes[k] - _EPS))
                differ = tops[at:k] != tops[k]
                if cross:
                    differ &= side[at:k] != side[k]
                if not differ.any():
                    continue
                x = ids[ends[k] - sizes[k] : ends[k]]
                both = np.bincount(np.concatenate([holders[a:b] for a, b in zip((until[x - 1] * (x > 0)).tolist(), until[x].tolist(), strict=True)]), minlength=k)[at:k]
                similar = differ & (both >= similarity * (sizes[at:k] + sizes[k] - both) - _EPS)
                for j in (at + np.flatnonzero(similar)).tolist():
                    if tops[j] == tops[k]:
                        continue
                    a, b = sorted((int(tops[j]), int(tops[k])))
                    root[b] = a
                    out.append((nodes[order[j]], nodes[order[k]]))
                    tops[tops == b] = a

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
                out.clear()

        group, parts, nodes, sets = None, [], [], []
        for b in batches:
            for key, lo, hi, part, node, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, lo, hi) != group:
                    if len(nodes) > 1:
                        compare(parts, nodes, sets, group[1] != group[2])
                    group, parts, nodes, sets = (key, lo, hi), [], [], []
                parts.append(part), nodes.append(node), sets.append(unpacked(blob))
            yield from flush()
        if len(nodes) > 1:
            compare(parts, nodes, sets, group[1] != group[2])
        yield from flush()

    return run


def _slots(node: F.Column) -> list:
    return [F.pmod(node, F.lit(1 << _BITS)), F.pmod(F.shiftright(node, _BITS), F.lit(1 << _BITS))]


def _filter_of(nodes: DataFrame):
    """A filter of fixed size (8 MB), broadcast, and a test of longs in it: false means that the table lacks them."""
    slots = nodes.select(F.explode(F.array(*_slots(F.col("node")))).alias("s"))
    words = slots.groupBy(F.shiftright("s", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("x")).toPandas()
    field = np.zeros(1 << (_BITS - 6), np.int64)
    field[words.w.to_numpy(np.int64)] = words.x.to_numpy(np.int64)
    shared = nodes.sparkSession.sparkContext.broadcast(field)

    def found(x: np.ndarray) -> np.ndarray:
        low, out = np.int64((1 << _BITS) - 1), np.ones(len(x), bool)
        for s in (x & low, (x >> _BITS) & low):
            out &= (shared.value[s >> 6] >> (s & 63)) & 1 == 1
        return out

    return found


def _may_hold(nodes: DataFrame):
    found = _filter_of(nodes)
    return F.pandas_udf(lambda node: pd.Series(found(node.to_numpy(np.int64))), "boolean")


def _chunks(m: F.Column) -> F.Column:
    return F.ceil(m * F.lit(2) / F.lit(CHUNK_NODES))


def _across(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (key, m, node, ...) of large groups, placed for the comparison of their chunks with each other. What links connect
    has one label. Of the label with the most nodes of a group each chunk meets those of the group's other nodes only, so
    that a group of one label gives no rows; only nodes without links make pairs of chunks."""
    named = rows.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("size", "label")).alias("top"), F.sum("size").alias("all"))
    largest = largest.select("key", F.col("top.label").alias("top"), _chunks(F.col("all") - F.col("top.size")).alias("others"))
    placed = named.join(largest.where("others > 0"), "key").withColumn("c", _chunks(F.col("m")))
    in_top, share = F.col("label") == F.col("top"), F.xxhash64("node")
    placed = placed.withColumn("part", F.when(in_top, F.pmod(share, F.col("c"))).otherwise(F.col("c") + F.pmod(share, F.col("others"))))
    met = F.sequence(F.when(in_top, F.col("c")).otherwise(F.lit(0).cast("long")), F.col("c") + F.col("others") - 1)
    return placed.withColumn("other", F.explode(met)).withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))


def keep_dissimilar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without near copies: of those that chains of similar pairs connect, the row with the smallest id stays
    (nulls last). Similar: the Jaccard similarity of the sets of word shingles is similarity or more; every such pair counts.

    Documents of equal sets are one node. Nodes meet in an index of wide SimHash fingerprints (index_keys()). Pairs of long sets
    whose fingerprints differ in more than most_bits() go; the others are compared by their whole sets in the first group in
    which they meet, unless links connect them already. A key's group gives a row a node, never its pairs. Texts without
    words equal each other and nothing else.
    """
    spark = small_batches(docs).sparkSession
    places = places_of(docs.count())
    turns = GROUPS[places] * (places + 1)

    @F.pandas_udf("node bigint, n bigint, decided binary, fp array<bigint>")
    def hashed_of(texts: pd.Series) -> pd.DataFrame:
        nodes, sizes, prints, sums = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64), [], np.zeros((len(texts), 64 * SUMS), np.int64)
        for i, text in enumerate(texts):
            s = shingle_set(text, width)
            nodes[i], sizes[i], sums[i] = signature(s), len(s), bit_sums(s)
            prints.append(wide_fingerprint(sums[i]) if len(s) >= LONG else None)
        decided = [x.tobytes() for x in most_decided(sums, turns).astype("<i2")]
        return pd.DataFrame({"node": nodes.view(np.int64), "n": sizes, "decided": decided, "fp": prints})

    found = docs.select(F.monotonically_increasing_id().alias("__row"), hashed_of(F.col(text_col)).alias("__h"), F.struct(*docs.columns).alias("__doc"))
    hashed = staged(found.select("__row", F.col("__h.node").alias("node"), F.col("__h.n").alias("n"), F.col("__h.decided").alias("decided"), F.col("__h.fp").alias("fp"), "__doc"), "similar-docs")
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("__row"))
    least = staged(hashed.select("node", "__row", F.col(f"__doc.`{id_col}`").alias("id")).groupBy("node").agg(F.min(order).alias("first"), F.count("*").alias("copies")), "similar-nodes")
    able = F.col("n") * (1 - similarity) >= similarity - _EPS  # smaller sets are equal or less similar
    keyed = hashed.where(able).groupBy("node").agg(F.first(F.struct("n", "decided")).alias("h")).select("node", "h.n", "h.decided").mapInArrow(_keyed(places), "key bigint, node bigint, n bigint")
    shared = staged(keyed.select("key", "node", "n").repartition("key").sortWithinPartitions("key").mapInArrow(_shared(similarity), "key bigint, node bigint, m bigint"), "similar-keys")

    key = F.struct((-F.col("m")).alias("rank"), "key")  # the largest groups first
    prints = hashed.groupBy("node").agg(F.first(F.struct("n", F.coalesce("fp", F.array_repeat(F.lit(0).cast("long"), WORDS)).alias("fp"))).alias("h"))
    met = shared.groupBy("node").agg(F.sort_array(F.collect_list(key)).alias("keys")).join(prints, "node")
    none = F.array_repeat(F.lit(-1).cast("long"), FIRST)
    met = staged(met.select("node", "h.n", "h.fp", F.slice(F.concat("keys.key", none), 1, FIRST).alias("first"), "keys"), "similar-met")

    def linked(placed: DataFrame, name: str) -> DataFrame:
        """Links of rows (key, lo, hi, part, node, label, n, first, fp): a set moves once for each group that it is compared in."""
        group, rest = ["key", "lo", "hi"], "part bigint, node bigint, label bigint"
        placed = placed.select(*group, "part", "node", "label", "n", "first", "fp").repartition(*group).sortWithinPartitions(*group)
        placed = staged(placed.mapInArrow(_with_partner(similarity, most_bits(similarity)), f"key bigint, lo bigint, hi bigint, {rest}"), f"similar-groups-{name}")
        asked = least.join(placed.select("node").distinct(), "node", "left_semi").select(F.xxhash64("first.__row").alias("node"))
        wanted = _filter_of(asked)

        @F.pandas_udf("binary")
        def sets_of(row: pd.Series, texts: pd.Series) -> pd.Series:
            return pd.Series([packed(shingle_set(t, width)) if ask else None for ask, t in zip(wanted(row.to_numpy(np.int64)), texts, strict=True)], dtype=object)

        texts = hashed.select("node", sets_of(F.xxhash64("__row"), F.col(f"__doc.`{text_col}`")).alias("shingles"))
        sets = texts.where("shingles is not null")  # a node may come twice, which links nothing new
        rows = placed.join(sets, "node").select(*group, "part", "label", "shingles").repartition(*group).sortWithinPartitions(*group)
        return staged(rows.mapInArrow(_forest(similarity), "a bigint, b bigint"), f"similar-links-{name}")

    # each chunk of a group in itself; a large group is cut twice, by different hashes, so that links chain its chunks
    def parts(k: F.Column) -> F.Column:
        placed = lambda part: F.struct(k.key.alias("key"), part.alias("part"))
        c = _chunks(-k.rank)
        return F.when(-k.rank <= CHUNK_NODES, F.array(placed(F.lit(0).cast("long")))).otherwise(F.array(placed(F.pmod(F.xxhash64("node"), c)), placed(c + F.pmod(F.xxhash64("node", F.lit(1)), c))))

    rows = met.select("node", F.col("node").alias("label"), "n", "first", "fp", F.explode(F.flatten(F.transform("keys", parts))).alias("k"))
    links = linked(rows.select("*", "k.*", F.col("k.part").alias("lo"), F.col("k.part").alias("hi")), "within")
    if shared.where(F.col("m") > CHUNK_NODES).limit(1).count():
        large = met.select("node", "n", "first", "fp", F.explode(F.filter("keys", lambda k: -k.rank > CHUNK_NODES)).alias("k"))
        large = large.select("node", "n", "first", "fp", "k.key", (-F.col("k.rank")).alias("m"))
        links = links.unionByName(linked(_across(large, connected_components(links)), "across"))

    roots = connected_components(links).withColumnRenamed("root", "top")
    firsts = least.join(roots, "node", "left").select(F.coalesce("top", "node").alias("top"), "node", "first", "copies")
    kept = firsts.groupBy("top").agg(F.min("first").alias("first")).select(F.col("first.__row").alias("__row"))
    touched = staged(firsts.where("copies > 1 or top <> node").select("node").unionByName(roots.select("node")).distinct(), "similar-touched")
    columns = [F.col(f"__doc.`{c}`").alias(c) for c in docs.columns]
    marked = hashed.withColumn("may", _may_hold(touched)(F.col("node")))
    return marked.where("not may").select(columns).unionByName(marked.where("may").join(kept, "__row", "left_semi").select(columns))
