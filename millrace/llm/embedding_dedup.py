"""Embedding near-dedup by a subspace pigeonhole join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import join_by_hot_key, staged
from millrace.llm.components import connected_components
from millrace.llm.vectors import binary_of, matrix_of, rows_of, usable

#: Dimensions of a block of the rotated vectors, and how many of its first ones order its vectors by cells.
BLOCK_DIMS, CELL_DIMS = 16, 4
#: Vectors of a chunk, about: a task compares two chunks.
CHUNK_ROWS = 16384
#: Vectors that are sent to tasks at once, for every vector there is; what goes beyond that goes in later rounds.
ROUND_COPIES = 4
#: Rotated vectors are 32-bit floats; this much more squared distance makes up for it.
SLACK = 1e-5
#: Rows of a tile of a chunk.
TILE = 512
#: Links that a task holds before it counts them.
HELD_LINKS = 1 << 20


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int) -> list[tuple[int, int]]:
    n = max(1, -(-dim // BLOCK_DIMS))
    edges = np.linspace(0, dim, n + 1).astype(int).tolist()
    return list(zip(edges, edges[1:], strict=False))


def budgets_of(dim: int, least_cosine: float) -> list[float]:
    """Each block's share, by its dimensions, of the squared distance of unit vectors at that cosine."""
    whole = 2 * (1 - least_cosine) + SLACK
    return [whole * (b - a) / dim for a, b in blocks_of(dim)]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by a power of two of about their largest component: exact, and safe to square."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def inverse_norms(x: np.ndarray) -> np.ndarray:
    return 1 / np.sqrt((x * x).sum(axis=1))


def turned_of(x: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Rows as rotated unit vectors. Sums of whole numbers below 2^53 are exact in any order, so that every task gets the same."""
    return (np.rint(x * inverse[:, None] * 2**26) @ np.rint(rotation(x.shape[1]) * 2**24) / 2**50).astype(np.float32)


def cells_of(turned: np.ndarray, least_cosine: float) -> list[np.ndarray]:
    """Each block's cells, one per coordinate: ranges as wide as the root of the block's share."""
    dim = turned.shape[1]
    shares = zip(blocks_of(dim), budgets_of(dim, least_cosine), strict=True)
    return [np.floor(turned[:, a:b].astype(np.float64) / (math.sqrt(most) * (1 + 1e-6))).astype(np.int32) for (a, b), most in shares]


def linked_pairs(x: np.ndarray, turned: np.ndarray, left: np.ndarray, right: np.ndarray, block: int, least_cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of pairs, i from left and j from right, that this block has to report, a batch at a time.

    A pair is reported by the first block in whose budget it lies. Candidates come from the block alone: rows are ordered by
    cells, and tiles of them meet unless their boxes lie further apart; they are then verified by the cosine of x, the vectors
    as they came.
    """
    dim = turned.shape[1]
    spans, budgets = blocks_of(dim), budgets_of(dim, least_cosine)
    (a, b), most = spans[block], budgets[block]
    same = left is right
    norms = np.sqrt((x * x).sum(axis=1))
    order = cells_of(turned, least_cosine)[block][:, :CELL_DIMS]
    ordered = lambda rows: rows[np.lexsort(order[rows].T[::-1])]
    u = ordered(left)
    v = u if same else ordered(right)
    if not len(u) or not len(v):
        return
    y, z = turned[u, a:b], turned[v, a:b]
    norms_y, norms_z = (y * y).sum(axis=1), (z * z).sum(axis=1)
    edges = lambda rows: np.arange(0, len(rows), TILE)
    low_y, high_y, low_z, high_z = (f.reduceat(m, edges(m)) for m in (y, z) for f in (np.minimum, np.maximum))
    for at in range(len(low_y)):
        gap = np.maximum(np.maximum(low_z - high_y[at], low_y[at] - high_z), 0)
        s = slice(at * TILE, (at + 1) * TILE)
        for to in np.flatnonzero((gap.astype(np.float64) ** 2).sum(axis=1) <= most + SLACK):
            if same and to < at:
                continue
            t = slice(to * TILE, (to + 1) * TILE)
            i, j = np.nonzero(norms_y[s, None] + norms_z[None, t] - 2 * (y[s] @ z[t].T) <= most + SLACK)
            if same and to == at:
                i, j = i[j > i], j[j > i]
            i, j = u[s][i], v[t][j]
            for part in range(0, len(i), 1 << 16):
                p, q = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                apart = (turned[p].astype(np.float64) - turned[q]) ** 2
                inside = [apart[:, c:d].sum(axis=1) <= share for (c, d), share in zip(spans, budgets, strict=True)]
                here = inside[block] & ~np.any(inside[:block], axis=0) if block else inside[block]
                p, q = p[here], q[here]
                close = np.einsum("ij,ij->i", x[p], x[q]) / (norms[p] * norms[q]) >= least_cosine
                if close.any():
                    yield p[close], q[close]


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position of each position's component, root without links i, j as root with them."""
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


_BLOCK = ["label", "dim", "block"]


def _placed(nodes: DataFrame, chunk_rows: int) -> DataFrame:
    """Rows (label, dim, block, node, c, chunk): every node once in every block, with its cells there.

    Nodes of a block follow each other by the cells of its first coordinates, and within a cell by a hash; each chunk is the
    next chunk_rows or so of them. A cell of many nodes is many chunks, small cells share one.
    """
    rows = nodes.select("label", "dim", "node", F.posexplode("cells").alias("block", "c")).withColumn("cell", F.slice("c", 1, CELL_DIMS))
    sizes = rows.groupBy(*_BLOCK, "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(*_BLOCK).orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    starts = staged(sizes.withColumn("start", before), "cells", release=True)
    place = F.col("start") + F.pmod(F.xxhash64("node"), F.col("n"))
    return staged(rows.join(starts, [*_BLOCK, "cell"]).select(*_BLOCK, "node", "c", F.floor(place / chunk_rows).cast("int").alias("chunk")), "places", release=True)


def _meetings(placed: DataFrame) -> DataFrame:
    """Rows (label, dim, block, i, j, n): pairs of chunks, i <= j, that can hold a pair within the block's share, and their rows.

    A cell is as wide as the share's root: where boxes are g cells apart in a coordinate, vectors are more than g - 1 widths apart.
    """
    at = lambda k: F.try_element_at("c", F.lit(k + 1))
    box = [f(at(k)).alias(f"{name}{k}") for k in range(BLOCK_DIMS) for name, f in (("low", F.min), ("high", F.max))]
    corner = lambda name: F.array(*[F.coalesce(f"{name}{k}", F.lit(0)) for k in range(BLOCK_DIMS)]).alias(name)
    boxes = staged(placed.groupBy(*_BLOCK, "chunk").agg(F.count("*").alias("n"), *box).select(*_BLOCK, "chunk", "n", corner("low"), corner("high")), "boxes", release=True)
    named = lambda x: boxes.select(*_BLOCK, *[F.col(c).alias(f"{c}_{x}") for c in ("chunk", "n", "low", "high")])
    gaps = F.zip_with(F.zip_with("low_j", "high_i", lambda x, y: x - y), F.zip_with("low_i", "high_j", lambda x, y: x - y), lambda x, y: F.greatest(x - 1, y - 1, F.lit(0)))
    near = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g.cast("long") * g) <= 1
    pairs = named("i").join(named("j"), _BLOCK).where((F.col("chunk_i") <= F.col("chunk_j")) & near)
    both = F.col("n_i") + F.when(F.col("chunk_i") < F.col("chunk_j"), F.col("n_j")).otherwise(0)
    return staged(pairs.select(*_BLOCK, F.col("chunk_i").alias("i"), F.col("chunk_j").alias("j"), both.alias("n")).where("n > 1"), "meetings", release=True)


def embedding_near_duplicates(vectors: DataFrame, least_cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per vector: its id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their lengths equal and their cosine (double
    precision) is at least least_cosine. Null, empty and zero vectors and those with null or non-finite
    components have no links and are their own component. Equal vectors of a label count as one node and are
    never paired out. Rows stay rows: a repeated id counts as another vector. A row without an id takes part,
    lends no id to its component, and is not kept.

    Unit vectors are rotated and split into blocks; of a pair within the squared distance d2 at least one block
    lies within its share of d2. Per block, nodes are ordered by cells and cut into chunks (see _placed); two chunks whose boxes
    lie within the share are a task of bounded size. Tasks run in rounds: what a round sends is ROUND_COPIES times the vectors
    or so and is removed before the next. A task returns link counts and a forest of its links, a row or two per vector, not
    the pairs.
    """
    vec = F.col(vec_col)
    good = F.col(label_col).isNotNull() & usable(vec) & (F.size(vec) > 0) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))
    signature = F.concat(F.hex(F.xxhash64(F.col(label_col), vec)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), F.col(label_col), vec)))
    own = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vec.alias("vec"), F.when(good, signature).alias("sig"), F.monotonically_increasing_id().alias("row"))
    own = staged(own, "vectors", release=True)
    node = own.where("sig is not null").groupBy("sig").agg(F.min("row").alias("node"), F.min("id").alias("least_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    least = float(least_cosine)
    kind = np.float32 if own.schema["vec"].dataType.elementType.typeName() == "float" else np.float64

    def turn(batches):
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist(), int)
            out = [None] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                raw = rows_of(batch.column("vec").take(pa.array(at)))
                x = scaled(raw.astype(np.float64))
                inverse = inverse_norms(x)
                cells = zip(*[c.tolist() for c in cells_of(turned_of(x, inverse), least)], strict=True)
                for i, r, n, c in zip(at, binary_of(raw.astype(kind)).to_pylist(), inverse.tolist(), cells, strict=True):
                    out[i] = (r, n, list(c))
            columns = [pa.array([o[c] for o in out], t) for c, t in enumerate((pa.binary(), pa.float64(), pa.list_(pa.list_(pa.int32()))))]
            names = ["sig", "label", "node", "least_id", "copies", "dim"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + columns, names=[*names, "raw", "inverse", "cells"])

    label_type, id_type = own.schema["label"].dataType.simpleString(), own.schema["id"].dataType.simpleString()
    ddl = f"sig string, label {label_type}, node long, least_id {id_type}, copies long, dim int, raw binary, inverse double, cells array<array<int>>"
    nodes = staged(node.withColumn("dim", F.size("vec")).mapInArrow(turn, ddl), "nodes", release=True)
    placed = _placed(nodes, chunk_rows)
    meetings = _meetings(placed)

    def kernel(group: pa.Table) -> pa.Table:
        x = scaled(matrix_of(group["raw"], kind).astype(np.float64))
        turned = turned_of(x, group["inverse"].to_numpy())
        chunk, ids, copies = (group[c].to_numpy() for c in ("chunk", "node", "copies"))
        block, i, j = (group[c][0].as_py() for c in ("block", "i", "j"))
        left = np.flatnonzero(chunk == i)
        right = left if i == j else np.flatnonzero(chunk == j)
        links, root, held = np.zeros(len(ids), np.int64), np.arange(len(ids)), []

        def count() -> np.ndarray:
            u, v = (np.concatenate(c) for c in zip(*held, strict=True))
            np.add.at(links, u, copies[v])
            np.add.at(links, v, copies[u])
            held.clear()
            return joined(root, u, v)

        for pair in linked_pairs(x, turned, left, right, block, least):
            held.append(pair)
            if sum(len(h[0]) for h in held) >= HELD_LINKS:
                root = count()
        root = count() if held else root
        some, child = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"node": np.concatenate((ids[some], ids[child])), "links": np.concatenate((links[some], np.zeros(len(child), np.int64))), "to": pa.array(np.concatenate((np.full(len(some), -1), ids[root[child]])), pa.int64())})

    sent = meetings.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    rounds = max(1, -(-sent // (ROUND_COPIES * max(1, nodes.count()))))
    meetings = meetings.withColumn("round", F.pmod(F.xxhash64(*_BLOCK, "i", "j"), F.lit(rounds)))
    met = None
    for k in range(rounds):
        sides = F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk")
        dealt = placed.drop("c").join(meetings.where(F.col("round") == k).select(*_BLOCK, "i", "j", sides), [*_BLOCK, "chunk"])
        dealt = dealt.join(nodes.select("node", "copies", "raw", "inverse"), "node")
        part = staged(dealt.groupBy(*_BLOCK, "i", "j").applyInArrow(kernel, "node long, links long, to long"), "links", release=True)
        met = part if met is None else met.unionByName(part)
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(met.where("to >= 0"), "node", "to")
    known = nodes.select("sig", "node", "least_id", "copies").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = known.join(named, "root").select("sig", "component_id", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    known = staged(known, "vector-classes", release=True)
    linked = join_by_hot_key(own.where("sig is not null").select("id", "sig"), known, "sig").select("id", "n_links", "component_id")
    alone = own.where("sig is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
