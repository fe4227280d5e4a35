"""Exact top-k search by multi-resolution segment statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import staged
from millrace.llm.vectors import binary_of, matrix_of, rows_of, usable

#: Segments of the turned vector at each resolution, coarse to fine. Blocks are told apart by the first of them.
LEVELS = (8, 16, 32)
#: Vectors, about, from which the axes and the cells are learned. They order the work and change no result.
SAMPLE_ROWS = 8192
#: Bytes of a block's vectors.
BLOCK_BYTES = 1 << 21
#: Block summaries that meet as one group.
SUMMARIES = 512


def edges_of(dim: int, segments: int) -> list[int]:
    """Where segments begin and end: short ones first, where principal axes gather the energy."""
    return sorted({round(dim * (j / segments) ** 2) for j in range(segments + 1)} | {0, dim})


def segment_stats(rows: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of its length, side by side.

    For two vectors the sum over segments of length * ((mean - mean')^2 + (dev - dev')^2) is at most their
    squared distance; so length * (mean * mean' + dev * dev'), the dot product of these rows, is at least their
    inner product.
    """
    edges = edges_of(rows.shape[1], segments)
    parts = [rows[:, a:b] for a, b in zip(edges, edges[1:], strict=False)]
    means = [p.mean(axis=1) * np.sqrt(p.shape[1]) for p in parts]
    devs = [p.std(axis=1) * np.sqrt(p.shape[1]) for p in parts]
    return np.stack(means + devs, axis=1)


def survivors(stats: list[np.ndarray], wanted: list[np.ndarray], floor: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(rows left, which of the queries each is left for, pairs left after each level).

    Squared distance is |q|^2 + |x|^2 - 2 q.x, so that a lower bound of distance is an upper bound of score.
    """
    at, left = np.arange(len(stats[0])), []
    alive = np.ones((len(at), len(floor)), bool)
    for of_rows, of_queries in zip(stats, wanted, strict=True):
        alive &= of_rows[at] @ of_queries.T >= floor - slack
        some = alive.any(axis=1)
        at, alive = at[some], alive[some]
        left.append(int(alive.sum()))
    return at, alive, left


def near_floor(x: np.ndarray, of: np.ndarray, asks: np.ndarray, coarse: np.ndarray, k: int) -> np.ndarray:
    """For each query row the k-th best exact score among the rows whose coarsest statistics are the most like its own; -inf
    where there are fewer than k others. Any k rows would do as a floor; near ones give a high one."""
    few = min(len(of), 4 * k + 1)
    bounds = coarse[of] @ coarse[asks].T
    pick = np.argpartition(-bounds, few - 1, axis=0)[:few].T if few < len(of) else np.tile(np.arange(len(of)), (len(asks), 1))
    scores = np.einsum("qfd,qd->qf", x[of[pick]], x[asks])
    scores[of[pick] == asks[:, None]] = -np.inf
    return np.sort(scores, axis=1)[:, -k] if few >= k else np.full(len(asks), -np.inf)


def block_best(x: np.ndarray, stats: list[np.ndarray], norms: np.ndarray, ids: np.ndarray, rows: np.ndarray, of: np.ndarray, asks: np.ndarray, floor: np.ndarray, k: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], list[int]]:
    """(query, its best rows of a block, their scores) for the queries that any row can reach the floor of, and how many pairs
    of query and row were left after each level: only those are scored. A query's own row is none of its candidates."""
    left, alive, seen = survivors([s[of] for s in stats], [s[asks] for s in stats], floor, 1e-7 * norms[of].max(initial=0) * norms[asks])
    of, found = of[left], []
    scores = np.where(alive, x[of] @ x[asks].T, -np.inf)
    scores[(scores < floor) | (of[:, None] == asks)] = -np.inf
    for i in np.flatnonzero((scores > -np.inf).any(axis=0)):
        best = best_of(scores[:, i], ids[of], rows[of], k)
        found.append((i, of[best], scores[best, i]))
    return found, seen


def best_of(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of a query's k best rows: by score, ties by id, then by row. Rows of score -inf don't count."""
    at = np.flatnonzero(scores > -np.inf)
    if at.size > k:
        at = at[scores[at] >= np.partition(scores[at], at.size - k)[at.size - k]]
    return at[np.lexsort((rows[at], ids[at], -scores[at]))[:k]]


class Space:
    """Principal axes of a sample of vectors of one length, and cells of about equal size along the first of them."""

    def __init__(self, sample: np.ndarray, cells: int):
        moments = sample.T @ sample / max(1, len(sample))
        self.axes = np.linalg.eigh(moments)[1][:, ::-1]
        self.splits: list[np.ndarray] = []  # of each depth: (axis, value) of each node
        turned = sample @ self.axes
        groups = [turned]
        for _ in range(max(0, int(cells) - 1).bit_length()):
            axis = [int(g[:, :8].var(axis=0).argmax()) if len(g) else 0 for g in groups]
            value = [float(np.median(g[:, a])) if len(g) else 0.0 for g, a in zip(groups, axis, strict=True)]
            self.splits.append(np.array([axis, value]))
            groups = [part for g, a, v in zip(groups, axis, value, strict=True) for part in (g[g[:, a] < v], g[g[:, a] >= v])]

    def cell(self, turned: np.ndarray) -> np.ndarray:
        node = np.zeros(len(turned), np.int64)
        for split in self.splits:
            value = turned[np.arange(len(turned)), split[0].astype(int)[node]]
            node = 2 * node + (value >= split[1][node])
        return node


def spaces_of(part: DataFrame, n: int, block_rows: int) -> dict[int, Space]:
    """A Space for each length of vector that a sample of bounded size holds."""
    share = max(1, n // SAMPLE_ROWS)
    held = part.where(F.pmod(F.xxhash64("row", F.lit(3)), F.lit(share)) == 0).select("dim", "v").limit(2 * SAMPLE_ROWS).collect()
    by_dim: dict[int, list] = {}
    for r in held:
        by_dim.setdefault(r["dim"], []).append(r["v"])
    return {dim: Space(np.array(rows), min(-(-n // block_rows), max(1, len(rows) // 8))) for dim, rows in by_dim.items()}


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, levels: tuple[int, ...] = LEVELS, query_rows: int = 1024, block_rows: int | None = None, tally: list[Accumulator] | None = None) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query row's k highest integer inner products among all other rows.

    Components become floor(scale * x), x as double; scores are exact while they stay below 2^53. Ties go to the
    smaller id; a query with fewer candidates gets all. Vectors that are null or empty or hold null or non-finite
    components, and rows without an id, take no part; vectors meet only others of equal length. A row is a query or a
    candidate by itself: of repeated ids each query row gets its own ranks, and the others of its id are candidates.
    An empty table gives no rows.

    Vectors are turned to principal axes, which leaves inner products as they are, and fall into blocks of neighbours, a
    block about block_rows (BLOCK_BYTES of vectors if not given). Each query first meets its own block: the k-th score among a
    few rows of like statistics is a floor, which the block's rows are bounded against; the k-th of what is left and scored is
    the floor elsewhere. Of other blocks only those are shipped whose summary (the ranges of the coarsest statistics) allows a score above the floor of a
    block of about query_rows neighbouring queries, and there bounds from coarse to fine leave the rows that are
    scored. k rows a query and block are ranked. Where vectors have no structure, bounds leave almost all rows. tally:
    accumulators that get the pairs of query and row that met, and those left after each level (tasks that run again count
    again).
    """
    as_ints = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    part = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vec_col)))
    part = part.select(F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("dim"), as_ints.alias("v"), is_query.alias("q"), F.monotonically_increasing_id().alias("row")).where("dim > 0")
    part = staged(part, "topk")
    n, n_queries = part.agg(F.count("*"), F.count_if(F.col("q"))).first()
    longest = part.agg(F.max("dim")).first()[0] or 1
    block_rows = block_rows or max(64, BLOCK_BYTES // (8 * longest))
    spaces = spaces_of(part, n, block_rows)
    per_block = max(1, round(query_rows * n / max(1, n_queries) / block_rows))  # blocks whose queries go together

    def place(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            raw, cells = np.full(len(dims), None, object), np.zeros(len(dims), np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = rows_of(batch.column("v").take(pa.array(at)))
                raw[at] = binary_of(x).to_pylist()
                if int(dim) in spaces:
                    cells[at] = spaces[int(dim)].cell(x @ spaces[int(dim)].axes)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "row", "q", "dim")] + [pa.array(cells), pa.array(raw.tolist(), pa.binary())], names=["id", "row", "q", "dim", "cell", "v"])

    placed = staged(part.mapInArrow(place, "id long, row long, q boolean, dim int, cell long, v binary"), "topk-cells")
    counts = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(block_rows)).alias("chunks"))
    chunk = F.pmod(F.xxhash64("row"), F.col("chunks"))
    asked = (F.col("cell") / F.lit(per_block)).cast("long")  # neighbouring cells' queries; a hot cell's by chunks
    part_of = F.concat_ws("-", asked.cast("string"), F.floor(chunk / F.lit(per_block)).cast("string"))
    blocks = placed.join(counts, ["dim", "cell"]).select("id", "row", "q", "dim", F.concat_ws("-", "cell", chunk).alias("block"), part_of.alias("qblock"), "v")
    blocks = staged(blocks, "topk-blocks")

    def measured(group: pa.Table):
        dim = group["dim"][0].as_py()
        x = matrix_of(group["v"], np.float64)
        turned = x @ spaces[dim].axes if dim in spaces else x
        return x, [segment_stats(turned, s) for s in levels], np.sqrt((x * x).sum(axis=1))

    def noted(met: int, seen: list[int]) -> None:
        for total, n in zip(tally or (), [met, *seen], strict=False):
            total.add(n)

    def home(group: pa.Table) -> pa.Table:
        """A row per query: its best rows here and its floor. And one for the block: ranges of its statistics, and its queries'."""
        x, stats, norms = measured(group)
        ids, rows, asks = group["id"].to_numpy(), group["row"].to_numpy(), np.flatnonzero(group["q"].to_numpy(zero_copy_only=False))
        out = []
        head = {c: group[c][0].as_py() for c in ("dim", "block", "qblock")}
        every = np.arange(len(x))
        for at in range(0, len(asks), 256):
            some = asks[at : at + 256]
            found, seen = block_best(x, stats, norms, ids, rows, every, some, near_floor(x, every, some, stats[0], k), k)
            noted(len(x) * len(some), seen)
            best = {i: (b, s) for i, b, s in found}
            for i, q in enumerate(some.tolist()):
                b, s = best.get(i, (every[:0], np.zeros(0)))
                out.append(head | {"row": rows[q], "id": ids[q], "floor": s[-1] if len(b) == k else -np.inf, "norm": norms[q], "ids": ids[b], "rows": rows[b], "scores": s})
        box = {"lo": stats[0].min(axis=0), "hi": stats[0].max(axis=0), "norm": norms.max()}
        if len(asks):
            of = stats[0][asks]
            box |= {"qlo": of.min(axis=0), "qhi": of.max(axis=0), "qnorm": norms[asks].max(), "floor": min(o["floor"] for o in out)}
        return pa.Table.from_pylist([*out, head | box], schema=_HOME)

    met = staged(blocks.groupBy("dim", "block").applyInArrow(home, _HOME_DDL), "topk-home")
    boxes = met.where("row is null")
    groups = max(1, -(-boxes.count() // SUMMARIES))
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    by_row = boxes.select("dim", "block", "lo", "hi", "norm", F.lit(None).cast("double").alias("floor"), spot("block").alias("i"), every.alias("j"))
    asking = boxes.where("qlo is not null").select("dim", F.col("qblock").alias("block"), F.col("qlo").alias("lo"), F.col("qhi").alias("hi"), F.col("qnorm").alias("norm"), "floor", spot("qblock").alias("j"))
    asking = asking.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(by_row.columns)

    def meet(group: pa.Table) -> pa.Table:
        """Pairs (qblock, block) of which a score can be above the lowest floor of the queries."""
        asks = ~group["floor"].is_null().to_numpy()
        lo, hi = (np.array(group[c].to_pylist()) for c in ("lo", "hi"))
        names, norm, floor = np.array(group["block"].to_pylist(), object), group["norm"].to_numpy(), group["floor"].to_numpy()
        of, found = np.flatnonzero(~asks), set()
        for q in np.flatnonzero(asks) if len(of) else []:
            corners = np.maximum(np.maximum(lo[of] * lo[q], lo[of] * hi[q]), np.maximum(hi[of] * lo[q], hi[of] * hi[q]))
            found |= {(names[q], b) for b in names[of[corners.sum(axis=1) >= floor[q] - 1e-7 * norm[of] * norm[q]]]}
        pairs = sorted(found)
        return pa.table({"dim": pa.array([group["dim"][0].as_py()] * len(pairs), pa.int32()), "qblock": pa.array([p[0] for p in pairs], pa.string()), "block": pa.array([p[1] for p in pairs], pa.string())})

    pairs = by_row.unionByName(asking).groupBy("dim", "i", "j").applyInArrow(meet, "dim int, qblock string, block string")
    pairs = staged(pairs.distinct(), "topk-pairs")
    none = F.lit(None).cast("double")
    rows = blocks.join(pairs.withColumnRenamed("qblock", "for"), ["dim", "block"]).select("id", "row", "dim", "v", "block", F.col("for").alias("qblock"), none.alias("floor"), F.lit("").alias("home"))
    queries = blocks.where("q").join(met.where("row is not null").select("row", "floor"), "row").select("id", "row", "dim", "v", "block", "qblock", "floor")
    queries = queries.withColumnRenamed("block", "home").join(pairs, ["dim", "qblock"]).select(rows.columns)

    def kernel(group: pa.Table) -> pa.Table:
        asks = ~group["floor"].is_null().to_numpy()
        x, stats, norms = measured(group)
        ids, rows = group["id"].to_numpy(), group["row"].to_numpy()
        here = group["block"][0].as_py()
        away = np.array([h != here for h in group["home"].to_pylist()]) & asks  # queries at home in this block have met it
        of, found = np.flatnonzero(~asks), []
        for at in range(0, int(away.sum()) if len(of) else 0, query_rows):
            q = np.flatnonzero(away)[at : at + query_rows]
            best, seen = block_best(x, stats, norms, ids, rows, of, q, group["floor"].to_numpy()[q], k)
            noted(len(of) * len(q), seen)
            found += [(np.full(b.size, rows[q[i]]), np.full(b.size, ids[q[i]]), ids[b], rows[b], s.astype(np.int64)) for i, b, s in best]
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_row", "query_id", "vec_id", "row", "score"])

    near = rows.unionByName(queries).groupBy("dim", "qblock", "block").applyInArrow(kernel, "query_row long, query_id long, vec_id long, row long, score long")
    homely = met.where("row is not null").select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.explode(F.arrays_zip("ids", "rows", "scores")).alias("x"))
    homely = homely.select("query_row", "query_id", F.col("x.ids").alias("vec_id"), F.col("x.rows").alias("row"), F.col("x.scores").cast("long").alias("score"))
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = near.unionByName(homely).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


_DOUBLES, _LONGS = pa.list_(pa.float64()), pa.list_(pa.int64())
_HOME = pa.schema([
    ("dim", pa.int32()), ("block", pa.string()), ("qblock", pa.string()), ("row", pa.int64()), ("id", pa.int64()), ("floor", pa.float64()), ("norm", pa.float64()), ("ids", _LONGS), ("rows", _LONGS), ("scores", _DOUBLES),
    ("lo", _DOUBLES), ("hi", _DOUBLES), ("qlo", _DOUBLES), ("qhi", _DOUBLES), ("qnorm", pa.float64()),
])
_HOME_DDL = "dim int, block string, qblock string, row long, id long, floor double, norm double, ids array<long>, rows array<long>, scores array<double>, lo array<double>, hi array<double>, qlo array<double>, qhi array<double>, qnorm double"
