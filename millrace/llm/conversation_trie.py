"""The prefix trie of conversations: a node for each different sequence of first turns, with what hangs below it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import staged, word_count

#: Turns of a conversation that a matrix holds at once; members of a node whose ids are joined to one row.
BAND, JOINED = 64, 4096
#: Bytes of a turn's id: a SHA-256 digest of its role and text, cut.
ID_BYTES = 16
NOTHING = hashlib.sha256(b"").hexdigest()
_NODE = "key string, parent_key string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_rows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, ids (array of binary) and words (array of long) of its turns in order.

    Turns are in the order of turn, null first, ties by their ids. Null roles and texts are empty. Rows without a conversation
    are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    slim = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("t"), F.substring(digest, 1, ID_BYTES).alias("id"), word_count(text).alias("words")).alias("x"))
    held = slim.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return held.select("conv_id", F.col("x.id").alias("ids"), F.col("x.words").alias("words"))


def with_shared_heads(convs: DataFrame, stride: int = 20, heads: int = 4) -> DataFrame:
    """Conversations c whose first h turns are those of conversation c - c % stride, h being crc32(decimal c) % heads: fewer if
    it has fewer, none if there is no such one. At most stride conversations share a head."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    head = convs.select(F.col("conv_id").alias("base"), *(F.slice(c, 1, heads - 1).alias(f"head_{c}") for c in ("ids", "words")))
    own = convs.select("*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % stride).alias("base"))
    built = lambda c: F.concat(F.coalesce(F.slice(f"head_{c}", F.lit(1), F.col("h")), F.slice(c, 1, 0)), F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0))))
    return own.join(head, "base", "left").select("conv_id", *(built(c).alias(c) for c in ("ids", "words")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (path, conv_id) in order: (path, first, n, part), the decimal ids of so many members at a time."""
    path, ids = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": pa.array([path], pa.binary()), "first": [ids[0]], "n": [len(ids)], "part": [",".join(map(str, ids))]})

    for batch in batches:
        for p, c in zip(batch["path"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if ids and (p != path or len(ids) == JOINED):
                yield row()
                ids = []
            path = p
            ids.append(c)
    if ids:
        yield row()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of parts in order: (conv_id, n, ends), a row a path: its smallest member, their number, and the digest of all their ids."""
    path, first, n, state = None, 0, 0, None
    done: list[tuple[int, int, str]] = []

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "n", "ends"])
        done.clear()
        return out

    for batch in batches:
        for p, at, k, part in zip(*(batch[c].to_pylist() for c in ("path", "first", "n", "part")), strict=True):
            if p != path:
                if state:
                    done.append((first, n, state.hexdigest()))
                path, first, n, state = p, at, 0, hashlib.sha256()
            state.update(("," if n else "").encode() + part.encode())
            n += k
        yield rows()
    if state:
        done.append((first, n, state.hexdigest()))
        yield rows()


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """Each different sequence of turns once: conv_id (smallest member), ids, words, n (members), ends (the SHA-256 of the members'
    decimal ids in order, joined by commas).

    Members are sorted by ranges of sequence and id, so that a sequence with a third of all conversations is many tasks; only
    the digest, which is sequential, reads a sequence's joined ids as one stream.
    """
    convs = staged(convs, "conversations")
    path = F.unhex(F.sha2(F.concat(F.array_join(F.transform("ids", F.hex), "").cast("binary")), 256))
    parts = convs.select(path.alias("path"), "conv_id").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_joined, "path binary, first long, n long, part string")
    ends = parts.repartition("path").sortWithinPartitions("path", "first").mapInArrow(_digested, "conv_id long, n long, ends string")
    return convs.join(ends, "conv_id")


def ordered(turn: np.ndarray, lengths: np.ndarray, band: int = BAND) -> tuple[np.ndarray, np.ndarray]:
    """The order of different sequences of positive ints (flat, one after the other), and how many first turns each shares
    with the one before it in that order.

    Padded matrices of so many columns at a time: rows that are still equal after one matrix go on in the next. lexsort orders
    a matrix within groups of equal rows; the change of each column against the row above, OR-accumulated, marks where the
    two part.
    """
    n = len(lengths)
    starts = np.cumsum(lengths) - lengths
    order, group, shared = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    at, places = 0, np.arange(n)
    while len(places):
        rows = order[places]
        column = at + np.arange(band)
        inside = column < lengths[rows, None]
        matrix = np.where(inside, turn[np.minimum(starts[rows, None] + column, len(turn) - 1)] if len(turn) else 0, 0)
        by = np.lexsort((*matrix.T[::-1], group[places]))
        order[places], matrix, rows = rows[by], matrix[by], rows[by]
        changed = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)
        together = group[places[1:]] == group[places[:-1]]
        common = np.minimum(at + (~changed).sum(axis=1), np.minimum(lengths[rows[1:]], lengths[rows[:-1]]))
        shared[places[1:][together]] = common[together]
        parted = ~together | changed[:, -1] if len(changed) else np.zeros(0, bool)
        group[places] = np.cumsum(np.r_[True, parted])
        at += band
        tied = np.r_[False, ~parted] | np.r_[~parted, False]
        places = places[tied & (lengths[rows] >= at)]
    return order, shared


def shard_nodes(turn: np.ndarray, words: np.ndarray, lengths: np.ndarray, conv: np.ndarray, n: np.ndarray, before: int, after: int) -> dict[str, np.ndarray]:
    """The nodes of one range of different sequences, as columns. before and after: how many first turns the range's first
    and last sequences share with their neighbours in other ranges.

    Nodes that other ranges hold too have mark 1 (on the first sequence's way) or 2 (on the last one's), else 0: their figures are
    this range's part, and add up. parent_mark is their parent's. row is the place of a sequence of the node, end that of
    the one that ends there, or -1.
    """
    order, shared = ordered(turn, lengths)
    k = len(order)
    starts = np.cumsum(lengths) - lengths
    length, conv, n = lengths[order], conv[order], n[order]
    shared[0] = before
    follows = np.r_[shared[1:], after]
    split = np.maximum(shared, follows)  # nodes below this depth hold one sequence
    leaf = follows < length
    below = np.concatenate([np.append(words[s : s + m][::-1].cumsum()[::-1], 0) for s, m in zip(starts[order], length, strict=True)])  # words from a depth on
    first = np.cumsum(length + 1) - (length + 1)
    rest = lambda rows, depth: below[first[rows] + np.minimum(np.maximum(depth, 1) - 1, length[rows])]  # noqa: E731  words of turns depth, depth + 1, ...
    up, up_mark = np.full(k, -1, np.int64), np.zeros(k, np.int64)  # conv_id and mark of the node above
    out: list[dict[str, np.ndarray]] = []
    for depth in range(int(split.max()) + 1):
        rows = np.flatnonzero((split >= depth) & (length >= depth))
        heads = np.flatnonzero((shared[rows] < depth) | (rows == 0) | (np.diff(rows, prepend=-2) != 1))
        total = lambda x, heads=heads: np.add.reduceat(x, heads)
        head = rows[heads]
        tail = rows[np.r_[heads[1:], len(rows)] - 1]
        saved = n[rows] * rest(rows, depth) - rest(rows, np.maximum(depth, shared[rows] + 1))
        mark = np.where((tail == k - 1) & (after >= depth), 2, 0)
        mark = np.where((head == 0) & (before >= depth), 1, mark) if depth else np.full(len(head), 1)
        node = {
            "conv_id": np.minimum.reduceat(conv[rows], heads), "depth": np.full(len(head), depth), "parent": up[head], "mark": mark, "parent_mark": up_mark[head], "row": head,
            "n_convs": total(n[rows]), "n_children": total(((length[rows] > depth) & (shared[rows] <= depth)).astype(np.int64)), "n_leaves": total(leaf[rows].astype(np.int64)), "saved_tokens": total(saved),
            "end": np.where(length[head] == depth, head, -1),
        }
        out.append(node)
        sizes = np.diff(np.r_[heads, len(rows)])
        up[rows], up_mark[rows] = np.repeat(node["conv_id"], sizes), np.repeat(mark, sizes)
    each = length - split
    rows = np.repeat(np.arange(k), each)
    depth = np.arange(len(rows)) - np.repeat(np.cumsum(each) - each, each) + split[rows] + 1
    top, last, zero = depth == split[rows] + 1, depth == length[rows], np.zeros(len(rows), np.int64)
    out.append({
        "conv_id": conv[rows], "depth": depth, "parent": np.where(top, up[rows], conv[rows]), "mark": zero, "parent_mark": np.where(top, up_mark[rows], 0), "row": rows,
        "n_convs": n[rows], "n_children": 1 - last, "n_leaves": zero + 1, "saved_tokens": (n[rows] - 1) * rest(rows, depth), "end": np.where(last, rows, -1),
    })
    held = {c: np.concatenate([x[c] for x in out]) for c in out[0]}
    return held | {"row": order[held["row"]], "end": np.where(held["end"] < 0, -1, order[held["end"]]), "order": order}


def _keys(ids: list[bytes], most: int) -> list[str]:
    """Names of the nodes on a sequence's way, down to a depth."""
    state, out = hashlib.sha256(), ["0"]
    for depth, x in enumerate(ids[:most], 1):
        state.update(x)
        out.append(f"{depth}:{state.hexdigest()}")
    return out


def _shard(group: pa.Table) -> pa.Table:
    ids, words = (group[c].combine_chunks() for c in ("ids", "words"))
    lengths = np.array([len(x) for x in ids], np.int64)
    raw = np.frombuffer(b"".join(ids.flatten().to_pylist()), ">u8").reshape(-1, ID_BYTES // 8).astype(np.uint64)
    _, turn = np.unique(np.rec.fromarrays(list(raw.T)), return_inverse=True)
    conv, n = (group[c].to_numpy() for c in ("conv_id", "n"))
    before, after = group["before"][0].as_py(), group["after"][0].as_py()
    node = shard_nodes(turn.ravel() + 1, words.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lengths, conv, n, before, after)
    ways = {1: _keys(ids[int(node["order"][0])].as_py(), max(before, 0)), 2: _keys(ids[int(node["order"][-1])].as_py(), max(after, 0))}
    key = [ways[m][d] if m else None for m, d in zip(node["mark"].tolist(), node["depth"].tolist(), strict=True)]
    up = [ways[m][d - 1] if m else None for m, d in zip(node["parent_mark"].tolist(), node["depth"].tolist(), strict=True)]
    parent = pa.array(node["parent"], mask=np.array([u is not None or d == 0 for u, d in zip(up, node["depth"].tolist(), strict=True)]))
    ends = group["ends"].combine_chunks().take(pa.array(node["end"], mask=node["end"] < 0))
    figures = [pa.array(node[c].astype(np.int64)) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    return pa.Table.from_arrays([pa.array(key, pa.string()), pa.array(up, pa.string()), pa.array(node["conv_id"]), pa.array(node["depth"].astype(np.int64)), parent, *figures, ends], names=[c.split()[0] for c in _NODE.split(", ")])


def _alike(a: Column, b: Column) -> Column:
    """How many first elements two different arrays share."""
    return F.coalesce(F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False) - 1, F.size(a).cast("long"))


def prefix_trie(convs: DataFrame) -> DataFrame:
    """The nodes of conversations given as rows (conv_id, ids, words), see turn_rows(); conv_id is theirs alone.

    A node is a different sequence of first turns; members are the conversations that begin with it. Rows: conv_id (smallest
    member), depth, parent_conv_id (the parent's; null for the root), n_convs (members), n_children, n_leaves (nodes without
    children in its subtree, its top included), saved_tokens (over the subtree: members but one, times the words of the last
    turn), ends_sha256 (of the decimal ids of the members that end there, ascending, joined by commas).

    Equal conversations are one sequence with a count before they are sorted into ranges, so that neither a common
    conversation nor a common first turn makes a large range. Each range knows how many turns its ends share with its
    neighbours: what it counts, it counts once, and the nodes on those two ways are recombined by sums. A conversation is a
    row: its turns take some 24 bytes each in a task. An empty table gives no node; a table of conversations without turns
    the root.
    """
    rows = distinct_sequences(convs)
    rows = staged(rows.repartitionByRange("ids").withColumn("shard", F.spark_partition_id()), "sequences")
    order = Window.orderBy("shard")
    bounds = rows.groupBy("shard").agg(F.min("ids").alias("low"), F.max("ids").alias("high"))  # a row a partition
    meets = lambda a, b: F.coalesce(_alike(a, b), F.lit(-1).cast("long"))
    bounds = bounds.select("shard", F.when(F.lag("shard").over(order).isNull(), -1).otherwise(meets(F.lag("high").over(order), F.col("low"))).alias("before"), F.when(F.lead("shard").over(order).isNull(), -1).otherwise(meets(F.col("high"), F.lead("low").over(order))).alias("after"))
    parts = staged(rows.join(bounds, "shard").groupBy("shard").applyInArrow(_shard, _NODE), "nodes")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    both = parts.where("key is not null").groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), F.first("parent_key", ignorenulls=True).alias("parent_key"), F.max("parent_conv_id").alias("parent_conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    both = staged(both.select(*(c.split()[0] for c in _NODE.split(", "))), "boundary-nodes")
    known = both.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"))
    whole = parts.where("key is null")
    loose = whole.where("parent_key is not null").unionByName(both.where("parent_key is not null"))
    fixed = whole.where("parent_key is null").unionByName(both.where("parent_key is null"))
    loose = loose.join(known, "parent_key", "left").withColumn("parent_conv_id", F.col("up")).select(fixed.columns)
    nodes = fixed.unionByName(loose)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """prefix_trie() of a table of turns, as they are; other columns are left out."""
    return prefix_trie(turn_rows(turns, conv_col, turn_col, role_col, text_col))
