"""Operator 13: every node against a plain dictionary of prefixes; ranges, bands, hot sequences and odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import conversation_trie as trie
from millrace.llm.conversation_trie import conversation_trie, ordered, prefix_trie, turn_rows, with_shared_heads
from millrace.llm.queries import QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(convs):
    """The nodes of {conv_id: [(role, text), ...]}."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {p: [q for q in nodes if len(q) == len(p) + 1 and q[:-1] == p] for p in nodes} if len(nodes) < 400 else None
    if children is None:
        children = {p: [] for p in nodes}
        for q in nodes:
            if q:
                children[q[:-1]].append(q)
    below = {}
    for p in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[p]) - 1) * len(p[-1][1].split()) if p else 0
        below[p] = (sum(below[q][0] for q in children[p]) or 1, own + sum(below[q][1] for q in children[p]))
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children[p]), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def random_convs(seed, n, letters="ab", deepest=7):
    rng = random.Random(seed)
    hot = [("user", rng.choice(letters) * 2) for _ in range(deepest)]
    out = {}
    for c in rng.sample(range(3 * n), n):
        kind = rng.random()
        out[c] = hot if kind < 0.3 else [("user" if i % 2 else "system", " ".join(rng.choice(letters) for _ in range(rng.randint(0, 2)))) for i in range(rng.randint(0, deepest))]
        if 0.3 <= kind < 0.5:
            out[c] = hot[: rng.randint(0, deepest)] + out[c]
    return out


def turns_of(spark, convs):
    data = [(c, i, role, text, "x", 1) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    return spark.createDataFrame(data or [], "conv_id long, turn long, role string, text string, ids string, depth int").repartition(3)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("band", [1, 3, 64])
def test_order_and_shared_turns(band):
    rng = random.Random(band)
    for _ in range(200):
        rows = sorted({tuple(rng.randint(1, 2) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 30))})
        mixed = rng.sample(rows, len(rows))
        order, shared = ordered(np.array([x for r in mixed for x in r], np.int64), np.array([len(r) for r in mixed]), band)
        assert [mixed[i] for i in order] == rows
        alike = [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(rows, rows[1:], strict=False)]
        assert shared[1:].tolist() == alike


@pytest.mark.parametrize(("seed", "parts"), [(0, "7"), (1, "40")])
def test_nodes_over_many_ranges(spark, seed, parts, monkeypatch):
    monkeypatch.setattr(trie, "JOINED", 3)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    convs = random_convs(seed, 60)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        known = {c: t for c, t in convs.items() if t}
        if parts == "7":
            assert got(conversation_trie(turns_of(spark, known))) == brute(known)
        else:
            assert got(prefix_trie(with_shared_heads(turn_rows(turns_of(spark, known))))) == brute(rebuilt(known))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_ranges_meet_inside_one_conversation(spark):
    """Ranges of a sequence each: every node on the way is shared by all."""
    convs = {c: [("u", "w w")] * (c + 1) for c in range(6)} | {50: [("u", "w w")] * 3 + [("u", "z")]}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        assert got(conversation_trie(turns_of(spark, convs))) == brute(convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_conversations(spark):
    long = [("u", f"t{i % 7}") for i in range(700)]
    convs = {1: long, 2: long[:650], 3: long[:300] + [("u", "other")] + long, 4: [("u", "x" * 100_000)], 5: long}
    assert got(conversation_trie(turns_of(spark, convs))) == brute(convs)


def test_single_and_empty(spark):
    for convs in ({7: [("u", "a b"), ("u", "c")]}, {7: [("u", "a")], 8: [("u", "a")]}):
        assert got(conversation_trie(turns_of(spark, convs))) == brute(convs)
    assert got(conversation_trie(turns_of(spark, {}))) == []
    bare = spark.createDataFrame([(3, [], []), (4, [], [])], "conv_id long, ids array<binary>, words array<long>")
    assert got(prefix_trie(bare)) == brute({3: [], 4: []}) and got(prefix_trie(bare.limit(1))) == brute({3: []})


def test_nulls_ties_and_repeated_rows(spark):
    data = [(1, None, None, "first"), (1, 0, "u", None), (1, 0, "u", None), (1, 2, "u", "a"), (None, 0, "u", "lost"), (2, None, "", "first"), (2, 5, "u", ""), (2, 5, "u", "")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    convs = {1: [("", "first"), ("u", ""), ("u", ""), ("u", "a")], 2: [("", "first"), ("u", ""), ("u", "")]}
    assert got(conversation_trie(df)) == brute(convs)
    tied = spark.createDataFrame([(c, 0, "u", t) for c in (1, 2) for t in ("b", "a", "c")[:: 1 if c == 1 else -1]], df.schema)
    assert conversation_trie(tied).where("n_convs = 2").count() == 4  # in one order, whatever came first


def test_heads_that_are_absent_or_short(spark):
    convs = {c: [("u", f"{c}-{i}") for i in range(n)] for c, n in ((0, 1), (1, 2), (2, 5), (3, 1), (7, 3), (25, 4), (26, 1), (30, 2), (40, 9), (41, 1), (59, 3))}
    held = {r.conv_id: len(r.ids) for r in with_shared_heads(turn_rows(turns_of(spark, convs))).collect()}
    want = rebuilt(convs)
    assert held == {c: len(t) for c, t in want.items()} and 0 in held.values()
    assert got(prefix_trie(with_shared_heads(turn_rows(turns_of(spark, convs))))) == brute(want)


def test_query_on_its_table(spark):
    for sf in ("sf0.001", "sf0.01"):
        convs = {}
        for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").orderBy("conv_id", F.col("turn").asc_nulls_first()).collect():
            convs.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
        assert got(QUERIES["op13_conversation_trie"](spark, f"/root/testdata/{sf}")) == brute(rebuilt(convs))
