"""Near copies by similarity against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import similarity
from millrace.llm.similarity import keep_dissimilar, shingle_set


def kept_by_all_pairs(data, width=5, least=0.8):
    sets = [frozenset(shingle_set(t, width).tolist()) for _, t in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            both, every = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both >= least * every - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(min(data[i][0] for i in range(len(data)) if find(i) == r) for r in {find(i) for i in range(len(data))})


def near_copies(seed=1):
    """Texts of 1 to 200 words, their copies with 0 to 15 words changed, and a line that many of them share."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    line = [rng.choice(words) for _ in range(30)]
    data = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice((1, 4, 5, 40, 120, 200)))] + line * rng.randint(0, 1)
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 2, 3, 5, 15))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            data.append((len(data), " ".join(copy)))
    return data + [(900, ""), (901, "  "), (902, None)]


@pytest.mark.parametrize("chunk", [2048, 8])
def test_all_similar_pairs_count(spark, monkeypatch, chunk):
    monkeypatch.setattr(similarity, "CHUNK_NODES", chunk)
    data = near_copies()
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_dissimilar(docs).collect()) == kept_by_all_pairs(data)


def test_stage_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == kept_by_all_pairs(data)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c", 1), (None, "a b c", 2), (3, "x y", 3)], "doc_id long, text string, n int")
    assert keep_dissimilar(docs).count() == 2 and keep_dissimilar(docs.unionByName(docs)).count() == 2
    assert keep_dissimilar(docs.limit(0)).count() == 0


@pytest.mark.parametrize("places", [2, 3])
def test_similar_sets_meet_in_the_index_of_fingerprints(places):
    rng = np.random.default_rng(4)
    one, other = [], []
    for n in [4] * 100 + [9] * 100 + [40] * 100 + [400] * 100:  # similarity 0.8, or the least above it
        x = rng.integers(0, 2**63, n + n // 4, dtype=np.uint64)
        one.append(similarity.bit_sums(x)), other.append(similarity.bit_sums(x[:n]))
    keys = [similarity.index_keys(similarity.most_decided(np.array(sums), similarity.GROUPS[places] * (places + 1)), places) for sums in (one, other)]
    assert (keys[0] == keys[1]).any(axis=1).all()
    assert (keys[0] == np.roll(keys[1], 1, axis=0)).sum() <= 2  # unrelated ones, 400 pairs
    assert all(len(set(k)) == len(k) for k in keys[0].tolist())


def test_places_grow_with_the_table():
    assert [similarity.places_of(n) for n in (0, 1, 1 << 22, (1 << 22) + 1, 1 << 40)] == [2, 2, 2, 3, 3]


def test_sums_are_the_same_in_both_types():
    rng = np.random.default_rng(5)
    sums = np.array([similarity.bit_sums(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (0, 1, 50, 500)])
    large = np.full((1, 64 * similarity.SUMS), 1 << 20)
    assert (similarity.most_decided(sums, 12) == similarity.most_decided(np.concatenate([sums, large]), 12)[:-1]).all()


def one_group(n, most, seed=7):
    """So many texts of 150 words, of which up to most are changed from one text."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    base, data = [rng.choice(words) for _ in range(150)], []
    for i in range(n):
        copy = list(base)
        for at in rng.sample(range(150), 1 + i % most):
            copy[at] = rng.choice(words)
        data.append((i, " ".join(copy)))
    return data


@pytest.mark.parametrize("chunk", [2048, 32])
def test_rows_grow_with_a_group_not_with_its_square(spark, monkeypatch, chunk):
    monkeypatch.setattr(similarity, "CHUNK_NODES", chunk)
    counts, plain = [], similarity.staged

    def counted(df, name):
        held = plain(df, name)
        counts[-1][name.partition("-groups")[2]] = held.count() if name.startswith(("similar-groups", "similar-pairs")) else 0
        return held

    monkeypatch.setattr(similarity, "staged", counted)
    for n in (30, 120):
        counts.append({})
        assert keep_dissimilar(spark.createDataFrame(one_group(n, 2), "doc_id long, text string")).count() == 1
    few, many = (sum(c.values()) for c in counts)
    assert few and many <= 6 * few, counts


@pytest.mark.parametrize("chunk", [2048, 8])
def test_a_group_of_which_only_some_are_linked(spark, monkeypatch, chunk):
    monkeypatch.setattr(similarity, "CHUNK_NODES", chunk)
    named, plain = [], similarity.staged
    monkeypatch.setattr(similarity, "staged", lambda df, name: named.append((name, plain(df, name))) or named[-1][1])
    data = one_group(160, 12)
    kept = sorted(r.doc_id for r in keep_dissimilar(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert kept == kept_by_all_pairs(data) and 1 < len(kept) < 160
    across = dict(named).get("similar-groups-across")
    assert across is None if chunk == 2048 else across.count() > 0


def test_groups_are_whole_whatever_the_batches():
    import pyarrow as pa

    t = pa.table({"a": [1, 1, 1, 2, 3, 3, 3, 3, 3, 4], "b": [0, 0, 1, 1, 1, 1, 1, 1, 1, 1], "c": list(range(10))})
    for size in range(1, 11):
        got = [x.to_pylist() for x in similarity._groups(2)(iter(t.to_batches(size)))]
        assert sum(got, []) == t.to_pylist()
        assert all((x[-1]["a"], x[-1]["b"]) != (y[0]["a"], y[0]["b"]) for x, y in zip(got, got[1:]))
