"""Operator 12: shares, distances and ranks against plain arithmetic; copies, hot sources and odd tables."""

import random
import re
from collections import Counter, defaultdict

import pytest

from millrace.llm import divergence
from millrace.llm.divergence import collapsed, source_divergence, terms_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=3, smoothing=5, scale=1_000_000_000, terms=50):
    """docs: (lang, source, text)."""
    docs = [tuple(x or "" for x in d) for d in docs]
    out = []
    for lang in {d[0] for d in docs}:
        cut = [(s, TERM.findall(t.translate(UPPER))) for g, s, t in docs if g == lang]
        df = Counter(t for _, ts in cut for t in set(ts))
        kept = [t for t, n in df.items() if n >= least]
        counts = defaultdict(Counter)
        for s, ts in cut:
            counts[s].update(t for t in ts if df[t] >= least)
        share = lambda c: {t: 1 + scale * (c[t] + smoothing) // (sum(c.values()) + smoothing * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            found = {"pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s], "term": [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]}
            for part, rows in found.items():
                ranked = sorted(rows, key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked[: terms if part == "term" else None], 1)]
    return sorted(out)


def made(seed, n, sources=7, langs=("en", "de", None)):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "ünit", "Ünit", "日本", "x", "Don", "t", "zéro", *(f"w{chr(97 + i)}" for i in range(20))]
    docs = []
    for _ in range(n):
        source = rng.choice([None, "hot", "hot", "hot", *(f"s{i}" for i in range(sources))])
        docs.append((rng.choice(langs), source, " ".join(rng.choice(words[: rng.randint(3, len(words))]) + rng.choice(["", ",", "1"]) for _ in range(rng.randint(0, 12)))))
    docs += [("en", rng.choice(["hot", "s1", "s2"]), "the common copy of it all") for _ in range(n // 3)]
    return docs + [("en", "bare", None), ("en", "digits", "12 34"), ("solo", "alone", "one one"), ("none", "a", "rare"), ("none", "b", "words")]


def run(spark, docs, **kw):
    df = spark.createDataFrame([(i, *d, "x", 1) for i, d in enumerate(docs)], "doc_id long, lang string, source string, text string, term string, n int").repartition(4)
    return sorted(tuple(r) for r in source_divergence(df, **{"least_documents": 3} | kw).collect())


@pytest.mark.parametrize("seed", range(2))
def test_against_plain_arithmetic(spark, seed):
    docs = made(seed, 300)
    assert run(spark, docs) == brute(docs)


def test_small_memory_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "PAIRS_HELD", 2)
    docs = made(5, 200)
    assert run(spark, docs, terms=3, smoothing=1, scale=997) == brute(docs, terms=3, smoothing=1, scale=997)


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = "Äpfel and oranges, " * 30 + "x" * 100 + "日本語 y"
    assert [t.decode() for part in terms_of(text.encode()) for t in part] == TERM.findall(text.translate(UPPER))


def test_large_counts_are_exact(spark):
    docs = [("en", "a", "x " * 200_000 + "y"), ("en", "b", "x y z"), ("en", "b", "z z"), ("en", None, "x")]
    assert run(spark, docs, least_documents=1, scale=10**9) == brute(docs, least=1)


def test_equal_texts_are_one_row(spark):
    df = spark.createDataFrame([("en", "a", "t"), ("en", "a", "t"), ("en", "b", "t"), ("de", "a", "t"), (None, None, None)], "lang string, source string, text string")
    got = sorted((r.lang, bytes(r.text).decode(), sorted(map(tuple, r.copies))) for r in collapsed(df, "lang", "source", "text").collect())
    assert got == [("", "", [("", 1)]), ("de", "t", [("a", 1)]), ("en", "t", [("a", 2), ("b", 1)])]


def test_empty_and_repeated(spark):
    assert run(spark, []) == []
    docs = [("en", "a", "t u"), ("en", "b", "u v")]
    assert run(spark, docs * 5) == brute(docs * 5)
