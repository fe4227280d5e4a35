"""Analyzers: every word and the best path against a plain search of the lattice; what the dictionary's own words give."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.functions.analysis import ByRuns, Dictionary, max_word, smart
from millrace.operators.retrieval import FIELDS, Field, multi_field_scores, query_terms, ranked


def cut(spark, texts, *analyzers):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", *[a(F.col("x")).alias(f"a{n}") for n, a in enumerate(analyzers)]).orderBy("i").collect()
    return [tuple(r)[1:] for r in rows]


def every_word(run, words):
    found = [(i, j) for i in range(len(run)) for j in range(i + 1, len(run) + 1) if run[i:j] in words]
    covered = {k for i, j in found for k in range(i, j)}
    return sorted([run[i:j] for i, j in found] + [run[k] for k in range(len(run)) if k not in covered])


def best_path(run, words):
    """All ways to cut a run, by brute force: most letters in words, fewest pieces, longest first."""
    best = None
    for bits in itertools.product((0, 1), repeat=len(run) - 1):
        cuts = [0, *[i + 1 for i, b in enumerate(bits) if b], len(run)]
        pieces = [run[a:b] for a, b in itertools.pairwise(cuts)]
        if all(len(p) == 1 or p in words for p in pieces):
            key = (sum(len(p) for p in pieces if p in words), -len(pieces), [len(p) for p in pieces])
            best = max(best, (key, pieces)) if best else (key, pieces)
    return best[1]


@pytest.mark.parametrize("seed", (0, 1, 3))
def test_lattice_against_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = "甲乙丙丁"[: 2 + seed % 3]
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1 if seed == 3 else 2, 4))) for _ in range(6)}
    held = Dictionary(tuple(words), ())
    runs = ["".join(rng.choice(letters + "戊") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    got = cut(spark, runs, lambda x: max_word(x, held), lambda x: smart(x, held))
    for run, (every, best) in zip(runs, got, strict=True):
        assert sorted(every) == every_word(run, words), run
        assert best == best_path(run, words), run


def test_own_dictionary(spark):
    texts = ["冒口如何保证热节补缩", "符合 GB/T 标准, xGB/T9, ht250 的浇注系统横浇道", None, "", "The cat's 3 mice", "浇不足和缩松"]
    every, best = zip(*cut(spark, texts, max_word, smart), strict=True)
    assert best[0] == ["冒口", "如", "何", "保", "证", "热节", "补缩"] and sorted(every[0]) == sorted(best[0])
    assert best[1] == ["gb/t", "xgb", "t9", "ht250", "符", "合", "标", "准", "浇注系统", "横浇道"]
    assert sorted(every[1]) == sorted(["gb", "t", "xgb", "t9", "ht250", "gb/t", "符", "合", "标", "准", "浇注系统", "横浇道"])
    assert best[2] == best[3] == every[2] == [] and best[4] == ["the", "cat", "s", "3", "mice"] and best[5] == ["浇不足", "缩松"]


def test_search_of_chinese_texts(spark):
    """A query finds what holds its words, and not what merely shares its characters."""
    docs = spark.createDataFrame([(1, "冒口应保证热节补缩"), (2, "口冒"), (3, "浇注系统"), (4, "系统的冒口和冷铁")], "doc_id int, content string")
    asked = spark.createDataFrame([(1, "冒口"), (2, "热节的补缩"), (3, "口")], "query_id int, text string")
    hits = ranked(multi_field_scores(docs, query_terms(asked, analyzer=smart), FIELDS), 10).collect()
    assert {q: sorted(h.id for h in hits if h.query_id == q) for q in (1, 2, 3)} == {1: [1, 4], 2: [1], 3: [2]}


def test_long_texts_take_time_in_proportion(spark):
    for unit in ("冒口如何", "冒", "浇注系统横浇道的"):
        began = time.perf_counter()
        df = spark.range(1).select(F.repeat(F.lit(unit), 400_000 // len(unit)).alias("x"))
        df.select(F.size(max_word(F.col("x"))), F.size(smart(F.col("x")))).first()
        assert time.perf_counter() - began < 30, unit


def test_runs_cut_once_score_as_whole_texts(spark):
    """A text's words are those of its runs; scores by runs equal scores by texts, with null, empty and letterless texts counted."""
    held = Dictionary(("the", "th", "he", "er", "re", "ere", "st", "a"), ("er",), letters="a-z", latin=False)
    rng = random.Random(4)
    texts = [None, "", "12 !", *["".join(rng.choice("thersax  -") for _ in range(rng.randint(0, 80))) for _ in range(60)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    asked = spark.createDataFrame([(1, "there st"), (2, "xaxa"), (3, "q")], "query_id int, text string")
    terms = query_terms(asked, analyzer=lambda x: smart(x, held))
    fields = lambda every, best: (Field("text", 3.0, every), Field("text", 1.0, best))
    plain = multi_field_scores(docs, terms, fields(lambda x: max_word(x, held), lambda x: smart(x, held)))
    by_runs = multi_field_scores(docs, terms, fields(ByRuns(max_word, held), ByRuns(smart, held)))
    assert sorted(map(tuple, by_runs.collect())) == sorted(map(tuple, plain.collect())) and plain.count() > 30
    with pytest.raises(ValueError):
        ByRuns(smart, Dictionary())
