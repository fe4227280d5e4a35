"""Operator 11: the automaton against merging by ranks, whole texts against the library, odd tables."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from millrace.llm import bpe_automaton
from millrace.llm.bpe_automaton import Automaton, Tokenizer, bpe_round_trip, decoded, tokenizer
from millrace.llm.queries import QUERIES

PATH, SF = public_tokenizers.path("word_bpe_49k.json"), "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    held = Library.from_file(PATH)
    held.no_truncation()
    held.no_padding()
    return held


def by_ranks(word, ranks):
    """The lowest-ranked pair is merged, the leftmost first, till there is none."""
    parts = list(word)
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = ["".join(parts[i : i + 2])]


def random_merges(rng, letters, size):
    """Merges learned from random words, as a trainer does: any that two neighbours still allow."""
    words = [[rng.choice(letters) for _ in range(rng.randint(2, 9))] for _ in range(60)]
    merges, made = [], set(letters)
    while len(merges) < size:
        pairs = [p for w in words for p in zip(w, w[1:], strict=False) if "".join(p) not in made]
        if not pairs:
            break
        u, v = rng.choice(pairs)
        merges.append((u, v))
        made.add(u + v)
        for w in words:
            i = 0
            while i < len(w) - 1:
                if (w[i], w[i + 1]) == (u, v):
                    w[i : i + 2] = [u + v]
                i += 1
    return merges


@pytest.mark.parametrize("seed", range(12))
def test_automaton_gives_what_merging_gives(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 3 == 0 else "abcd"
    merges = random_merges(rng, letters, 5 + 4 * seed)
    vocab = {t: i for i, t in enumerate([*letters, *(u + v for u, v in merges)])}
    machine, ranks = Automaton(vocab, merges), {m: i for i, m in enumerate(merges)}
    for _ in range(1500):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert [machine.labels[i] for i in machine.encode(word)] == by_ranks(word, ranks)


def test_automaton_with_runs_and_pairs_that_never_meet():
    merges = [("a", "a"), ("aa", "aa"), ("a", "b"), ("b", "a"), ("b", "aa"), ("ab", "ab"), ("ab", "a")]
    vocab = {t: i for i, t in enumerate(["a", "b", *(u + v for u, v in merges)])}
    machine, ranks = Automaton(vocab, merges), {m: i for i, m in enumerate(merges)}
    for n in range(1, 11):
        for bits in range(1 << n):
            word = "".join("ab"[bits >> k & 1] for k in range(n))
            assert [machine.labels[i] for i in machine.encode(word)] == by_ranks(word, ranks), word
    with pytest.raises(ValueError):
        Automaton({"a": 0, "b": 1, "ab": 2, "aba": 3}, [("ab", "a"), ("a", "b")])
    with pytest.raises(ValueError):
        machine.encode("c")


ODD = [
    "", "  ", "\t\n", "<|endoftext|> a<|startoftext|>b", "<|ENDOFTEXT|>", "don't WE'LL I'Ve ''s \"'s", "é é İ Ⱥ ﬁ Σας ΣΑΣ", "12a½²x",
    "́abc ́", "日本語テキスト 한국어 😀👍🏽", "a　b c\x85d\x1ce​f", "a" * 5000, "ab" * 3000, "x\x00y",
]


def same(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    ids = tokenizer(PATH).encode(text).tolist()
    assert ids == want
    assert tokenizer(PATH).decode(ids) == library.decode(want, skip_special_tokens=False)


def test_texts_against_the_library(library):
    for text in ODD:
        same(library, text)
    rng = random.Random(1)
    labels = [t.replace("</w>", "") for t in tokenizer(PATH).labels.values()]
    for _ in range(4000):
        same(library, "".join(rng.choice(labels) for _ in range(rng.randint(1, 4))))
    for _ in range(100):
        same(library, "".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(32, 0x3000), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(300)))


def test_code_points_against_the_library(library):
    """All below U+3400, every sixteenth above."""
    for a in range(0, 0x110000, 8192):
        same(library, "".join(f"{chr(c)} {chr(c)}a{chr(c)}1{chr(c)}{chr(c)}'s" for c in range(a, a + 8192) if (c < 0x3400 or c % 16 == 0) and not 0xD800 <= c < 0xE000))


def test_long_texts_are_cut_at_spaces(library, monkeypatch):
    monkeypatch.setattr(bpe_automaton, "PIECE", 50)
    held = Tokenizer(PATH)
    for text in ("the cat's 12 mice, " * 40, "x" * 400 + " y", "é é " * 60, "́ 😀 don't " * 30):
        assert held.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_small_memory_gives_the_same(library, monkeypatch):
    monkeypatch.setattr(bpe_automaton, "WORDS_KEPT", 3)
    monkeypatch.setattr(bpe_automaton, "PAIRS_KEPT", 5)
    held = Tokenizer(PATH)
    for text in ODD:
        assert held.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_odd_tables(spark, library):
    data = [(i, t, [1], "d", "x") for i, t in enumerate([None, *ODD, "same", "same"])] + [(None, "no id", [2], "d", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, ids array<int>, decoded string, doc string")
    got = {r.doc_id: r for r in bpe_round_trip(docs, PATH).collect()}
    for i, t in [(r[0], r[1] or "") for r in data]:
        want = library.encode(t, add_special_tokens=False).ids
        assert got[i].ids == want and got[i].decoded == library.decode(want, skip_special_tokens=False)
    assert bpe_round_trip(docs.limit(0), PATH).count() == 0 and bpe_round_trip(docs, PATH).columns == ["doc_id", "ids", "decoded"]
    nulls = spark.createDataFrame([(None,), ([],), ([None, 518, 10**6],)], "ids array<int>")
    assert [r.t for r in nulls.select(decoded("ids", PATH).alias("t")).collect()] == ["", "", tokenizer(PATH).labels[518]]


def test_query_against_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_bpe_automaton"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
