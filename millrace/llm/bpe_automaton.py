"""BPE encoding and decoding by a deterministic automaton that is built merge by merge."""

from __future__ import annotations

import json
import math
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct words whose encodings, and pairs of state and entry whose answers, a worker keeps; beyond that it starts anew.
WORDS_KEPT, PAIRS_KEPT = 300_000, 600_000
#: Characters of texts whose ids and decoded texts a task hands on together.
HANDED = 1 << 22
#: Code points below this one are split by one compiled pattern; what holds others is split by the library.
NEAR = 0x250
#: Code points that are split into words at once: a long text takes memory by pieces.
PIECE = 1 << 18


class Automaton:
    """The automaton over vocabulary entries that accepts exactly the sequences that the merges give.

    It begins as one state with an arc for each symbol. A merge of u and v is a gadget: the arcs of u now lead to a copy of
    the state they led to that lacks v's arc, and wherever u and v could follow each other there is an arc of the new entry
    to where v's led. So all arcs of an entry lead to one state (goes_to), and a state is the one it was copied from less one
    arc: it holds what the copies on the way took away, and when. An arc that a copy lacks can't be the left part of later
    entries there, but those made before stay: leaves() reads that from the left parts of an entry.

    Every prefix of an accepted sequence is accepted, and there is one accepted sequence for a string: so each place of a word
    has one state, whichever way the word goes on, and encoding comes to a place once at most.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.labels = {i: t for t, i in vocab.items()}
        self.end = end
        made = {vocab[u + v] for u, v in merges}
        base = {t: i for t, i in vocab.items() if i not in made}
        self.left, self.birth = dict.fromkeys(base.values(), -1), dict.fromkeys(base.values(), -1)
        self.lacks: list[dict[int, int]] = [{}]  # of each state: entries taken from it, and by which merge
        self.goes_to = dict.fromkeys(base.values(), 0)
        for rank, (u, v) in enumerate(merges):
            self._gadget(vocab[u], vocab[v], vocab[u + v], rank)
        alphabet = byte_letters()
        self.arcs, self.entry_of = self._trie(vocab, alphabet)
        self._seen: dict[int, bool] = {}

    def _gadget(self, u: int, v: int, both: int, rank: int) -> None:
        if both in self.birth or u not in self.birth or v not in self.birth:
            raise ValueError("each entry must be made once, by a merge of entries made before")
        q = self.goes_to[u]
        self.left[both], self.birth[both], self.goes_to[both] = u, rank, self.goes_to[v]
        if not self.leaves(q, v):
            self.goes_to[both] = -1  # these two never meet: no state has the new arc
            return
        self.lacks.append(self.lacks[q] | {v: rank})
        self.goes_to[u] = len(self.lacks) - 1

    def leaves(self, state: int, entry: int) -> bool:
        """Whether a state has an arc of an entry."""
        lacks, until = self.lacks[state], math.inf
        while entry >= 0:
            if lacks.get(entry, math.inf) <= until and entry in lacks:
                return False
            until, entry = self.birth[entry], self.left[entry]
        return True

    def _trie(self, vocab: dict[str, int], alphabet: list[str]) -> tuple[dict[int, int], list[int]]:
        """(node * 512 + symbol) to node, and each node's entry or -1: the entries by their symbols, the last one of a word being
        another symbol."""
        at = {c: i for i, c in enumerate(alphabet)}
        nodes: dict[int, int] = {}
        entries: dict[int, int] = {}
        for token, i in vocab.items():
            if i not in self.birth or self.goes_to[i] < 0:
                continue
            last = bool(self.end) and token.endswith(self.end) and len(token) > len(self.end)
            symbols = [at[c] for c in (token[: -len(self.end)] if last else token)]
            symbols[-1] += 256 * last
            node = 0
            for s in symbols:
                node = nodes.setdefault(node * 512 + s, len(nodes) + 1)
            entries[node] = i
        return nodes, [entries.get(n, -1) for n in range(len(nodes) + 1)]

    def encode(self, word: str) -> list[int]:
        """The entries of a word: arcs from state to state, the longest first; a place that leads nowhere is left for good."""
        symbols = list(word.encode())
        if not symbols:
            return []
        if self.end:
            symbols[-1] += 256
        arcs, entry_of, goes_to, seen = self.arcs, self.entry_of, self.goes_to, self._seen
        if len(seen) > PAIRS_KEPT:
            seen.clear()
        n, path, states, choices, been = len(symbols), [], [0], [], bytearray(len(symbols) + 1)
        place = 0
        while place < n:
            if len(choices) < len(states):  # a new place: what may begin here, by length
                node, here = 0, []
                for i in range(place, n):
                    node = arcs.get(node * 512 + symbols[i])
                    if node is None:
                        break
                    if (entry := entry_of[node]) >= 0:
                        here.append((entry, i + 1))
                choices.append(here)
            state, here = states[-1], choices[-1]
            while here:
                entry, end = here.pop()
                if been[end]:
                    continue
                pair = state << 32 | entry
                if (there := seen.get(pair)) is None:
                    there = seen[pair] = self.leaves(state, entry)
                if there:
                    been[end] = 1
                    path.append(entry)
                    states.append(goes_to[entry])
                    place = end
                    break
            else:
                if not path:
                    raise ValueError("a symbol is not in the vocabulary")
                path.pop(), states.pop(), choices.pop()  # on with what is left of the place before
        return path


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Tokenizer:
    """A .json file of a byte-level BPE with words of their own: normalising and splitting as the file says, words by the automaton."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, added = told["model"], told["added_tokens"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or told["decoder"]:
            raise ValueError("a plain BPE without a decoder is needed")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("special tokens that are found as they stand are needed")
        steps = told["pre_tokenizer"]["pretokenizers"] if told["pre_tokenizer"]["type"] == "Sequence" else [told["pre_tokenizer"]]
        if not (steps[-1]["type"] == "ByteLevel" and not steps[-1]["add_prefix_space"] and not steps[-1]["use_regex"]):
            raise ValueError("words split by a pattern and turned to bytes are needed")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in added}
        self.labels = self.automaton.labels | {i: t for t, i in self.special.items()}
        self._library = Library.from_file(path)
        self._cuts = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._bytes = {c: b for b, c in enumerate(byte_letters())}
        self._near()
        self._known: dict[str, bytes] = {}

    def _near(self) -> None:
        """One pattern with the library's words for texts of near code points that it lower-cases as Python does."""
        kinds: dict[str, list[str]] = {"letter": [], "digit": [], "space": [], "other": []}
        split = lambda s: len(self._library.pre_tokenizer.pre_tokenize_str(s))
        for c in map(chr, range(NEAR)):
            turned = self._library.normalizer.normalize_str(c)
            if turned == " ":
                kinds["space"].append(c)
            elif turned == c.lower() and len(turned) == 1 and ord(turned) < NEAR:
                one = split(c.lower() * 2)
                kinds["space" if not one else "digit" if one == 2 else "letter" if split(c.lower() + "a") == 1 else "other"].append(c)
        of = lambda *names: "[" + "".join(map(re.escape, chain.from_iterable(kinds[n] for n in names))) + "]"
        self._words = re.compile(f"{of('letter')}+|{of('digit')}|'(?:s|t|re|ve|m|ll|d)|{of('other')}+")
        self._any_far, self._far = (re.compile(p.format(f"[^{of(*kinds)[1:-1]}]")) for p in ("{}", "[^ ]*{}[^ ]*"))

    def _by_library(self, text: str) -> list[str]:
        pieces = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(self._bytes[c] for c in piece).decode() for piece, _ in pieces]

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text without special tokens, some at a time; nothing reaches across a space, so that texts can be cut there."""
        at = 0
        while at < len(text):
            end = text.find(" ", at + PIECE)
            end = len(text) if end < 0 else end
            part, done = text[at:end], 0
            for far in self._far.finditer(part) if self._any_far.search(part) else ():
                yield self._words.findall(part[done : far.start()].lower())
                yield self._by_library(far.group())
                done = far.end()
            yield self._words.findall(part[done:].lower())
            at = end

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, as the library gives them without added special tokens; special tokens' strings are these tokens."""
        if self._cuts is None:
            return self._encode_plain(text)
        out, done = [], 0
        for cut in self._cuts.finditer(text):
            out += [self._encode_plain(text[done : cut.start()]), np.array([self.special[cut.group()]], np.int32)]
            done = cut.end()
        return np.concatenate([*out, self._encode_plain(text[done:])])

    def _encode_plain(self, text: str) -> np.ndarray:
        out, known = [], self._known
        for words in self.words(text):
            if len(known) > WORDS_KEPT:
                known.clear()
            for w in set(words).difference(known):
                known[w] = array("i", self.automaton.encode(w)).tobytes()
            out.append(b"".join(map(known.__getitem__, words)))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: list[int]) -> str:
        """The labels of the ids' arcs, a space between them, as the library's decode() without a decoder; an unknown id has none."""
        try:
            return " ".join(map(self.labels.__getitem__, ids))
        except KeyError:
            return " ".join(self.labels[i] for i in ids if i in self.labels)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encoded(text: Column, path: str) -> Column:
    """The token ids of whole texts (array of int); null counts as empty."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            each = [tokenizer(path).encode(t.as_py() or "") for t in texts]
            ends = np.cumsum([0, *map(len, each)], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *each])))

    return ids(text)


def decoded(ids: Column, path: str) -> Column:
    """The text that token ids stand for; a null array gives an empty text, null ids none."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield pa.array([tokenizer(path).decode(x.values.drop_null().to_numpy().tolist() if x.is_valid else []) for x in lists], pa.string())

    return text(ids)


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ids (array of int), decoded (string, from the ids alone).

    Ids are the tokenizers library's for the whole text with add_special_tokens=False and neither truncation nor padding;
    decoded is its decode(ids, skip_special_tokens=False). A null or empty text has no ids and decodes to an empty one. Long
    texts are split by pieces that end at a space, and some texts are handed on at a time, so that memory follows the longest one's
    ids. Repeated rows stay; other columns are left out, whatever their names. One scan, no shuffle; each worker compiles the
    merges once. encoded() and decoded() are the same as columns.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            ids, texts, at = [], [], 0
            size = 0
            for place, text in enumerate(batch.column(1), 1):
                text = text.as_py() or ""
                ids.append(coder.encode(text))
                texts.append(coder.decode(ids[-1].tolist()))
                size += len(text)
                if size > HANDED or place == len(batch):
                    ends = pa.array(np.cumsum([0, *map(len, ids)], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0)[at:place], pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids))), pa.array(texts, pa.string())], names=[id_col, "ids", "decoded"])
                    ids, texts, at, size = [], [], place, 0

    slim = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__text"))
    return slim.mapInArrow(coded, T.StructType([slim.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))
