"""Analyzers with a dictionary: texts without spaces are cut into words by the lattice of dictionary words in them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.schemas import ANALYZER_TERMS, STOP_WORDS

Analyzer = Callable[[Column], Column]
_LATIN = "[a-z0-9]"


@dataclass(frozen=True)
class Dictionary:
    """Words and stop words, in lower case. letters: the class of characters that are cut by the dictionary, as in a regular
    expression; words of other characters too (standards, alloys) are found between what is no ASCII letter or digit."""

    words: tuple[str, ...] = ANALYZER_TERMS
    stop_words: tuple[str, ...] = STOP_WORDS
    letters: str = r"\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
    latin: bool = True  # whether runs of ASCII letters and digits are words too

    def __post_init__(self):
        import re

        low = tuple(dict.fromkeys(w.lower() for w in self.words if w))
        own = [w for w in low if re.fullmatch(f"[{self.letters}]+", w)]
        object.__setattr__(self, "own", tuple(own))
        object.__setattr__(self, "mixed", tuple(sorted((w for w in low if w not in set(own)), key=lambda w: (-len(w), w))))
        object.__setattr__(self, "lengths", tuple(sorted({len(w) for w in own if len(w) > 1})))

    def is_word(self, x: Column) -> Column:
        return x.isin(*self.own) if self.own else F.lit(False)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _words_at(chars: Column, at: Column, dictionary: Dictionary) -> Column:
    """The lengths, from two, of the dictionary words that begin at a place."""
    lengths = F.array(*[F.lit(n) for n in dictionary.lengths]).cast("array<int>")
    return F.filter(lengths, lambda n: (at + n - 1 <= F.size(chars)) & dictionary.is_word(F.array_join(F.slice(chars, at, n), "")))


def _best_path(chars: Column, dictionary: Dictionary) -> Column:
    """The words of the path that leaves the fewest characters out of words, then has the fewest words, then the longest first.

    Suffixes are taken from the shortest: a state keeps (characters in words, - words, words) of as many suffixes as the longest
    word has characters, so that a step looks at no more.
    """
    longest = max(dictionary.lengths, default=1)
    kind = "array<struct<covered: int, fewer: int, first: int, words: array<string>>>"
    first = F.expr("array(named_struct('covered', 0, 'fewer', 0, 'first', 0, 'words', cast(array() as array<string>)))").cast(kind)

    def step(state: Column, i: Column) -> Column:
        def option(k: Column) -> Column:
            word, rest = F.array_join(F.slice(chars, i, k), ""), F.element_at(state, k)
            is_one = F.when(k > 1, F.lit(True)).otherwise(dictionary.is_word(word))
            return F.struct((rest["covered"] + F.when(is_one, k).otherwise(0)).cast("int").alias("covered"), (rest["fewer"] - 1).cast("int").alias("fewer"), k.cast("int").alias("first"), F.concat(F.array(word), rest["words"]).alias("words"))

        lengths = F.filter(F.concat(F.array(F.lit(1)), _words_at(chars, i, dictionary)), lambda k: k <= F.size(state))
        return F.slice(F.concat(F.array(F.array_max(F.transform(lengths, option))), state), 1, longest).cast(kind)

    return F.element_at(F.aggregate(F.reverse(F.sequence(F.lit(1), F.size(chars))), first, step), 1)["words"]


def _tree(words: Iterable[str]) -> str:
    """A regular expression of words, by the tree of their beginnings: each letter is looked at once, longer words first."""
    ends, rest = False, {}
    for w in words:
        if w:
            rest.setdefault(w[0], []).append(w[1:])
        else:
            ends = True
    branches = [c + _tree(tails) for c, tails in rest.items()]
    if not branches:
        return ""
    whole = branches[0] if len(branches) == 1 and not ends else f"(?:{'|'.join(branches)})"
    return f"{whole}?" if ends else whole


def _marked(low: Column, dictionary: Dictionary) -> Column:
    """The text with a space wherever two letters meet and no dictionary word reaches across: stretches of letters are now
    either one letter that is in no longer word, or what words that overlap cover without a gap."""
    across: dict[str, dict[str, list[str]]] = {}  # by the letter before the place, then by all of the word before it
    for w in dictionary.own:
        for n in range(1, len(w)):
            across.setdefault(w[n - 1], {}).setdefault(w[:n], []).append(w[n:])
    of = lambda p, tails: (f"(?<={p})" if len(p) > 1 else "") + _tree(tails)
    near = lambda heads: "".join(sorted({t[0] for tails in heads.values() for t in tails}))
    held = "|".join(f"(?<={c})(?=[{near(heads)}])(?:{'|'.join(of(p, tails) for p, tails in heads.items())})" for c, heads in across.items())
    held = f"(?!{held})" if held else ""
    return F.regexp_replace(low, f"(?<=[{dictionary.letters}])(?=[{dictionary.letters}]){held}", " ")


def _latin(low: Column, dictionary: Dictionary, apart: bool) -> list[Column]:
    """Latin words; dictionary words with other characters too, in their place or (apart) besides their parts."""
    if not dictionary.latin:
        return []
    quoted = "|".join("".join(c if c.isalnum() else "\\" + c for c in w) for w in dictionary.mixed)
    mixed = rf"(?<!{_LATIN})(?:{quoted})(?!{_LATIN})"
    if not dictionary.mixed or apart:
        found = [F.regexp_extract_all(low, F.lit(f"{_LATIN}+"), F.lit(0))]
        return [*found, F.filter(F.regexp_extract_all(low, F.lit(mixed), F.lit(0)), lambda w: ~w.rlike(f"^{_LATIN}+$"))] if dictionary.mixed else found
    return [F.regexp_extract_all(low, F.lit(f"{mixed}|{_LATIN}+"), F.lit(0))]


def _without_stops(found: list[Column], dictionary: Dictionary) -> Column:
    tokens = F.concat(*found)
    return F.coalesce(F.filter(tokens, lambda w: ~w.isin(*dictionary.stop_words)) if dictionary.stop_words else tokens, F.array().cast("array<string>"))


def max_word(x: Column, dictionary: Dictionary = Dictionary()) -> Column:
    """Every dictionary word at every place of a text, the letters that are in none, and the Latin words; repeats included.
    For what is indexed: no part of a compound is missed. A null text has none. One pass over the text for each length that
    dictionary words have, by regular expressions that are trees of them."""
    low, letters = F.lower(x), dictionary.letters
    ones = "".join(w for w in dictionary.own if len(w) == 1)
    alone = f"(?<![{letters}])[{letters}](?![{letters}])"
    found = _latin(low, dictionary, apart=True)
    found.append(F.filter(F.regexp_extract_all(_marked(low, dictionary), F.lit(alone), F.lit(0)), lambda w: ~w.isin(*ones)) if ones else F.regexp_extract_all(_marked(low, dictionary), F.lit(alone), F.lit(0)))
    if ones:
        found.append(F.regexp_extract_all(low, F.lit(f"[{ones}]"), F.lit(0)))
    for n in dictionary.lengths:
        found.append(F.regexp_extract_all(low, F.lit(f"(?=({_tree(w for w in dictionary.own if len(w) == n)}))"), F.lit(1)))
    return _without_stops(found, dictionary)


def smart(x: Column, dictionary: Dictionary = Dictionary()) -> Column:
    """A text cut into words once: of all paths through the lattice the one of _best_path(); Latin words that are part of a
    dictionary word (GB/T) aren't told apart. For queries. Time follows a text's length; within a stretch that
    overlapping words cover without a gap, and that is no word itself, it follows the square."""
    low = F.lower(x)
    stretches = F.regexp_extract_all(_marked(low, dictionary), F.lit(f"[{dictionary.letters}]+"), F.lit(0))
    path = lambda s: let(F.regexp_extract_all(s, F.lit("."), F.lit(0)), lambda chars: _best_path(chars, dictionary))
    cut = lambda s: F.when((F.length(s) == 1) | dictionary.is_word(s), F.array(s)).otherwise(path(s))
    return _without_stops([*_latin(low, dictionary, apart=False), F.flatten(F.transform(stretches, cut))], dictionary)


@dataclass(frozen=True)
class ByRuns:
    """max_word or smart with a dictionary of letters alone. No word reaches across a mark of _marked(), so a text's words are those
    of the runs of letters between marks, one by one; of these few differ, and each that does can be cut once for all texts."""

    cut: Callable[[Column, Dictionary], Column]
    dictionary: Dictionary

    def __post_init__(self):
        if self.dictionary.latin or self.dictionary.mixed:
            raise ValueError("words of other characters than letters lie across runs")

    def __call__(self, x: Column) -> Column:
        return self.cut(x, self.dictionary)

    def runs(self, x: Column) -> Column:
        return F.regexp_extract_all(_marked(F.lower(x), self.dictionary), F.lit(f"[{self.dictionary.letters}]+"), F.lit(0))
