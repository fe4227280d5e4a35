"""Language identification with bit-sliced Bloom filters over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import small_batches, staged

_LETTER = regex.compile(r"\p{L}")
#: Languages that one word of a slot has bits for.
WORD_BITS = 64
#: Bytes that a task turns into n-grams at once.
STEP = 1 << 19


@dataclass(frozen=True)
class LanguageSettings:
    """train_docs: a language learns from about so many distinct labelled texts (all, if it has fewer).

    share: a language holds an n-gram if it is at least that often there as in the language where it is most
    frequent, both in proportion. least_slots: the smallest filter; it has sparse slots for each n-gram of the language
    with the most of them, and a word of 64 bits in each slot for every 64 languages.
    """

    train_docs: int = 2000
    sizes: tuple[int, ...] = (3, 4, 5)
    least_count: int = 3
    share: float = 0.35
    least_slots: int = 1 << 16
    sparse: int = 16
    hashes: int = 2


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size bytes (at most 7)."""
    n = max(0, len(data) - size + 1)
    packed = np.full(n, size, np.uint64)
    for i in range(size):
        packed = (packed << np.uint64(8)) | data[i : i + n].astype(np.uint64)
    packed = (packed ^ (packed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    packed = (packed ^ (packed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return packed ^ (packed >> np.uint64(29))


_WORDS = regex.compile(r"[^\p{L}\p{M}]+")


def prepared(text: str) -> bytes:
    """Lower-case letters, every run of anything else as one space, a space on either side."""
    return b" " + _WORDS.sub(" ", text.lower()).strip().encode("utf-8", "ignore") + b" "


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, and where each begins. Runs over an end count nowhere: see owned()."""
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])


@dataclass(frozen=True)
class LanguageModel:
    """slots x words: bit l % 64 of word l // 64 of a slot is set if an n-gram of language l falls there."""

    languages: tuple[str, ...]
    filter: np.ndarray
    settings: LanguageSettings

    def false_positives(self) -> np.ndarray:
        """Per language, the share of unknown n-grams that its filter would take for known."""
        fill = [((self.filter[:, i // WORD_BITS] >> np.uint64(i % WORD_BITS)) & np.uint64(1)).mean() for i in range(len(self.languages))]
        return np.array(fill) ** self.settings.hashes

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages: n-grams known to each, texts: n-grams)."""
        data, ends = joined(texts)
        known = np.zeros((len(texts), len(self.languages)), np.int64)
        total = np.zeros(len(texts), np.int64)
        for size in self.settings.sizes:
            hashes = gram_hashes(data, size)
            lengths = np.maximum(0, np.diff(ends) - size + 1)
            # the runs that start in a text but end in the next one are left out
            starts = np.minimum(ends[:-1], len(hashes))
            stops = np.minimum(starts + lengths, len(hashes))
            total += lengths
            for word in range(self.filter.shape[1]):
                mask = self.lookup(hashes, word)
                for i in range(word * WORD_BITS, min(len(self.languages), (word + 1) * WORD_BITS)):
                    run = np.concatenate(([0], np.cumsum((mask >> np.uint64(i % WORD_BITS)) & np.uint64(1), dtype=np.int64)))
                    known[:, i] += run[stops] - run[starts]
        return known, total

    def lookup(self, hashes: np.ndarray, word: int = 0) -> np.ndarray:
        """Bits of all languages of a word that hold each n-gram."""
        column = self.filter[:, word]
        out = None
        for place in slots_of(hashes, len(column), self.settings.hashes):
            out = column[place] if out is None else out & column[place]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(languages, scores); "und" and 0 where there is no letter or no language."""
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        wrong = self.false_positives()
        some: list[int] = []
        raw: list[bytes] = []

        def decide() -> None:
            if not some:
                return
            known, total = self.counts(raw)
            right = np.clip((known - total[:, None] * wrong) / (1 - wrong), 0, None)
            best = right.argmax(axis=1)
            top = right[np.arange(len(some)), best]
            score = np.clip(top / np.maximum(total, 1), 0, 1)
            for at, b, s in zip(some, best, score, strict=True):
                names[at], scores[at] = self.languages[b], s
            some.clear()
            raw.clear()

        size = 0
        for i, text in enumerate(texts):
            if text is None or not _LETTER.search(text):
                continue
            some.append(i)
            raw.append(prepared(text))
            size += len(raw[-1])
            if size > STEP:
                decide()
                size = 0
        decide()
        return names, scores


def slots_of(hashes: np.ndarray, slots: int, times: int) -> Iterator[np.ndarray]:
    for k in range(times):
        yield ((hashes >> np.uint64(k * 21)) % np.uint64(slots)).astype(np.int64)


def training_rows(docs: DataFrame, settings: LanguageSettings, text_col: str, lang_col: str) -> DataFrame:
    """About settings.train_docs distinct texts (lang, text) of each language, those with the smallest hashes.

    An estimate of the distinct texts of each language, a row a label for the driver, sets how small a hash has to be;
    only what passes is shuffled, and copies are combined before that.
    """
    named = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    order = F.xxhash64("text", F.lit(17))
    counts = named.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()
    if not counts:
        return named
    pairs = [F.lit(x) for r in counts for x in (r["lang"], settings.train_docs / max(1, r["n"]))]
    return named.where(F.pmod(order, F.lit(1_000_000_000)) < F.element_at(F.create_map(*pairs), F.col("lang")) * 1_000_000_000).distinct()


def train_languages(docs: DataFrame, settings: LanguageSettings = LanguageSettings(), text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn the filters from labelled rows (text, lang); rows without either are left out.

    N-grams are counted in tasks and summed by Spark; the driver gets those that the filters hold, which follow from
    the size of the sample, and sizes the filters by their number: none is left out.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [prepared(t) for lg, t in zip(langs, texts, strict=True) if lg == lang]
                for at in range(0, len(own), 64):
                    data, _ = joined(own[at : at + 64])
                    found = [np.unique(gram_hashes(data, s), return_counts=True) for s in settings.sizes]
                    h, n = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    rows = training_rows(docs, settings, text_col, lang_col)
    counts = staged(rows.mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    shares = counts.join(totals, "lang").withColumn("p", F.col("n") / F.col("all")).withColumn("top", F.max("p").over(W.partitionBy("gram")))
    kept = shares.where((F.col("p") >= settings.share * F.col("top")) & (F.col("n") >= settings.least_count))
    held = kept.select("lang", "gram").toPandas()
    languages = tuple(sorted(held["lang"].unique()))
    most = int(held["lang"].value_counts().max()) if languages else 0
    slots = max(settings.least_slots, 1 << max(0, settings.sparse * most - 1).bit_length())
    table = np.zeros((slots, -(-max(1, len(languages)) // WORD_BITS)), np.uint64)
    by_lang = dict(list(held.groupby("lang")["gram"]))
    for i, lang in enumerate(languages):
        hashes = by_lang[lang].to_numpy(np.int64).view(np.uint64)
        for place in slots_of(hashes, slots, settings.hashes):
            table[place, i // WORD_BITS] |= np.uint64(1 << (i % WORD_BITS))
    return LanguageModel(languages, np.asfortranarray(table), settings)


def language_of(docs: DataFrame, model: LanguageModel, text: Column) -> Column:
    """A struct (lang string, score double) of a whole text: the learned language that knows most of its n-grams."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = shared.value.predict(texts.tolist())
            yield pd.DataFrame({"lang": names, "score": scores})

    return of(text)


def identify_languages(docs: DataFrame, held_out: Column, settings: LanguageSettings = LanguageSettings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: its id, held_out, lang_pred, score (0 to 1: the share of its n-grams known).

    Learns from rows that held_out is not true for and whose language is not null. A null text, or one without a letter,
    is "und" with score 0, as is every text if there is nothing to learn from. Repeated rows stay. The filter's
    size follows from the sample and the number of languages; it is broadcast, and documents are scanned again but not shuffled.
    """
    marked = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = train_languages(marked.where(~F.col("held_out")), settings, "text", "lang")
    found = marked.select(id_col, "held_out", language_of(docs, model, F.col("text")).alias("found"))
    return found.select(id_col, "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def keep_identified(docs: DataFrame, least_score: float = 0.3, settings: LanguageSettings = LanguageSettings(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents, with their columns, of which a language can be told: not "und", and of least_score or more.

    Learns from the labelled documents themselves. Without any label no language is known and none is missed: then only
    documents without a letter go.
    """
    model = train_languages(docs, settings, text_col, lang_col)
    if not model.languages:
        return docs.where(F.col(text_col).cast("string").rlike(r"\p{L}"))
    found = docs.select(F.struct(*docs.columns).alias("__doc"), language_of(docs, model, F.col(text_col).cast("string")).alias("__found"))
    kept = found.where((F.col("__found.lang") != "und") & (F.col("__found.score") >= least_score))
    return kept.select(*[F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])
