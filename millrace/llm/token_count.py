"""Token counts of whole texts; huge texts in overlapping chunks that are spliced where both must agree."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import small_batches

#: Code points of a chunk, of its first overlap with the next, and of the longest text that is encoded whole.
CHUNK, OVERLAP, WHOLE = 16_384, 256, 32_768


@dataclass(frozen=True)
class Encoder:
    """A tokenizer file: .model by sentencepiece, .json by tokenizers."""

    path: str

    def __post_init__(self):
        if not self.path.endswith((".model", ".json")):
            raise ValueError("a .model or .json file is needed")

    def count(self, texts: list[str]) -> list[int]:
        if self.path.endswith(".model"):
            return [len(x) for x in _library(self.path).encode(texts, num_threads=1)] if texts else []
        return [len(x) for x in _library(self.path).encode_batch(texts, add_special_tokens=False)]

    def begins(self, text: str) -> list[int]:
        """Where each token begins, in code points of the text."""
        if self.path.endswith(".model"):
            raw = np.frombuffer(text.encode(), np.uint8)
            place = np.append(np.cumsum((raw & 0xC0) != 0x80) - 1, len(text))  # sentencepiece gives bytes
            return place[[p.begin for p in _library(self.path).encode(text, return_type="proto").pieces]].tolist()
        return [a for a, _ in _library(self.path).encode(text, add_special_tokens=False).offsets]

    def stable(self, left: str, right: str) -> bool:
        """Whether every encoding of any text has a boundary between these two neighbours.

        sentencepiece: no vocabulary piece holds the one just before the other, and pieces are all that merges
        can make; that needs a model that leaves characters alone but for the space. tokenizers (byte-level
        BPE): words are cut between a letter and a following space before anything is merged.
        """
        if self.path.endswith(".json"):
            return left.isalpha() and left.isascii() and right == " "
        pairs = _neighbours(self.path)
        return pairs is not None and (left if left != " " else "▁") + (right if right != " " else "▁") not in pairs


@lru_cache(maxsize=4)
def _library(path: str):
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _neighbours(path: str) -> frozenset[str] | None:
    """Pairs of neighbours within vocabulary pieces; None if the model rewrites text, when nothing is proven."""
    model = _library(path)
    probe = "x  ééﬁ①Ａ 　y\tZ "
    if model.normalize(probe).lstrip("▁") != probe.replace(" ", "▁"):
        return None
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return frozenset(p[i : i + 2] for p in pieces for i in range(len(p) - 1))


def spliced_count(text: str, encoder: Encoder, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of a text, from encodings of chunks.

    A chunk begins within the one before, by the overlap. The splice is the last place there where both
    encodings have a token begin and the neighbours are stable: tokens before it count from the first chunk,
    those from it on from the second. Where there is no such place the overlap is widened, till the two chunks
    are one; the next chunk is then as long as this one, so that a text without any stable place is encoded a few
    times in all, not once per chunk.
    """
    total, start, cut, end = 0, 0, 0, min(len(text), chunk)  # of the open chunk; its tokens count from cut on
    begins = encoder.begins(text[:end])
    while end < len(text):
        wide = overlap
        stop = min(len(text), end + max(chunk, end - start))
        while True:
            ahead = max(start, end - wide)
            following = [ahead + b for b in encoder.begins(text[ahead:stop])]
            splice = _splice(text, begins, following, max(ahead, cut), encoder)
            if splice is not None or ahead == start:
                break
            wide *= 16
        if splice is not None:
            total += sum(cut <= b < splice for b in begins)
            start, cut = ahead, splice
        end, begins = stop, following
    return total + sum(b >= cut for b in begins)


def _splice(text: str, begins: list[int], following: list[int], above: int, encoder: Encoder) -> int | None:
    both = set(following).intersection(begins)
    return max((b for b in both if b > above and encoder.stable(text[b - 1], text[b])), default=None)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", whole: int = WHOLE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: its id, n_bytes (UTF-8), n_tokens, over_limit (more than limit tokens).

    Counts are the library's for the whole text, without begin, end or added special tokens. A null text counts
    as empty: 0 and 0. Texts of up to whole code points are encoded in batches; longer ones in chunks, so that
    memory follows the chunk. Repeated rows stay; other columns are left out. One scan, no shuffle.
    """
    encoder, docs = Encoder(path), small_batches(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), _counts(text, encoder, whole, chunk, overlap).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)


def _counts(text: Column, encoder: Encoder, whole: int, chunk: int, overlap: int) -> Column:
    @F.pandas_udf(T.LongType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, some, size = [0] * len(texts), [], 0
            for i, t in enumerate(texts):
                if len(t) > whole:
                    out[i] = spliced_count(t, encoder, chunk, overlap)
                    continue
                some.append((i, t))
                size += len(t)
                if size > 1 << 20 or i == len(texts) - 1:
                    _fill(out, some, encoder)
                    some, size = [], 0
            _fill(out, some, encoder)
            yield pd.Series(out)

    return of(text)


def _fill(out: list[int], some: list[tuple[int, str]], encoder: Encoder) -> None:
    for (i, _), n in zip(some, encoder.count([t for _, t in some]), strict=True):
        out[i] = n
