"""Secret scans by patterns and by character Markov models, with DataFrame functions only."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns. Of assign's value 6, of the others' matches 20 and 24 characters are needed.
#: The last two are written with their least length, which gives the same spans: runs of such characters are maximal.
_NAMED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = _NAMED + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
#: Kinds in the order that settles ties.
KINDS = ("assign", "access", "hex", "random")
#: Fixed value: the characters of tokens that the models judge.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_TOKEN = r"[A-Za-z0-9+/_=-]"
#: What joins the parts of a token, which are judged besides the whole.
_JOINT = r"[+/_=-]+"
#: Tokens that hold, or end within, a span of another base kind.
_OTHER = rf"{ACCESS}|[0-9a-f]{{23,}}|AKIA[A-Z0-9]{{8,}}$"
_STEP = "struct<gap:string,found:string>"
_SPAN = "struct<start:int,kind:int,stop:int>"
_PLACE = "struct<found:string,start:int,stop:int>"
#: Matches whose places are summed up in one go; such runs are then put one after the other, so that the work on a text
#: grows with its matches.
_RUN = 512


@dataclass(frozen=True)
class MarkovSettings:
    """sample_docs: about so many documents, by a hash of their text, lend samples to the models.

    least_chars: the shortest token judged. least_ratio: the mean log-likelihood ratio of the pairs of neighbours that tell,
    in nats, from which a token counts as random. uniform: the weight of evenly spread characters in the model of random strings,
    for kinds of secrets that the samples lack.
    """

    sample_docs: int = 4000
    least_chars: int = 20
    least_ratio: float = 2.0
    uniform: float = 0.5


def _tokens(least_chars: int) -> str:
    """One pass for assignments and for runs of token characters, which end where an assignment starts."""
    named = _NAMED + "[A-Za-z0-9+/_.=-]"
    return rf"{_NAMED}[A-Za-z0-9+/_.=-]+|(?<!{_TOKEN})(?={_TOKEN}{{{least_chars}}})(?:(?!{named}){_TOKEN}){{{least_chars},}}+"


def _steps(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """The text as pairs of what stands before a match and the match, the last without one; empty if nothing matches."""
    here = F.coalesce(gate if gate is not None else text.rlike(pattern), F.lit(False))
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(gap.alias("gap"), m.alias("found")))
    return F.when(here, pairs).otherwise(F.array()).cast(f"array<{_STEP}>")


def _places(steps: str) -> Column:
    """Matches with their places in code points, from a column of steps (a column, so that it is computed once)."""
    empty = F.array().cast(f"array<{_PLACE}>")

    def one(acc, x):
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["found"]), F.lit(0))
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(x["found"].alias("found"), begin.alias("start"), end.alias("stop"))).alias("out"))

    def run(acc, i):
        of = F.aggregate(F.slice(steps, i * _RUN + 1, F.lit(_RUN)), F.struct(acc["at"].alias("at"), empty.alias("out")), one)
        return F.transform(F.array(of), lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], r["out"]).alias("out")))[0]

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_PLACE}>>").alias("out"))
    runs = F.sequence(F.lit(0), F.floor(F.size(steps) / _RUN).cast("int"))
    places = F.aggregate(runs, start, run, lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(steps) > 0, F.filter(places, lambda x: x["found"].isNotNull())).otherwise(empty)


def _spans(places: Column, kind: int) -> Column:
    return F.transform(places, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["stop"].alias("stop")).cast(_SPAN))


def _assigned(found: Column) -> Column:
    """Whether a match of _tokens() is an assignment, and whether its value is long enough."""
    return F.regexp_extract(found, f"^{ASSIGN}", 1)


def train_markov(docs: DataFrame, settings: MarkovSettings = MarkovSettings(), text_col: str = "text") -> list[float]:
    """Log-likelihood ratios of each pair of ALPHABET's characters, random strings against ordinary identifiers.

    Pairs where identifiers join words (separators, and upper case after lower) say nothing: 0.

    Labelled samples: what the base patterns find in the sampled documents is random; their other tokens of 4
    or more characters, but fewer than would be judged, are ordinary: a secret that the patterns miss teaches nothing. The driver gets a count per pair of characters and label at most.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = max(1, docs.count())
    own = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(n)) < settings.sample_docs)
    assigned, access, hexes = (F.regexp_extract_all("text", F.lit(p), F.lit(g)) for p, g in ((ASSIGN, 1), (ACCESS, 0), (HEX, 0)))
    random = F.filter(F.concat(assigned, access, hexes), lambda x: F.length(x) >= 16)
    rest = F.col("text")
    for p in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, p, " ")
    ordinary = F.filter(F.regexp_extract_all(rest, F.lit(_TOKEN + "{4,}"), F.lit(0)), lambda x: F.length(x) < settings.least_chars)
    labelled = own.select(F.explode(F.array(F.struct(F.lit(1).alias("random"), random.alias("tokens")), F.struct(F.lit(0).alias("random"), ordinary.alias("tokens")))).alias("x"))
    tokens = labelled.select("x.random", F.explode("x.tokens").alias("token"))
    pairs = tokens.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, 2))).alias("pair"))
    counts: dict[tuple[int, str], int] = {(r["random"], r["pair"]): r["count"] for r in pairs.groupBy("random", "pair").count().toLocalIterator() if set(r["pair"]) <= set(ALPHABET)}
    ratios, size = [], len(ALPHABET)
    seen = {b: sum(counts.get((0, a + b), 0) for a in ALPHABET) + 0.5 for b in ALPHABET}
    total = sum(seen.values())
    for a in ALPHABET:
        sums = [sum(counts.get((k, a + b), 0) for b in ALPHABET) for k in (0, 1)]
        for b in ALPHABET:
            if not (a.isalnum() and b.isalnum()) or a.islower() and b.isupper():
                ratios.append(0.0)
                continue
            plain = (counts.get((0, a + b), 0) + seen[b] / total) / (sums[0] + 1)  # what follows a rare character is as common as it is itself
            drawn = (counts.get((1, a + b), 0) + 0.5) / (sums[1] + 0.5 * size)
            ratios.append(math.log((1 - settings.uniform) * drawn + settings.uniform / size) - math.log(plain))
    return ratios


def is_random(token: Column, ratios: list[float], settings: MarkovSettings) -> Column:
    """Whether the models take a token, or a part of it that is long enough by itself, for a random string."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")

    def mean_ratio(x):
        places = F.transform(F.split(x, ""), lambda c: F.instr(F.lit(ALPHABET), c))
        n = F.length(x) - 1
        pairs = F.zip_with(F.slice(places, 1, n), F.slice(places, 2, n), lambda a, b: F.element_at(table, ((a - 1) * len(ALPHABET) + b).cast("int")))
        told = F.filter(pairs, lambda x: x != 0)
        return F.aggregate(told, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.size(told), F.lit(1))

    parts = F.filter(F.split(token, _JOINT), lambda p: (F.length(p) >= settings.least_chars) & (p != token))
    return F.exists(F.concat(F.array(token), parts), lambda p: mean_ratio(p) >= settings.least_ratio)


def _adds(found: Column, ratios: list[float], settings: MarkovSettings) -> Column:
    return (_assigned(found) == "") & ~found.rlike(_OTHER) & is_random(found, ratios, settings)


def with_spans(docs: DataFrame, ratios: list[float], settings: MarkovSettings) -> DataFrame:
    """docs (with a column text, not null) and base and spans: arrays of (start, kind, stop) by start, then kind. An added
    span lies apart from all base ones, since tokens end at assignments and those that hold other base spans add none."""
    text = F.col("text")
    found = docs.withColumns({"_t": _steps(text, _tokens(settings.least_chars)), "_a": _steps(text, ACCESS, text.contains("AKIA") & text.rlike(ACCESS)), "_h": _steps(text, HEX)})
    found = found.withColumns({"_tp": _places("_t"), "_ap": _places("_a"), "_hp": _places("_h")})
    assigned = F.filter("_tp", lambda x: F.length(_assigned(x["found"])) >= 6)
    added = F.filter("_tp", lambda x: _adds(x["found"], ratios, settings))
    found = found.withColumns({"base": F.array_sort(F.concat(_spans(assigned, 0), _spans(F.col("_ap"), 1), _spans(F.col("_hp"), 2))), "_more": _spans(added, 3)})
    return found.withColumn("spans", F.array_sort(F.concat("base", "_more"))).drop("_t", "_a", "_h", "_tp", "_ap", "_hp", "_more")


def scan_secrets(docs: DataFrame, settings: MarkovSettings = MarkovSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, base and spans, arrays of (start, kind, stop) by start, then kind.

    Positions are code points, stop exclusive; kind is a place in KINDS. A null text is empty and has none. Where
    no document holds a secret, random strings are modelled as evenly spread characters. Repeated rows stay;
    other columns are left out. Three scans (a count of rows, a sample to train on, then all), no shuffle of texts; the
    work on a text grows with its length, however many spans it has.
    """
    ratios = train_markov(docs, settings, text_col)
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return with_spans(slim, ratios, settings).select(F.col("_id").alias(id_col), "base", "spans")


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redact(docs: DataFrame, settings: MarkovSettings = MarkovSettings(), text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """The same rows and columns, each secret in the text replaced by mark; spans that overlap become one. A null text stays.

    The text is put together again from what stands between assignments and tokens; in that the other patterns are
    replaced, also what an assignment has left over of their spans.
    """
    ratios = train_markov(docs, settings, text_col)
    text = F.col(text_col)
    held = docs.select(F.struct(*docs.columns).alias("__doc"), _steps(text, _tokens(settings.least_chars)).alias("__t"))
    text = F.col(f"__doc.`{text_col}`")
    gone = lambda m: (F.length(_assigned(m)) >= 6) | _adds(m, ratios, settings)
    pieces = F.transform("__t", lambda x: F.concat(x["gap"], F.when(x["found"].isNull(), "").when(gone(x["found"]), mark).otherwise(x["found"])))
    body = F.when(F.size("__t") > 0, F.array_join(pieces, "")).otherwise(text)
    rest = rf"(?:[0-9a-f]{{23,}}|AKIA[A-Z0-9]{{8,}})(?={re.escape(mark)})|{ACCESS}|{HEX}"
    clean = F.regexp_replace(body, rest, mark.replace("\\", r"\\").replace("$", r"\$"))
    return held.select(*[(clean if c == text_col else F.col(f"__doc.`{c}`")).alias(c) for c in docs.columns])
