"""URL filters: host and path rules first, then a weighted vocabulary counted by one Aho-Corasick pass."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import ascii_lower

#: One hit of these rejects a url.
STRICT_TERMS = (
    "bestiality", "blowjob", "bukkake", "camgirl", "camgirls", "casino", "cialis", "creampie", "cumshot", "deepthroat", "escort", "escorts", "fetish", "gangbang",
    "handjob", "hentai", "keygen", "livejasmin", "malware", "milf", "milfs", "nudes", "phishing", "porn", "porno", "pornhub", "pornos", "sportsbook", "swingers", "threesome", "viagra", "warez",
    "xhamster", "xnxx", "xvideos", "xxx", "youporn",
)
#: Several distinct ones reject a url. English, then German, French and Spanish.
SOFT_TERMS = (
    "adult", "adults", "bet", "betting", "bonus", "cheap", "coupon", "crack", "cracked", "crypto", "dating", "discount", "download", "erotic", "farm", "free", "gambling", "girls", "hack", "hot",
    "jackpot", "loan", "loans", "lottery", "naked", "nude", "payday", "pills", "poker", "prize", "replica", "serial", "sex", "sexy", "slots", "spam", "spins", "teen", "teens", "torrent", "webcam", "win",
    "billig", "erotik", "gewinn", "gratis", "kostenlos", "kredit", "nackt", "wetten", "gratuit", "nue", "paris-sportifs", "rencontre", "rencontres", "sexe",
    "apuestas", "citas", "desnuda", "descargar", "premio", "sexo",
)


@dataclass(frozen=True)
class UrlVocabulary:
    """Lower-case terms; soft_needed distinct soft terms, or one strict term, reject a url."""

    strict: tuple[str, ...] = STRICT_TERMS
    soft: tuple[str, ...] = SOFT_TERMS
    soft_needed: int = 2

    def __post_init__(self):
        if any(not t or t != t.lower() for t in self.strict + self.soft):
            raise ValueError("terms must be lower-case and not empty")
        if self.soft_needed < 1:
            raise ValueError("soft_needed must be at least 1")

    @classmethod
    def from_table(cls, terms: DataFrame, soft_needed: int = 2, most: int = 1_000_000) -> UrlVocabulary:
        """A vocabulary from rows (term, weight: "strict" or "soft"), lower-cased; blank terms are left out and a term of
        both weights is strict. The automaton is held by every task: a table of more than most terms is refused."""
        rows = terms.select(F.lower(F.trim("term")).alias("term"), "weight").where("term <> ''").groupBy("term").agg(F.max("weight").alias("weight"))
        held = rows.orderBy("term").limit(most + 1).collect()
        if len(held) > most:
            raise ValueError(f"more than {most} terms")
        if odd := {r["weight"] for r in held} - {"strict", "soft"}:
            raise ValueError(f"unknown weights: {sorted(map(str, odd))}")
        return cls(tuple(r["term"] for r in held if r["weight"] == "strict"), tuple(r["term"] for r in held if r["weight"] == "soft"), soft_needed)


@lru_cache(maxsize=8)
def _automaton(vocabulary: UrlVocabulary):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for term in vocabulary.soft:
        machine.add_word(term, (term, False))
    for term in vocabulary.strict:
        machine.add_word(term, (term, True))
    machine.make_automaton()
    return machine


def term_hits(url: str | None, vocabulary: UrlVocabulary) -> tuple[int, int]:
    """Distinct (strict, soft) terms that stand between characters other than ASCII letters and digits."""
    if not url or not (vocabulary.strict or vocabulary.soft):
        return 0, 0
    low, strict, soft = url.lower(), set(), set()
    if len(low) != len(url):
        low = "".join(c.lower() if c.isascii() else c for c in url)
    inner = lambda i: 0 <= i < len(low) and low[i].isascii() and low[i].isalnum()
    for end, (term, is_strict) in _automaton(vocabulary).iter(low):
        if not inner(end - len(term)) and not inner(end + 1):
            (strict if is_strict else soft).add(term)
    return len(strict), len(soft)


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no :// : empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; null or no :// : empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule is (host/path, allow or block)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], vocabulary: UrlVocabulary = UrlVocabulary(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: its id, host, path, rule, verdict (allow or block), strict_hits, soft_hits.

    The rule's verdict holds where a rule fits; else the vocabulary decides on the whole url. Null urls and
    urls without :// have an empty host and path; a null url has no hits and is allowed. Repeated rows stay,
    other columns of the input are left out. No shuffle: the pass is one scan of two columns.
    """

    @F.pandas_udf(T.StructType([T.StructField("strict", T.IntegerType()), T.StructField("soft", T.IntegerType())]))
    def hits(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([term_hits(u, vocabulary) for u in urls], columns=["strict", "soft"])

    url = F.col(url_col).cast("string")
    seen = pages.select(F.col(id_col).alias(id_col), url_host(url).alias("host"), url_path(url).alias("path"), hits(url).alias("hits"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    blocked = (F.col("hits.strict") >= 1) | (F.col("hits.soft") >= vocabulary.soft_needed)
    return seen.select(
        id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.col("hits.strict").cast("long").alias("strict_hits"), F.col("hits.soft").cast("long").alias("soft_hits"),
    )
