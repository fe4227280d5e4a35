"""Text functions, Column to Column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.schemas import CJK_TERMS, LATIN_TERMS

#: White space as Unicode has it, and the four separators that the regex class leaves out.
SPACE = r"[\s\x1c-\x1f\x85]"
TRUNCATED = "……[内容已截断]"


def strip(x: Column) -> Column:
    """Without white space at the ends. Each run of it is looked at once: inner ones aren't tried from all their places, and a
    text that neither begins nor ends with one isn't searched."""
    ends = F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1))
    return F.when(ends.rlike(rf"(?U){SPACE}"), F.regexp_replace(x, rf"(?U)^{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")).otherwise(x)


def squeeze(x: Column) -> Column:
    """Trimmed, every run of white space one space."""
    return F.regexp_replace(strip(x), rf"(?U){SPACE}+", " ")


def optional_text(x: Column) -> Column:
    """Trimmed; null if that leaves nothing."""
    return F.nullif(strip(x), F.lit(""))


def is_blank(x: Column) -> Column:
    """Null, empty, or white space alone; a text is read up to its first other character."""
    return ~F.coalesce(x.rlike(rf"(?U)[^{SPACE[1:]}"), F.lit(False))


def content_hash(item_type: Column, document_id: Column, title: Column, content: Column) -> Column:
    """SHA-256 of the four, squeezed, null as empty, a line each."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(squeeze(x.cast("string")), F.lit("")) for x in (item_type, document_id, title, content)]), 256)


def _escape(term: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in term)


def exact_terms(x: Column, latin: Sequence[str] = LATIN_TERMS, other: Sequence[str] = CJK_TERMS) -> Column:
    """The dictionary terms in a text, in dictionary order: Latin ones between other than ASCII letters and digits,
    in either case; the others wherever they stand."""
    hits = [F.when(x.rlike(rf"(?i)(?<![A-Za-z0-9]){_escape(t)}(?![A-Za-z0-9])"), t) for t in latin]
    hits += [F.when(x.contains(t), t) for t in other]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def matched_keywords(query: Column, content: Column, own_terms: Column | None = None, dictionary: Sequence[str] = LATIN_TERMS + CJK_TERMS) -> Column:
    """Terms, then tokens, of the query that the content holds too, in either case, each spelling once."""
    q, c = F.lower(query), F.lower(content)
    terms = F.array(*[F.lit(t) for t in dictionary]) if dictionary else F.array().cast("array<string>")
    if own_terms is not None:
        terms = F.concat(terms, F.coalesce(own_terms, F.array().cast("array<string>")))
    terms = F.filter(terms, lambda t: (t != "") & q.contains(F.lower(t)) & c.contains(F.lower(t)))
    tokens = F.regexp_extract_all(query, F.lit(r"[A-Za-z0-9][A-Za-z0-9/_\-.]*|[一-鿿]{2,}"), F.lit(0))
    tokens = F.filter(tokens, lambda t: (F.length(t) >= 2) & c.contains(F.lower(t)))
    return F.array_distinct(F.concat(terms, tokens))


def truncate(x: Column, budget: Column) -> Column:
    """At most budget code points, a marker within them telling of a cut."""
    n = len(TRUNCATED)
    cut = F.when(budget <= n, F.substring(F.lit(TRUNCATED), F.lit(1), F.greatest(budget, F.lit(0)).cast("int"))).otherwise(F.concat(F.substring(x, F.lit(1), (budget - n).cast("int")), F.lit(TRUNCATED)))
    return F.when(budget <= 0, F.lit("")).when(F.length(x) <= budget, x).otherwise(cut)


def shorten(x: Column, n: int, mark: str = "...") -> Column:
    """The first n code points and a mark, if there are more."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(mark))).otherwise(x)


def safe_segment(x: Column) -> Column:
    """A path segment of letters, digits, dot, underscore and hyphen, without dots or underscores at its ends."""
    return F.regexp_replace(F.regexp_replace(strip(x), r"[^A-Za-z0-9._-]+", "_"), r"^[._]++|(?<![._])[._]++\z", "")


def redact_urls(x: Column, most: int = 500, secrets: Sequence[str] = ()) -> Column:
    """White space squeezed, secrets and web addresses replaced, cut to length."""
    for s in secrets:
        x = F.replace(x, F.lit(s), F.lit("[REDACTED]"))
    return F.left(squeeze(F.regexp_replace(x, r"(?i)https?://\S+", "[URL]")), F.lit(most))


def json_text(x: Column) -> Column:
    """A text as JSON; null stays null."""
    body = F.to_json(F.struct(x.alias("x")))
    return F.when(x.isNotNull(), F.substring(body, F.lit(6), F.length(body) - 6))


def scalar_fields(v: Column, keys: Sequence[str], most: int = 200) -> list[tuple[str, Column]]:
    """(key, JSON) of the scalars that a VARIANT object has of keys: texts trimmed and cut, null if blank or not a scalar."""
    out = []
    for k in sorted(keys):
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
        text = F.try_variant_get(v, f"$.{k}", "string")
        out.append((k, F.when(kind == "STRING", json_text(F.left(optional_text(text), F.lit(most)))).when(kind.isNotNull() & ~kind.rlike("^(ARRAY|OBJECT|VOID)"), text)))
    return out


def json_without_nulls(x: Column) -> Column:
    """JSON text (without white space between its parts) less all fields and elements that are null, at any depth.

    Strings are matched first and put back as they are, so that only what stands outside of them goes; then the commas. A
    string is matched by a possessive loop, up to the end if it isn't closed, which takes no stack and never goes back: length and depth cost time in proportion.
    """
    string = r'"(?:[^"\\]++|\\.)*+(?:"|\z)'
    bare = F.regexp_replace(x, rf"(?s)({string}(?!:null))|(?:{string}:)?null", "$1")
    return F.regexp_replace(bare, rf"(?s)({string})|(?<=[\[{{,]),+|(?<=[\[{{]),|,+(?=[\]}}])", "$1")


def strip_code_fence(x: Column) -> Column:
    """What a Markdown code fence around the whole text holds."""
    text = strip(x)
    opened = r"^```[^\n\r]*+[\r\n]++"
    inner = F.when(text.rlike(opened), F.regexp_replace(F.regexp_replace(text, opened, ""), r"[\r\n]```\z", "")).otherwise("")
    return F.when(text.startswith("```"), strip(inner)).otherwise(text)


def looks_like_html(x: Column) -> Column:
    return F.coalesce(x.rlike(r"(?i)^\s*<(table|html|body)"), F.lit(False))


def token_estimate(x: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(x) / 4)).cast("int")


def latin_tokens(x: Column) -> Column:
    """Lower-case runs of letters and digits, ASCII."""
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))
