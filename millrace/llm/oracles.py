"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

from millrace.llm.queries import URL_RULES
from millrace.llm.url_filter import SOFT_TERMS, STRICT_TERMS

_WORD = r"[^\x20\x09-\x0D]+"


def _url_sql() -> str:
    rules = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in URL_RULES)
    hit = lambda term: f"regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')::int"
    return f"""
WITH rules(rule, domain, prefix, says) AS (VALUES {rules}),
seen AS (
  SELECT row_number() OVER () AS n, page_id, coalesce(lower(url), '') AS u,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
ruled AS (
  SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says
  FROM seen JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix)
  GROUP BY n),
hits AS (SELECT *, {" + ".join(map(hit, STRICT_TERMS))} AS strict, {" + ".join(map(hit, SOFT_TERMS))} AS soft FROM seen)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN strict >= 1 OR soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict,
  strict::bigint AS strict_hits, soft::bigint AS soft_hits
FROM hits LEFT JOIN ruled USING (n)"""


_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256::double * x::double)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::integer AS rank, vec_id, score FROM ranked WHERE r <= 5"""

_MIX = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::bigint AS size, md5(coalesce(doc_id::varchar, '')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::int]::double AS w FROM s),
r AS (SELECT *, source_size * 2.0::double AS cap, source_size * 2.0::double / w AS ratio FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::double * 1.5::double - (sum(cap) OVER o - cap)) / (sum(w) OVER () - sum(w) OVER o + w) AS level
  FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
t AS (SELECT source, source_size, least(cap, coalesce((max(level) FILTER (level <= ratio) OVER ()) * w, cap)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::bigint AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::bigint AS taken
FROM e"""

_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT n, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT n) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::hugeint AS n
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM f JOIN v USING (lang)),
t AS (SELECT lang, term, sum(n)::hugeint AS n FROM f GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM t JOIN v USING (lang)),
ab AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(ab.value, 0)::bigint AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN ab ON ab.lang = a.lang AND ab.source = a.source AND ab.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::bigint FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::integer AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50"""

_CRC = """
  xor(list_reduce([4294967295::ubigint] || flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::ubigint, 0, 0, 0, 0, 0, 0, 0])),
    lambda a, e: CASE WHEN xor(a, e) & 1 = 1 THEN xor(xor(a, e) >> 1, 3988292384::ubigint) ELSE xor(a, e) >> 1 END), 4294967295::ubigint)"""

_TRIE = f"""
WITH x AS (
  SELECT conv_id::bigint AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(struct_pack(role := role, text := text)
    ORDER BY turn NULLS FIRST, sha256(strlen(role)::varchar || ':' || role || text)) AS t
  FROM x GROUP BY conv_id),
h AS (SELECT *, ({_CRC} % 4)::bigint AS h FROM own),
r AS (SELECT h.conv_id, coalesce(b.t[1:h.h], []) || h.t[h.h + 1:] AS t FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, len(t) AS size, unnest(range(0, len(t) + 1)) AS depth, t FROM r),
n AS (
  SELECT depth, t[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM m GROUP BY ALL),
c AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
w AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(path[depth].text, '{_WORD}')) END AS saved
  FROM n LEFT JOIN c USING (depth, path)),
a AS (SELECT unnest(range(0, depth + 1)) AS up, path, (n_children = 0)::bigint AS leaf, saved FROM w),
s AS (SELECT up AS depth, path[1:up] AS path, sum(leaf)::bigint AS n_leaves, sum(saved)::bigint AS saved_tokens FROM a GROUP BY ALL)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM w JOIN s USING (depth, path) LEFT JOIN n p ON p.depth = w.depth - 1 AND p.path = w.path[1:w.depth - 1]"""

ORACLES = {"op1_url_filters": _url_sql(), "op2_exact_topk": _TOPK, "op8_source_mixing": _MIX, "op12_source_divergence": _DIVERGENCE, "op13_conversation_trie": _TRIE}
