"""DuckDB SQL with the same rows as the registered queries."""

from __future__ import annotations

from millrace.plans.queries import ACTIONS, RUN_STATUSES, SYLLABLES, TERMS
from millrace.schemas import ITEM_TYPES, TRANSITIONS

#: White space as text.SPACE has it, for trimming and squeezing.
_WS = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _squeeze(x: str) -> str:
    return f"regexp_replace({_strip(x)}, '{_WS}+', ' ', 'g')"


def _chunks(size: int, overlap: int, table: str = "documents") -> str:
    step = size - overlap
    return f"""
c AS (
  SELECT doc_id AS document_id, i::int AS chunk_index, substring(text, (i * {step} + 1)::int, {size}) AS content, (i * {step})::int AS char_start
  FROM (SELECT doc_id, text, unnest(range(0, 1 + ceil(greatest(length(text) - {size}, 0) / {step})::bigint)) AS i
        FROM {table} WHERE {_strip("text")} <> ''))"""


_ASKED = """
q AS (SELECT b.item_id AS query_id, b.text, e.embedding FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id WHERE b.item_id % 20 = 0)"""


def _bm25(name: str, text: str, source: str = "documents") -> str:
    return f"""
{name}_tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS term FROM {source}),
{name}_len AS (SELECT doc_id AS id, coalesce(len(regexp_extract_all(lower({text}), '[a-z0-9]+')), 0) AS dl FROM {source}),
{name}_all AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_len),
{name}_qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM q),
{name}_tf AS (SELECT id, term, count(*) AS tf FROM {name}_tok WHERE term IN (SELECT term FROM {name}_qt) GROUP BY id, term),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name} AS (
  SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf / (tf + 1.2::double * (1 - 0.75::double + 0.75::double * dl / avgdl))), 9) AS score
  FROM {name}_tf JOIN {name}_df USING (term) JOIN {name}_len USING (id) CROSS JOIN {name}_all JOIN {name}_qt USING (term) GROUP BY query_id, id)"""


def _lattice(texts: str) -> str:
    """RECURSIVE: xw and xs, the terms of each different run of letters by every word and by the best path."""
    words = ", ".join(f"'{w}'" for w in SYLLABLES.words)
    stop = ", ".join(f"'{w}'" for w in SYLLABLES.stop_words)
    longest = max(map(len, SYLLABLES.words))
    option = f"""{{'c': st[n].c + CASE WHEN n > 1 OR list_contains([{words}], substr(run, i - 1, n)) THEN n ELSE 0 END, 'f': st[n].f - 1, 'n': n, 'p': list_prepend(substr(run, i - 1, n), st[n].p)}}"""
    allowed = f"list_filter(range(1, {longest + 1}), lambda n: n <= len(st) AND (n = 1 OR list_contains([{words}], substr(run, i - 1, n))))"
    return f"""
xr AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS run FROM ({texts})),
xp AS (SELECT run, unnest(range(1, len(run) + 1)) AS i FROM xr),
xe AS (SELECT run, i, word, len(word) AS n FROM xp JOIN (SELECT unnest([{words}]) AS word) ON substr(run, i, len(word)) = word),
xu AS (SELECT run, i, substr(run, i, 1) AS word FROM xp WHERE NOT EXISTS (SELECT 1 FROM xe WHERE xe.run = xp.run AND xe.i <= xp.i AND xp.i < xe.i + xe.n)),
xw AS (SELECT run, word AS term FROM (SELECT run, word FROM xe UNION ALL SELECT run, word FROM xu) WHERE word NOT IN ({stop})),
xd AS (
  SELECT run, len(run) + 1 AS i, [{{'c': 0::bigint, 'f': 0::bigint, 'n': 0::bigint, 'p': []::varchar[]}}] AS st FROM xr
  UNION ALL
  SELECT run, i - 1, list_prepend(list_max(list_transform({allowed}, lambda n: {option})), st)[1:{longest}] FROM xd WHERE i > 1),
xs AS (SELECT run, term FROM (SELECT run, unnest(st[1].p) AS term FROM xd WHERE i = 1) WHERE term NOT IN ({stop}))"""


def _analyzed(name: str, cut: str) -> str:
    return f"""
{name}_tf AS (SELECT id, term, count(*) AS tf FROM dr JOIN {cut} USING (run) GROUP BY id, term),
{name}_len AS (SELECT doc_id AS id, coalesce(dl, 0) AS dl FROM documents LEFT JOIN (SELECT id, sum(tf) AS dl FROM {name}_tf GROUP BY id) ON id = doc_id),
{name}_all AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_len),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name} AS (
  SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf / (tf + 1.2::double * (1 - 0.75::double + 0.75::double * dl / avgdl))), 9) AS score
  FROM {name}_tf JOIN {name}_df USING (term) JOIN {name}_len USING (id) CROSS JOIN {name}_all JOIN qt USING (term) GROUP BY query_id, id)"""


def _present(*xs: str) -> str:
    return f"array_to_string(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL), ',')"


def _vec(vectors: str = "embeddings", queries: str = "q") -> str:
    return f"""
vs AS (
  SELECT query_id, vec_id AS id, round(1 - (1 - list_cosine_similarity(v.embedding::double[], {queries}.embedding::double[])), 9) AS score
  FROM {vectors} v JOIN {queries} ON v.vec_id <> query_id)"""


def _ranked(name: str, of: str, k: int) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {of} QUALIFY rank <= {k})"


def _fusion(limit: int, kw: float, vw: float) -> str:
    return f"""
f AS (
  SELECT coalesce(kr.query_id, vr.query_id) AS query_id, coalesce(kr.id, vr.id) AS id, kr.rank AS keyword_rank, vr.rank AS vector_rank,
    CASE WHEN kr.rank IS NULL THEN 'vector' WHEN vr.rank IS NULL THEN 'keyword' ELSE 'both' END AS retrieval_source,
    coalesce({kw}::double / (60 + kr.rank), 0::double) + coalesce({vw}::double / (60 + vr.rank), 0::double) AS hybrid_score
  FROM kr FULL JOIN vr ON kr.query_id = vr.query_id AND kr.id = vr.id),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, keyword_rank NULLS LAST, vector_rank NULLS LAST, id) AS position FROM f QUALIFY position <= {limit})"""


def _fused(limit: int, kw: float, vw: float, docs: str = "documents", vectors: str = "embeddings") -> str:
    return f"""{_ASKED}, {_bm25("ks", "text", docs)}, {_vec(vectors)}, {_ranked("kr", "ks", 50)}, {_ranked("vr", "vs", 50)}, {_fusion(limit, kw, vw)}"""


_HYBRID = _fused(10, 0.5, 0.5)

_PACK = f"""{_HYBRID},
i AS (
  SELECT h.query_id, h.id::varchar AS chunk_id, retrieval_source, hybrid_score, d.text AS content, d.source AS original_filename,
    row_number() OVER (PARTITION BY h.query_id ORDER BY hybrid_score DESC, position) AS citation_id
  FROM h JOIN documents d ON h.id = d.doc_id),
hd AS (SELECT *, '[' || citation_id || '] 来源文件: ' || original_filename || chr(10) || 'chunk_index: 0' || chr(10) || 'document_id: ' || chunk_id || chr(10) || 'chunk_id: ' || chunk_id
    || chr(10) || 'retrieval_source: ' || retrieval_source || chr(10) || 'hybrid_score: ' || printf('%.6f', hybrid_score) || chr(10) || 'content:' || chr(10) AS head,
    CASE WHEN citation_id > 1 THEN 2 ELSE 0 END AS gap FROM i),
w AS (SELECT *, gap + length(head) + length(content) AS whole FROM hd),
l AS (SELECT *, 6000 - (sum(whole) OVER (PARTITION BY query_id ORDER BY citation_id) - whole) - gap - length(head) AS room FROM w),
k AS (SELECT *, min((room > 0)::int) OVER (PARTITION BY query_id ORDER BY citation_id) AS ok FROM l QUALIFY ok = 1),
p AS (
  SELECT *, length(content) > room AS was_truncated,
    CASE WHEN length(content) <= room THEN content WHEN room <= 9 THEN left('……[内容已截断]', room::int) ELSE left(content, (room - 9)::int) || '……[内容已截断]' END AS cut
  FROM k),
u AS (SELECT *, sum(gap + length(head) + length(cut)) OVER (PARTITION BY query_id ORDER BY citation_id) AS used_chars FROM p)"""


def _case(m: dict[str, str], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"


def _runs() -> str:
    return f"""
r AS (SELECT event_id AS id, user_id AS document_id, {_case(RUN_STATUSES, "event_type")} AS status, ts FROM events),
a AS (SELECT *, coalesce(row_number() OVER (PARTITION BY document_id, status = 'succeeded' ORDER BY ts DESC, id DESC) = 1 AND status = 'succeeded', false) AS is_active FROM r)"""


def _hash(item_type: str, title: str) -> str:
    return f"sha256(concat_ws(chr(10), '{item_type}', '', {title}, {_squeeze('text')}))"


_MOVES = ", ".join(f"('{a}', '{s}', '{to}')" for a, (starts, to) in TRANSITIONS.items() for s in starts)
_TERMS = ", ".join(f"CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9]){t}($|[^A-Za-z0-9])') THEN '{t}' END" for t in TERMS)
_LISTED = ", ".join(f"'{t}'" for t in TERMS)

def _keywords(query: str, content: str, dictionary: str) -> str:
    """Ordered, each spelling once."""
    words = f"list_filter({dictionary}, lambda t: contains(lower({query}), lower(t)) AND contains(lower({content}), lower(t)))"
    found = f"list_filter(regexp_extract_all({query}, '[A-Za-z0-9][A-Za-z0-9/_\\-.]*|[一-鿿]{{2,}}'), lambda t: length(t) >= 2 AND contains(lower({content}), lower(t)))"
    both = f"list_concat({words}, {found})"
    return f"array_to_string(list_filter({both}, lambda t, i: list_position({both}, t) = i), '|')"


_DICTIONARY = "['GB/T', 'GJB', 'HB', 'ASTM', 'ISO', 'HT250', 'QT450', 'ZG25', '冒口', '冷铁', '热节', '补缩', '浇注系统', '浇口', '横浇道', '直浇道', '内浇道', '砂芯', '芯盒', '分型面', '缩孔', '缩松', '夹渣', '夹砂', '气孔', '卷气', '冷隔', '裂纹', '粘砂']"

_V = """
v AS (SELECT vec_id::varchar AS id, label, CASE WHEN label % 5 = 2 THEN '' ELSE 'm' END AS model, len(embedding) AS dim,
  ['embedded', 'embedded', 'not_started', 'embed_failed', 'embedding'][label % 5 + 1] AS status FROM embeddings)"""

ORACLES = {
    "chunk_fixed": f"""WITH {_chunks(1000, 100)}
SELECT document_id, chunk_index, content, char_start, (char_start + length(content))::int AS char_end, length(content)::int AS character_count,
  greatest(1, ceil(length(content) / 4))::int AS token_count FROM c""",
    "chunk_statistics": f"""WITH {_chunks(500, 50)}
SELECT document_id, count(*) AS chunk_count, sum(length(content))::bigint AS total_chars, min(length(content))::bigint AS min_chars, max(length(content))::bigint AS max_chars, avg(length(content)) AS avg_chars
FROM c GROUP BY document_id""",
    "chunk_totals": f"""WITH {_chunks(1000, 100)}
SELECT count(*) AS chunk_count, coalesce(sum(length(content)), 0)::bigint AS total_chars, coalesce(min(length(content)), 0)::bigint AS min_chars, coalesce(max(length(content)), 0)::bigint AS max_chars,
  coalesce(avg(length(content)), 0) AS avg_chars FROM c""",
    "chunk_page": f"""WITH {_chunks(1000, 100)}
SELECT document_id, chunk_index, length(content)::int AS character_count, (SELECT count(*) FROM c) AS total FROM c ORDER BY document_id, chunk_index LIMIT 50 OFFSET 100""",
    "chunk_deep_page": f"""WITH {_chunks(1000, 100)}, k AS (SELECT document_id, chunk_index, length(content)::int AS character_count FROM c),
a AS (SELECT *, (SELECT count(*) FROM k) AS total, 'offset' AS part FROM k ORDER BY character_count DESC, document_id, chunk_index LIMIT 100 OFFSET 1500),
b AS (SELECT *, 0::bigint AS total, 'after' AS part FROM k WHERE (-character_count, document_id, chunk_index) > (-700, 50, 0) ORDER BY character_count DESC, document_id, chunk_index LIMIT 100)
SELECT * FROM a UNION ALL SELECT * FROM b""",
    "vector_top10": """WITH w AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
d AS (SELECT vec_id, round(1 - list_cosine_similarity(e.embedding::double[], w.embedding::double[]), 9) AS x FROM embeddings e, w)
SELECT vec_id, round(x, 6) + 0.0 AS distance, round(1 - x, 6) AS score FROM d ORDER BY x, vec_id LIMIT 10""",
    "vector_top10_filtered": """WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT query_id, vec_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 9) AS score FROM embeddings e, q WHERE label = 3 AND vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM d)
SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "vector_batch": f"""WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0), {_vec()}, {_ranked("r", "vs", 5)}
SELECT query_id, id AS vec_id, rank::int AS rank, round(score, 6) AS score FROM r""",
    "vector_norms": """SELECT vec_id, len(embedding)::int AS dim, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) AS norm,
  round(embedding[1]::double / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) AS first, round_even(abs(embedding[1]::double)::varchar::decimal(20, 10), 4)::double AS q4 FROM embeddings""",
    "hash_embedding": """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, i - 1 AS i, CASE WHEN text = '' THEN '' ELSE substring(text, i::int, 1) END AS c FROM (SELECT doc_id, text, unnest(range(1, greatest(1, length(text)) + 1)) AS i FROM t)),
h AS (SELECT doc_id, sha256(i || ':' || c) AS h FROM p)
SELECT doc_id, (('0x' || substring(h, 1, 8))::bigint % 16)::int AS bucket,
  round(sum(CASE WHEN ('0x' || substring(h, 9, 2))::bigint % 2 = 0 THEN 1 ELSE -1 END * (0.5::double + ('0x' || substring(h, 11, 2))::bigint / 255)), 6) + 0.0 AS weight
FROM h GROUP BY 1, 2""",
    "hash_embedding_topk": f"""WITH t AS (SELECT item_id, coalesce(text, '') AS text FROM benchmark),
p AS (SELECT item_id, i - 1 AS i, CASE WHEN text = '' THEN '' ELSE substring(text, i::int, 1) END AS c FROM (SELECT item_id, text, unnest(range(1, greatest(1, length(text)) + 1)) AS i FROM t)),
h AS (SELECT item_id, sha256(i || ':' || c) AS h FROM p),
s AS (SELECT item_id, ('0x' || substring(h, 1, 8))::bigint % 32 AS b, sum(CASE WHEN ('0x' || substring(h, 9, 2))::bigint % 2 = 0 THEN 1 ELSE -1 END * (0.5::double + ('0x' || substring(h, 11, 2))::bigint / 255)) AS w FROM h GROUP BY 1, 2),
e AS (SELECT item_id AS vec_id, list(coalesce(w, 0::double) ORDER BY b) AS embedding FROM (SELECT DISTINCT item_id FROM t) CROSS JOIN (SELECT unnest(range(0, 32)) AS b) LEFT JOIN s USING (item_id, b) GROUP BY item_id),
q AS (SELECT vec_id AS query_id, embedding FROM e WHERE vec_id % 20 = 0), {_vec("e")}, {_ranked("r", "vs", 5)}
SELECT query_id, id AS item_id, rank::int AS rank, round(score, 6) AS score FROM r""",
    "term_statistics": """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)
SELECT term, count(*) AS df, sum(tf)::bigint AS cf FROM p GROUP BY term""",
    "document_lengths": "SELECT doc_id, coalesce(len(regexp_extract_all(lower(text), '[a-z0-9]+')), 0)::bigint AS dl FROM documents",
    "posting_lists": "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL",
    "bm25_topk": f"""WITH {_ASKED}, {_bm25("s", "text")}, {_ranked("r", "s", 10)}
SELECT query_id, id AS doc_id, rank::int AS rank, round(score, 6) AS score FROM r""",
    "bm25_multifield": f"""WITH {_ASKED}, {_bm25("s1", "text")}, {_bm25("s2", "split_part(text, chr(10), 1)")},
m AS (SELECT query_id, id, max(score) AS score FROM (SELECT * FROM s1 UNION ALL SELECT query_id, id, score * 3.0::double FROM s2) GROUP BY ALL), {_ranked("r", "m", 10)}
SELECT query_id, id AS doc_id, rank::int AS rank, round(score, 6) AS score FROM r""",
    "analyzed_terms": f"""WITH RECURSIVE {_lattice("SELECT text FROM benchmark")},
br AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS run FROM benchmark)
SELECT item_id, 'max_word' AS analyzer, term, count(*) AS n FROM br JOIN xw USING (run) GROUP BY ALL
UNION ALL SELECT item_id, 'smart', term, count(*) FROM br JOIN xs USING (run) GROUP BY ALL""",
    "analyzed_search": f"""WITH RECURSIVE {_lattice("SELECT text FROM documents UNION ALL SELECT text FROM benchmark")},
dr AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS run FROM documents),
qt AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS run FROM benchmark WHERE item_id % 20 = 0) JOIN xs USING (run)),
{_analyzed("sw", "xw")}, {_analyzed("ss", "xs")},
m AS (SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, score * 3.0::double AS score FROM sw UNION ALL SELECT query_id, id, score FROM ss) GROUP BY ALL), {_ranked("r", "m", 10)}
SELECT query_id, id AS doc_id, rank::int AS rank, round(score, 6) AS score FROM r""",
    "index_versions": f"""WITH {_ASKED}, {_bm25("a", "text", "(SELECT * FROM documents WHERE lang = 'en')")}, {_bm25("b", "text")}, {_ranked("ra", "a", 3)}, {_ranked("rb", "b", 3)}
SELECT version::int AS version, query_id, id AS doc_id, rank::int AS rank, round(score, 6) AS score
FROM (SELECT 1 AS version, * FROM ra UNION ALL SELECT unnest([2, 3]), * FROM rb)""",
    "json_sanitized": f"""WITH e AS (
  SELECT event_id, CASE WHEN value > 50 THEN event_id::varchar END AS a,
    CASE WHEN event_id % 3 <> 0 THEN '"' || replace(event_type || ': "null", [1,null]', '"', '\\"') || '"' END AS k FROM events)
SELECT event_id, '{{' || {_present("""'"event_id":' || event_id""", """'"a":' || a""", f"""'"in":{{' || {_present("""'"low":' || a""", f"""'"kinds":[' || {_present("k", "'\"null\"'")} || ']'""", f"""'"deep":{{' || {_present("""'"k":' || k""", """'"null":' || a""")} || '}}'""")} || '}}'""", f"""'"ns":[' || {_present("a", "a", "'7'")} || ']'""")} || '}}' AS clean FROM e""",
    "parse_decisions": """WITH c AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'system') AS titles, count(*) FILTER (turn = conv_id % 7) AS odd, min(turn) AS first FROM c GROUP BY conv_id),
i AS (SELECT conv_id, min(place) AS place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM c) WHERE turn = conv_id % 7 GROUP BY conv_id),
d AS (SELECT g.*, i.place, conv_id % 11 AS kind, conv_id % 2 = 0 AS beside FROM g LEFT JOIN i USING (conv_id)),
r AS (SELECT *, CASE WHEN kind = 3 THEN 'not JSON' WHEN kind = 4 THEN 'not a list' WHEN kind = 5 AND NOT beside THEN NULL
  WHEN kind = 5 THEN NULL WHEN odd > 0 THEN 'block ' || place || ': block is not an object' END AS reason FROM d)
SELECT conv_id::varchar AS document_id, (reason IS NOT NULL)::bigint AS n_faults, reason,
  CASE WHEN reason IS NOT NULL THEN 0 WHEN kind = 5 THEN beside::int ELSE n END::bigint AS n_blocks,
  CASE WHEN reason IS NOT NULL OR kind = 5 THEN 0 ELSE titles END::bigint AS n_titles FROM r""",
    "rrf_fusion": f"""WITH {_fused(20, 0.7, 0.3)}
SELECT query_id, id AS doc_id, retrieval_source, keyword_rank::int AS keyword_rank, vector_rank::int AS vector_rank, round(hybrid_score, 9) AS hybrid_score, position::int AS position FROM h""",
    "hybrid_search_batch": f"WITH {_HYBRID} SELECT query_id, id AS doc_id, retrieval_source, round(hybrid_score, 9) AS hybrid_score, position::int AS position FROM h",
    "hybrid_highlights": f"""WITH {_HYBRID}, t AS (SELECT h.query_id, h.id, q.text AS q, coalesce(d.text, '') AS d FROM h JOIN q USING (query_id) LEFT JOIN documents d ON h.id = d.doc_id)
SELECT query_id, id AS doc_id, {_keywords("q", "d", _DICTIONARY)} AS keywords FROM t""",
    "hybrid_document_filter": f"""WITH en AS (SELECT * FROM documents WHERE lang = 'en'), ev AS (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM en)), {_fused(10, 0.5, 0.5, "en", "ev")}
SELECT query_id, id AS doc_id, retrieval_source, position::int AS position FROM h""",
    "exact_terms_found": f"SELECT doc_id, array_to_string(list_filter([{_TERMS}, CASE WHEN contains(text, 'ción') THEN 'ción' END, CASE WHEN contains(text, 'ß') THEN 'ß' END], lambda t: t IS NOT NULL), '|') AS terms FROM documents",
    "matched_terms": f"""WITH t AS (SELECT doc_id, text, 'The re/st of DER que-les the thing' AS q FROM documents)
SELECT doc_id, {_keywords("q", "text", f"[{_LISTED}]")} AS keywords FROM t""",
    "context_pack": f"WITH {_PACK} SELECT query_id, citation_id::int AS citation_id, chunk_id, was_truncated, length(cut)::int AS n_chars, used_chars::bigint AS used_chars FROM u",
    "context_text": rf"""WITH {_PACK}
SELECT query_id, md5(regexp_replace(string_agg(head || cut, chr(10) || chr(10) ORDER BY citation_id), 'hybrid_score: [0-9.]+', '', 'g')) AS context_md5, count(*) AS n_chunks FROM u GROUP BY query_id""",
    "citation_list": f"WITH {_PACK} SELECT query_id, citation_id::int AS citation_id, chunk_id, original_filename, retrieval_source, was_truncated FROM u",
    "prompt_texts": f"""WITH {_PACK}, x AS (SELECT query_id, string_agg(head || cut, chr(10) || chr(10) ORDER BY citation_id) AS context, max(used_chars) AS total FROM u GROUP BY query_id)
SELECT query_id, CASE WHEN context IS NULL THEN 'no_context' ELSE 'ok' END AS context_status,
  md5(regexp_replace('检索片段：' || chr(10) || coalesce(nullif({_strip("context")}, ''), '当前无可用检索上下文。') || chr(10) || chr(10) || '用户问题：' || chr(10) || q.text || chr(10) || chr(10)
    || '请只依据上述检索片段回答。依据不足时说明无法可靠回答，并不要补充未在片段中出现的工艺参数或标准条文。', 'hybrid_score: [0-9.]+', '', 'g')) AS prompt_md5, coalesce(total, 0)::bigint AS total_chars
FROM q LEFT JOIN x USING (query_id)""",
    "extraction_prompts": f"""WITH {_chunks(1000, 100)}, f AS (SELECT *, sum(length(content)) OVER (PARTITION BY document_id) > 12000 AS over_budget FROM c WHERE chunk_index < 20)
SELECT document_id, over_budget, CASE WHEN NOT over_budget THEN md5('Allowed item_type values for this extraction:' || chr(10) || '{", ".join(sorted(ITEM_TYPES))}' || chr(10) || chr(10) || 'Source chunks:' || chr(10)
  || string_agg('[chunk_id: ' || document_id || '-' || chunk_index || ']' || chr(10) || 'chunk_index: ' || chunk_index || chr(10) || 'content:' || chr(10) || content || chr(10), chr(10) ORDER BY chunk_index)
  || chr(10) || 'Extract concise knowledge items from the chunks above.' || chr(10) || 'Return only JSON with top-level key items.') END AS prompt_md5 FROM f GROUP BY document_id, over_budget""",
    "content_hashes": f"SELECT {_hash('process_rule', 'lang')} AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "duplicates_skipped": f"""WITH i AS (SELECT doc_id, {_hash('process_rule', "'t'")} AS h FROM documents), live AS (SELECT DISTINCT h FROM i JOIN labels USING (doc_id) WHERE toxic IS DISTINCT FROM 1),
n AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS r FROM i WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT doc_id, r > 1 OR h IN (SELECT h FROM live) AS skipped FROM n""",
    "list_filter": "SELECT doc_id FROM documents WHERE text ILIKE '%THE%re_t%' OR source ILIKE '%THE%re_t%'",
    "latest_per_key": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "active_runs": f"WITH {_runs()} SELECT id AS run_id, document_id, is_active FROM a",
    "run_statuses": f"""WITH {_runs()}
SELECT document_id, count(*) AS n_runs, arg_max(id, (ts, id)) AS latest_run_id, arg_max(status, (ts, id)) AS latest_status, arg_max(id, (ts, id)) FILTER (is_active) AS active_run_id FROM a GROUP BY document_id""",
    "review_states": f"""WITH RECURSIVE m(action, was, becomes) AS (VALUES {_MOVES}),
e AS (SELECT user_id, {_case(ACTIONS, "event_type")} AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (
  SELECT DISTINCT user_id, 0::bigint AS n, 'draft' AS status, 0 AS ok, 0 AS bad, NULL::varchar AS first FROM e
  UNION ALL
  SELECT s.user_id, e.n, coalesce(m.becomes, s.status), s.ok + (m.becomes IS NOT NULL)::int, s.bad + (m.becomes IS NULL)::int, coalesce(s.first, CASE WHEN m.becomes IS NULL THEN e.action END)
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1 LEFT JOIN m ON m.action = e.action AND m.was = s.status)
SELECT user_id, status, ok AS n_applied, bad AS n_refused, first AS first_refused FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""",
    "version_snapshots": "SELECT doc_id, to_json({'doc_id': doc_id, 'lang': lang, 'source': source, 'n_chars': n_chars})::varchar AS snapshot FROM documents",
    "extraction_validation": f"""SELECT doc_id, CASE WHEN doc_id % 8 = 5 THEN 'forbidden field' WHEN doc_id % 8 = 6 THEN 'unknown field' WHEN doc_id % 8 = 1 THEN 'unknown item_type'
  WHEN doc_id % 8 = 2 OR {_strip("text")} = '' THEN 'title or content missing' WHEN doc_id % 8 = 3 THEN 'confidence out of range' WHEN doc_id % 8 = 4 THEN 'unknown source chunk' END AS error,
  CASE WHEN error IS NULL THEN 1 ELSE 0 END AS n_items, CASE WHEN doc_id % 8 = 0 AND error IS NULL THEN 0.1234::double END AS confidence FROM documents""",
    "syncable_chunks": f"WITH {_V} SELECT id AS chunk_id, d.source AS original_filename, status AS embedding_status, '{{}}' AS source_metadata FROM v JOIN documents d ON d.doc_id::varchar = v.id WHERE status = 'embedded' AND model = 'm' AND dim = 64",
    "embedding_statuses": f"""WITH {_V} SELECT label, count(*) AS total, count(*) FILTER (status = 'not_started') AS not_started, count(*) FILTER (status = 'embedding') AS embedding, count(*) FILTER (status = 'embedded') AS embedded,
  count(*) FILTER (status = 'embed_failed') AS embed_failed, coalesce(string_agg(DISTINCT nullif(model, ''), '|'), '') AS models, string_agg(DISTINCT dim::varchar, '|') AS dims FROM v GROUP BY label""",
    "index_drift": """SELECT count(d.doc_id) AS n_source, count(e.vec_id) AS n_index, count(*) FILTER (e.vec_id IS NULL) AS n_missing, count(*) FILTER (d.doc_id IS NULL) AS n_stale
FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT vec_id FROM embeddings) e ON d.doc_id = e.vec_id""",
    "index_refresh": """WITH o AS (SELECT doc_id AS chunk_id, source AS document_id FROM documents WHERE lang = 'en'),
n AS (SELECT doc_id AS chunk_id, source AS document_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT *, 'old' AS version, 'all' AS mode FROM o WHERE chunk_id NOT IN (SELECT chunk_id FROM n) UNION ALL SELECT *, 'new', 'all' FROM n
UNION ALL SELECT *, 'old', 'document' FROM o WHERE document_id NOT IN (SELECT document_id FROM n) UNION ALL SELECT *, 'new', 'document' FROM n""",
    "unparsed_documents": "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "ordered_chunks": "SELECT l.doc_id AS position, l.doc_id * 7 AS id, d.lang FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id * 7",
    "summaries": """SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '...' ELSE text END AS text, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS caption,
  length(text) > 500 AS truncated, least(20, len(string_split(text, ' ')))::int AS n_path FROM documents""",
    "text_functions": f"""WITH d AS (SELECT doc_id, text, {_squeeze("regexp_replace(text, '(?i)https?://[^ \\t\\n\\x0b\\f\\r]+', '[URL]', 'g')")} AS redacted FROM documents)
SELECT doc_id, md5({_squeeze("text")}) AS squeezed_md5, md5(regexp_replace(regexp_replace({_strip("text")}, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g')) AS segment_md5,
  md5(redacted) AS redacted_md5, least(500, length(redacted))::int AS n_redacted, (CASE WHEN length(text) > 40 THEN 43 ELSE length(text) END)::int AS n_shortened, greatest(1, ceil(length(text) / 4))::int AS n_tokens FROM d""",
    "upload_validation": """WITH f AS (SELECT doc_id, ['.txt', '.md', '.exe', '', '.pdf'][doc_id % 5 + 1] AS extension, n_chars FROM documents)
SELECT doc_id, extension, CASE WHEN extension IN ('.exe', '') THEN 'INVALID_FILE_TYPE' WHEN n_chars > 3000 THEN 'FILE_TOO_LARGE' END AS reject_reason FROM f""",
    "message_validation": f"""WITH m AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, count(*) AS n_messages, count(*) FILTER (NOT coalesce(role IN ('system', 'user', 'assistant', 'tool'), false)) AS bad_roles, count(*) FILTER (coalesce({_strip("text")}, '') = '') AS blank_texts,
  count(*) FILTER (role = 'system' AND before IS NOT NULL) AS late_system, count(*) FILTER (role = before) AS repeated_roles FROM m GROUP BY conv_id""",
    "normalized_blocks": f"""WITH m AS (SELECT conv_id, role, turn, nullif({_strip("text")}, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
p AS (SELECT *, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i) AS title FROM m)
SELECT conv_id::varchar AS document_id, i::int AS block_index, 'block-' || lpad(i::varchar, 6, '0') AS block_key, CASE role WHEN 'system' THEN 'title' WHEN 'user' THEN 'text' ELSE 'unknown' END AS block_type,
  (turn + 1)::int AS page_start, (turn + 1)::int AS page_end, md5(text) AS text_md5, md5(coalesce(title, '')) AS path_md5, (title IS NOT NULL)::int AS depth FROM p""",
    "page_assets": """WITH m AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'title' WHEN 'user' THEN 'text' ELSE 'unknown' END AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id::varchar AS document_id, kind || '.png' AS asset_key, 'image' AS asset_type, (arg_max(turn, i) + 1)::int AS page_number, 'block-' || lpad(max(i)::varchar, 6, '0') AS source_block_key FROM m GROUP BY conv_id, kind""",
    "asset_resolution": """WITH a AS (SELECT doc_id, lang, 'p/' || source || '/' || n_chars || '.png' AS key, n_chars || '.png' AS base FROM documents),
k AS (SELECT lang, base, count(DISTINCT key) AS n, min(key) AS key FROM a GROUP BY lang, base)
SELECT a.doc_id, CASE WHEN a.doc_id % 3 = 0 THEN a.key WHEN a.doc_id % 3 = 1 AND k.n = 1 THEN k.key END AS resolved_key,
  CASE WHEN a.doc_id % 3 = 2 THEN 'no asset matches' WHEN a.doc_id % 3 = 1 AND k.n > 1 THEN 'more than one asset matches' END AS error
FROM a JOIN k USING (lang, base) WHERE a.doc_id IN (SELECT doc_id FROM labels)""",
    "parsed_chunks": f"""WITH f AS (SELECT doc_id, source || ['.txt', '.md', '.exe', '.csv', '.pdf'][doc_id % 5 + 1] AS name, text AS own FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 5 <> 2),
t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN '原始文件名：' || name || chr(10) || '文件类型：.pdf' || chr(10) || 'parser_name：SimpleParser' || chr(10) || 'source_type：pdf' || chr(10) || '当前为轻量解析占位，后续由 MinerU 替换。' ELSE own END AS text FROM f WHERE own IS NOT NULL),
{_chunks(1000, 100, "t")}
SELECT document_id, chunk_index, content, 'not_started' AS embedding_status FROM c""",
    "parse_failures": f"""SELECT doc_id::varchar AS document_id, CASE WHEN done THEN 'DOCUMENT_ALREADY_PARSED' ELSE 'DOCUMENT_PARSE_FAILED' END AS code,
  CASE WHEN done THEN 'chunks exist' WHEN doc_id % 5 = 2 OR text IS NULL THEN 'unknown kind of file or no content' ELSE 'no text' END AS reason
FROM (SELECT doc_id, text, doc_id IN (SELECT doc_id FROM labels) AS done FROM documents) WHERE done OR doc_id % 5 = 2 OR text IS NULL OR (doc_id % 5 <> 4 AND {_strip("text")} = '')""",
    "stream_chunks": f"WITH {_chunks(1000, 100)} SELECT document_id, chunk_index, char_start, length(content)::int AS character_count FROM c",
    "stream_refresh": f"""WITH m AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
r AS (SELECT d.doc_id, CASE WHEN quality = 1 THEN text || ' and ' || text ELSE text END AS text FROM documents d LEFT JOIN m USING (doc_id) WHERE toxic IS DISTINCT FROM 1), {_chunks(1000, 100, "r")}
SELECT document_id, chunk_index, char_start, length(content)::int AS character_count, md5(content) AS content_md5 FROM c""",
    "document_lookup": "SELECT l.doc_id * 3 AS doc_id, d.lang, d.source, CASE WHEN d.doc_id IS NULL THEN 'DOCUMENT_NOT_FOUND' END AS error FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id * 3",
    "item_navigation": f"WITH {_chunks(1000, 100)} SELECT document_id, chunk_index, length(content)::int AS character_count FROM c WHERE document_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "item_sources": """WITH c AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 10 = 9 THEN doc_id + 1000000000 ELSE doc_id - doc_id % 2 END AS d FROM documents),
i AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN doc_id - doc_id % 2 WHEN doc_id % 7 = 0 THEN doc_id + 2000000000 END AS own, CASE WHEN doc_id % 5 = 0 THEN 'own.md' END AS name FROM labels),
l AS (SELECT doc_id AS id, unnest([doc_id, CASE WHEN doc_id % 8 = 0 THEN doc_id + 5 ELSE doc_id - doc_id % 2 END]) AS chunk_id FROM labels WHERE doc_id % 4 <> 3),
h AS (SELECT id, min(d) AS a, max(d) AS z, count(*) FILTER (c.chunk_id IS NULL) AS lost FROM l LEFT JOIN c USING (chunk_id) GROUP BY id),
e AS (SELECT i.*, coalesce(a, own) AS doc, k.source AS known, CASE WHEN own IS NOT NULL AND t.doc_id IS NULL THEN 'KNOWLEDGE_ITEM_SOURCE_DOCUMENT_NOT_FOUND' WHEN lost > 0 THEN 'KNOWLEDGE_ITEM_SOURCE_CHUNK_NOT_FOUND'
  WHEN a <> z OR a <> own THEN 'KNOWLEDGE_ITEM_VALIDATION_FAILED' WHEN coalesce(a, own) IS NOT NULL AND k.doc_id IS NULL THEN 'KNOWLEDGE_ITEM_SOURCE_DOCUMENT_NOT_FOUND' END AS error
  FROM i LEFT JOIN h USING (id) LEFT JOIN documents t ON t.doc_id = own LEFT JOIN documents k ON k.doc_id = coalesce(a, own))
SELECT id, CASE WHEN error IS NULL THEN doc END AS document_id, CASE WHEN error IS NULL THEN coalesce(name, known) END AS filename, error FROM e""",
    "patch_duplicates": f"""WITH i AS (SELECT doc_id, {_hash('process_rule', "'t'")} AS h FROM documents), live AS (SELECT * FROM i WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
n AS (SELECT h, count(*) AS n FROM live GROUP BY h) SELECT i.doc_id, coalesce(n, 0) > (l.doc_id IS NOT NULL)::int AS duplicate FROM i LEFT JOIN n USING (h) LEFT JOIN live l ON l.doc_id = i.doc_id""",
    "search_hits": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'h' END || doc_id AS chunk_id, CASE WHEN doc_id % 5 = 2 THEN 0 ELSE coalesce(n_chars / 8::double, 0) END::double AS score, lang
FROM documents WHERE doc_id % 5 IN (0, 1, 2)""",
    "block_listing": """WITH m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, role FROM conversations), u AS (SELECT * FROM m WHERE role IS NULL OR role NOT IN ('system', 'user'))
SELECT conv_id::varchar AS document_id, i::int AS block_index, 'unknown' AS block_type, count(*) OVER () AS total FROM u ORDER BY conv_id % 5 DESC, i, conv_id::varchar LIMIT 50 OFFSET 20""",
    "stored_block_rows": """WITH m AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations)
SELECT conv_id::varchar AS document_id, 'r' AS parse_run_id, i::int AS block_index, CASE role WHEN 'system' THEN 'title' WHEN 'user' THEN 'text' ELSE 'unknown' END AS block_type,
  CASE role WHEN 'system' THEN '{"original_type":"heading","heading_level":1' WHEN 'user' THEN '{"original_type":"Paragraph"' ELSE '{"original_type":"mystery"' END
    || CASE WHEN turn % 2 = 0 THEN ',"asset_keys":["block-' || lpad(i::varchar, 6, '0') || '.png"]}' ELSE '}' END AS source_metadata FROM m""",
}
