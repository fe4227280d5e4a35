"""DuckDB SQL with the same rows as the queries over knowledge items and the search of an index."""

from __future__ import annotations

from millrace.plans.oracles import _DICTIONARY, _MOVES, _V, _bm25, _case, _chunks, _fusion, _keywords, _ranked, _squeeze, _strip
from millrace.plans.queries import ACTIONS


def _digest(title: str, content: str, document: str = "''") -> str:
    return f"sha256(concat_ws(chr(10), 'process_rule', {document}, {_squeeze(title)}, {_squeeze(content)}))"


_ITEMS = f"""
i AS (SELECT doc_id AS id, source AS title, text AS content, ['draft', 'rejected', 'approved', 'deprecated', 'pending_review'][doc_id % 5 + 1] AS status, {_digest("source", "text")} AS h FROM documents)"""

ORACLES = {
    "item_creation": f"""WITH c AS (SELECT doc_id AS id, CASE WHEN doc_id % 13 = 5 THEN '' ELSE {_strip("text")} END AS content, source AS title, CASE WHEN doc_id % 4 = 0 AND doc_id % 12 <> 8 THEN doc_id - doc_id % 2 END AS doc,
  CASE WHEN doc_id % 11 = 4 THEN 'KNOWLEDGE_ITEM_VALIDATION_FAILED' WHEN doc_id % 17 = 3 THEN 'KNOWLEDGE_ITEM_INVALID_STATUS' WHEN doc_id % 13 = 5 OR {_strip("text")} = '' OR {_strip("source")} = '' THEN 'KNOWLEDGE_ITEM_VALIDATION_FAILED'
    WHEN doc_id % 12 = 8 THEN 'KNOWLEDGE_ITEM_SOURCE_CHUNK_NOT_FOUND' END AS fault FROM documents),
s AS (SELECT c.*, d.source AS name, coalesce(fault, CASE WHEN doc IS NOT NULL AND d.doc_id IS NULL THEN 'KNOWLEDGE_ITEM_SOURCE_DOCUMENT_NOT_FOUND' END) AS wrong FROM c LEFT JOIN documents d ON d.doc_id = c.doc),
h AS (SELECT *, {_digest("title", "content", "coalesce(doc::varchar, '')")} AS hash FROM s),
live AS (SELECT DISTINCT {_digest("source", "text")} AS hash FROM documents JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id) WHERE toxic IS DISTINCT FROM 1),
r AS (SELECT *, row_number() OVER (PARTITION BY hash, wrong IS NULL ORDER BY id) > 1 OR (doc IS NULL AND hash IN (SELECT hash FROM live)) AS double FROM h),
e AS (SELECT *, coalesce(wrong, CASE WHEN double THEN 'KNOWLEDGE_ITEM_DUPLICATE' END) AS error FROM r)
SELECT id, CASE WHEN error IS NULL THEN 'draft' END AS status, CASE WHEN error IS NULL THEN doc END AS source_document_id, CASE WHEN error IS NULL THEN name END AS source_filename, CASE WHEN error IS NULL THEN hash END AS content_hash,
  CASE WHEN error IS NULL THEN CASE WHEN doc IS NULL THEN '[]' ELSE '["' || id || '"]' END END AS chunk_ids, error FROM e""",
    "item_updates": f"""WITH {_ITEMS}, m AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id),
p AS (SELECT CASE WHEN doc_id % 10 = 9 THEN doc_id + 1000000000 ELSE doc_id END AS id, coalesce(q = 1, false) AS titled, coalesce(t = 1, false) AS told, doc_id % 7 = 0 AS blank FROM m),
n AS (SELECT p.id, CASE WHEN titled THEN 'new title' ELSE i.title END AS title, CASE WHEN told THEN 'the same' ELSE i.content END AS content, CASE WHEN i.id IS NULL THEN 'KNOWLEDGE_ITEM_NOT_FOUND'
  WHEN status NOT IN ('draft', 'rejected') THEN 'KNOWLEDGE_ITEM_INVALID_STATUS' WHEN titled AND blank THEN 'KNOWLEDGE_ITEM_VALIDATION_FAILED' END AS fault FROM p LEFT JOIN i USING (id)),
h AS (SELECT *, {_digest("title", "content")} AS hash FROM n),
d AS (SELECT *, fault IS NULL AND EXISTS (SELECT 1 FROM i WHERE i.h = h.hash AND i.id <> h.id AND status <> 'deprecated') AS taken FROM h),
r AS (SELECT *, taken OR row_number() OVER (PARTITION BY hash, fault IS NULL AND NOT taken ORDER BY id) > 1 AS double FROM d),
e AS (SELECT *, coalesce(fault, CASE WHEN double THEN 'KNOWLEDGE_ITEM_DUPLICATE' END) AS error FROM r)
SELECT id, CASE WHEN error IS NULL THEN 4 END AS version, CASE WHEN error IS NULL THEN hash END AS content_hash, CASE WHEN error IS NULL THEN title END AS snapshot_title, error FROM e""",
    "item_revisions": f"""WITH {_ITEMS}, w AS (SELECT DISTINCT doc_id + CASE WHEN doc_id % 9 = 8 THEN 1000000000 ELSE 0 END AS id FROM labels),
e AS (SELECT w.id, CASE WHEN i.id IS NULL THEN 'KNOWLEDGE_ITEM_NOT_FOUND' WHEN status NOT IN ('approved', 'deprecated') THEN 'KNOWLEDGE_ITEM_INVALID_TRANSITION' END AS error FROM w LEFT JOIN i USING (id))
SELECT CASE WHEN error IS NULL THEN id + 5000000000 ELSE id END AS id, CASE WHEN error IS NULL THEN id END AS revises_item_id, CASE WHEN error IS NULL THEN 'draft' END AS status, CASE WHEN error IS NULL THEN 1 END AS version,
  CASE WHEN error IS NULL AND id % 4 > 0 THEN array_to_string(list_transform(range(0, id % 4), lambda n: id || '-' || n), '|') END AS chunk_ids, error FROM e""",
    "review_log": f"""WITH RECURSIVE m(action, was, becomes) AS (VALUES {_MOVES}),
e AS (SELECT user_id, event_id, {_case(ACTIONS, "event_type")} AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (
  SELECT user_id, 0::bigint AS n, NULL::bigint AS event_id, NULL::varchar AS action, NULL::varchar AS was, NULL::varchar AS becomes, 'draft' AS status FROM (SELECT DISTINCT user_id FROM e WHERE user_id % 10 <> 7)
  UNION ALL
  SELECT s.user_id, e.n, e.event_id, e.action, s.status, m.becomes, coalesce(m.becomes, s.status) FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1 LEFT JOIN m ON m.action = e.action AND m.was = s.status)
SELECT user_id, event_id, action, was AS from_status, becomes AS to_status, CASE WHEN becomes IS NULL THEN 'KNOWLEDGE_ITEM_INVALID_TRANSITION' END AS error FROM s WHERE n > 0
UNION ALL SELECT user_id, event_id, action, NULL, NULL, 'KNOWLEDGE_ITEM_NOT_FOUND' FROM e WHERE user_id % 10 = 7""",
    "revision_roots": """WITH RECURSIVE i AS (SELECT doc_id AS id, CASE WHEN doc_id % 50 <> 0 THEN doc_id - 1 END AS up FROM documents),
w AS (SELECT id, coalesce(up, id) AS root, (up IS NOT NULL)::int AS depth FROM i UNION ALL SELECT w.id, i.up, depth + 1 FROM w JOIN i ON i.id = w.root WHERE i.up IS NOT NULL AND depth > 0)
SELECT id, arg_max(root, depth) AS root_id, max(depth) AS depth, NULL::varchar AS error FROM w GROUP BY id""",
    "item_page": f"""WITH {_ITEMS}, f AS (SELECT * FROM i WHERE status = 'approved' AND (title ILIKE '%an%' OR content ILIKE '%an%'))
SELECT id, length(content)::int AS n_chars, (SELECT count(*) FROM f) AS total FROM f ORDER BY n_chars DESC, id LIMIT 20 OFFSET 5""",
    "explicit_chunks": f"""WITH {_chunks(1000, 100)}, w AS (SELECT doc_id, unnest(range(0, doc_id % 25 + 1)) AS position FROM labels),
k AS (SELECT doc_id, CASE WHEN position = 0 AND doc_id % 7 = 0 THEN doc_id + 1 ELSE doc_id END AS d, position AS n FROM w),
g AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (c.document_id IS NULL) AS lost, min(document_id) AS least, max(document_id) AS most, sum(length(content)) AS chars FROM k LEFT JOIN c ON c.document_id = k.d AND c.chunk_index = k.n GROUP BY doc_id)
SELECT doc_id AS request_id, n_chunks, CASE WHEN n_chunks > 20 THEN 'KNOWLEDGE_ITEM_CONFIG_INVALID' WHEN lost > 0 THEN 'KNOWLEDGE_ITEM_SOURCE_CHUNK_NOT_FOUND'
  WHEN least <> most OR (doc_id % 3 = 0 AND doc_id <> least) OR chars > 12000 THEN 'KNOWLEDGE_ITEM_CONFIG_INVALID' END AS error FROM g""",
    "chunk_search": f"""WITH {_V}, ok AS (SELECT id FROM v WHERE status = 'embedded' AND model = 'm' AND dim = 64),
en AS (SELECT doc_id::varchar AS doc_id, text, source FROM documents WHERE doc_id::varchar IN (SELECT id FROM ok)), ev AS (SELECT vec_id::varchar AS vec_id, embedding FROM embeddings WHERE vec_id::varchar IN (SELECT doc_id FROM en)),
t AS (SELECT item_id, {_strip("coalesce(text, '')")} AS text FROM benchmark WHERE item_id % 20 = 0),
x AS (SELECT item_id, sha256((i - 1) || ':' || substring(text, i::int, 1)) AS h FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM t)),
s AS (SELECT item_id, ('0x' || substring(h, 1, 8))::bigint % 64 AS b, sum(CASE WHEN ('0x' || substring(h, 9, 2))::bigint % 2 = 0 THEN 1 ELSE -1 END * (0.5::double + ('0x' || substring(h, 11, 2))::bigint / 255)) AS w FROM x GROUP BY 1, 2),
q AS (SELECT item_id AS query_id, any_value(text) AS text, list(coalesce(w, 0::double) ORDER BY b) AS embedding FROM t CROSS JOIN (SELECT unnest(range(0, 64)) AS b) LEFT JOIN s USING (item_id, b) WHERE text <> '' GROUP BY item_id),
{_bm25("k0", "text", "en")}, ks AS (SELECT query_id, id, score * 3.0::double AS score FROM k0),
vs AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(v.embedding::double[], q.embedding), 9) AS score FROM ev v, q), {_ranked("kr", "ks", 50)}, {_ranked("vr", "vs", 50)}, {_fusion(20, 0.5, 0.5)}
SELECT query_id, position::int AS position, id AS chunk_id, id AS document_id, en.source AS original_filename, 0 AS chunk_index, md5(en.text) AS content_md5, '{{}}' AS source_metadata, retrieval_source, round(kr.score, 6) AS keyword_score, round(vr.score, 6) AS vector_score,
  h.keyword_rank::int AS keyword_rank, h.vector_rank::int AS vector_rank, round(hybrid_score, 9) AS hybrid_score, {_keywords("q.text", "en.text", _DICTIONARY)} AS keywords, 'm' AS embedding_model, 64 AS embedding_dim
FROM h JOIN q USING (query_id) JOIN en ON en.doc_id = h.id LEFT JOIN kr USING (query_id, id) LEFT JOIN vr USING (query_id, id)""",
}
