"""DuckDB SQL with the same rows as the queries over blocks of a layout."""

from __future__ import annotations

from millrace.plans.oracles import _strip


def _grouped(name: str, of: str, most: int, joint: int) -> str:
    """Units (key, k from 1, unit) with a group g each: one goes on while its lengths and seams make most at most."""
    return f"""
{name} AS (
  SELECT key, k, unit, 0 AS g, length(unit) AS filled FROM {of} WHERE k = 1
  UNION ALL
  SELECT u.key, u.k, u.unit, CASE WHEN s.filled + {joint} + length(u.unit) <= {most} THEN s.g ELSE s.g + 1 END,
    CASE WHEN s.filled + {joint} + length(u.unit) <= {most} THEN s.filled + {joint} + length(u.unit) ELSE length(u.unit) END
  FROM {name} s JOIN {of} u ON u.key = s.key AND u.k = s.k + 1)"""


#: Blocks as layout_blocks() makes them, rendered; headers and blanks left out, each with the title above it.
_BLOCKS = f"""
line AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS i, unnest(parts) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
kinds AS (SELECT doc_id, i, {_strip("text")} AS t, CASE WHEN length(text) < 60 THEN 'title' ELSE ['table', 'formula', 'image', 'header', 'list', 'text', 'text', 'text'][(doc_id + i) % 8 + 1] END AS kind,
  (doc_id + i) % 8 = 5 AND length(text) >= 60 AS starred FROM line),
shown AS (SELECT *, CASE WHEN kind = 'table' THEN '| ' || t || ' |' WHEN kind = 'formula' AND doc_id % 2 = 0 THEN '$$' || chr(10) || t || chr(10) || '$$' WHEN kind = 'formula' THEN t || chr(10) || chr(10) || '$$' || chr(10) || t || chr(10) || '$$'
  WHEN kind = 'image' THEN 'Figure ' || i || chr(10) || chr(10) || t WHEN starred THEN t || chr(10) || chr(10) || '* ' || t ELSE t END AS content,
  CASE WHEN kind = 'table' OR (kind = 'formula' AND doc_id % 2 = 0) THEN 'markdown' WHEN kind = 'formula' OR starred THEN 'mixed' ELSE 'plain_text' END AS form FROM kinds WHERE t <> '' AND kind <> 'header'),
b AS MATERIALIZED (SELECT *, row_number() OVER w AS j, last_value(CASE WHEN kind = 'title' THEN content END IGNORE NULLS) OVER w AS section,
  CASE WHEN kind = 'table' THEN 'closes' WHEN length(content) > 1000 THEN 'apart' ELSE 'joins' END AS how FROM shown WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""

#: Pieces (doc_id, i, g, piece) of long texts: paragraphs cut at the last space within 1000, packed again, a short end joined
#: to what is before it, and each later piece led by the last words of the one before.
_PIECES = f"""
para AS (SELECT doc_id, i, generate_subscripts(ps, 1) AS p, unnest(ps) AS x FROM (SELECT doc_id, i, string_split(content, chr(10) || chr(10)) AS ps FROM b WHERE how = 'apart' AND kind <> 'formula')),
cut AS (
  SELECT doc_id, i, p, 0 AS n, '' AS unit, {_strip("x")} AS rest FROM para
  UNION ALL
  SELECT doc_id, i, p, n + 1, {_strip("left(rest, ends::int)")}, {_strip("substring(rest, ends::int + 1)")}
  FROM (SELECT *, CASE WHEN length(rest) <= 1000 THEN length(rest) WHEN back = 0 THEN 1000 ELSE 1001 - back END AS ends FROM (SELECT *, strpos(reverse(substring(rest, 2, 1000)), ' ') AS back FROM cut WHERE rest <> ''))),
unit AS MATERIALIZED (SELECT (doc_id, i) AS key, unit, row_number() OVER (PARTITION BY doc_id, i ORDER BY p, n) AS k FROM cut WHERE n > 0),
{_grouped("packed", "unit", 1000, 2)},
sized AS (SELECT key, g, sum(length(unit)) + 2 * (count(*) - 1) AS size FROM packed GROUP BY key, g),
ends AS (SELECT key, max(g) AS last, arg_max(size, g) AS size FROM sized GROUP BY key),
joined AS (SELECT e.key, e.last FROM ends e JOIN sized s ON s.key = e.key AND s.g = e.last - 1 WHERE e.size < 200 AND s.size + 2 + e.size <= 1000),
bare AS (SELECT key, g, string_agg(unit, chr(10) || chr(10) ORDER BY k) AS piece FROM (SELECT p.key, p.k, p.unit, CASE WHEN p.g = j.last THEN p.g - 1 ELSE p.g END AS g FROM packed p LEFT JOIN joined j ON j.key = p.key) GROUP BY key, g),
tail AS (SELECT *, {_strip("right(lag(piece) OVER (PARTITION BY key ORDER BY g), 100)")} AS w FROM bare),
lead AS (SELECT *, CASE WHEN strpos(w, ' ') = 0 THEN w ELSE {_strip("substring(w, strpos(w, ' ') + 1)")} END AS words FROM tail),
piece AS MATERIALIZED (
  SELECT key[1] AS doc_id, key[2] AS i, g, CASE WHEN coalesce(words, '') <> '' AND length(words) + 2 + length(piece) <= 1000 THEN words || chr(10) || chr(10) || piece ELSE piece END AS piece FROM lead
  UNION ALL SELECT doc_id, i, 0, content FROM b WHERE how = 'apart' AND kind = 'formula')"""

#: Parts (doc_id, chunk, part, i, fragment) of chunks: a block joins the open chunk of its section if it fits; a table only one of titles, and closes it.
_PARTS = f"""
item AS MATERIALIZED (SELECT b.*, length(content) AS need, coalesce(n, 1) AS pieces FROM b LEFT JOIN (SELECT doc_id, i, count(*) AS n FROM piece GROUP BY doc_id, i) USING (doc_id, i)),
pack AS (
  SELECT doc_id, 0::bigint AS j, 0::bigint AS chunk, 0 AS part, 0::bigint AS number, 0 AS parts, 0::bigint AS size, NULL::varchar AS held_by, true AS titles FROM item WHERE j = 1
  UNION ALL
  SELECT doc_id, j, at_number, at_parts, CASE how WHEN 'apart' THEN at_number + pieces WHEN 'closes' THEN at_number + 1 ELSE at_number END, CASE how WHEN 'joins' THEN at_parts + 1 ELSE 0 END,
    CASE how WHEN 'joins' THEN at_size + need ELSE 0 END, section, CASE how WHEN 'joins' THEN at_titles AND kind = 'title' ELSE true END
  FROM (SELECT *, CASE WHEN parts > 0 AND NOT stays THEN number + 1 ELSE number END AS at_number, CASE WHEN stays THEN parts ELSE 0 END AS at_parts, CASE WHEN stays THEN size ELSE 0 END AS at_size, titles OR NOT stays AS at_titles
    FROM (SELECT i.doc_id, i.j, i.how, i.pieces, i.need, i.kind, i.section, p.number, p.parts, p.size, p.titles,
      parts > 0 AND i.section IS NOT DISTINCT FROM p.held_by AND i.how <> 'apart' AND (i.how = 'joins' OR p.titles) AND p.size + 2 * p.parts + i.need <= 1000 AS stays
      FROM pack p JOIN item i ON i.doc_id = p.doc_id AND i.j = p.j + 1))),
part AS (
  SELECT doc_id, chunk, part, item.i, item.content AS fragment, kind, form, section FROM pack JOIN item USING (doc_id, j) WHERE how <> 'apart'
  UNION ALL SELECT doc_id, chunk + g, 0, item.i, piece, kind, form, section FROM pack JOIN item USING (doc_id, j) JOIN piece USING (doc_id, i) WHERE how = 'apart')"""

_LAYOUT = f"WITH RECURSIVE {_BLOCKS}, {_PIECES}, {_PARTS}"

_META = """WITH m AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations)"""

ORACLES = {
    "layout_chunks": f"""{_LAYOUT},
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk, kind ORDER BY part) = 1 AS new FROM part),
held AS (SELECT doc_id, chunk, {_strip(f"string_agg({_strip('fragment')}, chr(10) || chr(10) ORDER BY part)")} AS content, min(i // 5 + 1)::int AS page_start, max(i // 5 + 1 + i % 2)::int AS page_end, arg_min(section, part) AS section_title,
  list(DISTINCT kind) AS kinds, count(DISTINCT form) AS n_forms, min(form) AS form, string_agg('b' || i, '|' ORDER BY part) AS block_keys, string_agg(kind, '|' ORDER BY part) FILTER (new) AS block_types,
  coalesce(string_agg(i || '.png', '|' ORDER BY part) FILTER (kind = 'image'), '') AS asset_keys FROM kept GROUP BY doc_id, chunk)
SELECT doc_id::varchar AS document_id, chunk::int AS chunk_index, content, page_start, page_end, section_title,
  CASE WHEN list_has_all(['title', 'text', 'list'], kinds) THEN 'text' WHEN list_has_all(['title', 'table'], kinds) THEN 'table' WHEN list_has_all(['title', 'formula'], kinds) THEN 'formula' WHEN list_has_all(['title', 'image'], kinds) THEN 'image_caption' ELSE 'mixed' END AS chunk_type,
  CASE WHEN n_forms = 1 THEN form ELSE 'mixed' END AS content_format, block_keys, block_types, asset_keys, greatest(1, ceil(length(content) / 4))::int AS token_count FROM held""",
    "layout_lineage": f"""{_LAYOUT}
SELECT doc_id::varchar AS document_id, sha256(doc_id || chr(10) || 'r' || chr(10) || chunk) AS chunk_id, i::int AS block_index, part::int AS block_order, NULL::varchar AS error FROM part""",
    "table_chunks": f"""WITH RECURSIVE t AS (SELECT doc_id, {_strip("text")} AS content FROM documents WHERE {_strip("text")} <> ''),
row_ AS (SELECT doc_id, generate_subscripts(parts, 1) AS n, unnest(parts) AS x FROM (SELECT doc_id, string_split(content, chr(10)) AS parts FROM t WHERE length(content) > 1500)),
unit AS MATERIALIZED (SELECT doc_id AS key, x AS unit, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM row_ WHERE {_strip("x")} <> ''),
{_grouped("packed", "unit", 1500, 1)},
held AS (SELECT key AS doc_id, g, {_strip("string_agg(unit, chr(10) ORDER BY k)")} AS content FROM packed GROUP BY key, g UNION ALL SELECT doc_id, 0, content FROM t WHERE length(content) <= 1500)
SELECT doc_id::varchar AS document_id, g::int AS chunk_index, content, 'table' AS chunk_type, 'markdown' AS content_format, greatest(1, ceil(length(content) / 4))::int AS token_count FROM held""",
    "block_metadata": f"""{_META}
SELECT conv_id::varchar AS document_id, i::int AS block_index, CASE role WHEN 'system' THEN '{{"original_type":"heading","heading_level":1}}' WHEN 'user' THEN '{{"original_type":"Paragraph"}}' ELSE '{{"original_type":"mystery"}}' END AS source_metadata FROM m""",
    "parse_run_totals": f"""{_META}
SELECT conv_id::varchar AS document_id, count(*) AS block_count, count(DISTINCT CASE WHEN turn % 2 = 1 THEN CASE role WHEN 'system' THEN 'title' WHEN 'user' THEN 'text' ELSE 'unknown' END END) AS asset_count, (max(turn) + 1)::int AS page_count,
  'parsed-assets/' || conv_id || '/r/output.md' AS output_markdown_key, 'parsed-assets/' || conv_id || '/r/output.json' AS output_json_key FROM m GROUP BY conv_id""",
    "asset_union": """SELECT source AS document_id, n_chars || '.png' AS asset_key, arg_min(lang, (doc_id % 3, doc_id)) AS caption, min(doc_id % 3)::int AS origin FROM documents GROUP BY source, n_chars""",
}
