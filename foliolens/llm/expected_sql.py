"""The SQL that queries of this package must agree with, where SQL can express them."""

from foliolens.llm.license_templates import TEMPLATES

SQL = {}

# The templates as rows; the comparison looks at every pair of a part and a template.
_TEMPLATE_ROWS = ", ".join(
    "({}, '{}', '{}')".format(number, name, text.replace("'", "''")) for number, (name, text) in enumerate(TEMPLATES)
)

SQL["op5_license_scan"] = rf"""
WITH templates(t, name, text) AS (VALUES {_TEMPLATE_ROWS}),
lines AS (
  SELECT doc_id, 'line' || i AS part, l FROM (
    SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), blocks AS (
  SELECT doc_id, unnest(bs) AS b, unnest(range(len(bs))) AS i, len(bs) AS n
  FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\n([ \t\r\x0B\x0C]*\n)+') AS bs FROM documents)
), parts AS (
  SELECT * FROM lines
  UNION ALL SELECT doc_id, 'block' || i, b FROM blocks WHERE contains(trim(b, chr(10)), chr(10))
  UNION ALL SELECT doc_id, 'text', text FROM documents WHERE doc_id IN (SELECT doc_id FROM blocks WHERE n > 1)
), words AS (
  SELECT doc_id, part, regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM parts
), pairs AS (
  SELECT DISTINCT doc_id, part, w[i] || ' ' || w[i + 1] AS pair FROM words, unnest(range(1, len(w))) AS r(i)
), sizes AS (SELECT doc_id, part, count(*) AS a FROM pairs GROUP BY ALL),
template_words AS (
  SELECT t, name, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM templates
), template_pairs AS (
  SELECT DISTINCT t, name, w[i] || ' ' || w[i + 1] AS pair FROM template_words, unnest(range(1, len(w))) AS r(i)
), template_sizes AS (SELECT t, count(*) AS b FROM template_pairs GROUP BY ALL),
shared AS (SELECT doc_id, part, t, name, count(*) AS c FROM pairs JOIN template_pairs USING (pair) GROUP BY ALL),
scored AS (
  SELECT doc_id, part, name, 2.0::DOUBLE * c / (a + b) AS dice
  FROM shared JOIN sizes USING (doc_id, part) JOIN template_sizes USING (t)
), best AS (
  SELECT * FROM scored WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, part ORDER BY dice DESC, name) = 1
), found AS (
  SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(*) AS n_parts, max(dice) AS best_dice FROM best GROUP BY doc_id
)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n_parts, 0)::BIGINT AS n_parts, best_dice
FROM documents LEFT JOIN found USING (doc_id)
"""

SQL["op1_decontamination"] = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS phrase
  FROM items, unnest(range(1, greatest(2, len(w) - 11))) AS r(s) WHERE len(w) > 0
), widths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM docs, widths, unnest(range(1, len(w) - n + 2)) AS r(s)
), hits AS (SELECT doc_id, item_id, s, n FROM grams JOIN windows USING (n, phrase)),
counts AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM hits, unnest(range(s, s + n)) AS r(p) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN counts USING (doc_id) LEFT JOIN named USING (doc_id)
"""

SQL["op3_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (
    SELECT doc_id, unnest(parts) AS l, unnest(range(len(parts))) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
  )
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT lines.*, keeper IS NOT NULL AND doc_id <> keeper AS dropped FROM lines LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SQL["op6_chat"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + length(text) + 2 * length(role) - length(replace(role, chr(92), '')) - length(replace(role, chr(10), ''))
    + length(text) - length(replace(text, chr(92), '')))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""

SQL["op8_mixing"] = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sizes GROUP BY source
), ordered AS (
  SELECT *, 3 * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS total,
    (coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS caps_before,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM sources WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST)
), levels AS (
  SELECT *, max(CASE WHEN cap > (total - caps_before) / weight_left * weight THEN (total - caps_before) / weight_left END) OVER () AS level
  FROM ordered
), targets AS (
  SELECT source, source_size, kind, round(CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END, 6)::DOUBLE AS target FROM levels
), placed AS (
  SELECT s.*, source_size, target, kind, round(target)::BIGINT AS aim,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5(doc_id::VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taking AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE aim // source_size END AS whole,
    CASE WHEN source_size = 0 THEN 0 ELSE greatest(0, least(size, aim % source_size - before)) END AS part, before / target AS share
  FROM placed
)
SELECT doc_id, size, source_size, target, (whole * size + part)::BIGINT AS taken,
  CASE WHEN whole * size + part > 0 THEN round(CASE kind WHEN 0 THEN 1 - sqrt(1 - share) WHEN 1 THEN share ELSE sqrt(share) END, 9) END AS position,
  (CASE WHEN whole * size + part > 0 THEN whole + (part > 0)::INT ELSE 0 END)::BIGINT AS n_passes
FROM taking
"""

SQL["op9_warc"] = r"""
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first,
    array_to_string([lpad(bin(('0x' || d)::INTEGER), 4, '0') FOR d IN string_split(sha1(coalesce(html, '')), '')], '') AS bits
  FROM pages
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string([
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
      1 + 16 * substr(bits, 5 * i + 1, 1)::INTEGER + 8 * substr(bits, 5 * i + 2, 1)::INTEGER
      + 4 * substr(bits, 5 * i + 3, 1)::INTEGER + 2 * substr(bits, 5 * i + 4, 1)::INTEGER + substr(bits, 5 * i + 5, 1)::INTEGER
    ] FOR i IN range(32)
  ], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM hashed
"""

# The checksum of a decimal id, bit by bit; a node of the trie is the hashes of its turns end to end.
SQL["op12_prefix_trie"] = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, coalesce(role, '') AS role, sha256(coalesce(text, '')) AS t,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn
  FROM conversations
), turns AS (
  SELECT conv_id, sha256(t || role) AS hash, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t) AS place
  FROM said
), convs AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY ALL),
bits(conv_id, i, c) AS (
  SELECT conv_id, 0, 4294967295::BIGINT FROM convs
  UNION ALL
  SELECT conv_id, i + 1, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END FROM (
    SELECT conv_id, i, CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(conv_id::VARCHAR, i // 8 + 1, 1))::BIGINT) ELSE c END AS x
    FROM bits WHERE i < 8 * len(conv_id::VARCHAR)
  )
), taken AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(c, 4294967295::BIGINT) % 4 AS h FROM bits WHERE i = 8 * len(conv_id::VARCHAR)
), parts AS (
  SELECT taken.conv_id, 0 AS own, place, hash, words FROM taken JOIN turns ON turns.conv_id = base AND place <= h
  UNION ALL
  SELECT conv_id, 1, place, hash, words FROM taken JOIN turns USING (conv_id) WHERE place > h
), lists AS (
  SELECT conv_id, coalesce(list(hash ORDER BY own, place) FILTER (WHERE hash IS NOT NULL), []) AS s,
    list(words ORDER BY own, place) AS w
  FROM convs LEFT JOIN parts USING (conv_id) GROUP BY conv_id
), prefixes AS (
  SELECT conv_id, d, len(s) AS n, array_to_string(s[1:d], '') AS node, array_to_string(s[1:d - 1], '') AS above, w[d] AS words
  FROM lists, unnest(range(len(s) + 1)) AS r(d)
), nodes AS (
  SELECT node, d, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * max(words) END AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY node, d
), children AS (SELECT above, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY above),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children ON children.above = nodes.node),
below AS (
  SELECT a.node, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum(b.saved) AS saved_tokens
  FROM counted a JOIN counted b ON starts_with(b.node, a.node) GROUP BY a.node
)
SELECT c.conv_id, c.d::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children::BIGINT AS n_children, n_leaves,
  saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN below USING (node) LEFT JOIN nodes p ON c.d > 0 AND p.node = c.above
"""
