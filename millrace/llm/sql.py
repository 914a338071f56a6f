"""DuckDB SQL that must give the rows of queries of this subpackage."""

URLS = r"""
WITH RECURSIVE rules(verdict, rule, rhost, rpath) AS (
  VALUES ('allow', 'com/', 'com', '/'),
         ('block', 'example.com/en/', 'example.com', '/en/'),
         ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
         ('block', 'net/es/', 'net', '/es/'),
         ('block', 'net/fr/', 'net', '/fr/')
),
rest AS (
  SELECT page_id, url, html,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
places AS (
  SELECT page_id, html,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail
  FROM rest
),
tags AS (
  SELECT host, path, host || tail AS node, regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS link
  FROM (SELECT *, unnest(regexp_extract_all(html, '(?i)<link\b[^>]*>')) AS tag FROM places)
  WHERE regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b')
  UNION ALL
  SELECT host, path, host || tail, regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)
  FROM (SELECT *, unnest(regexp_extract_all(html, '(?i)<meta\b[^>]*>')) AS tag FROM places)
  WHERE regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')
),
targets AS (
  SELECT node,
         CASE WHEN instr(link, '://') > 0 THEN substr(link, instr(link, '://') + 3)
              WHEN starts_with(link, '//') THEN substr(link, 3)
              WHEN starts_with(link, '/') THEN host || link
              WHEN starts_with(link, '#') THEN ''
              ELSE host || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || link
         END AS target
  FROM (SELECT * REPLACE (replace(link, '&amp;', '&') AS link) FROM tags WHERE link <> '' AND host <> '')
),
one_way AS (
  SELECT node AS a,
         translate(regexp_extract(target, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
           || regexp_extract(target, '^[^/?#]*([^#]*)', 1) AS b
  FROM targets WHERE regexp_extract(target, '^[^/?#]*') <> ''
),
edges AS (SELECT a, b FROM one_way UNION SELECT b, a FROM one_way),
nodes AS (
  SELECT a AS node, regexp_extract(a, '^[^/?#]*') AS host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path
  FROM edges
),
bad(node) AS (
  SELECT node FROM (
    SELECT node, arg_max(verdict, length(rule)) AS verdict
    FROM nodes JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    GROUP BY node
  ) WHERE verdict = 'block'
  UNION
  SELECT edges.b FROM bad JOIN edges ON edges.a = bad.node
),
judged AS (
  SELECT places.host, places.path, max_by(rule, length(rule)) AS rule, max_by(rules.verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM places) places
  JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY places.host, places.path
)
SELECT page_id, places.host, places.path, judged.rule,
       coalesce(judged.verdict, CASE WHEN bad.node IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       bad.node IS NOT NULL AS alias_blocked
FROM places
LEFT JOIN judged ON judged.host = places.host AND judged.path = places.path
LEFT JOIN bad ON places.host <> '' AND bad.node = places.host || places.tail
"""

LINES = r"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site,
         unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents
),
spread AS (
  SELECT line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY line HAVING count(DISTINCT site) >= 10
),
marked AS (SELECT lines.*, spread.line IS NOT NULL AS hit FROM lines LEFT JOIN spread USING (line)),
cleaned AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hit) AS n_hit,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT hit), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines,
       coalesce(n_hit, 0) AS n_removed, md5(CASE WHEN n_hit > 0 THEN kept ELSE text END) AS kept_md5
FROM documents LEFT JOIN cleaned USING (doc_id)
"""

#: The repair as a recursion over turns: the cheapest, then least, edits per state
#: (0 start, 1 system, 2 user, 3 assistant) and the turns that they leave.
CONVERSATIONS = r"""
WITH RECURSIVE places AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place
  FROM conversations
),
sums AS (
  SELECT *, xor(list_reduce(
    list_transform(string_split(place, ''), lambda c: ascii(c)::BIGINT),
    lambda sum, byte: list_reduce(
      [xor(sum, byte), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, step: xor(x >> 1, (x & 1) * 3988292384)),
    4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM places
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM sums WHERE kind <> 0
),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place
  FROM damaged
),
faults AS (
  SELECT *, role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY place) AS previous,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM turns
),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
),
inserts(q, state, cost, edits, lines) AS (
  VALUES (0, 0, 0, '', []), (0, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']),
         (1, 1, 0, '', []), (1, 2, 5, 'I', ['user:']), (1, 3, 10, 'II', ['user:', 'assistant:']),
         (2, 2, 0, '', []), (2, 3, 5, 'I', ['assistant:']),
         (3, 3, 0, '', []), (3, 2, 5, 'I', ['user:'])
),
edits(state, op, initial, cost, next_state, new_role) AS (
  VALUES (0, 'K', 's', 0, 1, NULL), (0, 'K', 'u', 0, 2, NULL), (1, 'K', 'u', 0, 2, NULL),
         (2, 'K', 'a', 0, 3, NULL), (3, 'K', 'u', 0, 2, NULL),
         (0, 'R', NULL, 1, 2, 'user'), (1, 'R', NULL, 1, 2, 'user'), (2, 'R', NULL, 1, 3, 'assistant'),
         (3, 'R', NULL, 1, 2, 'user'),
         (0, 'D', NULL, 2, 0, NULL), (1, 'D', NULL, 2, 1, NULL), (2, 'D', NULL, 2, 2, NULL), (3, 'D', NULL, 2, 3, NULL)
),
ways(conv_id, place, state, cost, audit, lines) AS (
  SELECT conv_id, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM counts
  UNION ALL
  SELECT conv_id, place, best.next_state, best.cost, best.audit, best.lines FROM (
    SELECT ways.conv_id, ways.place + 1 AS place, edits.next_state, min(struct_pack(
      cost := ways.cost + inserts.cost + edits.cost + CASE WHEN faults.fault = 'truncated' AND op <> 'D' THEN 5 ELSE 0 END,
      audit := ways.audit || inserts.edits || op,
      next_state := edits.next_state,
      lines := ways.lines || inserts.lines
        || CASE WHEN op = 'D' THEN [] ELSE [coalesce(new_role, faults.role) || ':' || faults.text] END)) AS best
    FROM ways
    JOIN faults ON faults.conv_id IS NOT DISTINCT FROM ways.conv_id AND faults.place = ways.place + 1
    JOIN inserts ON inserts.q = ways.state
    JOIN edits ON edits.state = inserts.state AND (op <> 'K' OR edits.initial = faults.initial)
      AND (op = 'D' OR faults.fault NOT IN ('blank', 'duplicate'))
    GROUP BY ways.conv_id, ways.place, edits.next_state
  )
),
ends AS (
  SELECT ways.conv_id, min(struct_pack(cost := ways.cost + inserts.cost, audit := ways.audit || inserts.edits,
                                       lines := ways.lines || inserts.lines)) AS best
  FROM ways
  JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ways.conv_id AND counts.n = ways.place
  JOIN inserts ON inserts.q = ways.state AND inserts.state IN (0, 3)
  GROUP BY ways.conv_id
),
names AS (SELECT DISTINCT conv_id FROM conversations)
SELECT names.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(ends.best.cost, 0)::BIGINT AS cost, coalesce(ends.best.audit, '') AS audit,
       sha256(coalesce(array_to_string(ends.best.lines, chr(10)), '')) AS repaired_sha256
FROM names
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM names.conv_id
LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM names.conv_id
"""

NEGATIVES = r"""
WITH vectors AS (
  SELECT row_number() OVER () AS place, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS whole
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT a.place, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_inner_product(a.whole, b.whole)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.place <> b.place
  WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT place, anchor_id, other_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY place ORDER BY score DESC, other_id NULLS FIRST) AS number
  FROM scores WHERE same QUALIFY number <= 5
)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.place, number ORDER BY score DESC, other_id NULLS FIRST)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores n ON n.place = p.place AND NOT n.same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
