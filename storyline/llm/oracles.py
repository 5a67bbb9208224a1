"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import string

LOWERED = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
WORD_LIST = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""WITH doc AS (SELECT doc_id, {WORD_LIST} AS ws FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORD_LIST} AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(ws), 13) AS k, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS g
  FROM item, range(1, greatest(len(ws) - 12, 1) + 1) r(i) WHERE len(ws) > 0),
width AS (SELECT DISTINCT k FROM win),
gram AS (
  SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT * FROM doc, width WHERE len(ws) >= k), range(1, len(ws) - k + 2) r(i)),
hit AS (SELECT doc_id, i, k, item FROM gram JOIN win USING (k, g)),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, k FROM hit), range(i, i + k) r(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

NEAR_DUPLICATES = r"""WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
usable AS (SELECT * FROM v WHERE label IS NOT NULL AND list_inner_product(v, v) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, least(vec_id, coalesce(b, vec_id)) = vec_id AS kept
FROM v LEFT JOIN counted c ON c.a = vec_id LEFT JOIN least l ON l.a = vec_id"""

CHAT = r"""WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) h(n, role)),
written AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn') AS escaped FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<turn ' || role || '>' || escaped || '</turn>') + 2) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id"""

COLLOCATIONS = rf"""WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWERED}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
ws AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
word AS (SELECT id, lang, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM ws),
next AS (SELECT lang, x, lead(x) OVER (PARTITION BY id ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY id ORDER BY i) AS z FROM word),
gram AS (
  SELECT lang, 1 AS k, x AS g, count(*) AS f FROM next GROUP BY ALL
  UNION ALL SELECT lang, 2, x || ' ' || y, count(*) FROM next WHERE y IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z, count(*) FROM next WHERE z IS NOT NULL GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM gram WHERE k = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT lang, k, g, string_split(g, ' ') AS words, f FROM gram WHERE f >= 10),
cut AS (
  SELECT lang, k, words, g, f AS a, unnest(CASE k WHEN 2 THEN [1] ELSE [1, 2] END) AS j FROM often WHERE k >= 2),
part AS (SELECT *, array_to_string(words[1:j], ' ') AS g1, array_to_string(words[j + 1:], ' ') AS g2 FROM cut),
scored AS (
  SELECT part.*, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM part JOIN often x ON x.lang = part.lang AND x.g = g1 JOIN often y ON y.lang = part.lang AND y.g = g2),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
around AS (
  SELECT DISTINCT lang, g FROM (
    SELECT lang, a, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS g FROM best WHERE k = 3) t
  JOIN (SELECT lang, g, a AS own FROM best WHERE k = 2) s USING (lang, g) WHERE 100 * a >= 50 * own)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM best ANTI JOIN around USING (lang, g) JOIN total USING (lang) QUALIFY rank <= 2000"""

PREFIX_TRIE = r"""WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT range AS x, list_reduce(list_prepend(range, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
  FROM range(256)),
crcs AS (SELECT list(v ORDER BY x) AS tab FROM crc),
ids AS (SELECT DISTINCT c FROM t),
convs AS (
  SELECT c, c - c % 5 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))),
             lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h FROM ids, crcs),
base AS (SELECT c AS base, max(i) AS n FROM t GROUP BY c),
seq AS (
  SELECT convs.c, t.i AS d, role, text FROM convs JOIN t ON t.c = base AND t.i <= h
  UNION ALL
  SELECT convs.c, t.i - h + least(h, coalesce(n, 0)), role, text FROM convs LEFT JOIN base USING (base) JOIN t ON t.c = convs.c AND t.i > h),
path AS (
  SELECT convs.c, list(sha256(length(role) || ':' || role || text) ORDER BY d) FILTER (d IS NOT NULL) AS keys,
         list(strlen(text) ORDER BY d) FILTER (d IS NOT NULL) AS sizes FROM convs LEFT JOIN seq USING (c) GROUP BY convs.c),
whole AS (SELECT c, coalesce(keys, []) AS keys, coalesce(sizes, []) AS sizes FROM path),
visit AS (
  SELECT c, d, array_to_string(keys[1:d], ',') AS k, array_to_string(keys[1:d - 1], ',') AS up, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(keys) AS ends
  FROM (SELECT *, unnest(range(0, len(keys) + 1)) AS d FROM whole)),
node AS (
  SELECT d, k, min(up) AS up, min(c) AS c, count(*) AS n, min(size) AS size, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ended
  FROM visit GROUP BY d, k),
child AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY d, up),
full_ AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (d, k)),
up_ AS (
  SELECT d0 AS d, array_to_string(parts[1:d0], ',') AS k, leaf, saved FROM (
    SELECT string_split(k, ',') AS parts, unnest(range(0, d + 1)) AS d0, CAST(n_children = 0 AS BIGINT) AS leaf, (n - 1) * size AS saved FROM full_)),
sums AS (SELECT d, k, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up_ GROUP BY d, k)
SELECT f.c AS conv_id, f.d AS depth, p.c AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, saved_tokens, sha256(f.ended) AS ends_sha256
FROM full_ f JOIN sums USING (d, k) LEFT JOIN node p ON p.d = f.d - 1 AND p.k = f.up"""

ORACLES: dict[str, str] = {
    "op1_decontamination": DECONTAMINATION,
    "op2_near_duplicates": NEAR_DUPLICATES,
    "op3_chat": CHAT,
    "op11_collocations": COLLOCATIONS,
    "op13_prefix_trie": PREFIX_TRIE,
}
