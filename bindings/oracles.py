"""DuckDB SQL with the same result as each query, over the whole given tables."""

from __future__ import annotations

DOC = r"""doc AS (
  SELECT doc_id AS seq, source, lang, split_part(text, chr(10), 1) AS title,
         CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS rest,
         TIMESTAMP '2024-01-01' + to_minutes(7 * doc_id) AS published
  FROM documents)"""

ART = (
    DOC
    + r""", art AS (
  SELECT seq, source, lang AS country, title, trim(regexp_replace(rest, '\s+', ' ', 'g')) AS description, published,
         strftime(published, '%a, %d %b %Y %H:%M:%S +0000') AS date, '' AS author,
         'https://www.' || source || '.example.org/' || seq AS link, 'documents' AS programme,
         strftime(published, '%Y-%m-%d') AS issue_date
  FROM doc)"""
)

# Raw entries of documents with their feed: even sources come through an aggregator, every third has patterns.
ENTRY = (
    DOC
    + r""", entry AS (
  SELECT seq, source, lang, published, rest, CAST(substr(source, 4) AS INTEGER) % 2 = 0 AS listed,
         CAST(substr(source, 4) AS INTEGER) % 3 = 0 AS patterned,
         CASE WHEN CAST(substr(source, 4) AS INTEGER) % 2 = 0 THEN title || ' - ' || source ELSE title END AS raw_title
  FROM doc),
flat AS (
  SELECT *, trim(regexp_replace(regexp_replace(raw_title, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS t,
         trim(regexp_replace(regexp_replace(rest, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS d
  FROM entry)"""
)

EVENT = r"""entry AS (
  SELECT event_id AS seq, event_type AS feed_id, props AS description,
         CASE WHEN event_id % 10 = 0 THEN '' ELSE event_type || ' ' || user_id END AS title,
         CASE WHEN event_id % 10 = 0 THEN 'Missing title' WHEN event_id % 10 = 1 THEN 'Missing published date'
              WHEN event_id % 10 = 2 THEN 'Invalid date format' ELSE '' END AS reason,
         CASE WHEN event_id % 10 IN (1, 2) THEN NULL ELSE date_trunc('second', ts) END AS at_time
  FROM events)"""

LAB = (
    DOC
    + r""", lab AS (
  SELECT vec_id AS seq, CAST(vec_id % 3 AS VARCHAR) AS programme,
         strftime(DATE '2024-01-02' + CAST(vec_id % 4 AS INTEGER), '%Y-%m-%d') AS issue_date,
         coalesce(doc.lang, 'none') AS source, coalesce(doc.title, 'v' || vec_id) AS title,
         trim(regexp_replace(coalesce(doc.rest, ''), '\s+', ' ', 'g')) AS description,
         TIMESTAMP '2024-01-01' + to_minutes(7 * vec_id) AS wall,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS emb, CAST(label AS BIGINT) AS cluster_id
  FROM embeddings LEFT JOIN doc ON vec_id = doc.seq),
links AS (
  SELECT *, CASE WHEN seq % 5 = 0 THEN '' ELSE 'https://www.' || source || '.example.org/' || seq END AS link,
         CASE WHEN seq % 5 = 0 THEN '' ELSE source || '.example.org' END AS domain,
         CASE WHEN strftime(wall, '%Y-%m-%d') = issue_date THEN strftime(wall, '%H:%M')
              ELSE strftime(wall, '%d %b %H:%M') END AS time_display
  FROM lab)"""
)

METRICS = r"""metrics AS (
  SELECT programme, issue_date, cluster_id, count(*) AS size, count(DISTINCT source) AS n_sources,
         string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
         count(DISTINCT source) / count(*) AS diversity_score,
         (count(*) + count(DISTINCT source)) / 2.0 AS importance_score
  FROM lab GROUP BY ALL),
classed AS (
  SELECT *, CASE WHEN size > 2 AND n_sources = 1 THEN 'junk' WHEN size >= 3 AND diversity_score >= 0.3 THEN 'top'
                 ELSE 'niche' END AS category FROM metrics),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY programme, issue_date ORDER BY importance_score DESC, cluster_id) AS rank
  FROM classed WHERE category = 'top')"""

UNIT = r"""unit AS (
  SELECT *, list_transform(emb, lambda x: x / sqrt(list_inner_product(emb, emb))) AS u FROM lab),
part AS (
  SELECT programme, issue_date, cluster_id, i, avg(u[i]) AS m, sum(u[i]) AS s
  FROM unit, range(1, 65) r(i) GROUP BY ALL),
center AS (
  SELECT programme, issue_date, cluster_id, list(m ORDER BY i) AS c, list(s ORDER BY i) AS total FROM part GROUP BY ALL),
far AS (
  SELECT unit.*, round(1 - list_cosine_similarity(u, c), 12) AS distance
  FROM unit JOIN center USING (programme, issue_date, cluster_id)),
medoid AS (
  SELECT programme, issue_date, cluster_id, seq AS medoid_seq, title AS label, description
  FROM (SELECT *, row_number() OVER (PARTITION BY programme, issue_date, cluster_id ORDER BY distance, seq) AS n FROM far)
  WHERE n = 1)"""

DIGEST = r"""told AS (
  SELECT r.*, m.label, m.description FROM ranked r JOIN medoid m USING (programme, issue_date, cluster_id) WHERE rank <= 20),
digest AS (
  SELECT DISTINCT programme, issue_date, 0 AS rank, 0 AS block, n AS row,
         CASE n WHEN 0 THEN '# Coverage Pulse - ' || issue_date ELSE '' END AS line
  FROM lab, range(0, 2) r(n)
  UNION ALL SELECT programme, issue_date, rank, 1, 0, '## ' || rank || '. ' || label FROM told
  UNION ALL SELECT programme, issue_date, rank, 1, 1, '' FROM told
  UNION ALL SELECT programme, issue_date, rank, 1, 2, '> **Context:** ' || description FROM told WHERE description <> ''
  UNION ALL SELECT programme, issue_date, rank, 1, 3, '' FROM told WHERE description <> ''
  UNION ALL SELECT programme, issue_date, rank, 2, l.seq, '- **' || l.source || '**: ' || l.title || ' ' || l.description
            FROM lab l JOIN told t USING (programme, issue_date, cluster_id)
  UNION ALL SELECT programme, issue_date, rank, 3, n, '' FROM told, range(0, 2) r(n))"""

OTHERS = r"""others AS (
  SELECT * FROM lab a WHERE NOT EXISTS (
    SELECT 1 FROM lab b JOIN classed k USING (programme, issue_date, cluster_id)
    WHERE k.category = 'top' AND b.programme = a.programme AND b.issue_date = a.issue_date
      AND b.source = a.source AND b.title = a.title))"""

EPISODE = r"""episode AS (
  SELECT CAST(conv_id AS VARCHAR) AS programme, strftime(DATE '2024-01-01' + CAST(turn + turn // 3 AS INTEGER), '%Y-%m-%d') AS day,
         text AS script, octet_length(encode(text)) AS audio_bytes, CAST(floor(length(text) / 15) AS INTEGER) AS duration_s,
         role = 'assistant' AS has_sources_view
  FROM conversations),
item AS (
  SELECT *, 'https://example.org/' || programme || '/artifacts/' || day AS guid,
         CASE WHEN has_sources_view THEN 'https://example.org/' || programme || '/artifacts/' || day || '/' || day || '-sources-view.html' END AS view_url
  FROM episode)"""

CELLS = r"""cells AS (
  SELECT CAST(label AS BIGINT) AS label_a, vec_id % 10 AS label_b, count(*) AS n FROM embeddings GROUP BY ALL)"""

SHAPES = r"""shaped AS (
  SELECT event_id, date_trunc('second', ts) AS sec, ts, event_id % 7 AS k,
         CASE event_id % 7
           WHEN 0 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S GMT')
           WHEN 1 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S Z')
           WHEN 2 THEN strftime(ts + INTERVAL 1 HOUR, '%a, %d %b %Y %H:%M:%S +0100')
           WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
           WHEN 4 THEN strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S.%f+01:00')
           WHEN 5 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
           ELSE strftime(ts, '%d/%m/%Y %H:%M') END AS text
  FROM events)"""

# Cleaning of a document entry, step by step.
CLEANED = r"""named AS (
  SELECT *, CASE WHEN listed THEN regexp_replace(t, '\s*-\s*' || source || '$', '') ELSE t END AS t1,
         CASE WHEN listed THEN regexp_replace(d, '\s+' || source || '$', '') ELSE d END AS d1
  FROM flat),
pruned AS (
  SELECT *,
    trim(CASE WHEN patterned THEN regexp_replace(regexp_replace(t1, '^[A-Za-z]+ ', ''), '[.!?]+$', '') ELSE t1 END) AS t2,
    trim(CASE WHEN patterned THEN regexp_replace(regexp_replace(d1, '^^[A-Z]', ''), ' [a-z]+[.]$', '') ELSE d1 END) AS d2
  FROM named),
cleaned AS (
  SELECT *, CASE WHEN d2 IN ('undefined', 'Continua a leggere', 'Read more', '') OR length(d2) < 15
      OR trim(regexp_replace(lower(d2), '[\s\-–—|]+', ' ', 'g')) = trim(regexp_replace(lower(t2), '[\s\-–—|]+', ' ', 'g'))
    THEN '' ELSE d2 END AS d3
  FROM pruned)"""


def _merged(threshold: float, linkage: str, name: str, vector: str = "embedding") -> str:
    """CTEs with the groups of one linkage, ``<name>(id, cluster_id)``: rounds of mutual nearest pairs.

    The state holds pairs of groups (kind 0, with the sum, largest or least of their distances and their sizes) and members (1).
    """
    joined = {"average": "sum(s)", "complete": "max(s)", "single": "min(s)"}[linkage]
    d = "s / (na * nb)" if linkage == "average" else "s"
    return f"""{name}_v AS MATERIALIZED (
  SELECT vec_id, list_transform({vector}, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
{name}_state(step, kind, a, b, s, na, nb) AS (
  SELECT 0, 0, x.vec_id, y.vec_id, 1 - list_cosine_similarity(x.v, y.v), CAST(1 AS BIGINT), CAST(1 AS BIGINT)
  FROM {name}_v x JOIN {name}_v y ON x.vec_id < y.vec_id
  UNION ALL SELECT 0, 1, vec_id, vec_id, CAST(0 AS DOUBLE), CAST(1 AS BIGINT), CAST(1 AS BIGINT) FROM {name}_v
  UNION ALL
  SELECT * FROM (
    WITH near AS (SELECT a, b, {d} AS d FROM {name}_state WHERE kind = 0 AND {d} < {threshold}),
    ends AS (SELECT a AS n, b AS o, d FROM near UNION ALL SELECT b, a, d FROM near),
    best AS (SELECT n, arg_min(o, d) AS o FROM ends GROUP BY n),
    moved AS (SELECT p.n AS keep, p.o AS gone FROM best p JOIN best q ON p.o = q.n AND q.o = p.n WHERE p.n < p.o),
    mapped AS (
      SELECT step, kind, coalesce(m.keep, a) AS a, coalesce(k.keep, b) AS b, s, na, nb
      FROM {name}_state LEFT JOIN moved m ON m.gone = a AND kind = 0 LEFT JOIN moved k ON k.gone = b),
    sizes AS (SELECT b AS n, count(*) AS size FROM mapped WHERE kind = 1 GROUP BY b)
    SELECT min(step) + 1, 0, least(a, b), greatest(a, b), {joined}, min(x.size), min(y.size)
    FROM mapped JOIN sizes x ON x.n = least(a, b) JOIN sizes y ON y.n = greatest(a, b)
    WHERE kind = 0 AND a <> b AND EXISTS (SELECT 1 FROM moved) GROUP BY least(a, b), greatest(a, b)
    UNION ALL SELECT step + 1, 1, a, b, s, na, nb FROM mapped WHERE kind = 1 AND EXISTS (SELECT 1 FROM moved))),
{name} AS (SELECT a AS id, b AS cluster_id FROM {name}_state WHERE kind = 1 AND step = (SELECT max(step) FROM {name}_state))"""


def _groups(threshold: float, linkage: str) -> str:
    return f"WITH RECURSIVE {_merged(threshold, linkage, 'merged')}\nSELECT id, cluster_id FROM merged"


#: The vectors with their groups as ``lab``, as the other fragments expect it.
VECTOR_LAB = r"""lab AS (
  SELECT vec_id AS seq, CAST('all' AS VARCHAR) AS programme, '2024-01-01' AS issue_date, 'src' || label AS source, 'v' || vec_id AS title,
         CAST('' AS VARCHAR) AS description, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS emb, m.cluster_id
  FROM embeddings JOIN merged m ON m.id = vec_id)"""

SWEPT = [0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90]


def _sweep(swept: list[float] = SWEPT, vector: str = "embedding", dimensions: int = 64) -> str:
    """CTEs ending in ``sweep``: metrics of the groups at each threshold."""
    names = [f"at{round(100 * t)}" for t in swept]
    every = " UNION ALL ".join(f"SELECT {t} AS threshold, id, cluster_id FROM {n}" for t, n in zip(swept, names))
    return (
        "WITH RECURSIVE "
        + ",\n".join(_merged(t, "average", n, vector) for t, n in zip(swept, names))
        + f""",
grouped AS ({every}),
unit AS (
  SELECT vec_id, 'src' || label AS source, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u
  FROM (SELECT *, list_transform({vector}, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)),
member AS (SELECT CAST(g.threshold AS DOUBLE) AS threshold, g.id, g.cluster_id, source, u FROM grouped g JOIN unit ON vec_id = id),
sized AS (
  SELECT threshold, cluster_id, count(*) AS size, count(DISTINCT source) AS n_sources FROM member GROUP BY ALL),
classed AS (
  SELECT *, n_sources / size AS diversity, CASE WHEN size > 2 AND n_sources = 1 THEN 'junk'
              WHEN size >= 3 AND n_sources / size >= 0.3 THEN 'top' ELSE 'niche' END AS category FROM sized),
part AS (SELECT threshold, cluster_id, i, sum(u[i]) AS s FROM member, range(1, {dimensions + 1}) r(i) GROUP BY ALL),
total AS (SELECT threshold, cluster_id, list(s ORDER BY i) AS total FROM part GROUP BY ALL),
shared AS (SELECT * FROM sized JOIN total USING (threshold, cluster_id) WHERE size >= 2),
inner_d AS (
  SELECT m.threshold, m.id, (size - list_inner_product(u, total)) / (size - 1) AS a
  FROM member m JOIN shared USING (threshold, cluster_id)),
outer_d AS (
  SELECT m.threshold, m.id, min(1 - list_inner_product(m.u, s.total) / s.size) AS b
  FROM member m JOIN shared own USING (threshold, cluster_id) JOIN shared s ON s.threshold = m.threshold AND s.cluster_id <> m.cluster_id
  GROUP BY ALL),
quality AS (SELECT threshold, avg((b - a) / greatest(a, b)) AS silhouette FROM inner_d JOIN outer_d USING (threshold, id) GROUP BY 1),
inside AS (
  SELECT threshold, avg((list_inner_product(total, total) - size) / (size * (size - 1))) AS mean_intra_sim FROM shared GROUP BY 1),
counted AS (
  SELECT threshold, CAST(sum(size) AS BIGINT) AS articles, count(*) AS n_clusters, count(*) FILTER (size = 1) AS n_singletons,
         count(*) FILTER (category = 'top') AS n_top_stories, count(*) FILTER (category = 'junk') AS n_junk,
         coalesce(avg(diversity) FILTER (category = 'top'), 0) AS diversity,
         count(*) FILTER (size >= 2) AS groups, coalesce(sum(size) FILTER (size >= 2), 0) AS members
  FROM classed GROUP BY 1),
sweep AS (
  SELECT threshold, n_clusters, n_singletons, round_even(100 * (1 - n_singletons / articles), 1) AS pct_clustered,
         CASE WHEN groups >= 2 AND members > groups THEN round_even(silhouette, 4) END AS silhouette,
         round_even(mean_intra_sim, 4) AS mean_intra_sim, n_top_stories, n_junk, round_even(diversity, 3) AS mean_top_diversity,
         round_even(n_top_stories * diversity, 2) AS task_score
  FROM counted LEFT JOIN quality USING (threshold) LEFT JOIN inside USING (threshold))
"""
    )


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _report(label: str, other: str) -> str:
    return (
        _with(LAB, CELLS)
        + f""", broken AS (
  SELECT {label} AS label, CAST(sum(n) AS BIGINT) AS size, count(*) AS pieces FROM cells GROUP BY 1
  HAVING sum(n) >= 2 AND count(*) > 1),
top AS (SELECT *, row_number() OVER (ORDER BY size DESC, label) AS rank FROM broken QUALIFY rank <= 5),
pairs AS (SELECT vec_id AS seq, CAST(label AS BIGINT) AS label_a, vec_id % 10 AS label_b FROM embeddings),
sample AS (
  SELECT {label} AS label, {other} AS other_label, left(title, 80) AS title,
         row_number() OVER (PARTITION BY {label} ORDER BY seq) AS sample
  FROM pairs JOIN lab USING (seq) QUALIFY sample <= 3)
SELECT rank, label, size, pieces, sample, other_label, title FROM top JOIN sample USING (label)"""
    )


def _article_columns() -> str:
    return "strftime(published, '%Y-%m-%d %H:%M:%S') AS published"


ITALIAN_DAYS = "['Lunedì', 'Martedì', 'Mercoledì', 'Giovedì', 'Venerdì', 'Sabato', 'Domenica']"
ITALIAN_MONTHS = (
    "['Gennaio', 'Febbraio', 'Marzo', 'Aprile', 'Maggio', 'Giugno', 'Luglio', 'Agosto', 'Settembre', 'Ottobre', "
    "'Novembre', 'Dicembre']"
)
LETTER_VECTOR = (
    "array_to_string(list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), "
    "lambda c: CAST(length(e) - length(replace(e, c, '')) AS VARCHAR)), ',')"
)
EMBEDDING_TEXT = (
    "CASE WHEN description IN ('', 'nan') THEN trim(title) ELSE trim(title) || '. ' || description END"
)

ORACLES: dict[str, str] = {
    "rss_scan": _with(ENTRY)
    + r"""SELECT source AS feed_id, row_number() OVER (ORDER BY source, seq) AS place, regexp_replace(raw_title, '^\s+|\s+$', '', 'g') AS title,
       strftime(published, '%a, %d %b %Y %H:%M:%S +0000') AS published,
       CASE WHEN seq % 2 = 0 THEN regexp_replace(rest, '^\s+|\s+$', '', 'g') ELSE '' END AS description,
       regexp_replace(rest, '^\s+|\s+$', '', 'g') AS summary,
       lang || '@example.org (' || source || ')' AS author, 'https://example.org/' || seq AS link
FROM entry""",
    "feed_dim": r"""WITH f AS (SELECT DISTINCT source, CAST(substr(source, 4) AS INTEGER) AS n FROM documents)
SELECT source AS feed_id, source AS name,
       CASE WHEN n % 2 = 0 THEN 'https://news.google.com/rss?q=' || source ELSE 'https://example.org/' || source END AS url,
       '' AS country,
       CASE WHEN n % 3 = 0 THEN '[A-Za-z]+ ' ELSE '-' END AS title_prefix,
       CASE WHEN n % 3 = 0 THEN '[.!?]+' ELSE '-' END AS title_suffix,
       CASE WHEN n % 3 = 0 THEN '^[A-Z]' ELSE '-' END AS description_prefix,
       CASE WHEN n % 3 = 0 THEN ' [a-z]+[.]' ELSE '-' END AS description_suffix
FROM f""",
    "articles_scan": _with(DOC)
    + "SELECT seq, source, title, '' AS country, '' AS description, '' AS author, '' AS link FROM doc",
    "articles_roundtrip": _with(ART)
    + f"SELECT source, date, title, country, description, author, link, {_article_columns()}, seq, programme, issue_date FROM art",
    "incremental_issues": _with(ART)
    + "SELECT seq, source, title, issue_date FROM art WHERE day(published) % 2 = 0",
    "embed_incremental": _with(ART)
    + f""", e AS (SELECT seq, {EMBEDDING_TEXT} AS e FROM art)
SELECT seq, e AS embedding_text, {LETTER_VECTOR} AS vector FROM e""",
    "embed_articles": _with(ART)
    + f""", e AS (SELECT seq, {EMBEDDING_TEXT} AS e FROM art)
SELECT seq, {LETTER_VECTOR} AS vector, 'letters' AS provider FROM e""",
    "episode_scan": _with(EPISODE) + "SELECT programme, day AS date, script, audio_bytes, has_sources_view FROM episode",
    "episode_feed": _with(EPISODE)
    + r"""SELECT programme, guid, 'Show ' || programme || ' - ' || day AS title, guid || '/' || day || '-audio.mp3' AS link,
       CAST(audio_bytes AS VARCHAR) AS length, 'audio/mpeg' AS type,
       strftime(CAST(day AS DATE), '%a, %d %b %Y 08:00:00 +0000') AS pub_date,
       CASE WHEN view_url IS NULL THEN script
            ELSE 'View all sources: ' || view_url || chr(10) || chr(10) || '---' || chr(10) || chr(10) || script END AS description,
       duration_s AS itunes_duration
FROM item""",
    "episode_feed_scan": _with(EPISODE)
    + r"""SELECT programme, 'Show ' || programme || ' - ' || day AS title, day AS published,
       regexp_replace(script, '^\s+|\s+$', '', 'g') AS description, coalesce(view_url, '') AS sources_url,
       guid || '/' || day || '-audio.mp3' AS audio_url
FROM item""",
    "episode_catalog": _with(EPISODE)
    + r""", e AS (SELECT *, regexp_replace(script, '^\s+|\s+$', '', 'g') AS s FROM item)
SELECT programme, row_number() OVER (PARTITION BY programme ORDER BY day DESC) AS position, 'Show ' || programme || ' - ' || day AS title,
       day AS published,
       regexp_replace(CASE WHEN length(s) <= 505 THEN s ELSE regexp_replace(left(s, 497), ' [^ ]*$', '') || '...' END,
                      '^\s+|\s+$', '', 'g') AS blurb
FROM e""",
    "stories_digest": _with(LAB, METRICS, UNIT, DIGEST)
    + "SELECT programme, issue_date, rank, CAST(block AS INTEGER) AS block, row, line FROM digest",
    "headline_context": _with(ART)
    + r"""SELECT programme, issue_date, row_number() OVER (PARTITION BY programme, issue_date ORDER BY source, seq) AS position,
       '<article source="' || source || '" date="' || date || '">' || chr(10) || title
       || CASE WHEN description <> '' THEN chr(10) || description ELSE '' END || chr(10) || '</article>' AS line
FROM art""",
    "clean_html": r"""WITH u AS (
  SELECT page_id, replace(replace(replace(replace(html, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS h
  FROM pages)
SELECT page_id, trim(regexp_replace(regexp_replace(h, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS cleaned FROM u""",
    "clean_author": r"""SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN source WHEN doc_id % 4 = 2 THEN source || ' & ' || lang
       ELSE '' END AS author FROM documents""",
    "strip_feed_suffix": _with(ENTRY)
    + r"""SELECT seq, CASE WHEN listed THEN regexp_replace(t, '\s*-\s*' || source || '$', '') ELSE t END AS title FROM flat""",
    "feed_patterns": _with(ENTRY)
    + r"""SELECT seq,
       CASE WHEN patterned THEN regexp_replace(regexp_replace(t, '^[A-Za-z]+ ', ''), '[.!?]+$', '') ELSE t END AS title,
       CASE WHEN patterned THEN regexp_replace(regexp_replace(d, '^^[A-Z]', ''), ' [a-z]+[.]$', '') ELSE d END AS description
FROM flat""",
    "title_desc_dedupe": _with(ART)
    + r""", x AS (
  SELECT seq, title, CASE WHEN seq % 3 = 0 THEN replace(title, ' ', ' – ') || ' | ' ELSE description END AS d FROM art)
SELECT seq, CASE WHEN d IN ('undefined', 'Continua a leggere', 'Read more', '') OR length(d) < 15
    OR trim(regexp_replace(lower(d), '[\s\-–—|]+', ' ', 'g')) = trim(regexp_replace(lower(title), '[\s\-–—|]+', ' ', 'g'))
  THEN '' ELSE d END AS description
FROM x""",
    "clean_article": _with(ENTRY, CLEANED)
    + r"""SELECT seq, source, strftime(published, '%a, %d %b %Y %H:%M:%S +0000') AS date, t2 AS title, '' AS country,
       d3 AS description, source AS author, 'https://example.org/' || seq AS link,
       strftime(published, '%Y-%m-%d %H:%M:%S') AS published
FROM cleaned""",
    "parse_published": _with(SHAPES)
    + r"""SELECT event_id, text,
       strftime(CASE WHEN k = 6 THEN date_trunc('minute', ts) ELSE sec END, '%Y-%m-%d %H:%M:%S') AS published,
       CASE WHEN k = 0 THEN '' ELSE strftime(CASE WHEN k = 6 THEN date_trunc('minute', ts) ELSE sec END, '%Y-%m-%d %H:%M:%S') END AS view_published
FROM shaped""",
    "time_display": _with(SHAPES)
    + r""", w AS (SELECT event_id, ts, CASE WHEN k IN (2, 4) THEN ts + INTERVAL 1 HOUR ELSE ts END AS wall FROM shaped)
SELECT event_id, CASE WHEN CAST(wall AS DATE) = CAST(ts AS DATE) THEN strftime(wall, '%H:%M')
       ELSE strftime(wall, '%d %b %H:%M') END AS shown
FROM w""",
    "extract_domain": r"""SELECT page_id,
       regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '^www\.', '') AS domain
FROM pages""",
    "embedding_text": _with(ART) + f"SELECT seq, {EMBEDDING_TEXT} AS embedding_text FROM art",
    "italian_datetime": f"""SELECT event_id, {ITALIAN_DAYS}[isodow(ts)] || ' ' || day(ts) || ' ' || {ITALIAN_MONTHS}[month(ts)]
       || ' ' || strftime(ts, '%H:%M') AS shown
FROM events""",
    "l2_normalize": r"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS v FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM v)
SELECT vec_id, round(sqrt(list_inner_product(u, u)), 6) AS length, round(u[1], 6) AS first, round(list_sum(u), 6) AS total FROM u""",
    "cosine_pairs": _with(LAB, UNIT) + "SELECT seq, cluster_id, round(distance, 6) AS distance FROM far",
    "desc_preview": _with(ART)
    + "SELECT seq, CASE WHEN length(description) > 180 THEN left(description, 180) || '...' ELSE description END AS preview FROM art",
    "truncate_words": r"""SELECT conv_id, turn, CASE WHEN length(text) <= 505 THEN text
       ELSE regexp_replace(left(text, 497), ' [^ ]*$', '') || '...' END AS blurb
FROM conversations""",
    "split_sources_link": r"""SELECT conv_id, turn,
       CASE WHEN role = 'assistant' THEN 'https://example.org/' || conv_id ELSE '' END AS sources_url,
       CASE WHEN role = 'assistant' THEN regexp_replace(text, '^\n+', '') ELSE text END AS description
FROM conversations""",
    "script_budget": r"""SELECT doc_id, left(text, 5000) AS spoken, length(text) AS script_length, length(text) > 5000 AS is_cut
FROM documents""",
    "infer_model": r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'voyage' WHEN 1 THEN lower(source) ELSE 'openai' END AS model,
       '2024-01-05' AS issue
FROM documents""",
    "validate_entries": _with(EVENT)
    + "SELECT seq, reason, coalesce(strftime(at_time, '%Y-%m-%d %H:%M:%S'), '') AS published_at FROM entry",
    "age_filter": _with(EVENT)
    + r"""SELECT seq, feed_id, strftime(at_time, '%Y-%m-%d %H:%M:%S') AS published_at
FROM entry WHERE reason = '' AND at_time >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY""",
    "topn_per_feed": _with(EVENT)
    + r"""SELECT feed_id, seq, CAST(row_number() OVER (PARTITION BY feed_id ORDER BY at_time DESC, seq) AS INTEGER) AS rank
FROM entry WHERE reason = '' QUALIFY rank <= 150""",
    "validation_stats": _with(EVENT)
    + "SELECT reason, count(*) AS entries FROM entry WHERE reason <> '' GROUP BY reason",
    "feed_stats": _with(EVENT)
    + r"""SELECT feed_id, count(*) AS total, count(*) FILTER (reason <> '') AS failed,
       count(*) FILTER (reason = '' AND at_time >= TIMESTAMP '2024-01-31' - INTERVAL 2 DAY) AS recent,
       least(count(*) FILTER (reason = '' AND at_time >= TIMESTAMP '2024-01-31' - INTERVAL 2 DAY), 150) AS kept
FROM entry GROUP BY feed_id""",
    "dedupe_articles": _with(ART) + "SELECT min(seq) AS seq, source, title FROM art GROUP BY source, title",
    "dedupe_removed": _with(ART)
    + r"""SELECT source, count(*) AS articles, count(DISTINCT title) AS kept, count(*) - count(DISTINCT title) AS removed
FROM art GROUP BY source""",
    "ingest_articles": _with(EVENT)
    + r""", kept AS (
  SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY at_time DESC, seq) AS rank
  FROM entry WHERE reason = '' AND at_time >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY QUALIFY rank <= 150),
firsts AS (SELECT *, row_number() OVER (PARTITION BY feed_id, title ORDER BY seq) AS n FROM kept QUALIFY n = 1)
SELECT seq, feed_id AS source, strftime(at_time, '%a, %d %b %Y %H:%M:%S +0000') AS date, title,
       CASE WHEN length(description) < 15 THEN '' ELSE description END AS description,
       strftime(at_time, '%Y-%m-%d %H:%M:%S') AS published
FROM firsts""",
    "union_feeds": _with(ART, EVENT)
    + r"""SELECT source, seq, title, link FROM art
UNION ALL SELECT feed_id, seq, title, '' FROM entry
UNION ALL SELECT 'pages', page_id, '', url FROM pages""",
    "group_by_source": _with(ART)
    + r"""SELECT issue_date, source, count(*) OVER (PARTITION BY issue_date, source) AS source_articles,
       row_number() OVER (PARTITION BY issue_date, source ORDER BY seq) AS position, seq
FROM art""",
    "stream_ingest": _with(ENTRY, CLEANED) + "SELECT DISTINCT source, t2 AS title FROM cleaned WHERE raw_title <> ''",
    "other_headlines": _with(LAB, METRICS, OTHERS) + "SELECT programme, issue_date, seq, source, title FROM others",
    "attach_embeddings": _with(ART)
    + r"""SELECT seq, title, len(embedding) AS dimensions, round(CAST(embedding[1] AS DOUBLE), 6) AS first
FROM art JOIN embeddings ON seq = vec_id""",
    "similarity_join": r"""WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT a.vec_id AS id, b.vec_id AS partner, round(1 - list_cosine_similarity(a.v, b.v), 6) AS distance
FROM v a JOIN v b ON a.vec_id < b.vec_id AND 1 - list_cosine_similarity(a.v, b.v) < 0.75""",
    "similarity_join_copies": r"""WITH one AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
v AS (SELECT vec_id, v FROM one UNION ALL SELECT vec_id + 1000000000, v FROM one WHERE vec_id % 7 = 0),
d AS (
  SELECT a.vec_id AS id, b.vec_id AS partner, CASE WHEN a.v = b.v THEN 0.0 ELSE 1 - list_cosine_similarity(a.v, b.v) END AS d
  FROM v a JOIN v b ON a.vec_id < b.vec_id)
SELECT id, partner, round(CAST(d AS DOUBLE), 6) AS distance FROM d WHERE d < 0.75""",
    "previous_episode": _with(EPISODE)
    + r"""SELECT c.programme, c.day AS issue_date, strftime(CAST(c.day AS DATE) - 1, '%Y-%m-%d') AS previous_date,
       coalesce(p.script, 'No previous episode found.') AS previous_script
FROM episode c LEFT JOIN episode p ON p.programme = c.programme AND CAST(p.day AS DATE) = CAST(c.day AS DATE) - 1""",
    "contingency": _with(CELLS) + "SELECT label_a, label_b, n FROM cells",
    "cluster_metrics": _with(LAB, METRICS)
    + r"""SELECT programme, issue_date, cluster_id, size, n_sources, sources, round(diversity_score, 6) AS diversity_score,
       round(importance_score, 6) AS importance_score FROM metrics""",
    "cluster_medoid": _with(LAB, UNIT) + "SELECT programme, issue_date, cluster_id, medoid_seq, label, description FROM medoid",
    "story_categories": _with(LAB, METRICS)
    + r"""SELECT programme, issue_date, cluster_id, size, category,
       CASE WHEN category = 'junk' THEN 'Single source (' || sources || ')' ELSE '' END AS junk_reason FROM classed""",
    "analysis_summary": _with(LAB, METRICS)
    + r"""SELECT programme, issue_date, CAST(sum(size) AS BIGINT) AS total_articles, count(*) AS total_clusters,
       count(*) FILTER (size = 1) AS singletons FROM metrics GROUP BY ALL""",
    "view_stats": _with(LAB, METRICS)
    + r"""SELECT programme, issue_date, count(*) AS total_articles, count(DISTINCT source) AS source_count,
       count(DISTINCT CASE WHEN size >= 2 THEN cluster_id END) AS cluster_count,
       count(*) FILTER (size >= 2) AS clustered_count, count(*) FILTER (size < 2) AS unclustered_count,
       CAST(round_even(100 * count(*) FILTER (size >= 2) / count(*), 0) AS BIGINT) AS clustered_pct
FROM lab JOIN (SELECT programme, issue_date, cluster_id, size FROM metrics) USING (programme, issue_date, cluster_id) GROUP BY ALL""",
    "top_stories": _with(LAB, METRICS)
    + r"""SELECT programme, issue_date, rank, cluster_id, size, round(importance_score, 6) AS importance_score
FROM ranked WHERE rank <= 20""",
    "story_cards": _with(LAB, METRICS, UNIT)
    + r""", newest AS (
  SELECT *, row_number() OVER (PARTITION BY programme, issue_date, cluster_id, source ORDER BY wall DESC, seq) AS n
  FROM links WHERE domain <> '' QUALIFY n = 1),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY programme, issue_date, cluster_id ORDER BY wall DESC, seq) AS p FROM newest),
icons AS (
  SELECT programme, issue_date, cluster_id, string_agg(domain, ',' ORDER BY p) FILTER (p <= 6) AS icons,
         greatest(count(*) - 6, 0) AS more
  FROM placed GROUP BY ALL)
SELECT programme, issue_date,
       row_number() OVER (PARTITION BY programme, issue_date ORDER BY importance_score DESC, cluster_id) AS rank, cluster_id,
       size, n_sources, round(diversity_score, 6) AS diversity_score, round(importance_score, 6) AS importance_score,
       label, coalesce(icons, '') AS icons, coalesce(more, 0) AS more
FROM metrics JOIN medoid USING (programme, issue_date, cluster_id) LEFT JOIN icons USING (programme, issue_date, cluster_id)
WHERE size >= 2""",
    "story_domains": _with(LAB)
    + r""", newest AS (
  SELECT *, row_number() OVER (PARTITION BY programme, issue_date, cluster_id, source ORDER BY wall DESC, seq) AS n
  FROM links WHERE domain <> '' QUALIFY n = 1),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY programme, issue_date, cluster_id ORDER BY wall DESC, seq) AS p FROM newest)
SELECT programme, issue_date, cluster_id, string_agg(domain, ',' ORDER BY p) FILTER (p <= 2) AS icons,
       greatest(count(*) - 2, 0) AS more
FROM placed GROUP BY ALL""",
    "unclustered": _with(LAB, METRICS)
    + r"""SELECT programme, issue_date, lab.seq, lab.source, lab.title
FROM lab JOIN metrics USING (programme, issue_date, cluster_id) WHERE size = 1""",
    "unclustered_by_source": _with(LAB, METRICS)
    + r""", alone AS (
  SELECT l.*, count(*) OVER (PARTITION BY programme, issue_date, l.source) AS source_articles
  FROM links l JOIN (SELECT programme, issue_date, cluster_id FROM metrics WHERE size = 1) USING (programme, issue_date, cluster_id))
SELECT programme, issue_date, source,
       dense_rank() OVER (PARTITION BY programme, issue_date ORDER BY source_articles DESC, source) AS source_rank,
       source_articles,
       row_number() OVER (PARTITION BY programme, issue_date, source ORDER BY wall DESC, title, seq) AS position,
       seq, time_display
FROM alone""",
    "sources_view": _with(LAB, METRICS)
    + r"""SELECT programme, issue_date, cluster_id,
       row_number() OVER (PARTITION BY programme, issue_date, cluster_id ORDER BY wall DESC, seq) AS position, l.seq, l.source,
       domain, time_display,
       CASE WHEN length(description) > 180 THEN left(description, 180) || '...' ELSE description END AS preview
FROM links l JOIN (SELECT programme, issue_date, cluster_id FROM metrics WHERE size >= 2) USING (programme, issue_date, cluster_id)""",
    "briefing_context": _with(LAB, METRICS, UNIT, DIGEST, OTHERS, EPISODE)
    + r""", issue AS (SELECT DISTINCT programme, issue_date, strftime(CAST(issue_date AS DATE) - 1, '%Y-%m-%d') AS previous FROM lab),
told_before AS (
  SELECT i.*, coalesce(e.script, 'No previous episode found.') AS script
  FROM issue i LEFT JOIN episode e ON e.programme = i.programme AND e.day = i.previous),
opening AS (
  SELECT programme, issue_date, unnest(range(0, 11)) AS row, unnest([
    'Here is the latest data for today''s show:',
    '- In <previous_episode_transcript> find the script for the last episode for context.',
    '- In <clustered_headlines> find the "Top Stories" (widely covered).',
    '- In <other_headlines> find news that were only covered by single source.',
    '', '<previous_episode_transcript>', '# Previous Episode Transcript (' || previous || ')', script,
    '</previous_episode_transcript>', '', '<clustered_headlines>']) AS line
  FROM told_before)
SELECT programme, issue_date, 0 AS section, 0 AS rank, 0 AS block, row, line FROM opening
UNION ALL SELECT programme, issue_date, 1, rank, block, row, line FROM digest
UNION ALL SELECT programme, issue_date, 2, 0, 0, unnest(range(0, 3)),
                 unnest(['</clustered_headlines>', '', '<other_headlines>']) FROM issue
UNION ALL SELECT programme, issue_date, 3, 0, 0,
                 row_number() OVER (PARTITION BY programme, issue_date ORDER BY source, seq),
                 '<article source="' || source || '" date="' || strftime(wall, '%a, %d %b %Y %H:%M:%S +0100') || '">'
                 || chr(10) || title || CASE WHEN description <> '' THEN chr(10) || description ELSE '' END
                 || chr(10) || '</article>' FROM others
UNION ALL SELECT programme, issue_date, 4, 0, 0, 0, '</other_headlines>' FROM issue""",
    "top_stories_compare": "WITH "
    + LAB.replace("CAST(vec_id % 3 AS VARCHAR) AS programme", "CAST('all' AS VARCHAR) AS programme").replace(
        "coalesce(doc.lang, 'none') AS source", "'src' || (vec_id % 23) AS source"
    ).replace(
        "strftime(DATE '2024-01-02' + CAST(vec_id % 4 AS INTEGER), '%Y-%m-%d') AS issue_date", "'2024-01-02' AS issue_date"
    ).replace(", lab AS (", ", both_labels AS (").replace("FROM lab)", "FROM both_labels)")
    + r""", lab AS (
  SELECT * EXCLUDE (programme), 'a' AS programme FROM both_labels
  UNION ALL SELECT * EXCLUDE (programme) REPLACE (seq % 12 AS cluster_id), 'b' AS programme FROM both_labels),
"""
    + METRICS
    + ",\n"
    + UNIT
    + r""", told AS (
  SELECT r.programme, rank, size, n_sources, diversity_score, left(label, 80) AS label
  FROM ranked r JOIN medoid USING (programme, issue_date, cluster_id) WHERE rank <= 10),
a AS (SELECT * FROM told WHERE programme = 'a'), b AS (SELECT * FROM told WHERE programme = 'b')
SELECT CAST(rank AS INTEGER) AS rank, coalesce(a.size, 0) AS size_a, coalesce(a.n_sources, 0) AS sources_a,
       coalesce(b.size, 0) AS size_b, coalesce(b.n_sources, 0) AS sources_b, coalesce(a.label, '') AS label_a,
       coalesce(b.label, '') AS label_b, round(coalesce(a.diversity_score, 0), 6) AS diversity_a,
       round(coalesce(b.diversity_score, 0), 6) AS diversity_b
FROM a FULL JOIN b USING (rank)""",
    "distance_percentiles": r"""WITH s AS (
  SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  ORDER BY md5('42:' || vec_id) LIMIT 500),
d AS (SELECT round(1 - list_cosine_similarity(a.v, b.v), 12) AS d FROM s a, s b)
SELECT round(min(d), 6) AS min, round(quantile_cont(d, 0.05), 6) AS p5, round(quantile_cont(d, 0.10), 6) AS p10,
       round(quantile_cont(d, 0.25), 6) AS p25, round(quantile_cont(d, 0.5), 6) AS median,
       round(quantile_cont(d, 0.75), 6) AS p75, round(quantile_cont(d, 0.90), 6) AS p90, round(max(d), 6) AS max
FROM d WHERE d > 0""",
    "silhouette": _with(LAB, UNIT)
    + r""", sized AS (
  SELECT programme, issue_date, cluster_id, total, n
  FROM center JOIN (SELECT programme, issue_date, cluster_id, count(*) AS n FROM lab GROUP BY ALL) USING (programme, issue_date, cluster_id)
  WHERE n >= 2),
member AS (SELECT unit.*, n, total FROM unit JOIN sized USING (programme, issue_date, cluster_id)),
inner_d AS (SELECT programme, issue_date, seq, (n - list_inner_product(u, total)) / (n - 1) AS a FROM member),
outer_d AS (
  SELECT m.programme, m.issue_date, m.seq, min(1 - list_inner_product(m.u, s.total) / s.n) AS b
  FROM member m JOIN sized s ON s.programme = m.programme AND s.issue_date = m.issue_date AND s.cluster_id <> m.cluster_id
  GROUP BY ALL)
SELECT programme, issue_date, round(avg((b - a) / greatest(a, b)), 6) AS silhouette
FROM inner_d JOIN outer_d USING (programme, issue_date, seq) GROUP BY ALL""",
    "intra_similarity": _with(LAB, UNIT)
    + r""", pairs AS (
  SELECT a.programme, a.issue_date, a.cluster_id, avg(list_inner_product(a.u, b.u)) AS s
  FROM unit a JOIN unit b ON a.programme = b.programme AND a.issue_date = b.issue_date AND a.cluster_id = b.cluster_id AND a.seq < b.seq
  GROUP BY ALL)
SELECT programme, issue_date, round(avg(s), 6) AS mean_intra_sim FROM pairs GROUP BY ALL""",
    "cluster_splits": _report("label_a", "label_b"),
    "cluster_merges": _report("label_b", "label_a"),
    "adjusted_rand": _with(CELLS)
    + r""", p AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS both_,
  (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY label_a)) AS a,
  (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY label_b)) AS b,
  (SELECT sum(n) * (sum(n) - 1) / 2 FROM cells) AS total)
SELECT round((both_ - a * b / total) / ((a + b) / 2 - a * b / total), 6) AS adjusted_rand FROM p""",
    "nmi": _with(CELLS)
    + r""", t AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM cells),
ra AS (SELECT label_a, sum(n) AS na FROM cells GROUP BY 1), rb AS (SELECT label_b, sum(n) AS nb FROM cells GROUP BY 1),
mi AS (SELECT sum(n / total * ln(n * total / (na * nb))) AS mi FROM cells JOIN ra USING (label_a) JOIN rb USING (label_b), t),
ha AS (SELECT -sum(na / total * ln(na / total)) AS h FROM ra, t), hb AS (SELECT -sum(nb / total * ln(nb / total)) AS h FROM rb, t)
SELECT round(mi / ((ha.h + hb.h) / 2), 6) AS nmi FROM mi, ha, hb""",
    "short_context": _with(LAB, EPISODE)
    + r""", issue AS (SELECT DISTINCT programme, issue_date, strftime(CAST(issue_date AS DATE) - 1, '%Y-%m-%d') AS previous FROM lab)
SELECT programme, issue_date, 0 AS section, source, CAST(-1 AS BIGINT) AS seq, unnest([0, 1]) AS row, unnest(['## ' || source, '']) AS line
FROM (SELECT DISTINCT programme, issue_date, source FROM lab)
UNION ALL SELECT programme, issue_date, 0, source, seq, 0, '* ' || strftime(wall, '%a, %d %b %Y %H:%M:%S +0100') || ': ' || title FROM lab
UNION ALL SELECT i.programme, i.issue_date, 1, '', -1, unnest(range(0, 4)),
                 unnest(['', '# Previous Episode', '', coalesce(e.script, 'No previous episode found.')])
FROM issue i LEFT JOIN episode e ON e.programme = i.programme AND e.day = i.previous""",
    "hac_average": _groups(0.80, "average"),
    "hac_average_rounds": _groups(0.80, "average"),
    "hac_single": _groups(0.70, "single"),
    "hac_single_rounds": _groups(0.70, "single"),
    "hac_complete": _groups(0.80, "complete"),
    "hac_complete_rounds": _groups(0.80, "complete"),
    "daily_analysis": f"WITH RECURSIVE {_merged(0.80, 'average', 'merged')},\n{VECTOR_LAB},\n{METRICS},\n{UNIT}\n"
    + r"""SELECT programme, issue_date, CAST(rank AS INTEGER) AS rank, cluster_id, label, size, n_sources, round(diversity_score, 6) AS diversity_score,
       round(importance_score, 6) AS importance_score, category
FROM ranked JOIN medoid USING (programme, issue_date, cluster_id) WHERE rank <= 20""",
    "threshold_sweep": _sweep() + "SELECT * FROM sweep",
    "suggest_threshold": _sweep()
    + r""", valid AS (SELECT * FROM sweep WHERE silhouette IS NOT NULL AND pct_clustered >= 20),
peak AS (SELECT max(silhouette) AS peak FROM valid),
band AS (SELECT valid.* FROM valid, peak WHERE silhouette >= 0.75 * peak OR peak < 0),
chosen AS (SELECT * FROM band ORDER BY task_score DESC, threshold LIMIT 1)
SELECT threshold, printf('silhouette peak=%.4f (pct_clustered>=20%%), quality band=[%.2f, %.2f], chosen silhouette=%.4f, task_score=%.2f',
    peak, (SELECT min(threshold) FROM band), (SELECT max(threshold) FROM band), silhouette, task_score) AS reason
FROM chosen, peak""",
}
ORACLES["hac_single_history"] = (
    "WITH RECURSIVE "
    + ",\n".join(_merged(t, "single", f"at{round(100 * t)}") for t in (0.65, 0.70, 0.75))
    + "\n"
    + " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold, id, cluster_id FROM at{round(100 * t)}" for t in (0.65, 0.70, 0.75))
)
for _name in ("daily_analysis", "threshold_sweep", "suggest_threshold"):
    ORACLES[f"{_name}_rounds"] = ORACLES[_name]
ORACLES["stream_newest"] = ORACLES["ingest_articles"]
ORACLES["atom_scan"] = _with(ENTRY) + r"""SELECT source AS feed_id, row_number() OVER (ORDER BY source, seq) AS place, regexp_replace(raw_title, '^\s+|\s+$', '', 'g') AS title,
       strftime(published, '%a, %d %b %Y %H:%M:%S +0000') AS published, regexp_replace(rest, '^\s+|\s+$', '', 'g') AS summary,
       lang || '@example.org (' || source || ')' AS author, 'https://example.org/' || seq AS link
FROM entry"""
ORACLES["rss_rejects"] = r"""WITH f AS (SELECT source, CAST(substr(source, 4) AS INTEGER) AS n, count(*) AS items FROM documents GROUP BY ALL)
SELECT source AS feed_id, CAST(n % 3 = 0 AS BIGINT) + CAST(n % 5 = 0 AS BIGINT) AS broken_files, CAST(n % 5 = 0 AS BIGINT) AS empty_files,
       items + CAST(n % 3 = 0 AS BIGINT) AS items, CAST(0 AS BIGINT) AS untitled_items FROM f"""
ORACLES["attach_all_embeddings"] = _with(ART) + r"""SELECT seq, coalesce(array_to_string(list_transform(embedding, lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR)), ','), '') AS vector
FROM art LEFT JOIN embeddings ON seq = vec_id"""
ORACLES["missing_embeddings"] = _with(ART) + r"""SELECT source, count(*) AS articles, count(*) FILTER (WHERE vec_id IS NULL) AS without_vector
FROM art LEFT JOIN embeddings ON seq = vec_id GROUP BY source"""
ORACLES["episode_feed_document"] = _with(EPISODE) + r""", shows AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS programme FROM conversations),
n AS (SELECT CAST(programme AS VARCHAR) AS programme, count(*) AS items FROM item GROUP BY ALL)
SELECT programme, 'Show ' || programme AS title, 'About Show ' || programme || ' & more' AS description, 'it' AS language, 'Ada <Desk>' AS author,
       'https://example.org/' || programme || '/cover.png' AS cover, 'https://example.org/' || programme AS link, coalesce(items, 0) AS items
FROM shows LEFT JOIN n USING (programme)"""
ORACLES["embed_hashing"] = _with(ART) + rf""", word AS (
  SELECT seq, w, count(*) AS times FROM (SELECT seq, unnest(regexp_split_to_array(lower({EMBEDDING_TEXT}), '[^\p{{L}}\p{{M}}\p{{N}}_]+')) AS w FROM art)
  WHERE w <> '' GROUP BY ALL),
crc AS (
  SELECT range AS x, list_reduce(list_prepend(range, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
  FROM range(256)),
tab AS (SELECT list(v ORDER BY x) AS tab FROM crc),
digits AS (SELECT w, list_transform(string_split(hex(w), ''), lambda c: CAST(strpos('0123456789ABCDEF', c) - 1 AS BIGINT)) AS d FROM (SELECT DISTINCT w FROM word)),
bytes AS (SELECT w, list_transform(range(1, len(d), 2), lambda i: 16 * d[i] + d[i + 1]) AS b FROM digits),
bucket AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda a, c: xor(a >> 8, tab[(xor(a, c) & 255) + 1])), 4294967295) % 256 AS k FROM bytes, tab),
counted AS (SELECT seq, k, sum(times) AS n FROM word JOIN bucket USING (w) GROUP BY ALL),
df AS (SELECT k, ln((SELECT count(*) + 1 FROM art) / (count(*) + 1)) AS weight FROM counted GROUP BY k),
weighed AS (SELECT seq, k, n * weight AS x FROM counted JOIN df USING (k)),
norm AS (SELECT seq, sqrt(sum(x * x)) AS length FROM weighed GROUP BY seq),
cell AS (SELECT art.seq, r.k, coalesce(CASE WHEN length > 0 THEN x / length ELSE 0 END, 0) AS x
  FROM art CROSS JOIN range(256) r(k) LEFT JOIN weighed w ON w.seq = art.seq AND w.k = r.k LEFT JOIN norm ON norm.seq = art.seq)
SELECT seq, string_agg(printf('%.5f', CAST(CAST(x AS FLOAT) AS DOUBLE)), ',' ORDER BY k) AS vector FROM cell GROUP BY seq"""


def _labelled_by(vector: str, dimensions: int) -> str:
    """Labels of a model at the threshold it chooses: ``threshold, id, cluster_id``."""
    return f"""({_sweep([0.50, 0.60, 0.70, 0.80], vector, dimensions)}, valid AS (SELECT * FROM sweep WHERE silhouette IS NOT NULL AND pct_clustered >= 20),
  peak AS (SELECT max(silhouette) AS peak FROM valid),
  band AS (SELECT valid.* FROM valid, peak WHERE silhouette >= 0.75 * peak OR peak < 0),
  told AS (SELECT threshold, task_score, 0 AS last FROM band UNION ALL SELECT threshold, task_score, 1 FROM sweep),
  chosen AS (SELECT threshold FROM told ORDER BY last, task_score DESC, threshold LIMIT 1)
  SELECT CAST(threshold AS DOUBLE) AS threshold, id, cluster_id FROM grouped JOIN chosen USING (threshold))"""


ORACLES["model_comparison"] = f"""WITH a AS MATERIALIZED (SELECT * FROM {_labelled_by('embedding', 64)}), b AS MATERIALIZED (SELECT * FROM {_labelled_by('embedding[1:32]', 32)}),
cells AS (SELECT a.cluster_id AS x, b.cluster_id AS y, CAST(count(*) AS DOUBLE) AS n FROM a JOIN b USING (id) GROUP BY ALL),
one AS (SELECT x, sum(n) AS n FROM cells GROUP BY x), other AS (SELECT y, sum(n) AS n FROM cells GROUP BY y),
s AS (SELECT (SELECT sum(n) FROM cells) AS total, (SELECT sum(n * (n - 1) / 2) FROM cells) AS both_p, (SELECT sum(n * (n - 1) / 2) FROM one) AS a_p,
  (SELECT sum(n * (n - 1) / 2) FROM other) AS b_p, (SELECT sum(n * ln(n)) FROM cells) AS both_e, (SELECT sum(n * ln(n)) FROM one) AS a_e,
  (SELECT sum(n * ln(n)) FROM other) AS b_e),
e AS (SELECT *, a_p * b_p / (total * (total - 1) / 2) AS expected, (a_p + b_p) / 2 AS bound, ln(total) - both_e / total AS h, ln(total) - a_e / total AS ha,
  ln(total) - b_e / total AS hb FROM s)
SELECT CAST(total AS BIGINT) AS articles, round((both_p - expected) / (bound - expected), 6) AS adjusted_rand, round((ha + hb - h) / ((ha + hb) / 2), 6) AS nmi,
       (SELECT min(threshold) FROM a) AS threshold_a, (SELECT min(threshold) FROM b) AS threshold_b FROM e"""
