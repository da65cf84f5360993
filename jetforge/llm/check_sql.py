"""DuckDB statements that give the rows of the queries, where SQL can express them."""

from __future__ import annotations

SPACES = r"[ \t\n\x0B\f\r]+"
WORD = r"[^ \t\n\x0B\f\r]+"
SPLIT_URL = """
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)"""

URL_FILTER = f"""
WITH rules(host, path, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                          ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT row_number() OVER () AS n, page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path
      FROM ({SPLIT_URL})),
fits AS (SELECT p.n, r.host || r.path AS rule, r.action,
                row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
         FROM p JOIN rules r ON ('.' || p.host) LIKE ('%.' || r.host) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM p LEFT JOIN fits f ON f.n = p.n AND f.place = 1
"""


def _progress(share: str, points: tuple[float, float, float]) -> str:
    """Inverse of the cumulative demand for a schedule of three points."""
    a, m, b = points
    first, total = (a + m) / 4, (a + m) / 4 + (m + b) / 4

    def inside(rest: str, rate: float, grow: float, start: float) -> str:
        return f"least({start} + 2 * {rest} / ({rate} + sqrt(greatest({rate * rate} + 2 * ({grow}) * {rest}, 0))), {start + 0.5})"

    left = inside(f"greatest({share} * {total}, 0)", a, (m - a) * 2, 0.0)
    right = inside(f"greatest({share} * {total} - {first}, 0)", m, (b - m) * 2, 0.5)
    return f"CASE WHEN {share} * {total} < {first} THEN {left} ELSE {right} END"


MIXING = f"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
                  CAST(len(list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS class FROM per),
weighed AS (SELECT *, CASE class WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM ranked),
steps AS (SELECT *, row_number() OVER o AS k, 2.0 * total / weight AS ratio,
                 CAST(1.5 AS DOUBLE) * (SELECT sum(total) FROM per) AS demand,
                 coalesce(sum(total) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
                 sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing
          FROM weighed WINDOW o AS (ORDER BY 2.0 * total / weight, source NULLS LAST)),
level AS (SELECT CAST((demand - CAST(2 AS DOUBLE) * held) / sharing AS DOUBLE) AS level FROM steps
          WHERE ratio > (demand - CAST(2 AS DOUBLE) * held) / sharing ORDER BY k LIMIT 1),
targets AS (SELECT source, total, class, least(CAST(2 AS DOUBLE) * total, coalesce((SELECT level FROM level), 0) * weight) AS target FROM weighed),
placed AS (SELECT d.doc_id, d.source, d.size, t.total, t.target, t.class,
                  CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
           FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
cut AS (SELECT *, greatest(least(CAST(round(target) AS BIGINT) - start, size), 0) AS w1,
               greatest(least(CAST(round(target) AS BIGINT) - start - total, size), 0) AS w2, start / target AS share FROM placed)
SELECT doc_id, source, size, total AS source_size, target, w1 + w2 AS taken,
       CASE WHEN w1 > 0 THEN round(CASE class WHEN 0 THEN {_progress('share', (1.5, 1.0, 0.5))}
                                             WHEN 1 THEN {_progress('share', (1.0, 1.0, 1.0))}
                                             ELSE {_progress('share', (0.5, 1.0, 1.5))} END, 9) END AS position
FROM cut
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id, words, least(len(words), 10) AS width FROM (SELECT item_id, {_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
w AS (SELECT DISTINCT item_id, width, array_to_string(words[p:p + width - 1], ' ') AS part
      FROM (SELECT *, unnest(range(1, len(words) - width + 2)) AS p FROM b)),
cut AS (SELECT n, p, width, array_to_string(words[p:p + width - 1], ' ') AS part
        FROM (SELECT n, words, width, unnest(range(1, len(words) - width + 2)) AS p FROM d, (SELECT DISTINCT width FROM w))),
found AS (SELECT n, p, cut.width, item_id FROM cut JOIN w ON cut.part = w.part AND cut.width = w.width),
hit AS (SELECT n, count(DISTINCT spot) AS n_hit FROM (SELECT n, unnest(range(p, p + width)) AS spot FROM found) GROUP BY n),
listed AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
           FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY n)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (n) LEFT JOIN listed USING (n)
"""

CHAT = """
WITH t AS (SELECT conv_id, role, replace(coalesce(text, ''), '<|', '< |') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
p AS (SELECT t.conv_id, s.speaker, t.place, CAST(floor(t.place / 64) AS BIGINT) AS segment, coalesce(t.role = s.speaker, false) AS own,
             '<|im_start|>' || CASE WHEN t.role = s.speaker THEN 'assistant' WHEN t.role = 'system' THEN 'system'
                                    ELSE coalesce('user name=' || replace(t.role, '<|', '< |'), 'user') END || chr(10) AS head,
             t.text || '<|im_end|>' || chr(10) AS body
      FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
q AS (SELECT *, CAST(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, segment ORDER BY place) AS BIGINT) AS stop FROM p)
SELECT conv_id, speaker, segment, count(*) AS n_turns, count(*) FILTER (own) AS n_assistant, string_agg(head || body, '' ORDER BY place) AS text,
       coalesce(string_agg((stop - length(body)) || ':' || stop, ',' ORDER BY place) FILTER (own), '') AS mask
FROM q GROUP BY conv_id, speaker, segment
"""

ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
r AS (SELECT page_id, body, CASE WHEN strlen(body) >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to FROM p)
SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM r
"""

LINES = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT n, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 5),
m AS (SELECT k.*, often.key IS NOT NULL AND k.doc_id IS DISTINCT FROM often.last AS gone FROM k LEFT JOIN often ON k.key = often.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY n
"""
