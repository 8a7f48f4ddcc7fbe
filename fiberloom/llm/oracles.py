"""SQL that gives the same rows as the queries which SQL can express."""

from __future__ import annotations


def revisits(captures: str) -> str:
    return f"""
WITH c AS ({captures}),
b AS (SELECT *, regexp_replace(url, '#.*$', '') AS bare FROM c),
k AS (SELECT *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS head FROM b),
u AS (SELECT *, CASE WHEN head = '' THEN bare ELSE concat(regexp_replace(regexp_replace(head, '^(http://[^/?]*):80$', '\\1'), '^(https://[^/?]*):443$', '\\1'),
  CASE WHEN substring(bare, length(head) + 1, 1) = '/' THEN '' ELSE '/' END, substring(bare, length(head) + 1)) END AS key FROM k),
m AS (SELECT v.record_id, max(struct_pack(at := r.seconds, id := r.record_id)) AS latest FROM u v JOIN u r ON v.key = r.key AND v.kind = 'revisit' AND r.kind = 'response' AND r.seconds < v.seconds GROUP BY 1),
j AS (SELECT v.*, r.record_id AS rid, r.seconds AS rat, r.digest AS rdigest, r.etag AS retag, r.content_length AS rlength
  FROM u v LEFT JOIN m USING (record_id) LEFT JOIN u r ON r.record_id = m.latest.id WHERE v.kind = 'revisit'),
s AS (SELECT *, CASE WHEN rid IS NULL THEN 'orphan' WHEN etag IS NOT NULL AND replace(etag, 'W/', '') <> retag THEN 'mismatch'
  WHEN etag IS NULL AND digest <> rdigest THEN 'mismatch' ELSE 'resolved' END AS verdict FROM j)
SELECT record_id, url, seconds, verdict AS status, CASE WHEN verdict = 'resolved' THEN rid END AS response_id, CASE WHEN verdict = 'resolved' THEN rat END AS response_seconds,
  CASE WHEN verdict = 'resolved' THEN rdigest END AS body_digest, CASE WHEN verdict = 'resolved' THEN coalesce(etag, retag) END AS etag,
  CASE WHEN verdict = 'resolved' THEN cache_control END AS cache_control, CASE WHEN verdict = 'resolved' THEN rlength END AS content_length FROM s
"""


def _norm(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '\\s+', ' ', 'g'), ' .,;:!?\"''')"


def quotations(mail: str) -> str:
    return f"""
WITH RECURSIVE m AS ({mail}),
l AS (SELECT conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS raw FROM m),
k AS (SELECT *, regexp_extract(raw, '^\\s{{0,3}}((?:>\\s?)+)') AS marks FROM l),
v AS (SELECT conv_id, turn, n, length(marks) - length(replace(marks, '>', '')) AS level, substring(raw, length(marks) + 1) AS line FROM k),
e AS (SELECT *, CASE WHEN level <> lag(level) OVER (PARTITION BY conv_id, turn ORDER BY n) THEN 1 ELSE 0 END AS edge FROM v),
r AS (SELECT *, sum(edge) OVER (PARTITION BY conv_id, turn ORDER BY n) AS run FROM e),
p AS (SELECT conv_id, turn, run, level, string_agg(line, chr(10) ORDER BY n) AS text FROM r GROUP BY 1, 2, 3, 4),
own AS (SELECT conv_id, turn, trim(string_agg(text, chr(10) ORDER BY run), concat(' ', chr(9), chr(10), chr(13))) AS text FROM p WHERE level = 0 GROUP BY 1, 2),
o AS (SELECT DISTINCT conv_id, turn, md5({_norm("t")}) AS key FROM (SELECT conv_id, turn, text AS t FROM own UNION ALL SELECT conv_id, turn, unnest(string_split(text, chr(10))) FROM own) WHERE {_norm("t")} <> ''),
qs AS (SELECT conv_id, turn, run, level, 0 AS i, text AS t FROM p WHERE level > 0 UNION ALL
  SELECT conv_id, turn, run, level, generate_subscripts(string_split(text, chr(10)), 1), unnest(string_split(text, chr(10))) FROM p WHERE level > 0),
q AS (SELECT conv_id, turn, run, level, md5({_norm("t")}) AS key, min(i) AS nth FROM qs WHERE {_norm("t")} <> '' GROUP BY 1, 2, 3, 4, 5),
f AS (SELECT q.conv_id, q.turn, q.run, q.level, q.key, q.nth, max(o.turn) AS parent FROM q LEFT JOIN o ON o.conv_id = q.conv_id AND o.key = q.key AND o.turn < q.turn GROUP BY ALL),
g AS (SELECT conv_id, turn, run, level, arg_min(parent, nth) FILTER (parent IS NOT NULL) AS parent, arg_min(key, nth) AS key FROM f GROUP BY 1, 2, 3, 4),
origin AS (SELECT key, min(struct_pack(c := conv_id, t := turn)) AS source FROM o GROUP BY 1),
away AS (SELECT g.conv_id, turn, count(DISTINCT run) AS n FROM g JOIN origin USING (key) WHERE parent IS NULL AND source.c <> g.conv_id GROUP BY 1, 2),
near AS (SELECT conv_id, turn, count(*) AS n, count(parent) AS linked, arg_min(parent, level * 1000000 - parent) FILTER (parent IS NOT NULL) AS parent FROM g GROUP BY 1, 2),
w AS (SELECT m.conv_id, m.turn, m.role, near.parent, coalesce(near.n, 0) AS n_passages, coalesce(near.linked, 0) + coalesce(away.n, 0) AS n_linked, coalesce(own.text, '') AS text
  FROM m LEFT JOIN own USING (conv_id, turn) LEFT JOIN near USING (conv_id, turn) LEFT JOIN away USING (conv_id, turn)),
up AS (SELECT conv_id, turn, turn AS root_turn, 0 AS depth FROM w WHERE parent IS NULL UNION ALL SELECT w.conv_id, w.turn, up.root_turn, up.depth + 1 FROM w JOIN up ON w.conv_id = up.conv_id AND w.parent = up.turn)
SELECT conv_id, turn, role, parent AS parent_turn, CAST(depth AS BIGINT) AS depth, root_turn, CAST(n_passages AS BIGINT) AS n_passages, CAST(n_linked AS BIGINT) AS n_linked, text FROM w JOIN up USING (conv_id, turn)
"""
