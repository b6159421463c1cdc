"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from ledgerrecon.llm.licenses import COPYRIGHT_LINE, KNOWN_TEXTS, SPELLINGS

ORACLES: dict[str, str] = {
    "op2_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT size FROM g),
p AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, s WHERE len(w) >= size)),
h AS (SELECT p.doc_id, p.i, p.size, g.item FROM p JOIN g USING (size, win)),
n AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT doc_id, i, size FROM h)) GROUP BY 1),
t AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op5_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (
  SELECT doc_id, i, md5_number(array_to_string(w[i : i + 19], ' ')) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM p),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM o WHERE k > 1),
r AS (SELECT doc_id, list(k) AS gone FROM g GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w
         ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
""",
    "op7_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM c GROUP BY 1) m USING (doc_id)
""",
    "op12_ranked_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS n_all, sum(len(w))::BIGINT AS l_all FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY 1, 2),
q AS (
  SELECT item_id, t, count(*) AS reps FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM benchmark) GROUP BY 1, 2),
f AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT t, count(*) AS df FROM p GROUP BY 1), s),
m AS (SELECT r, doc_id, 75 + (25 * len(w) * n_all) // l_all AS m FROM d, s WHERE len(w) > 0),
x AS (
  SELECT item_id, r, CAST(sum(reps * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN f USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY 1, 2),
k AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
  FROM x JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
""",
    "op9_url_filters": r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r(rule, verdict, h, p) AS (VALUES
  ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
w(word) AS (VALUES ('cheap[^a-z0-9/]+pills'), ('spam[^a-z0-9/]+farm'), ('casino'), ('free[^a-z0-9/]+money'), ('adult')),
m AS (
  SELECT page_id, host, path,
         (SELECT max(struct_pack(n := length(rule), rule := rule, verdict := verdict)) FROM r
          WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best,
         (SELECT count(*) FROM w WHERE regexp_matches(host, '(^|[^a-z0-9])' || word || '([^a-z0-9]|$)')) AS spam
  FROM u)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN spam > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM m
""",
}


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '', 'g')"
    for other, kept in SPELLINGS:
        out = f"replace({out}, '{other}', '{kept}')"
    return f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"


_KNOWN = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN_TEXTS)
ORACLES["op8_license_scans"] = f"""
WITH k AS (
  SELECT sha256(form) AS digest, min(name) AS name FROM (
    SELECT name, trim(regexp_replace({_canonical("t")}, '[ \\n]+', ' ', 'g')) AS form FROM (VALUES {_KNOWN}) v(name, t)) GROUP BY 1),
d AS (SELECT doc_id, {_canonical("coalesce(text, '')")} AS t FROM documents),
w AS (SELECT doc_id, t, trim(regexp_replace(t, '[ \\n]+', ' ', 'g')) AS form FROM d),
n AS (
  SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) JOIN k ON k.digest = sha256(trim(line)) GROUP BY 1)
SELECT w.doc_id, CASE WHEN form <> '' THEN sha256(form) END AS text_digest, k.name AS license_id, coalesce(notices, '') AS notices
FROM w LEFT JOIN k ON form <> '' AND k.digest = sha256(form) LEFT JOIN n USING (doc_id)
"""
