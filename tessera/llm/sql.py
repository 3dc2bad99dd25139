"""DuckDB SQL for the queries that SQL can express."""

from .quality import STOP_WORDS

WORD = r"[^\x20\x09-\x0D]+"

OP8 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, b, substr(h, 1000 * b + 1, 1098) AS c FROM d, unnest(range(0, greatest(0, (length(h) // 2 + 450) // 500))) AS u(b)),
w AS (SELECT doc_id, 500 * b + q AS p, substr(c, 2 * q + 1, 100) AS s FROM c, unnest(range(0, least(500, length(c) // 2 - 49))) AS u(q)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT w.doc_id, w.p FROM w JOIN f USING (s) WHERE f.m < w.doc_id),
o AS (SELECT *, coalesce(p > 50 + lag(p) OVER (PARTITION BY doc_id ORDER BY p), true) AS opens FROM hit),
r AS (SELECT *, count_if(opens) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM o),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY doc_id, k),
x AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS before FROM spans),
t AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
      string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY k) AS kept FROM x JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
v AS (SELECT doc_id, p, sha256(array_to_string(w[p + 1:p + 50], ' ')) AS s FROM d, unnest(range(0, len(w) - 49)) AS u(p)),
f AS (SELECT s, min(doc_id) AS m FROM v GROUP BY s),
hit AS (SELECT v.doc_id, v.p FROM v JOIN f USING (s) WHERE f.m < v.doc_id),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM hit, unnest(range(0, 50)) AS u(k)),
x AS (SELECT d.doc_id, u.p, d.w[u.p + 1] AS word, g.p IS NOT NULL AS cut
      FROM d CROSS JOIN unnest(range(0, len(d.w))) AS u(p) LEFT JOIN gone g ON g.doc_id = d.doc_id AND g.p = u.p),
a AS (SELECT doc_id, count_if(cut) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT cut) AS kept FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_GROUP = " || ".join(f"substr('{_DIGITS}', 1 + ((CAST('0x' || substr(sha, {5 * g + 1}, 5) AS BIGINT) >> {s}) & 31), 1)" for g in range(8) for s in (15, 10, 5, 0))
OP1 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS sha FROM pages),
g AS (SELECT sha, octet_length(b) AS n, max(page_id) AS r FROM p GROUP BY ALL)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, {_GROUP} AS payload_digest,
       CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> r THEN r END AS refers_to
FROM p JOIN g USING (sha)
"""

OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1:p + 5], ' ') AS g FROM d, unnest(range(0, greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END))) AS u(p)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(i, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e2.b, r.c FROM r JOIN e2 ON e2.a = r.i)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT i AS doc_id, min(c) AS component_id FROM r GROUP BY i) c USING (doc_id)
"""

OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p + 1:p + 13], ' ') AS s
      FROM b, unnest(range(0, greatest(len(w) - 12, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END))) AS u(p)),
k AS (SELECT DISTINCT n FROM v),
x AS (SELECT d.doc_id, k.n, u.p, array_to_string(w[p + 1:p + k.n], ' ') AS s FROM d, k, unnest(range(0, len(w) - k.n + 1)) AS u(p)),
hit AS (SELECT x.doc_id, x.p, x.n, v.item_id FROM x JOIN v ON v.n = x.n AND v.s = x.s),
words AS (SELECT doc_id, count(DISTINCT p + j) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM hit), unnest(range(0, n)) AS u(j) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

STOPS = ", ".join(f"'{x}'" for x in STOP_WORDS)
OP6 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
v AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 8], ' ') AS s FROM a, unnest(range(0, len(w) - 7)) AS u(p)),
twice AS (SELECT doc_id, s FROM v GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM (SELECT v.doc_id, v.p FROM v JOIN twice USING (doc_id, s)), unnest(range(0, 8)) AS u(k) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, len(list_intersect(w, [{STOPS}])) AS stops FROM a LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * word_chars BETWEEN 200 * n_words AND 1500 * n_words
       AND 100 * n_symbols <= 10 * n_words AND 100 * n_dup_lines <= 50 * n_lines AND stops >= 2 AS kept
FROM m
"""

ORACLES: dict[str, str] = {"op1_warc": OP1, "op4_jaccard_join": OP4, "op5_decontamination": OP5, "op6_quality_rules": OP6, "op8_suffix_array_dedup": OP8, "op9_substring_dedup": OP9}
