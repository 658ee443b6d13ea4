"""DuckDB SQL for the queries that SQL expresses, written apart from the operators."""

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Sets of five-word shingles, links by counting common shingles, and components by reachability.
JACCARD = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {WORDS.format(ASCII_LOWER)} AS w FROM documents),
t AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM t),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c) UNION SELECT b, a FROM p WHERE 100 * c >= 80 * (na + nb - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, m.b AS component_id FROM t JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON t.doc_id = m.a"""

#: All windows of 13 words with the smallest document that has each; the covered places of every row.
SUBSTRINGS = f"""WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY doc_id, text) AS r, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
v AS MATERIALIZED (SELECT doc_id, r, k, array_to_string(w[k:k + 12], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13) q),
f AS (SELECT s, min(doc_id) AS first FROM v GROUP BY s),
g AS MATERIALIZED (SELECT DISTINCT v.r, v.k + j AS place FROM v JOIN f ON v.s = f.s, range(13) x(j) WHERE f.first < v.doc_id),
k AS (SELECT e.r, string_agg(e.word, ' ' ORDER BY e.place) AS kept FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d) e
  LEFT JOIN g ON g.r = e.r AND g.place = e.place WHERE g.r IS NULL GROUP BY e.r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT r, count(*) AS n FROM g GROUP BY r) c ON c.r = d.r LEFT JOIN k ON k.r = d.r"""

#: Base 32 from the hex digest: five hex digits are four letters.
ARCHIVE = """WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM d)
SELECT page_id, size AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((CAST(concat('0x', substr(x, 1 + 5 * (i // 4), 5)) AS INT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

ORACLE_SQL: dict[str, str] = {"op1_jaccard_join": JACCARD, "op5_substring_dedup": SUBSTRINGS, "op9_warc": ARCHIVE}
