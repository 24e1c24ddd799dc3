"""The registered query of each operator, and SQL where SQL can express it."""

from __future__ import annotations

from .archive import op12_warc
from .decontamination import op7_decontamination
from .divergence import op13_divergence
from .embeddings import op2_embeddings
from .filter_audit import op11_filter_audit
from .language import op10_language
from .minhash import op8_minhash
from .packing import op6_packing
from .pii import op5_pii
from .quality import op9_quality
from .secret_scan import op4_secrets
from .tokens import op3_token_counts
from .toxicity import op1_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_embeddings, op3_token_counts, op4_secrets, op5_pii,
        op6_packing, op7_decontamination, op8_minhash, op9_quality, op10_language,
        op11_filter_audit, op12_warc, op13_divergence,
    )
}

ORACLE_SQL = {
    "op2_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT vec_id AS node, vec_id AS other FROM v
  UNION SELECT r.node, p.b FROM reach r JOIN p ON r.other = p.a),
component AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
links AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, CAST(coalesce(links.n, 0) AS BIGINT) AS n_links, c.component_id,
  v.vec_id = c.component_id AS kept
FROM v LEFT JOIN links ON links.a = v.vec_id JOIN component c ON c.node = v.vec_id
""",
    "op11_filter_audit": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
failed AS (
  SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS f FROM words),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
parts AS (
  SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, f),
orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE position(x IN o) = 0),
steps AS (SELECT o AS filter_order, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step FROM orders WHERE len(o) = 5),
here AS (
  SELECT part, filter_order, step, n, good, toxic, f[ascii(substr(filter_order, step, 1)) - 64] AS fails,
    len(list_filter(f, lambda x: x)) AS n_fails,
    len(list_filter([1, 2, 3, 4, 5], lambda k: k < step AND f[ascii(substr(filter_order, k, 1)) - 64])) > 0 AS gone
  FROM parts, steps)
SELECT part, filter_order, step,
  CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (fails AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(sum(n) FILTER (fails AND NOT gone), 0)) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley
FROM here GROUP BY part, filter_order, step
""",
    "op12_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
o AS (SELECT page_id, payload, strlen(payload) AS size, max(page_id) OVER (PARTITION BY payload) AS owner FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN size >= 1000 AND owner IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 1000 AND owner IS DISTINCT FROM page_id THEN owner END AS refers_to
FROM o
""",
    "op13_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  coalesce(text, '') AS text FROM documents),
found AS (
  SELECT row_no, lang, source,
    unnest(list_transform(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'),
      lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM d),
totals AS (SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT row_no) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN totals USING (lang, term) GROUP BY ALL),
langs AS (
  SELECT lang, count(t.term) AS v, coalesce(sum(t.n), 0) AS total
  FROM (SELECT DISTINCT lang FROM d) LEFT JOIN totals t USING (lang) GROUP BY lang),
sizes AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
groups AS (
  SELECT lang, source, coalesce(sizes.total, 0) AS size, v, langs.total AS lang_size
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN sizes USING (lang, source) JOIN langs USING (lang)),
priced AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.size + 2 * v) AS p,
    1 + (1000000000::HUGEINT * (t.n + 2)) // (g.lang_size + 2 * v) AS q
  FROM groups g JOIN totals t ON t.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
valued AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows_of AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN valued v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM priced WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows_of)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
""",
}
