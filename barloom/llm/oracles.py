"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {}

ORACLES["op4_url_filters"] = f"""
WITH cut AS (
    SELECT page_id,
           coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
           coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages
), rules(rule_host, rule_path, verdict) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
           ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fitting AS (
    SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
           arg_max(verdict, length(rule_host || rule_path)) AS verdict
    FROM cut JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM cut LEFT JOIN fitting USING (page_id)
"""

ORACLES["op6_exact_dedup"] = f"""
WITH normal AS (
    SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body FROM documents
)
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(body) AS text_sha256
FROM normal
WINDOW same AS (PARTITION BY body)
"""

ORACLES["op9_line_dedup"] = """
WITH split AS (
    SELECT doc_id, unnest(range(len(parts))) AS place, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), lines AS (
    SELECT doc_id, place, line, lead(place) OVER each_doc AS next_place, lead(line) OVER each_doc AS next_line
    FROM split WHERE trim(line) <> '' WINDOW each_doc AS (PARTITION BY doc_id ORDER BY place)
), pairs AS (
    SELECT doc_id, place, next_place, row_number() OVER (PARTITION BY line, next_line ORDER BY doc_id, place) AS copy
    FROM lines WHERE next_line IS NOT NULL
), long AS (
    SELECT doc_id, place, row_number() OVER (PARTITION BY line ORDER BY doc_id, place) AS copy
    FROM lines WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= 50
), deleted AS (
    SELECT doc_id, place FROM pairs WHERE copy > 1
    UNION SELECT doc_id, next_place FROM pairs WHERE copy > 1
    UNION SELECT doc_id, place FROM long WHERE copy > 1
), kept AS (
    SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.place) AS body
    FROM split s ANTI JOIN deleted USING (doc_id, place) GROUP BY s.doc_id
), counts AS (
    SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id
), gone AS (
    SELECT doc_id, count(*) AS n_deleted FROM deleted GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted,
       length(coalesce(body, '')) AS n_chars, sha256(coalesce(body, '')) AS text_sha256
FROM documents LEFT JOIN counts USING (doc_id) LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES["op11_hard_negatives"] = """
WITH used AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM used a JOIN used b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER nearest AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW nearest AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER nearest <= 3
"""

ORACLES["op12_decontamination"] = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), b AS (
    SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item, w[i:i + least(len(w), 10) - 1] AS g
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), places AS (
    SELECT r, i, n, w[i:i + n - 1] AS g
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT len(g) AS n FROM windows) ON len(w) >= n)
), hits AS (
    SELECT r, i, n, item FROM places JOIN windows USING (g)
), covered AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), named AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
