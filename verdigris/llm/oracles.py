"""DuckDB SQL for the queries that SQL can express."""

OP3 = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best AS (
  SELECT u.host, u.path, max_by(r.h || r.p, length(r.h || r.p)) AS rule, max_by(r.v, length(r.h || r.p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM u) u JOIN r
    ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
  GROUP BY u.host, u.path)
SELECT page_id, u.host, u.path, rule, coalesce(verdict, 'allow') AS verdict
FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS stratum, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
w AS (
  SELECT row_id, i, count(*) OVER (PARTITION BY row_id, win) AS n FROM (
    SELECT doc_id AS row_id, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] AS win
    FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 2)) AS i FROM d WHERE len(ws) >= 3))),
rep AS (SELECT row_id, count(DISTINCT i + j) AS n FROM w, range(3) AS o(j) WHERE n > 1 GROUP BY 1),
m AS (
  SELECT doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z!]+', '', 'g')) AS n_shouting
  FROM d LEFT JOIN rep ON row_id = doc_id),
s AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    [CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END,
     CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END, CASE WHEN word_chars > 0 THEN n_shouting / word_chars ELSE 0 END] AS sig
  FROM m),
lab AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
l AS (SELECT stratum, good, sig FROM s JOIN lab USING (doc_id) WHERE NOT base_failed),
p AS (SELECT * FROM l WHERE stratum IN (SELECT stratum FROM l WHERE good = 1 GROUP BY 1 HAVING count(*) * ln(0.995) <= ln(0.05 / 48))),
g AS (SELECT unnest([0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS cutoff),
tests AS (
  SELECT stratum, j, cutoff, count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 1 AND sig[j] > cutoff) AS k, count(*) FILTER (good = 0 AND sig[j] > cutoff) AS caught
  FROM p, g, range(1, 5) AS o(j) GROUP BY ALL),
cert AS (
  SELECT stratum, j, max({'gain': caught - 20 * k, 'cutoff': cutoff}).cutoff AS cutoff FROM tests
  WHERE caught > 20 * k AND n > 0 AND k < n * 0.005 AND
    list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.005) + (n - i) * ln(0.995))))
      <= 0.05 / ((SELECT count(DISTINCT stratum) FROM p) * 4 * 12)
  GROUP BY ALL),
bad AS (
  SELECT DISTINCT doc_id FROM s JOIN cert ON cert.stratum = s.stratum
  WHERE sig[j] > cert.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (FROM bad) AS kept
FROM s
"""

OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
items AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i + 1:i + n], ' ') AS win
  FROM (SELECT item_id, ws, least(8, len(ws)) AS n, unnest(range(0, len(ws) - least(8, len(ws)) + 1)) AS i FROM b WHERE len(ws) > 0)),
spots AS (
  SELECT doc_id, n, i, array_to_string(ws[i + 1:i + n], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(0, greatest(0, len(ws) - n + 1))) AS i FROM d, (SELECT DISTINCT n FROM items))),
hit AS (SELECT doc_id, item_id, i, s.n FROM spots s JOIN items ON s.win = items.win AND s.n = items.n),
w AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, range(8) AS o(j) WHERE j < n GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN found USING (doc_id)
"""

ORACLES = {
    "op9_decontaminate": OP9,
    "op4_quality": OP4,
    "op3_url_filter": OP3,
}
