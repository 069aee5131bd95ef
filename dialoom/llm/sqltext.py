"""SQL twins (DuckDB) of the queries that SQL can express; each is written from the contract, not from the operator."""

from __future__ import annotations

PLAIN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ITEM_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SUBSTRING_DEDUP = f"""WITH d AS MATERIALIZED (SELECT doc_id, {PLAIN} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i+34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT doc_id, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

QUALITY_RULES = rf"""WITH d AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS t, {PLAIN} AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, w[i] AS a, w[i+1] AS b, w[i+2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
tw AS (SELECT doc_id, a, b, c FROM g GROUP BY 1, 2, 3, 4 HAVING count(*) > 1),
rp AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g SEMI JOIN tw USING (doc_id, a, b, c)) GROUP BY doc_id),
m AS (SELECT d.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(rp.n, 0) AS n_repeat_words FROM d LEFT JOIN rp USING (doc_id)),
j AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
s AS MATERIALIZED (SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR n_dup_lines > 10 OR word_chars / greatest(n_words, 1) < 2 OR word_chars / greatest(n_words, 1) > 15 AS soft FROM j),
h AS (SELECT source, count(*) AS n, count(*) FILTER (soft) AS bad FROM s GROUP BY source),
f AS (SELECT avg(bad / n) AS m, coalesce(var_samp(bad / n), 0) AS v, avg(1 / n) AS inv FROM h),
k AS (SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * inv, 1e-6) - 1, 1), 1e6) AS weight FROM f),
r AS (SELECT source, (bad + m * weight) / (n + weight) AS rate FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (rate > 0.5 AND soft) AS kept,
  round(rate, 6) AS host_rate FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source"""

DECONTAMINATION = f"""WITH d AS MATERIALIZED (SELECT doc_id, {ITEM_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 13) AS n FROM (SELECT item_id, {ITEM_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(w[i:i+n-1], ' ') AS k FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS MATERIALIZED (SELECT doc_id, n, i, item FROM dw JOIN bw USING (n, k)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""
