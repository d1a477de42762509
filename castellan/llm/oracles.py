"""SQL counterparts of document queries, for DuckDB.

``SUFFIX`` hashes every window of every text, so it suits small tables only.
"""

QUALITY = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 6, 1))) AS i, words FROM d WHERE len(words) >= 8),
w AS (SELECT doc_id, i, array_to_string(words[i : i + 7], ' ') AS win FROM win),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS times FROM w),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM t WHERE times > 1) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
c AS (SELECT doc_id, source AS host, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(u.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN r USING (doc_id) LEFT JOIN u USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
h AS (SELECT host, count(*)::DOUBLE AS n, count(CASE WHEN base_failed THEN 1 END)::DOUBLE AS y FROM f WHERE host IS NOT NULL GROUP BY 1),
g AS (SELECT sum(n) AS n, greatest(least(sum(y) / sum(n), 1 - 1e-6), 1e-6) AS m, count(*) AS k, sum(n * n) AS n2, sum(y * y / n) AS s FROM h),
q AS (SELECT m, CASE WHEN n - n2 / n > 0 THEN (s - n * m * m - (k - 1) * m * (1 - m)) / ((n - n2 / n) * m * (1 - m)) ELSE 0 END AS share FROM g),
p AS (SELECT m * z AS a, (1 - m) * z AS b, least(greatest(0.5, m + 3 * sqrt(m * (1 - m) / (z + 1))), 0.75) AS most FROM (SELECT m, CASE WHEN share > 0 THEN least(greatest(1 / share - 1, 2), 1000) ELSE 1000 END AS z FROM q)),
v AS (SELECT host, (y + a) / (n + a + b) AS rate, n + a + b AS total, most FROM h, p),
o AS (SELECT host, rate - 2 * sqrt(rate * (1 - rate) / (total + 1)) <= most AS host_ok FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(host_ok, true) AS kept FROM f LEFT JOIN o USING (host)
"""
SUFFIX = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, x, CAST(length(x) // 2 AS BIGINT) AS n FROM d),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS m FROM (SELECT doc_id, x, unnest(range(0, n - 399)) AS i FROM s WHERE n >= 400)),
t AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
r AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER k + 400 THEN 0 ELSE 1 END AS new FROM w SEMI JOIN t USING (m) WINDOW k AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
c AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY 1, 2),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM c),
k AS (SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM p JOIN s USING (doc_id) GROUP BY 1)
SELECT s.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM s LEFT JOIN k USING (doc_id)
"""
DEDUP = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
