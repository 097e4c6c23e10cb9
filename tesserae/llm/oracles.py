"""What the queries of this subpackage compute, where SQL can express it.

The others rest on hashes, models or searches that the SQL engine does not have; tests hold them against
brute force, and the ``part`` queries hold what SQL can say of them.
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op8_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents), w AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS g FROM d, unnest(range(0, n - 49)) AS r(i)),
 f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g), b AS (SELECT doc_id, i FROM w JOIN f USING (g) WHERE first < doc_id),
 m AS (SELECT *, CASE WHEN i <= lag(i) OVER o + 50 THEN 0 ELSE 1 END AS new FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY i)), l AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM m),
 s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS e FROM l GROUP BY doc_id, island), p AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
 k AS (SELECT doc_id, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(e) + 1 AS BIGINT)) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
 SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "part1_shard_totals": "SELECT count(*) AS n_rows, CAST(sum(strlen(coalesce(text, '')) + 8) AS BIGINT) AS bytes, true AS gapless, count(DISTINCT coalesce(text, '')) AS n_texts, true AS whole FROM documents",
    "part2_secret_counts": r"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS n_assign, len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex FROM documents""",
    "part6_base_rules": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents), g AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS g FROM d, unnest(range(0, len(w) - 4)) AS r(i)),
 t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1), c AS (SELECT doc_id, sum(least(5, coalesce(nx, i + 5) - i)) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM t) GROUP BY doc_id),
 x AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS l, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN c ON d.doc_id = c.doc_id)
 SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x""",
    "part9_targets": rf"""WITH RECURSIVE s AS (SELECT source, CAST(sum(len({_WORDS})) AS BIGINT) AS size FROM documents GROUP BY source), w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight FROM s),
 o AS (SELECT *, 3.0 * size AS cap, row_number() OVER (ORDER BY 3.0 * size / weight, source NULLS LAST) AS nth FROM w), total AS (SELECT sum(size) AS t FROM s),
 r AS (SELECT nth, cap, weight, (SELECT t FROM total) - coalesce(sum(cap) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open, sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy FROM o),
 level AS (SELECT max(open / heavy) FILTER (open / heavy * weight <= cap) AS lv FROM r)
 SELECT source, size AS source_size, round(least(cap, coalesce((SELECT lv FROM level), cap / weight) * weight), 2) AS target, true AS near FROM o""",
    "op10_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html)
 SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha256(p.html) AS payload_digest, CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f ON p.html = f.html""",
}
