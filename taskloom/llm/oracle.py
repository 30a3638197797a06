"""The queries of the operators in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
g AS (SELECT doc_id, i, w[i:i + 7] AS g FROM p),
r AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g JOIN r USING (doc_id, g), (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT s) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS s FROM d) WHERE regexp_matches(s, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
coalesce(l.n, 0) AS n_lines, length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F\x{80}-\x{BF}]', '', 'g')) + length(regexp_replace(t, '[^\x{80}-\x{BF}]', '', 'g')) AS letters, len(list_distinct(w)) AS kinds, len(list_distinct([w[i:i + 2] for i in range(1, len(w) - 1)])) AS triples FROM d LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_dup_lines > 6 * n_lines OR 2 * letters < word_chars OR (n_words > 50 AND 20 * kinds < n_words) OR (n_words > 50 AND 3 * triples < n_words - 2)) AS kept FROM f
"""

CHAT = """
WITH r AS (SELECT DISTINCT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS side, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
t AS (SELECT pair_id, turn, list((role, text) ORDER BY role, text) FILTER (side) AS a, list((role, text) ORDER BY role, text) FILTER (NOT side) AS b FROM r GROUP BY pair_id, turn),
f AS (SELECT pair_id, min(turn) FILTER (a IS DISTINCT FROM b) AS fork FROM t GROUP BY pair_id),
k AS (SELECT pair_id, any_value(fork) AS fork, count(*) FILTER (fork IS NULL OR turn < fork) AS prompt_turns FROM t JOIN f USING (pair_id) GROUP BY pair_id),
m AS (SELECT r.*, fork, prompt_turns, CASE WHEN fork IS NULL OR turn < fork THEN CASE WHEN side THEN 'prompt' END WHEN side THEN 'chosen' ELSE 'rejected' END AS part, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s,
length(role) + 5 AS head, length(text) + 8 AS body FROM r JOIN k USING (pair_id)),
o AS (SELECT *, sum(head + body) OVER (PARTITION BY pair_id, part ORDER BY turn, role, text) AS upto FROM m WHERE part IS NOT NULL)
SELECT pair_id, coalesce(string_agg(s, '' ORDER BY turn, role, text) FILTER (part = 'prompt'), '') AS prompt, coalesce(string_agg(s, '' ORDER BY turn, role, text) FILTER (part = 'chosen'), '') AS chosen, coalesce(string_agg(s, '' ORDER BY turn, role, text) FILTER (part = 'rejected'), '') AS rejected,
coalesce(string_agg(CAST(upto - body AS BIGINT) || '-' || CAST(upto AS BIGINT), ',' ORDER BY turn, role, text) FILTER (part = 'chosen' AND role = 'assistant'), '') AS chosen_spans,
coalesce(string_agg(CAST(upto - body AS BIGINT) || '-' || CAST(upto AS BIGINT), ',' ORDER BY turn, role, text) FILTER (part = 'rejected' AND role = 'assistant'), '') AS rejected_spans,
any_value(prompt_turns) AS prompt_turns, any_value(fork IS NOT NULL) AS differ FROM o GROUP BY pair_id
"""

DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w, least(8, len(w)) AS n FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, n, w[k:k + n - 1] AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
q AS (SELECT doc_id, n, k, w[k:k + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
h AS (SELECT doc_id, q.n, k, item_id FROM q JOIN v ON q.g = v.g AND q.n = v.n),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY doc_id),
e AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id)
"""

SHARDING = """
WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, text) - 1 AS copy, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, md5(coalesce(text, '')) AS m FROM documents),
h AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || m || ':' || copy), 1, 15) AS BIGINT) AS h FROM r),
p AS (SELECT *, d, h >> (60 - d) AS p FROM h, (SELECT CAST(unnest(range(61)) AS INTEGER) AS d)),
s AS (SELECT d, p, sum(n_bytes) AS b, count(*) AS n FROM p GROUP BY d, p),
f AS (SELECT doc_id, copy, n_bytes, h, min(d) AS depth FROM p JOIN s USING (d, p) WHERE b <= 1048576 OR n = 1 GROUP BY doc_id, copy, n_bytes, h)
SELECT doc_id, copy, n_bytes, depth, substr(lpad(bin(h), 60, '0'), 1, depth) AS shard FROM f
"""

DEDUP = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
s AS (SELECT doc_id, unnest(range(0, octet_length(t) - 199)) AS i, t FROM d WHERE octet_length(t) >= 200),
k AS (SELECT doc_id, i, md5_number(t[i + 1:i + 200]) AS g FROM s),
r AS (SELECT g FROM k GROUP BY g HAVING count(*) > 1),
m AS (SELECT doc_id, i, max(i + 200) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM k SEMI JOIN r USING (g)),
n AS (SELECT doc_id, i, sum(CASE WHEN e IS NULL OR i > e THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM m),
a AS (SELECT doc_id, z, min(i) AS a, max(i) + 200 AS b FROM n GROUP BY doc_id, z),
u AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM a GROUP BY doc_id),
o AS (SELECT doc_id, lag(b, 1, 0) OVER w AS x, a AS y FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY a) UNION ALL SELECT doc_id, coalesce(max(b), 0), any_value(octet_length(t)) FROM d LEFT JOIN a USING (doc_id) GROUP BY doc_id),
q AS (SELECT doc_id, string_agg(hex(t[x + 1:y]), '' ORDER BY x) AS kept FROM o JOIN d USING (doc_id) WHERE x < y GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN u USING (doc_id) LEFT JOIN q USING (doc_id)
"""

URLS = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
l AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) v(verdict, rh, rp)),
f AS (SELECT page_id, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k FROM h JOIN l ON (host = rh OR suffix(host, '.' || rh)) AND prefix(path, rp))
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN f ON f.page_id = h.page_id AND k = 1
"""

JACCARD = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 85 * (a.n + b.n - o)),
c(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x)
SELECT c.x AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c.y) AS component_id FROM c LEFT JOIN n ON n.doc_id = c.x GROUP BY c.x
"""

PAGES = r"""
WITH a AS (SELECT page_id, url, regexp_split_to_array(coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''), '</?(p|h1)>') AS b FROM pages),
u AS (SELECT page_id, k, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(b[k], '<br>', ' ', 'g'), '</?b>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g')) AS t FROM (SELECT page_id, b, unnest(range(1, len(b) + 1)) AS k FROM a)),
t AS (SELECT page_id, string_agg(t, chr(10) ORDER BY k) AS text FROM u WHERE t <> '' GROUP BY page_id)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM pages LEFT JOIN t USING (page_id)
"""

#: PAGES is for pages whose article has paragraphs, headings, bold text and breaks only, as the given ones are.
ORACLE_SQL = {
    "op4_html_extraction": PAGES,
    "op1_quality_rules": QUALITY,
    "op2_chat_formatting": CHAT,
    "op3_benchmark_decontamination": DECONTAMINATION,
    "op6_sharding": SHARDING,
    "op7_suffix_array_dedup": DEDUP,
    "op8_url_filters": URLS,
    "op10_ngram_jaccard_join": JACCARD,
}
