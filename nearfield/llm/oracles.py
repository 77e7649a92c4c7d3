"""SQL for DuckDB that gives the rows of those queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"'[^\x20\x09-\x0D]+'"

OP1 = f"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_ALNUM} AS w FROM benchmark) WHERE len(w) > 0 AND item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, n, w[p:p + n - 1] AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n),
h AS (SELECT doc_id, p, dp.n, item_id FROM dp JOIN iw ON dp.n = iw.n AND w[p:p + dp.n - 1] = win),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM h)) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN o ON d.doc_id = o.doc_id"""

OP7 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
g AS (SELECT doc_id, p, w[p:p + 4] AS win FROM (SELECT *, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) > 4)),
r AS (SELECT doc_id, win FROM g GROUP BY doc_id, win HAVING count(*) > 1),
q AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT g.doc_id, unnest(range(p, p + 5)) AS k FROM g JOIN r ON g.doc_id = r.doc_id AND g.win = r.win) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_SPACED})) AS l, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN q ON d.doc_id = q.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
NOT base_failed AND 10 * n_symbols <= n_words AS kept FROM b"""

OP8 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p),
c AS (SELECT *, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(s, g * 5 + 1, 5) AS BIGINT) >> CAST(15 - 5 * k AS INTEGER)) % 32 + 1 AS BIGINT), 1)), '')), '') AS b32 FROM f)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, b32 AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM c"""

OP9 = r"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '[\[<]\\*(/?INST\]|/?s>|</?SYS>>|</?ROLE)')) + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 21 + length(url_encode(role)) END AS n FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[p:p + 2] AS g FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 1))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS doc_id, b AS other FROM e UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.other = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(other) FROM reach WHERE reach.doc_id = d.doc_id), d.doc_id)) AS component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id"""

ORACLES = {"op1_decontaminate": OP1, "op7_quality": OP7, "op8_warc": OP8, "op9_chat": OP9, "op10_jaccard": OP10}
