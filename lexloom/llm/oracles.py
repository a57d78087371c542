"""DuckDB SQL of the training-data queries that SQL can express, straight from their contracts."""

ORACLES = {}

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op1_ngram_jaccard_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOW}, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""

ORACLES["op2_benchmark_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOW}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce({_LOW}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(ws), 13) AS k, array_to_string(ws[j : j + 12], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 11, 2))) AS j FROM b WHERE len(ws) > 0)),
x AS (SELECT doc_id, j, k, array_to_string(ws[j : j + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, greatest(len(ws) - k + 2, 1))) AS j FROM d, (SELECT DISTINCT k FROM i))),
m AS (SELECT doc_id, j, x.k, item_id FROM x JOIN i ON x.g = i.g AND x.k = i.k),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS q FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ORACLES["op3_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 19], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 18, 1))) AS i FROM w)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM x) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f),
k AS (SELECT a.doc_id, a.j, ws[a.j] AS word, c.j IS NOT NULL AS gone FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w) a LEFT JOIN c ON a.doc_id = c.doc_id AND a.j = c.j),
g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS starts FROM k),
t AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM g GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t USING (doc_id)
"""

ORACLES["op9_chat_formatting"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
n AS (SELECT *, 22 + length(regexp_replace(role, '([<\[])(\\*)(/?)(s>|INST\])', '\1\\\2\3\4', 'g')) + length(regexp_replace(text, '([<\[])(\\*)(/?)(s>|INST\])', '\1\\\2\3\4', 'g')) AS n FROM c),
k AS (SELECT *, row_number() OVER w AS k, sum(n) OVER w AS upto, count(*) OVER (PARTITION BY conv_id) AS m FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, max(m) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(upto) FILTER (role = 'assistant' OR k = m) AS BIGINT) AS formatted_chars FROM k GROUP BY 1
"""

ORACLES["op8_suffix_array_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents), n AS (SELECT *, length(hx) // 2 AS n FROM d),
c AS (SELECT doc_id, n, k * 1000 AS base, substr(hx, 2000 * k + 1, 2198) AS part FROM (SELECT *, unnest(range(0, (n + 900) // 1000)) AS k FROM n WHERE n >= 100)),
x AS (SELECT doc_id, base + i AS i, md5(substr(part, 2 * i + 1, 200)) AS g FROM (SELECT *, unnest(range(0, least(1000, n - 99 - base))) AS i FROM c)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS turn FROM x) WHERE turn > 1),
r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM f)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM r GROUP BY doc_id, run), p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT p.doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(hx, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(hx), 2 * max(b) + 1) AS kept FROM p JOIN n USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, hx))) AS kept_sha256 FROM n LEFT JOIN k USING (doc_id)
"""

ORACLES["op13_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT k, lang, source, unnest(ws) AS term FROM d),
t AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM t GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN t USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (coalesce(s.total, 0) + 5 * v.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (t.n + 5) // (v.total + 5 * v.v) AS q
      FROM g JOIN t USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""

ORACLES["op12_conversation_trie"] = r"""
WITH RECURSIVE o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth FROM conversations WHERE conv_id IS NOT NULL),
u(x) AS (SELECT unnest(range(0, 256))), tab AS (SELECT list(c ORDER BY x) AS t FROM (SELECT x, list_reduce([CAST(x AS UBIGINT)] || [CAST(0 AS UBIGINT) FOR i IN range(0, 8)], lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN CAST(3988292384 AS UBIGINT) ELSE 0 END)) AS c FROM u)),
n AS (SELECT conv_id, max(nth) AS own, xor(list_reduce([CAST(4294967295 AS UBIGINT)] || [CAST(ord(ch) AS UBIGINT) FOR ch IN string_split(CAST(conv_id AS VARCHAR), '')], lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) % 9 AS h, conv_id - conv_id % 5 AS base FROM o, tab GROUP BY conv_id, t),
c AS (SELECT n.conv_id, n.own, CAST(n.h AS BIGINT) AS h, n.base, least(CAST(n.h AS BIGINT), coalesce(b.own, 0)) AS taken FROM n LEFT JOIN n b ON b.conv_id = n.base),
r AS (SELECT c.conv_id, o.nth AS depth, o.role, o.text FROM c JOIN o ON o.conv_id = c.base AND o.nth <= c.taken UNION ALL SELECT c.conv_id, o.nth - c.h + c.taken, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.nth > c.h),
p AS (SELECT conv_id, 0 AS depth, '' AS key, '' AS before, '' AS text FROM c
      UNION ALL SELECT r.conv_id, r.depth, sha256(p.key || chr(10) || sha256(r.role) || sha256(r.text)), p.key, r.text FROM p JOIN r ON r.conv_id = p.conv_id AND r.depth = p.depth + 1),
g AS (SELECT depth, key, any_value(before) AS before, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * octet_length(encode(any_value(text))) AS v FROM p GROUP BY ALL),
k AS (SELECT depth - 1 AS depth, before AS key, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL),
w AS (SELECT g.*, coalesce(k.n_children, 0) AS n_children FROM g LEFT JOIN k USING (depth, key)),
s AS (SELECT p.depth, p.key, sum(w.v) AS saved, count(*) FILTER (w.n_children = 0) AS leaves FROM p JOIN w ON w.conv_id = p.conv_id AND w.depth >= p.depth GROUP BY ALL),
l AS (SELECT depth, key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, depth, key FROM p QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY ALL)
SELECT w.conv_id, w.depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(l.ends, sha256('')) AS ends_sha256
FROM w JOIN s USING (depth, key) LEFT JOIN l USING (depth, key) LEFT JOIN g q ON q.depth = w.depth - 1 AND q.key = w.before
"""
