"""DuckDB SQL of the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op5_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS x FROM p),
d AS (SELECT page_id, payload_bytes, x, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST((CAST(('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM f
""",
    "op7_quality": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
w AS (SELECT rid, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - 6, 1))) AS u(i)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM w),
p AS (SELECT rid, least(8, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -8)) AS k FROM c WHERE n > 1),
r AS (SELECT rid, sum(k) AS k FROM p GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
b AS (SELECT rid, ws[i] || ' ' || ws[i + 1] AS g, count(*) AS n FROM d, unnest(range(1, greatest(len(ws), 1))) AS u(i) GROUP BY ALL),
t AS (SELECT rid, max(n) AS top FROM b GROUP BY rid),
m AS (SELECT d.doc_id, len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter, coalesce(t.top, 0) AS top,
  len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS n_bullet, len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[ \\t\\r]*\\z'))) AS n_ellipsis, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(r.k, 0) AS n_repeat_words FROM d JOIN l USING (rid) LEFT JOIN r USING (rid) LEFT JOIN t USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR n_symbols > n_words OR 10 * n_dup_lines > 5 * n_lines OR 2 * n_letter < n_words OR 10 * n_bullet > 9 * n_lines OR 10 * n_ellipsis > 5 * n_lines OR 5 * top > n_words) AS kept FROM m
""",
    "op9_chat": r"""
WITH b AS (SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, 'unknown') AS role, string_split_regex(coalesce(text, ''), '\r?\n') AS ls FROM conversations),
x AS (SELECT rid, conv_id, turn, i, length(regexp_replace(regexp_extract(ls[i], '^(?:[ \t]{0,3}>)+'), '[^>]', '', 'g')) AS lv,
  regexp_replace(ls[i], '^(?:[ \t]{0,3}>)+[ \t]?', '') AS line FROM b, unnest(range(1, len(ls) + 1)) AS u(i)),
n AS (SELECT *, trim(regexp_replace(lower(line), '[\t-\r ]+', ' ', 'g'), ' ') AS h FROM x),
f AS (SELECT *, coalesce(lag(lv) OVER w <> lv OR (lag(lv) OVER w = 0 AND lag(h) OVER w = ''), true) AS starts FROM n WINDOW w AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY rid ORDER BY i) AS run FROM f),
p AS (SELECT rid, conv_id, turn, run, lv, coalesce(list(h ORDER BY i) FILTER (h <> ''), []) AS hs FROM r GROUP BY ALL
  UNION ALL SELECT rid, conv_id, turn, 0, 0, coalesce(list(h ORDER BY i) FILTER (h <> ''), []) FROM r WHERE lv = 0 GROUP BY ALL),
k AS (SELECT DISTINCT rid, conv_id, turn, run, lv, unnest(list_concat([array_to_string(hs, ' ')], string_split(regexp_replace(array_to_string(hs, ' '), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), hs)) AS u FROM p),
q AS (SELECT *, len(string_split(u, ' ')) AS w FROM k WHERE lv > 0 AND u <> ''),
s AS (SELECT q.rid, q.run, q.lv, q.u, q.w, max(o.turn) AS src FROM q JOIN k o ON o.conv_id = q.conv_id AND o.u = q.u AND o.lv = 0 AND o.turn < q.turn GROUP BY ALL),
v AS (SELECT rid, lv, src, sum(w) AS w FROM s GROUP BY ALL),
t AS (SELECT rid, arg_max(src, (-lv, w, src)) AS parent_turn FROM v GROUP BY rid),
d AS (SELECT rid, max(lv) AS depth FROM q GROUP BY rid),
y AS (SELECT rid, coalesce(trim(string_agg(line, chr(10) ORDER BY i) FILTER (lv = 0), ' ' || chr(9) || chr(10) || chr(13)), '') AS body FROM n GROUP BY rid),
m AS (SELECT conv_id, turn, role, parent_turn, coalesce(depth, 0) AS depth, '<|' || role || '|>' || chr(10) || body || chr(10) AS chat,
  CASE WHEN conv_id IS NULL OR turn IS NULL THEN rid ELSE 0 END AS own FROM b JOIN y USING (rid) LEFT JOIN t USING (rid) LEFT JOIN d USING (rid))
SELECT conv_id, 0::BIGINT AS part, min(turn) AS first_turn, count(*)::BIGINT AS n_messages, count(parent_turn)::BIGINT AS n_replies, max(depth)::BIGINT AS depth,
  string_agg(chat, '' ORDER BY turn, role, chat) AS text FROM m GROUP BY conv_id, own
""",
    "op12_minhash": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - 2, 2))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT a.rid AS a, b.rid AS b, a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.rid < b.rid GROUP BY ALL),
l AS (SELECT u, v FROM c JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (WITH RECURSIVE q AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT q.u, e.v FROM q JOIN e ON e.u = q.v) SELECT u AS doc_id, min(v) AS component_id FROM q GROUP BY u)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (rid) JOIN r USING (doc_id)
""",
    "op13_spelling": """
WITH k AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
c AS (SELECT id, w, count(*) AS n, hex(encode(id || ':' || w)) AS x FROM r WHERE length(w) > 5 GROUP BY ALL),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
  lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INT) + 1]))) AS h FROM c, k),
d AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
s AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY word HAVING length(word) > 5 AND sum(n) > 4),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS x FROM s, unnest(range(1, length(word) + 1)) AS u(i)),
e AS (SELECT a.word, b.word AS near, b.n FROM v a JOIN v b USING (i, x) WHERE a.word <> b.word
  UNION SELECT v.word, s.word, s.n FROM v JOIN s ON s.word = v.x UNION SELECT s.word, v.word, v.n FROM v JOIN s ON s.word = v.x),
f AS (SELECT word, count(*) AS n_near, max(n) AS m FROM e GROUP BY word),
g AS (SELECT e.word, min(e.near) AS near FROM e JOIN f ON f.word = e.word AND f.m = e.n GROUP BY e.word),
o AS (SELECT s.word, CASE WHEN m >= 5 * s.n THEN near END AS form, s.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * s.n THEN m END AS form_n FROM s LEFT JOIN f USING (word) LEFT JOIN g USING (word)),
p AS (WITH RECURSIVE q AS (SELECT word, word AS root FROM o UNION ALL SELECT q.word, o.form FROM q JOIN o ON o.word = q.root WHERE o.form IS NOT NULL)
  SELECT q.word, root FROM q JOIN o ON o.word = q.root WHERE o.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM o JOIN p USING (word)
""",
}
