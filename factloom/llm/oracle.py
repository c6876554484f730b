"""SQL for the queries whose rows an SQL engine can compute whole."""

_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

LINES = """WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM t),
n AS (SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS words FROM l),
w AS (SELECT doc_id, i, 3 AS lines, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS k FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY i)
UNION ALL SELECT doc_id, i, 1, line FROM n WHERE words > 50
UNION ALL SELECT doc_id, i, 2, k FROM (SELECT doc_id, i, words + lead(words) OVER d AS words, line || chr(10) || lead(line) OVER d AS k FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY i)) WHERE words > 50),
later AS (SELECT doc_id, i, lines FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM w WHERE k IS NOT NULL) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM later, (VALUES (0), (1), (2)) v(o) WHERE o < lines),
m AS (SELECT l.doc_id, l.i, l.line, g.i IS NOT NULL AS out FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i),
e AS (SELECT *, out AND NOT coalesce(lag(out) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM m),
a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (out) AS n_removed, count(*) FILTER (opens) AS n_runs, string_agg(line, chr(10) ORDER BY i) FILTER (NOT out) AS kept FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN a USING (doc_id)"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

DECONTAMINATION = f"""WITH items AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM items)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM items))),
hit AS (SELECT doc_id, dw.n, s, item_id FROM dw JOIN iw ON iw.k = dw.k AND iw.n = dw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hit GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""

FILTER_AUDIT = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, part, (len(w) < 100)::INTEGER + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INTEGER
+ 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text))::INTEGER
+ 8 * regexp_matches(text, '[#$%&*|]')::INTEGER + 16 * coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false)::INTEGER AS mask FROM t),
l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM d LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT v.f || w.f || x.f || y.f || z.f AS o, [v.b, w.b, x.b, y.b, z.b] AS bs FROM f v, f w, f x, f y, f z WHERE v.b | w.b | x.b | y.b | z.b = 31),
s AS (SELECT o, i::INTEGER AS step, bs[i] AS b, coalesce(list_sum(bs[1:i - 1]), 0)::INTEGER AS seen FROM (SELECT *, unnest(range(1, 6)) AS i FROM o)),
r AS (SELECT part, o AS filter_order, step, b, coalesce(sum(n) FILTER (mask & (seen | b) = 0), 0)::BIGINT AS kept,
coalesce(sum(n) FILTER (mask & b > 0 AND mask & seen = 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (mask & b > 0 AND mask & seen > 0), 0)::BIGINT AS redundant,
coalesce(sum(n) FILTER (mask = b), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (mask & b > 0 AND mask & seen = 0), 0)::BIGINT AS good_lost,
coalesce(sum(toxic) FILTER (mask & b > 0 AND mask & seen = 0), 0)::BIGINT AS toxic_lost FROM m, s GROUP BY 1, 2, 3, 4)
SELECT * EXCLUDE (b), (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley FROM r"""

ORACLE_SQL = {"op6_decontamination": DECONTAMINATION, "op8_exact_topk": TOPK, "op10_line_dedup": LINES, "op12_filter_audit": FILTER_AUDIT}
