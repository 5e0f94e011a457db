"""SQL of the registered queries of this subpackage, where SQL can say them."""

ORACLE = {
    "op11_decontaminate": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[i:i + 9], ' ') AS t
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), places AS (
  SELECT r, i, m, array_to_string(ws[i:i + m - 1], ' ') AS t
  FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win))
), hits AS (
  SELECT r, i, m, item_id FROM places JOIN win USING (m, t)
), words AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + m)) AS p FROM hits) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM hits GROUP BY r
)
SELECT doc_id, len(ws) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(items.names, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
""",
    "op12_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up,
    min(doc_id) OVER (PARTITION BY t) AS lo FROM d
), m AS (
  SELECT part, doc_id,
    [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * up > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > lo, false)] AS f
  FROM w
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), h AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x
  FROM (SELECT part, f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM m LEFT JOIN l USING (doc_id)) GROUP BY part, f
), s AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS ord FROM s a, s b, s c, s d, s e
  WHERE a.c <> b.c AND a.c <> c.c AND a.c <> d.c AND a.c <> e.c AND b.c <> c.c AND b.c <> d.c AND b.c <> e.c AND c.c <> d.c AND c.c <> e.c AND d.c <> e.c
), st AS (
  SELECT ord, CAST(step AS INT) AS step, ord[CAST(step AS INT)] AS letter FROM o, range(1, 6) r(step)
), r AS (
  SELECT part, f, n, g, x, ord, step, letter, f[strpos('ABCDE', letter)] AS bad,
    bool_or(f[strpos('ABCDE', letter)]) OVER (PARTITION BY part, f, ord ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was,
    len(list_filter(f, lambda y: y)) AS fails FROM h, st
), a AS (
  SELECT part, ord AS filter_order, step, letter,
    CAST(sum(n) FILTER (NOT bad AND NOT coalesce(was, false)) AS BIGINT) AS kept,
    CAST(sum(n) FILTER (bad AND NOT coalesce(was, false)) AS BIGINT) AS removed,
    CAST(sum(n) FILTER (bad AND coalesce(was, false)) AS BIGINT) AS redundant,
    CAST(sum(n) FILTER (bad AND fails = 1) AS BIGINT) AS unique_fails,
    CAST(sum(g) FILTER (bad AND NOT coalesce(was, false)) AS BIGINT) AS good_lost,
    CAST(sum(x) FILTER (bad AND NOT coalesce(was, false)) AS BIGINT) AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
  coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM a
""",
    "op13_prefix_trie": r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', role, text))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), s AS (
  SELECT c, max(p) AS n FROM t GROUP BY c
), h AS (
  SELECT c, c - c % 20 AS b, xor(list_reduce(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ord(CAST(c AS VARCHAR)[i]) AS BIGINT)),
    lambda crc, byte: list_reduce(range(0, 8), lambda k, j: CASE WHEN k % 2 = 1 THEN xor(k // 2, 3988292384) ELSE k // 2 END, xor(crc, byte)),
    CAST(4294967295 AS BIGINT)), 4294967295) % 4 AS h
  FROM s
), k AS (
  SELECT h.c, h.b, h.h, least(h.h, coalesce(s.n, 0)) AS taken FROM h LEFT JOIN s ON s.c = h.b
), rebuilt AS (
  SELECT k.c, t.p AS d, t.r, t.x FROM k JOIN t ON t.c = k.b AND t.p <= k.taken
  UNION ALL
  SELECT k.c, t.p - k.h + k.taken, t.r, t.x FROM k JOIN t ON t.c = k.c AND t.p > k.h
), lengths AS (
  SELECT k.c, coalesce(max(d), 0) AS n FROM k LEFT JOIN rebuilt USING (c) GROUP BY k.c
), prefixes AS (
  SELECT c, d, list({'r': r, 'x': x}) OVER (PARTITION BY c ORDER BY d) AS path, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words FROM rebuilt
  UNION ALL
  SELECT c, 0, [], 0 FROM lengths
), nodes AS (
  SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    string_agg(CASE WHEN n = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends
  FROM prefixes JOIN lengths USING (c) GROUP BY d, path
), linked AS (
  SELECT v.*, p.conv_id AS parent_conv_id FROM nodes v LEFT JOIN nodes p ON p.d = v.d - 1 AND p.path = v.path[1:v.d - 1]
), children AS (
  SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), known AS (
  SELECT v.*, coalesce(children.n, 0) AS n_children FROM linked v LEFT JOIN children USING (d, path)
), below AS (
  SELECT a AS d, path[1:a] AS path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM known) GROUP BY ALL
)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM known JOIN below USING (d, path)
""",
}
