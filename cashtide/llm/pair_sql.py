"""SQL of the two similarity joins: all pairs that share anything, counted, and everything reachable by links."""

_REACH = """
reach AS (SELECT rid AS a, rid AS b FROM {rows} UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)"""

JACCARD_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM d),
ids AS (SELECT sh, row_number() OVER () AS k FROM s GROUP BY sh HAVING count(*) > 1),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
t AS (SELECT rid, k FROM s JOIN ids USING (sh)),
c AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM t x JOIN t y ON x.k = y.k AND x.rid <> y.rid GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
{_REACH.format(rows="d")}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(o.doc_id)::BIGINT AS component_id
FROM d JOIN reach ON a = d.rid JOIN d o ON o.rid = b LEFT JOIN n ON n.rid = d.rid GROUP BY d.rid, d.doc_id, n.n"""

EMBEDDINGS_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT rid, label, v, sqrt(list_dot_product(v, v)) AS size FROM d WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
  AND NOT list_contains(list_transform(v, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true)),
links AS (SELECT x.rid AS a, y.rid AS b FROM u x JOIN u y ON x.label = y.label AND x.rid <> y.rid AND len(x.v) = len(y.v)
  WHERE x.size > 0 AND y.size > 0 AND list_dot_product(x.v, y.v) / (x.size * y.size) >= 0.93::DOUBLE),
{_REACH.format(rows="d")},
low AS (SELECT a, min(o.vec_id) AS low FROM reach JOIN d o ON o.rid = b GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = d.rid)::BIGINT AS n_links, low::BIGINT AS component_id, vec_id IS NOT DISTINCT FROM low AS kept FROM d JOIN low ON low.a = d.rid"""
