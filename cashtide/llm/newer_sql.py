"""SQL of conversation repair and vector codes: the same results by other ways (whole audit texts; all distances)."""

REPAIR_SQL = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '.'), lambda x: ascii(x)::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))) AS c FROM conversations),
h AS (SELECT * EXCLUDE c, xor(c, 4294967295::UBIGINT) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) FROM h WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,  regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said FROM d),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copy FROM n),
f AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '?' END AS initial FROM m),
rows_ AS (SELECT conv_id, list(struct_pack(role, text, fault, initial) ORDER BY i) AS r, count(*) AS n FROM f GROUP BY conv_id),
move(a, b, x) AS (VALUES ('n', 's', 's'), ('n', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
run(a, b, ins) AS (SELECT s, s, '' FROM (VALUES ('n'), ('s'), ('u'), ('a')) t(s) UNION ALL SELECT a, b, x FROM move WHERE x <> 's'
  UNION ALL SELECT m.a, o.b, m.x || o.x FROM move m JOIN move o ON m.b = o.a WHERE m.x <> 's' AND o.x <> 's'),
p AS (
  SELECT conv_id, r, n, 0 AS i, 'n' AS s, 0 AS cost, '' AS audit, ''::VARCHAR AS said FROM rows_
  UNION ALL
  (SELECT conv_id, r, n, i, s, cost, audit, said FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) AS best FROM (
      SELECT p.conv_id, p.r, p.n, p.i + 1 AS i, e.s, p.cost + 3 * len(run.ins) + e.cost AS cost, p.audit || repeat('I', len(run.ins)) || e.op AS audit,
        p.said || coalesce(list_aggregate(list_transform(regexp_extract_all(run.ins, '.'), lambda x: CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END || chr(10)), 'string_agg', ''), '') || e.said AS said
      FROM p JOIN run ON run.a = p.s, LATERAL (
        SELECT run.b AS s, 4 AS cost, 'D' AS op, '' AS said
        UNION ALL SELECT m.b, CASE p.r[p.i + 1].fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', p.r[p.i + 1].role || ':' || p.r[p.i + 1].text || chr(10) FROM move m
          WHERE m.a = run.b AND m.x = p.r[p.i + 1].initial AND p.r[p.i + 1].fault NOT IN ('blank', 'duplicate')
        UNION ALL SELECT m.b, CASE p.r[p.i + 1].fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', CASE m.x WHEN 'u' THEN 'user:' ELSE 'assistant:' END || p.r[p.i + 1].text || chr(10) FROM move m
          WHERE m.a = run.b AND m.x <> 's' AND p.r[p.i + 1].fault NOT IN ('blank', 'duplicate')) e
      WHERE p.i < p.n)) WHERE best = 1)),
o AS (SELECT * FROM (SELECT conv_id, cost + 3 * len(ins) AS cost, audit || repeat('I', len(ins)) AS audit,
    said || coalesce(list_aggregate(list_transform(regexp_extract_all(ins, '.'), lambda x: CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END || chr(10)), 'string_agg', ''), '') AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY cost + 3 * len(ins), audit || repeat('I', len(ins))) AS best
  FROM p JOIN run ON run.a = p.s WHERE i = n AND run.b IN ('n', 'a')) WHERE best = 1),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f) GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN o ON c.conv_id IS NOT DISTINCT FROM o.conv_id"""


def _codes_sql(rounds: int = 6, entries: int = 16, parts: int = 8) -> str:
    """Every distance of every round, one block of two tables a round."""
    text = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true)),
x AS MATERIALIZED (SELECT rid, vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM v, range({parts}) t(p)),
c0 AS MATERIALIZED (SELECT p, rid - 1 AS e, v AS c FROM x WHERE rid <= {entries})"""
    for r in range(rounds + 1):
        text += f""",
a{r} AS MATERIALIZED (SELECT rid, x.p, v, min(struct_pack(d := list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := e)) AS best FROM x JOIN c{r} USING (p) GROUP BY ALL)"""
        if r < rounds:
            text += f""",
s{r} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, best.e AS e, i, (sum(v[i])::BIGINT - ((sum(v[i])::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS m FROM a{r}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY ALL) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(s{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN s{r} USING (p, e))"""
    return text + f""",
o AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY rid),
b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN o USING (rid), b"""


CODES_SQL = _codes_sql()
