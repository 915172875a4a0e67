"""Queries of statements, emissions, the board, findings and nested windows over the whole tables, and their SQL (after oracle.BASE).

What the test tables lack (sources of amounts, events, tasks, earlier findings) is made from keys by rule, alike in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import board, checks, emissions, findings, ids, projection, statements
from ..sources import adapters

START, WINDOWS = "1998-01-01", (7, 30, 365)


def _statements(spark, d):
    i, k = adapters.instances(spark, d).where("confidence = 'very_low'"), F.col("id")
    source = F.when(k % 3 == 0, statements.ROLLUP).when((k % 3 == 1) & (k % 7 == 0), "portal_statement_amount").when(k % 3 == 2, "manual")
    return i.select(
        "id", F.col("entity_id").alias("target"), F.last_day("due_date").alias("closes"), F.date_add("due_date", 20).alias("due_date"), F.when(k % 2 == 0, F.col("amount") * 3).otherwise(F.col("amount")).cast(adapters.MONEY).alias("amount"),
        F.when(k % 5 == 0, "confirmed").otherwise("estimated").alias("amount_status"), source.alias("amount_source"),
        F.when((k % 3 == 0) & (k % 4 != 0), F.round(F.col("amount") * F.lit("0.25").cast("decimal(3,2)"), 2)).cast(adapters.MONEY).alias("baseline"), F.lit("medium").alias("confidence"), F.lit("own").alias("notes"),
    )


def _inputs(spark, d):
    i, k = adapters.instances(spark, d).where("direction = 'outflow' and confidence <> 'very_low'"), F.col("id")
    return i.select("id", F.when(k % 9 != 0, F.col("entity_id")).alias("target"), "due_date", "amount", F.when(k % 4 != 0, F.col("confidence")).alias("confidence"))


def _sums(spark, d):
    return statements.cycles(_statements(spark, d), _inputs(spark, d))


def statement_inputs(spark, d):
    return _sums(spark, d)


def statement_recompute(spark, d):
    found = statements.recompute(_statements(spark, d), _sums(spark, d).where("cycle_id % 11 <> 0"))
    return found.select("id", "amount", "amount_source", "baseline", "confidence", "action")


def statement_recompute_given(spark, d):
    found = statements.recompute(_statements(spark, d), _sums(spark, d).where("cycle_id % 11 <> 0"), baseline="1000.50")
    return found.select("id", "amount", "baseline", "action")


def _actuals(spark, d):
    s, k = _statements(spark, d), F.col("id")
    closes = F.when(k % 4 != 1, F.when(k % 10 == 0, F.date_add("closes", 1)).otherwise(F.col("closes")))
    return s.select(
        k.alias("actual_id"), "target", F.when(k % 8 != 3, closes).alias("closes"), F.when((k % 4 != 0) & (k % 8 != 3), F.col("due_date")).alias("due_date"),
        (-F.col("amount") - 1).cast(adapters.MONEY).alias("amount"), F.lit("portal_statement_amount").alias("source"), F.when(k % 2 == 0, "seen").alias("note"),
    )


def statement_actuals(spark, d):
    return statements.observed(_statements(spark, d), _actuals(spark, d))


def statement_set_actual(spark, d):
    found = statements.set_actual(_statements(spark, d), _actuals(spark, d))
    return found.select("id", "amount", "amount_status", "amount_source", "confidence", "notes")


def emission_events(spark, d):
    """Events of a board's life: each bill is asked for in its month and the two after it, some with other content."""
    k, month = F.col("id"), F.year("due_date") * 12 + F.month("due_date")
    key = F.when(k % 6 == 5, F.concat(F.lit("followup:"), k.cast("string"))).otherwise(F.concat(F.lit("obligation-due:"), F.col("obligation_id"), F.lit(":"), F.col("due_date").cast("string")))
    i = adapters.instances(spark, d).select("id", key.alias("surface_key"), month.cast("long").alias("m"))
    none, first, other = F.lit(None).cast("string"), F.concat(F.lit("h"), (k % 3).cast("string")), F.when(k % 4 == 0, "h9").otherwise(F.concat(F.lit("h"), (k % 3).cast("string")))

    def some(where, later, kind, content=none, task=none, status=none, gone=F.lit(False)):
        return i.where(where).select((F.col("m") + later).alias("batch"), k.alias("seq"), F.lit(kind).alias("kind"), "surface_key", content.alias("content_hash"), task.alias("task_id"), status.alias("status"), gone.alias("gone"))

    rows = some(k.isNotNull(), 0, "item", first).unionByName(some(k.isNotNull(), 1, "item", other, gone=k % 8 == 0)).unionByName(some(k % 5 == 1, 2, "item", other))
    rows = rows.unionByName(some(k % 7 == 3, 1, "close", status=F.lit("completed"))).unionByName(some(k % 3 == 1, 2, "retire"))
    rows = rows.unionByName(some(k % 11 == 2, 0, "adopt", F.lit("h0"), F.concat(F.lit("a"), k.cast("string"))))
    return emissions.events(rows.unionByName(some(k % 2 == 0, 0, "bill", status=F.lit("open"))).unionByName(some(k % 2 == 0, 3, "bill", status=F.lit("paid"))))


def emission_replay(spark, d):
    return emissions.replay(emission_events(spark, d)).where("action is not null").select("batch", "seq", "surface_key", "action", "task_id", "rekeyed_from")


def emission_ledger(spark, d):
    return emissions.replay(emission_events(spark, d)).where("action is null").select("surface_key", "task_id", "status", "content_hash", "created")


def _board(spark, d):
    i, k = adapters.instances(spark, d), F.col("id")
    title = F.when(k % 7 == 0, F.concat(F.lit("Onboard charge: Merchant "), (k % 13).cast("string"), F.lit(" NOT modeled"))).otherwise(F.concat(F.lit("Pay "), F.col("obligation_id")))
    marked = F.concat(F.lit("[fa:obligation-due:"), F.col("obligation_id"), F.lit("]"))
    tasks = i.select(k.alias("task_id"), (-k).alias("position"), title.alias("content"), F.when(k % 5 < 2, marked).when(k % 5 == 2, "by hand").alias("description"), F.when(k % 11 != 0, k % 3 == 0).alias("labelled"))
    opened = i.groupBy("obligation_id").agg(F.max("id").alias("task_id"), F.min("entity_id").alias("e"))
    live = opened.select(F.concat(F.lit("obligation-due:"), F.col("obligation_id")).alias("surface_key"), F.when(F.col("e") % 5 == 0, -F.col("task_id")).otherwise(F.col("task_id")).alias("task_id"), F.when(F.col("e") % 2 == 0, "open").otherwise("retired").alias("status"))
    a = F.col("account_id")
    names = adapters.accounts(spark, d).select(a.alias("id"), F.when(a % 13 < 5, F.concat(F.lit(" merchant "), (a % 13).cast("string"))).alias("display_name"), F.when(a % 13 < 10, F.concat(F.lit("MERCHANT "), (a % 13).cast("string"))).alias("merchant_key"), F.when(a % 13 % 2 == 0, "applied").otherwise("proposed").alias("status"))
    return tasks, live, names


def board_classes(spark, d):
    return board.classify(*_board(spark, d))


def board_orphans(spark, d):
    tasks, live, _ = _board(spark, d)
    return board.orphans(tasks, live)


def findings_merge(spark, d):
    i, k = adapters.instances(spark, d), F.col("id")
    row = [F.when(k % 4 == 0, "adversarial").otherwise("deterministic").alias("source"), F.concat(F.lit("check_"), (k % 6).cast("string")).alias("check_id"), F.when(k % 17 != 0, F.col("obligation_id")).alias("evidence")]
    state = F.when(k % 5 == 0, "resolved").when(k % 5 == 1, "acknowledged").otherwise("open")
    stored = i.where(k % 7 != 0).select("id", *row, F.concat(F.lit("T"), (k % 2).cast("string")).alias("title"), state.alias("status"))
    current = i.where(k % 3 != 0).select(*row, F.when(k % 10 == 0, "other").otherwise(F.concat(F.lit("T"), (k % 2).cast("string"))).alias("title"))
    ran = i.select(*row[:2]).distinct().where("source = 'adversarial' or check_id < 'check_4'")
    return checks.merge(stored, current, ran)


def _found(spark, d):
    from . import catalog

    return checks.united({
        "duplicate_instances": ("warn", catalog.verify_duplicates(spark, d), ["obligation_id", "due_date"]),
        "instance_sign_sanity": ("error", catalog.verify_signs(spark, d), ["id"]),
        "coverage_horizon": ("warn", catalog.verify_coverage_horizon(spark, d), ["obligation_id"]),
        "statement_identity": ("error", catalog.verify_statement_identity(spark, d), ["cycle_id"]),
        "cross_obligation_overlap": ("warn", catalog.verify_overlap(spark, d), ["obligation_a", "obligation_b"]),
        "projection_identity": ("error", catalog.verify_projection_identity(spark, d).where("not holds"), ["entity_id"]),
    })


def verification_run(spark, d):
    found = _found(spark, d)
    return checks.summary(found, found.where("evidence like '%1'"))


def project_windows(spark, d):
    a, i = adapters.accounts(spark, d), adapters.instances(spark, d)
    seen = a.select(F.col("account_id").alias("entity_id"), "balance", F.date_add(F.lit("1997-12-01").cast("date"), (F.col("account_id") % 3 * 20).cast("int")).alias("snapshot_date"))
    return projection.windows(i, seen, i.where("id % 4 = 0"), START, WINDOWS)


def instance_ids(spark, d):
    """The instances of a quarter of an obligation as if they fell on its first day: several a day, some with stored ids."""
    i = adapters.instances(spark, d).withColumn("due_date", F.trunc("due_date", "quarter"))
    base, k = F.concat_ws(":", "obligation_id", F.col("due_date").cast("string")), F.col("id")
    name = F.when(k % 6 == 0, base).when(k % 6 == 1, F.concat(base, F.lit(":"), (k % 4).cast("string"))).when(k % 6 == 2, F.concat(base, F.lit(":x"))).when(k % 6 == 3, F.concat(base, F.lit(":0")))
    stored = i.where(k % 12 < 4).select(name.alias("instance_id"), "obligation_id", "due_date")
    return ids.allocate(i.select("obligation_id", "due_date", k.alias("seq")), stored).select("seq", "instance_id")


ALL = (
    instance_ids, statement_inputs, statement_recompute, statement_recompute_given, statement_actuals, statement_set_actual, emission_replay, emission_ledger, board_classes, board_orphans, findings_merge, verification_run,
    project_windows,
)

_STM = """
stm AS (SELECT id, entity_id AS target, last_day(due_date) AS closes, due_date + 20 AS due_date, (CASE WHEN id % 2 = 0 THEN amount * 3 ELSE amount END)::DECIMAL(18,2) AS amount, CASE WHEN id % 5 = 0 THEN 'confirmed' ELSE 'estimated' END AS amount_status,
  CASE WHEN id % 3 = 0 THEN 'statement_input_rollup' WHEN id % 3 = 2 THEN 'manual' WHEN id % 7 = 0 THEN 'portal_statement_amount' END AS amount_source, CASE WHEN id % 3 = 0 AND id % 4 <> 0 THEN round(amount * 0.25::DECIMAL(3,2), 2) END::DECIMAL(18,2) AS baseline,
  'medium' AS confidence FROM inst WHERE confidence = 'very_low'),
inp AS (SELECT id, entity_id AS target, due_date, amount, CASE WHEN id % 4 <> 0 THEN confidence END AS confidence FROM inst WHERE direction = 'outflow' AND confidence <> 'very_low' AND id % 9 <> 0),
cyc AS (SELECT s.id AS cycle_id, count(i.id) AS n_inputs, coalesce(sum(i.amount), 0)::DECIMAL(18,2) AS input_sum, min(CASE i.confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END) AS r FROM stm s LEFT JOIN (
  SELECT inp.*, (SELECT arg_min(s.id, (s.closes, s.id)) FROM stm s WHERE s.target = inp.target AND s.closes >= inp.due_date) AS cycle_id FROM inp) i ON i.cycle_id = s.id GROUP BY s.id),
act AS (SELECT id AS actual_id, target, CASE WHEN id % 8 <> 3 AND id % 4 <> 1 THEN CASE WHEN id % 10 = 0 THEN closes + 1 ELSE closes END END AS closes, CASE WHEN id % 4 <> 0 AND id % 8 <> 3 THEN due_date END AS due_date, amount + 1 AS amount,
  CASE WHEN id % 2 = 0 THEN 'seen' END AS note FROM stm),
hit AS (SELECT a.actual_id, CASE WHEN a.closes IS NULL AND a.due_date IS NULL THEN 'unnamed' WHEN count(s.id) = 0 THEN 'unknown' WHEN count(s.id) > 1 THEN 'ambiguous' ELSE 'set' END AS outcome, min(s.id) AS s FROM act a
  LEFT JOIN stm s ON s.target = a.target AND (a.closes IS NULL OR a.closes = s.closes) AND (a.due_date IS NULL OR a.due_date = s.due_date) GROUP BY a.actual_id, a.closes, a.due_date)"""
#: One step of a recursion per event, with the list of a stem's keys.
_EMIT = """
em AS (SELECT *, year(due_date) * 12 + month(due_date) AS m, CASE WHEN id % 6 = 5 THEN 'followup:' || id ELSE 'obligation-due:' || obligation_id || ':' || due_date::VARCHAR END AS key,
  CASE WHEN id % 6 = 5 THEN 'followup:' || id ELSE 'obligation-due:' || obligation_id END AS stem, 'h' || (id % 3) AS h, CASE WHEN id % 4 = 0 THEN 'h9' ELSE 'h' || (id % 3) END AS h2 FROM inst),
el AS (SELECT stem, m AS batch, 3 AS phase, id AS seq, 'item' AS kind, key, h AS hash, NULL::VARCHAR AS task, NULL::VARCHAR AS status, false AS gone FROM em
  UNION ALL SELECT stem, m + 1, 3, id, 'item', key, h2, NULL, NULL, id % 8 = 0 FROM em UNION ALL SELECT stem, m + 2, 3, id, 'item', key, h2, NULL, NULL, false FROM em WHERE id % 5 = 1
  UNION ALL SELECT stem, m + 1, 1, id, 'close', key, NULL, NULL, 'completed', false FROM em WHERE id % 7 = 3 UNION ALL SELECT stem, m + 2, 2, id, 'retire', key, NULL, NULL, NULL, false FROM em WHERE id % 3 = 1
  UNION ALL SELECT stem, m, 1, id, 'adopt', key, 'h0', 'a' || id, NULL, false FROM em WHERE id % 11 = 2 UNION ALL SELECT stem, m, 0, id, 'bill', key, NULL, NULL, 'open', false FROM em WHERE id % 2 = 0
  UNION ALL SELECT stem, m + 3, 0, id, 'bill', key, NULL, NULL, 'paid', false FROM em WHERE id % 2 = 0),
ev2 AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY batch, phase, seq) AS n, list(CASE WHEN kind = 'item' THEN key END) OVER (PARTITION BY stem, batch) AS asked FROM el),
fold AS (SELECT DISTINCT stem, 0::BIGINT AS n, []::STRUCT(created BIGINT, key VARCHAR, task VARCHAR, status VARCHAR, hash VARCHAR, bill BOOLEAN)[] AS led, 0::BIGINT AS batch, 0::BIGINT AS seq, ''::VARCHAR AS key, NULL::VARCHAR AS act, NULL::VARCHAR AS task, NULL::VARCHAR AS moved FROM ev2
  UNION ALL SELECT stem, n, list_append(list_transform(list_filter(led, lambda x: x.key <> ekey), lambda x: CASE WHEN x.key = older.key AND act = 'rekeyed' THEN {'created': NULL::BIGINT, 'key': x.key, 'task': NULL::VARCHAR, 'status': NULL::VARCHAR, 'hash': NULL::VARCHAR, 'bill': x.bill}
      WHEN x.key = older.key AND act = 'created' AND gone THEN {'created': x.created, 'key': x.key, 'task': x.task, 'status': 'deleted_by_user', 'hash': x.hash, 'bill': x.bill} ELSE x END),
    {'created': CASE WHEN act IN ('adopted', 'created') THEN ebatch WHEN act = 'rekeyed' THEN older.created ELSE cur.created END, 'key': ekey, 'task': ntask,
     'status': CASE WHEN kind = 'close' THEN CASE WHEN cur.status IS NOT NULL THEN estatus END WHEN act = 'retired' THEN 'retired' WHEN act = 'closed' THEN 'deleted_by_user' WHEN act IN ('adopted', 'created', 'rekeyed') THEN 'open' ELSE cur.status END,
     'hash': CASE WHEN act IN ('adopted', 'created', 'rekeyed') OR act = 'updated' AND kind = 'item' THEN ehash ELSE cur.hash END, 'bill': CASE WHEN kind = 'bill' THEN estatus = 'open' ELSE coalesce(cur.bill, false) END}),
    ebatch, eseq, ekey, act, CASE WHEN act IS NOT NULL THEN ntask END, CASE WHEN act = 'rekeyed' THEN older.key END
  FROM (SELECT *, CASE WHEN kind = 'adopt' THEN etask WHEN act = 'created' THEN ebatch || '-' || eseq WHEN act = 'rekeyed' THEN older.task ELSE cur.task END AS ntask FROM (
    SELECT *, CASE kind WHEN 'adopt' THEN CASE WHEN cur.status IS NULL THEN 'adopted' ELSE 'updated' END WHEN 'retire' THEN CASE WHEN cur.status = 'open' THEN 'retired' END WHEN 'item' THEN CASE WHEN cur.status IN ('completed', 'deleted_by_user') THEN 'resolved'
      WHEN cur.status = 'open' AND cur.hash = ehash THEN 'skipped' WHEN cur.status = 'open' AND gone THEN 'closed' WHEN cur.status = 'open' THEN 'updated' WHEN older IS NOT NULL AND NOT gone THEN 'rekeyed' ELSE 'created' END END AS act FROM (
    SELECT f.stem, f.led, e.n, e.batch AS ebatch, e.seq AS eseq, e.kind, e.key AS ekey, e.hash AS ehash, e.task AS etask, e.status AS estatus, e.gone, list_filter(f.led, lambda x: x.key = e.key)[1] AS cur,
      CASE WHEN e.kind = 'item' AND e.stem <> e.key THEN list_sort(list_filter(f.led, lambda x: x.status = 'open' AND x.key <> e.key AND NOT list_contains(e.asked, x.key) AND NOT x.bill))[1] END AS older
    FROM fold f JOIN ev2 e ON e.stem = f.stem AND e.n = f.n + 1))))"""
_BOARD = """
tk AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'Onboard charge: Merchant ' || (id % 13) || ' NOT modeled' ELSE 'Pay ' || obligation_id END AS content, id % 13 AS m, CASE WHEN id % 5 < 2 THEN 'obligation-due:' || obligation_id END AS key,
  CASE WHEN id % 5 = 2 THEN 'by hand' ELSE '' END AS said, id % 11 <> 0 AND id % 3 = 0 AS labelled FROM inst),
op AS (SELECT * FROM (SELECT 'obligation-due:' || obligation_id AS key, CASE WHEN min(entity_id) % 5 = 0 THEN -max(id) ELSE max(id) END AS task, min(entity_id) % 2 = 0 AS live FROM inst GROUP BY obligation_id) WHERE live),
ck AS (SELECT tk.*, EXISTS (SELECT 1 FROM op WHERE op.key = tk.key AND op.task = tk.id) AS managed, tk.id IN (SELECT task FROM op) AS named, coalesce(tk.key, content || chr(10) || said) AS grp FROM tk),
sv AS (SELECT grp, list({'id': id, 'managed': managed, 'labelled': labelled} ORDER BY NOT named, CASE WHEN named THEN -id ELSE id END)[1] AS s FROM ck GROUP BY grp HAVING count(*) > 1),
nm AS (SELECT account_id % 13 AS m, arg_max(CASE WHEN account_id % 13 % 2 = 0 THEN 'applied' ELSE 'proposed' END, account_id) AS status FROM acc WHERE account_id % 13 < 10 GROUP BY 1),
cls AS (SELECT ck.*, s, nm.status AS state, CASE WHEN ck.managed THEN 'managed' WHEN starts_with(content, 'Onboard') THEN 'stale_applied' WHEN s.id <> ck.id AND (s.managed OR s.labelled) THEN 'duplicate' WHEN s IS NOT NULL THEN 'kept' WHEN ck.labelled THEN 'fa_auto_orphan' ELSE 'kept' END AS class
  FROM ck LEFT JOIN sv ON sv.grp = ck.grp LEFT JOIN nm ON nm.m = ck.m)"""
_MERGE = """
fi AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'adversarial' ELSE 'deterministic' END AS source, 'check_' || (id % 6) AS check_id, CASE WHEN id % 17 <> 0 THEN obligation_id END AS evidence, 'T' || (id % 2) AS title FROM inst),
so AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'resolved' WHEN id % 5 = 1 THEN 'acknowledged' ELSE 'open' END AS status, concat_ws('|', source, check_id, coalesce(evidence, 'null'), CASE WHEN source = 'adversarial' THEN title END) AS k FROM fi WHERE id % 7 <> 0),
lv AS (SELECT * FROM so WHERE status = 'open' OR status = 'acknowledged' AND source = 'deterministic'),
cu AS (SELECT source, check_id, evidence, CASE WHEN id % 10 = 0 THEN 'other' ELSE title END AS title, concat_ws('|', source, check_id, coalesce(evidence, 'null'), CASE WHEN source = 'adversarial' THEN CASE WHEN id % 10 = 0 THEN 'other' ELSE title END END) AS k
  FROM fi WHERE id % 3 <> 0 AND (source = 'adversarial' OR check_id < 'check_4'))"""
_WINDOWS = """
sn AS (SELECT account_id AS entity_id, balance, DATE '1997-12-01' + (account_id % 3 * 20)::INT AS seen FROM acc),
we AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY phase, due_date, id) AS n FROM (SELECT i.*, CASE WHEN i.due_date >= DATE '1998-01-01' THEN 2 WHEN seen < DATE '1998-01-01' AND i.due_date > seen THEN 0 WHEN id % 4 <> 0 THEN 1 END AS phase
  FROM inst i JOIN sn USING (entity_id) WHERE status <> 'paid' AND due_date < DATE '1998-01-01' + 365) WHERE phase IS NOT NULL),
wf AS (SELECT entity_id, 0::BIGINT AS n, balance, 0 AS phase, DATE '1998-01-01' AS on_day FROM sn UNION ALL SELECT e.entity_id, e.n, (f.balance + CASE WHEN e.direction = 'inflow' THEN e.amount WHEN e.discretionary
  THEN -(least(e.amount, e.required_minimum) + least(e.amount - least(e.amount, e.required_minimum), greatest(0, f.balance - least(e.amount, e.required_minimum) - 2500))) ELSE -e.amount END)::DECIMAL(18,2), e.phase,
  CASE WHEN e.phase = 2 THEN e.due_date ELSE DATE '1998-01-01' END FROM wf f JOIN we e ON e.entity_id = f.entity_id AND e.n = f.n + 1),
wr AS (SELECT w AS window_days, wf.*, arg_max(CASE WHEN phase = 0 THEN balance END, CASE WHEN phase = 0 THEN n END) OVER (PARTITION BY entity_id, w) AS starting FROM wf, (VALUES (7), (30), (365)) v(w) WHERE phase < 2 OR on_day < DATE '1998-01-01' + w)"""


#: One step of a recursion per new instance, with the list of the day's ids.
_IDS = """
qi AS (SELECT id, obligation_id || ':' || date_trunc('quarter', due_date)::DATE::VARCHAR AS base FROM inst),
qs AS (SELECT base, list(DISTINCT CASE id % 6 WHEN 0 THEN base WHEN 1 THEN base || ':' || (id % 4) WHEN 2 THEN base || ':x' ELSE base || ':0' END) AS had FROM qi WHERE id % 12 < 4 GROUP BY base),
qn AS (SELECT qi.*, coalesce(had, []) AS had, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM qi LEFT JOIN qs USING (base)),
qf AS (SELECT DISTINCT base, 0::BIGINT AS n, NULL::BIGINT AS id, ''::VARCHAR AS got, []::VARCHAR[] AS taken FROM qn UNION ALL SELECT base, n, id, got, list_append(taken, got) FROM (
  SELECT q.base, q.n, q.id, f.taken, CASE WHEN NOT list_contains(f.taken, q.base) AND len(list_filter(list_concat(q.had, f.taken), lambda x: regexp_full_match(x[len(q.base) + 1:], ':[0-9]+'))) = 0 THEN q.base
    ELSE q.base || ':' || list_filter(range(1, 1000), lambda k: NOT list_contains(q.had, q.base || ':' || k) AND NOT list_contains(f.taken, q.base || ':' || k))[1] END AS got
  FROM qf f JOIN qn q ON q.base = f.base AND q.n = f.n + 1))"""


def _unite() -> str:
    from . import oracle

    ids = {"verify_duplicates": ("duplicate_instances", "warn", "obligation_id || '|' || due_date"), "verify_signs": ("instance_sign_sanity", "error", "id::VARCHAR"), "verify_coverage_horizon": ("coverage_horizon", "warn", "obligation_id"),
           "verify_statement_identity": ("statement_identity", "error", "cycle_id::VARCHAR"), "verify_overlap": ("cross_obligation_overlap", "warn", "obligation_a || '|' || obligation_b")}
    rows = [f"SELECT '{c}' AS check_id, '{s}' AS severity, {e} AS evidence FROM ({oracle.BODY[q]}) x" for q, (c, s, e) in ids.items()]
    rows.append(f"SELECT 'projection_identity', 'error', entity_id::VARCHAR FROM ({oracle.BODY['verify_projection_identity']}) x WHERE NOT holds")
    return "SELECT check_id, severity, count(*) AS findings, count(*) FILTER (evidence NOT LIKE '%1') AS new, count(*) FILTER (evidence LIKE '%1') AS acknowledged FROM (" + " UNION ALL ".join(rows) + ") u GROUP BY 1, 2"


def steps() -> dict[str, str]:
    from . import oracle

    stm = dict.fromkeys(("statement_inputs", "statement_recompute", "statement_recompute_given", "statement_actuals", "statement_set_actual"), _STM)
    return stm | {"instance_ids": _IDS, "emission_replay": _EMIT, "emission_ledger": _EMIT, "board_classes": _BOARD, "board_orphans": _BOARD, "findings_merge": _MERGE, "verification_run": oracle.STEPS["verify_overlap"], "project_windows": _WINDOWS}


def _recomputed(base: str, floored: str) -> str:
    return f"""(SELECT *, CASE WHEN amount_status <> 'estimated' THEN 'confirmed' WHEN amount_source = 'portal_statement_amount' THEN 'protected' WHEN input_sum IS NULL THEN 'no_cycle' WHEN {floored} THEN 'floored' ELSE 'updated' END AS action
  FROM (SELECT s.*, c.input_sum, c.r, ({base})::DECIMAL(18,2) AS base FROM stm s LEFT JOIN (SELECT * FROM cyc WHERE cycle_id % 11 <> 0) c ON c.cycle_id = s.id))"""


def sql() -> dict[str, str]:
    grade = "CASE r WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END"
    own = _recomputed("coalesce(CASE WHEN amount_source = 'statement_input_rollup' THEN baseline END, greatest(amount - input_sum, 0))", "base + input_sum < amount")
    return {
        "statement_inputs": f"SELECT cycle_id, n_inputs, input_sum::DOUBLE AS input_sum, {grade} AS confidence FROM cyc",
        "statement_recompute": f"""SELECT id, CASE action WHEN 'updated' THEN base + input_sum ELSE amount END::DOUBLE AS amount, CASE action WHEN 'updated' THEN 'statement_input_rollup' ELSE amount_source END AS amount_source,
  CASE action WHEN 'updated' THEN base ELSE baseline END::DOUBLE AS baseline, CASE action WHEN 'updated' THEN coalesce({grade}, 'low') ELSE confidence END AS confidence, action FROM {own}""",
        "statement_recompute_given": f"SELECT id, CASE action WHEN 'updated' THEN base + input_sum ELSE amount END::DOUBLE AS amount, CASE action WHEN 'updated' THEN base ELSE baseline END::DOUBLE AS baseline, action FROM {_recomputed('1000.50', 'false')}",
        "statement_actuals": "SELECT actual_id, CASE outcome WHEN 'set' THEN s END AS statement_id, outcome FROM hit",
        "statement_set_actual": """SELECT id, coalesce(a.amount, s.amount)::DOUBLE AS amount, CASE WHEN a.s IS NULL THEN amount_status ELSE 'confirmed' END AS amount_status, CASE WHEN a.s IS NULL THEN amount_source ELSE 'portal_statement_amount' END AS amount_source,
  CASE WHEN a.s IS NULL THEN confidence ELSE 'high' END AS confidence, coalesce(note, 'own') AS notes FROM stm s LEFT JOIN (SELECT hit.s, act.* FROM hit JOIN act USING (actual_id) WHERE outcome = 'set' QUALIFY row_number() OVER (PARTITION BY hit.s ORDER BY actual_id DESC) = 1) a ON a.s = s.id""",
        "emission_replay": "SELECT batch, seq, key AS surface_key, act AS action, task AS task_id, moved AS rekeyed_from FROM fold WHERE act IS NOT NULL",
        "emission_ledger": "SELECT x.key AS surface_key, x.task AS task_id, x.status, x.hash AS content_hash, x.created FROM (SELECT unnest(led) AS x FROM fold QUALIFY n = max(n) OVER (PARTITION BY stem)) WHERE x.status IS NOT NULL",
        "board_classes": """SELECT id AS task_id, class, CASE WHEN class = 'stale_applied' THEN CASE WHEN state = 'applied' THEN 'would_delete' ELSE 'needs_review' END WHEN class IN ('duplicate', 'fa_auto_orphan') THEN 'would_delete' ELSE 'kept' END AS action,
  CASE WHEN class NOT IN ('managed', 'stale_applied') AND s.id <> id THEN s.id END AS survivor_id FROM cls""",
        "board_orphans": "SELECT key AS surface_key, task AS task_id FROM op WHERE task NOT IN (SELECT id FROM tk)",
        "findings_merge": """SELECT source, check_id, evidence, title, CASE WHEN c = 'resolved' THEN c ELSE status END AS status, id, c AS change FROM (SELECT *, CASE WHEN id IN (SELECT id FROM lv) AND (source = 'adversarial' OR check_id < 'check_4') AND k NOT IN (SELECT k FROM cu) THEN 'resolved' ELSE 'kept' END AS c FROM so)
  UNION ALL SELECT any_value(source), any_value(check_id), max(evidence), max(title), 'open', NULL, 'opened' FROM cu WHERE k NOT IN (SELECT k FROM lv) GROUP BY k""",
        "instance_ids": "SELECT id AS seq, got AS instance_id FROM qf WHERE n > 0",
        "verification_run": _unite(),
        "project_windows": """SELECT entity_id, window_days::BIGINT AS window_days, any_value(starting)::DOUBLE AS starting, arg_max(balance, n)::DOUBLE AS ending, least(any_value(starting), coalesce(min(balance) FILTER (phase > 0), any_value(starting)))::DOUBLE AS low,
  CASE WHEN min(balance) FILTER (phase > 0) < any_value(starting) THEN arg_min(on_day, (balance, n)) FILTER (phase > 0) ELSE DATE '1998-01-01' END::VARCHAR AS low_date, count(*) FILTER (phase = 1) AS n_carried, count(*) FILTER (phase > 0) AS n_events FROM wr GROUP BY 1, 2""",
    }
