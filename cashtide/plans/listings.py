"""Queries of the lists over the whole tables, and their SQL (after oracle.BASE). Limits are pages, the lists' feature."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings, lists, parity, reconcile
from ..sources import adapters

DAY = "1998-06-30"


def _parts(spark, d):
    from . import catalog

    return catalog._statements(spark, d)


def statement_status(spark, d):
    statements, inputs = _parts(spark, d)
    return findings.statement_status(findings.cycles(statements), findings.rollup(inputs, statements), adapters.instances(spark, d), "1996-06-30")


def statement_list(spark, d):
    statements, inputs = _parts(spark, d)
    ids = F.array_join(F.transform("inputs", lambda x: x["input_id"].cast("string")), ",")
    return lists.statement_list(inputs, statements).select("target", "cycle_id", "opens", "closes", ids.alias("ids"))


def list_matched(spark, d):
    from . import catalog

    return lists.matched(catalog.matches(spark, d), adapters.instances(spark, d), "needs_review", 100, 5).select("instance_id", "transaction_id", "obligation_id", "score", "due_date", "status")


def list_unmatched(spark, d):
    from . import catalog

    i = adapters.instances(spark, d)
    return lists.unmatched_late(reconcile.unmatched(i, catalog.matches(spark, d), DAY), i, True, 200, 50).select("id", "obligation_id", "age_days", "past_grace")


def recently_cleared(spark, d):
    from . import catalog

    # the test tables have no sure match: those within two days count as such, alike in the SQL
    sure = catalog.matches(spark, d).withColumn("match_type", F.when(F.abs("days") <= 2, "auto").otherwise(F.col("match_type")))
    return lists.recently_cleared(sure, adapters.instances(spark, d), adapters.transactions(spark, d), DAY, 2000).select("instance_id", "transaction_id", "obligation_id", "posted", "paid")


def list_drift(spark, d):
    from . import catalog

    return lists.listed(catalog.drift_payment(spark, d), [F.asc("severity"), F.asc("finding_type"), F.asc("id")], {"finding_type": "missing_expected", "severity": None}, limit=150, offset=20).select("id", "severity", "impact")


def _facts(spark, d):
    i = adapters.instances(spark, d)
    kind = adapters.by_value(F.col("confidence"), {"high": "business_closure", "low": "income_pay_date"}, "note")
    return i.select("id", kind.alias("fact_type"), F.col("due_date").alias("fact_date"), F.when(F.col("status") == "paid", "active").otherwise("retired").alias("status"), F.col("entity_id").alias("related_entity_id"))


def list_calendar_facts(spark, d):
    return lists.listed(_facts(spark, d), [F.asc("fact_date"), F.asc("fact_type"), F.asc("id")], {"status": "active", "fact_type": "income_pay_date"}, {"fact_date": "1997-01-01"}, {"fact_date": "1997-12-31"})


def closure_dates(spark, d):
    return lists.closures(_facts(spark, d), "1996-01-01", "1997-12-31")


def list_parity(spark, d):
    """A second list made from the first by rule, alike in the SQL: other amounts, dates, labels and directions of some rows."""
    i, k = adapters.instances(spark, d), F.col("id")
    name = F.concat(F.lit("Brand "), F.element_at(F.split("obligation_id", ":"), 2))
    new = i.select("id", "entity_id", "direction", "due_date", "amount", name.alias("name"))
    raised = F.when(k % 5 == 0, F.round(F.col("amount") * F.lit("1.20").cast("decimal(3,2)"), 2)).otherwise(F.col("amount")).cast(adapters.MONEY)
    moved = F.when(k % 7 == 0, F.date_add("due_date", 12)).otherwise(F.col("due_date"))
    old = new.select("id", "entity_id", F.when(k % 13 == 0, "inflow").otherwise(F.col("direction")).alias("direction"), moved.alias("on_date"), raised.alias("amount"), F.when(k % 11 == 0, "Other").otherwise(F.col("name")).alias("label"))
    return parity.compare(old, new).select("old_id", "new_id", "kind", "severity", "amount_delta", "date_delta")


ALL = (list_parity, statement_status, statement_list, list_matched, list_unmatched, recently_cleared, list_drift, list_calendar_facts, closure_dates)

_CYCLES = "(SELECT entity_id AS target, id AS cycle_id, lag(due_date) OVER (PARTITION BY entity_id ORDER BY due_date, id) + 1 AS opens, due_date AS closes, amount AS modeled FROM inst WHERE confidence = 'very_low')"
_PLACED = """(SELECT i.id, i.due_date, any_value(i.amount) AS amount, arg_min(s.id, (s.due_date, s.id)) AS cycle_id FROM inst i JOIN (SELECT * FROM inst WHERE confidence = 'very_low') s ON s.entity_id = i.entity_id AND s.due_date >= i.due_date
  WHERE i.direction = 'outflow' AND i.confidence <> 'very_low' GROUP BY i.id, i.due_date)"""
_FACTS = "(SELECT id, CASE confidence WHEN 'high' THEN 'business_closure' WHEN 'low' THEN 'income_pay_date' ELSE 'note' END AS fact_type, due_date AS fact_date, CASE status WHEN 'paid' THEN 'active' ELSE 'retired' END AS status, entity_id AS related_entity_id FROM inst)"
#: One step of a recursion per row of the second list: claims in order, then unique rows of the same amount.
PARITY = """
new AS (SELECT id, entity_id, direction, due_date, amount, words FROM words_i),
old AS (SELECT id, entity_id, CASE WHEN id % 13 = 0 THEN 'inflow' ELSE direction END AS direction, CASE WHEN id % 7 = 0 THEN due_date + 12 ELSE due_date END AS due_date,
  (CASE WHEN id % 5 = 0 THEN round(amount * 1.20, 2) ELSE amount END)::DECIMAL(18,2) AS amount, CASE WHEN id % 11 = 0 THEN ['other'] ELSE words END AS words FROM words_i),
met AS (SELECT * FROM (SELECT o.id AS o, n.id AS n, CASE WHEN close AND days <= 7 THEN 'matched' WHEN days <= 7 THEN 'amount_changed' WHEN close AND days <= 31 THEN 'date_changed' END AS kind FROM
  (SELECT o, n, abs(n.due_date - o.due_date) AS days, abs(o.amount - n.amount) <= greatest(5.00, greatest(o.amount, n.amount) * 0.05) AS close FROM old o JOIN new n ON o.entity_id = n.entity_id AND o.direction = n.direction AND list_has_any(o.words, n.words))) WHERE kind IS NOT NULL),
turns AS (SELECT old.id, entity_id, direction, l, row_number() OVER (PARTITION BY entity_id, direction ORDER BY old.id) AS k FROM old JOIN (SELECT o, list({'n': n, 'kind': kind} ORDER BY kind <> 'matched', n) AS l FROM met GROUP BY o) ON o = old.id),
first AS (SELECT DISTINCT entity_id, direction, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS id, {'n': 0::BIGINT, 'kind': ''::VARCHAR} AS c FROM turns UNION ALL
  SELECT entity_id, direction, k, CASE WHEN f IS NULL THEN taken ELSE list_append(taken, f.n) END, id, f FROM (SELECT t.entity_id, t.direction, t.k, t.id, s.taken, list_filter(t.l, lambda e: NOT list_contains(s.taken, e.n))[1] AS f
    FROM first s JOIN turns t ON t.entity_id = s.entity_id AND t.direction = s.direction AND t.k = s.k + 1)),
named AS (SELECT id AS o, c.n AS n, c.kind AS kind FROM first WHERE k > 0 AND c.n IS NOT NULL),
same AS (SELECT *, row_number() OVER (PARTITION BY entity_id, direction ORDER BY id) AS k FROM (SELECT o.id, o.entity_id, o.direction, list(n.id) AS l FROM old o JOIN new n ON o.entity_id = n.entity_id AND o.direction = n.direction AND o.amount = n.amount
  AND abs(n.due_date - o.due_date) <= 2 WHERE o.id NOT IN (SELECT o FROM named) AND n.id NOT IN (SELECT n FROM named) GROUP BY ALL)),
second AS (SELECT DISTINCT entity_id, direction, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS id, NULL::BIGINT AS n FROM same UNION ALL
  SELECT entity_id, direction, k, CASE WHEN len(f) = 1 THEN list_concat(taken, f) ELSE taken END, id, CASE WHEN len(f) = 1 THEN f[1] END FROM (SELECT t.entity_id, t.direction, t.k, t.id, s.taken, list_filter(t.l, lambda e: NOT list_contains(s.taken, e)) AS f
    FROM second s JOIN same t ON t.entity_id = s.entity_id AND t.direction = s.direction AND t.k = s.k + 1)),
bound AS (SELECT * FROM named UNION ALL SELECT id, n, 'renamed' FROM second WHERE n IS NOT NULL)"""
SQL = {
    "list_parity": """SELECT o.id AS old_id, n.id AS new_id, coalesce(b.kind, CASE WHEN o.id IS NULL THEN 'extra' ELSE 'missing' END) AS kind, CASE WHEN o.id IS NULL THEN 'low' WHEN n.id IS NULL THEN 'medium' WHEN b.kind = 'date_changed' THEN 'low'
  WHEN b.kind = 'amount_changed' THEN CASE WHEN abs(n.amount - o.amount) >= 50 THEN 'medium' ELSE 'low' END END AS severity, (n.amount - o.amount)::DOUBLE AS amount_delta, (n.due_date - o.due_date)::BIGINT AS date_delta
  FROM old o LEFT JOIN bound b ON b.o = o.id FULL JOIN new n ON n.id = b.n""",
    "statement_status": f"""SELECT t.target, c.cycle_id AS closed_id, c.modeled::DOUBLE AS closed_amount, CASE WHEN c.cycle_id IS NOT NULL THEN 'estimated' END AS closed_state, o.cycle_id AS open_id, o.opens::VARCHAR AS opens, o.closes::VARCHAR AS closes,
  o.spend::DOUBLE AS spend, o.n_inputs, o.modeled::DOUBLE AS modeled, (o.modeled - o.spend)::DOUBLE AS variance,
  CASE WHEN o.modeled <> 0 AND o.closes > o.opens THEN CASE WHEN o.spend::DOUBLE <= o.modeled::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (DATE '1996-06-30' - o.opens)::DOUBLE / (o.closes - o.opens))) THEN 'ahead' ELSE 'behind' END END AS on_track
  FROM (SELECT DISTINCT target FROM {_CYCLES}) t
  LEFT JOIN (SELECT * FROM {_CYCLES} WHERE closes <= DATE '1996-06-30' QUALIFY row_number() OVER (PARTITION BY target ORDER BY closes DESC, cycle_id DESC) = 1) c ON c.target = t.target
  LEFT JOIN (SELECT y.*, coalesce(p.spend, 0) AS spend, coalesce(p.n, 0) AS n_inputs FROM {_CYCLES} y LEFT JOIN (SELECT cycle_id, sum(amount) AS spend, count(*) AS n FROM {_PLACED} GROUP BY 1) p USING (cycle_id)
    WHERE closes > DATE '1996-06-30' QUALIFY row_number() OVER (PARTITION BY target ORDER BY closes, cycle_id) = 1) o ON o.target = t.target""",
    "statement_list": f"SELECT target, cycle_id, opens::VARCHAR AS opens, closes::VARCHAR AS closes, coalesce(ids, '') AS ids FROM {_CYCLES} LEFT JOIN (SELECT cycle_id, string_agg(id::VARCHAR, ',' ORDER BY due_date, id) AS ids FROM {_PLACED} GROUP BY 1) USING (cycle_id)",
    "list_matched": "SELECT instance_id, transaction_id, obligation_id, score, i.due_date::VARCHAR AS due_date, i.status FROM match m JOIN inst i ON i.id = instance_id WHERE match_type = 'needs_review' ORDER BY score DESC, i.due_date, instance_id LIMIT 100 OFFSET 5",
    "list_unmatched": f"SELECT id, obligation_id, (DATE '{DAY}' - due_date)::BIGINT AS age_days, true AS past_grace FROM inst WHERE status <> 'paid' AND DATE '{DAY}' - due_date > 7 AND id NOT IN (SELECT instance_id FROM match) ORDER BY age_days DESC, due_date, id LIMIT 200 OFFSET 50",
    "recently_cleared": f"SELECT instance_id, transaction_id, obligation_id, t.posted::VARCHAR AS posted, t.amount::DOUBLE AS paid FROM match m JOIN inst i ON i.id = instance_id JOIN txn t ON t.id = transaction_id WHERE abs(days) <= 2 AND i.due_date BETWEEN DATE '{DAY}' - 2000 AND DATE '{DAY}'",
    "list_drift": "SELECT id, severity, impact FROM drifts WHERE finding_type = 'missing_expected' ORDER BY severity, finding_type, id LIMIT 150 OFFSET 20",
    "list_calendar_facts": f"SELECT id, fact_type, fact_date::VARCHAR AS fact_date, status, related_entity_id FROM {_FACTS} WHERE status = 'active' AND fact_type = 'income_pay_date' AND fact_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'",
    "closure_dates": f"SELECT DISTINCT fact_date::VARCHAR AS day FROM {_FACTS} WHERE status = 'active' AND fact_type = 'business_closure' AND fact_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'",
}
