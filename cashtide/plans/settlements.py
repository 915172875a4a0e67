"""Queries of stored run outcomes and decisions over the whole tables, and their SQL (after oracle.BASE)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import settlement
from ..sources import adapters
from ..sources.tables import saved

DAY, BEFORE = "1998-06-30", "1998-01-31"


def recon_stored(spark, d):
    """Both ledgers after a whole run over what an earlier one stored."""
    from . import catalog

    i, k, then = adapters.instances(spark, d), F.col("id"), F.lit(BEFORE).cast("date")
    ran = saved(catalog.recon_run(spark, d))
    old = i.where("id % 4 = 0").select(k.alias("instance_id"), F.concat(F.lit("old-"), k.cast("string")).alias("transaction_id"), F.lit("auto").alias("match_type"), F.lit(0.5).alias("score"), then.alias("as_of"), then.alias("created_on"))
    open_ = i.where("id % 4 = 1").select(k.alias("instance_id"), "obligation_id", "due_date", F.lit(1).alias("age_days"), F.lit(False).alias("past_grace"), then.alias("as_of"), then.alias("created_on"))
    kept, rest = settlement.matches_after(old, ran, DAY), settlement.unmatched_after(open_, ran, i, DAY)
    return kept.withColumn("ledger", F.lit("match")).unionByName(rest.withColumn("ledger", F.lit("unmatched")), allowMissingColumns=True)


def _decided(spark, d):
    from . import catalog

    i, k = adapters.instances(spark, d), F.col("id")
    found = catalog.matches(spark, d)
    held = found.where("instance_id % 4 <> 1").select("instance_id", "transaction_id", "score")
    named = i.join(found.select(F.col("instance_id").alias("_x"), F.col("transaction_id").alias("_t")), k == F.col("_x"), "left")
    some = F.when(k % 2 == 0, F.col("_t")).otherwise(F.concat(F.lit("nowhere-"), k.cast("string")))
    made = lambda n, rest, kind, at, by: F.when(k % rest == 0, F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), at.alias("at"), by.alias("by")))
    none = F.lit(None).cast("string")
    each = F.array(made(0, 3, "confirm", k, none), made(1, 5, "force", k, some), made(2, 7, "unconfirm", k, none), made(3, 11, "confirm", k, none), made(4, 13, "confirm", -k, none), made(5, 17, "guess", k, none))
    rows = named.withColumn("_e", F.explode(F.filter(each, lambda x: x.isNotNull())))
    said = rows.select((k * 10 + F.col("_e.n")).alias("decision_id"), F.col("_e.at").alias("instance_id"), F.col("_e.kind").alias("kind"), F.col("_e.by").alias("transaction_id"))
    return settlement.decided(i, held, adapters.transactions(spark, d).select("id"), said)


def recon_decisions(spark, d):
    return _decided(spark, d)


def recon_settled(spark, d):
    i = adapters.instances(spark, d)
    rows = i.select("id", "status", F.when(F.col("status") == "paid", "earlier").alias("matched_transaction_id"), F.when(F.col("status") == "paid", F.lit(0.75)).alias("match_confidence"))
    return settlement.settled(rows, _decided(spark, d))


ALL = (recon_stored, recon_decisions, recon_settled)

_DECIDED = """dec AS (SELECT i.id * 10 + n AS decision_id, CASE n WHEN 4 THEN -i.id ELSE i.id END AS instance_id, kind, CASE n WHEN 1 THEN CASE WHEN i.id % 2 = 0 THEN m.transaction_id ELSE 'nowhere-' || i.id END END AS t
  FROM inst i LEFT JOIN match m ON m.instance_id = i.id JOIN (VALUES (0, 3, 'confirm'), (1, 5, 'force'), (2, 7, 'unconfirm'), (3, 11, 'confirm'), (4, 13, 'confirm'), (5, 17, 'guess')) v(n, rest, kind) ON i.id % rest = 0),
res AS (SELECT decision_id, instance_id, outcome, CASE outcome WHEN 'paid' THEN u END AS transaction_id, CASE WHEN outcome = 'paid' THEN CASE WHEN f IS NOT NULL THEN 1.0 ELSE s END END::DOUBLE AS score FROM (
  SELECT *, coalesce(f, h) AS u, CASE WHEN instance_id < 0 THEN 'unknown_instance' WHEN kind = 'unconfirm' THEN 'expected' WHEN kind = 'force' AND NOT good THEN 'unknown_transaction' WHEN kind = 'guess' THEN 'unknown_kind' WHEN coalesce(f, h) IS NULL THEN 'no_match' ELSE 'paid' END AS outcome FROM (
    SELECT d.*, good, m.transaction_id AS h, m.score AS s, (SELECT arg_max(e.t, e.decision_id) FROM dec e WHERE e.instance_id = d.instance_id AND e.kind = 'force' AND e.decision_id <= d.decision_id AND e.t IN (SELECT id FROM txn)) AS f
    FROM (SELECT *, coalesce(t IN (SELECT id FROM txn), false) AS good FROM dec) d LEFT JOIN match m ON m.instance_id = d.instance_id AND m.instance_id % 4 <> 1)))"""

SQL = {
    "recon_decisions": "SELECT * FROM res",
    "recon_settled": """SELECT id, coalesce(outcome, status) AS status, CASE WHEN outcome IS NOT NULL THEN transaction_id WHEN status = 'paid' THEN 'earlier' END AS matched_transaction_id, CASE WHEN outcome IS NOT NULL THEN score WHEN status = 'paid' THEN 0.75 END::DOUBLE AS match_confidence
  FROM inst LEFT JOIN (SELECT * FROM res WHERE outcome IN ('paid', 'expected') QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY decision_id DESC) = 1) r ON r.instance_id = id""",
    "recon_stored": """SELECT 'match' AS ledger, * FROM (SELECT id AS instance_id, coalesce(transaction_id, 'old-' || id) AS transaction_id, coalesce(CASE outcome WHEN 'shared' THEN 'needs_review' ELSE outcome END, 'auto') AS match_type, CASE WHEN outcome IS NULL THEN 0.5 ELSE score END::DOUBLE AS score,
    NULL::VARCHAR AS obligation_id, NULL::VARCHAR AS due_date, NULL::BIGINT AS age_days, NULL::BOOLEAN AS past_grace, CASE WHEN outcome IS NULL THEN '1998-01-31' ELSE '1998-06-30' END AS as_of, CASE WHEN id % 4 = 0 THEN '1998-01-31' ELSE '1998-06-30' END AS created_on
    FROM inst LEFT JOIN ran r ON r.instance_id = id WHERE coalesce(outcome <> 'unmatched', id % 4 = 0))
  UNION ALL SELECT 'unmatched', id, NULL, NULL, NULL, obligation_id, due_date::VARCHAR, coalesce(r.age_days, 1), coalesce(r.past_grace, false), CASE WHEN outcome IS NULL THEN '1998-01-31' ELSE '1998-06-30' END, CASE WHEN id % 4 = 1 THEN '1998-01-31' ELSE '1998-06-30' END
    FROM inst LEFT JOIN ran r ON r.instance_id = id WHERE coalesce(outcome = 'unmatched', id % 4 = 1)""",
}


def steps() -> dict[str, str]:
    from . import oracle

    return {"recon_decisions": _DECIDED, "recon_settled": _DECIDED, "recon_stored": f"{oracle.STEPS['recon_run']}, ran AS ({oracle.BODY['recon_run']})"}
