"""Queries over the whole tables for keyed tables, lists, verdicts and ids, and their SQL (after oracle.BASE)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, identity
from ..operators import balances, ledger, projection, roster
from ..sources import adapters

BEFORE, AFTER, DAY = "2024-01-02", "2024-01-20", "1998-06-30"
#: Text that the test tables lack, made from a key by rule, alike in the SQL.
REMINDERS = ("move $4,000 to savings by Jan 31 [fa:move:1]", "Pay $12.50 on february 30", "no figure here [fa: ]", "[fa:bill:7] call \"them\"\nsoon", "due Mar 5, $ 1,234.56 then $9")
WORDS = ("Checking", "ckg main", "High Saving", "Home Loan", "Trust", "Visa Card", "Plain")


def _pick(c, options):
    return F.element_at(F.array(*[F.lit(x) for x in options]), (c % len(options) + 1).cast("int"))


def _latest(spark, d, day):
    return balances.latest(adapters.snapshots(spark, d), day).select("account_id", "balance", "source")


def ledger_upsert(spark, d):
    return ledger.upsert(_latest(spark, d, BEFORE), _latest(spark, d, AFTER), ["account_id"], refresh=["balance"])


def ledger_insert_absent(spark, d):
    return ledger.insert_absent(_latest(spark, d, BEFORE), _latest(spark, d, AFTER), ["account_id"])


def ledger_update(spark, d):
    i = adapters.instances(spark, d).select("id", "status", "due_date")
    return ledger.update_where(i, (F.col("status") == "expected") & (F.col("due_date") < F.lit(DAY).cast("date")), {"status": F.lit("overdue")})


def ledger_delete(spark, d):
    s = adapters.snapshots(spark, d)
    gone = roster.superseded_manual(s).select(F.col("id").alias("_id"))
    return ledger.delete_where(s.join(gone, F.col("id") == F.col("_id"), "left"), F.col("_id").isNotNull()).select("id", "account_id", "source")


def ledger_acknowledge(spark, d):
    i = adapters.instances(spark, d)
    found = i.select("id", F.when(F.col("status") == "paid", "resolved").otherwise("active").alias("status"), F.lit(None).cast("string").alias("note"))
    return ledger.acknowledge(found, i.where("discretionary").select("id"), "seen")


def superseded_manual(spark, d):
    return roster.superseded_manual(adapters.snapshots(spark, d)).select("id", "account_id")


def _obligations(spark, d):
    i = adapters.instances(spark, d)
    rows = i.groupBy("obligation_id").agg(F.min("direction").alias("kind"), F.min("cadence").alias("cadence")).withColumn("name", F.concat(F.lit("Plan "), F.element_at(F.split("obligation_id", ":"), 2)))
    return roster.obligations(rows, i, name_contains="high", kind="outflow")


def list_obligations(spark, d):
    ids = F.array_join(F.transform("instances", lambda x: x["id"].cast("string")), ",")
    return _obligations(spark, d).select("obligation_id", "name", "kind", ids.alias("ids"), "n", "total", "next_due")


def list_obligations_page(spark, d):
    return ledger.page(_obligations(spark, d), [F.asc("kind"), F.asc(F.lower("name")), F.asc("obligation_id")], 25, 10).select("obligation_id", "n")


def list_due_followups(spark, d):
    i = adapters.instances(spark, d)
    rows = i.select("id", F.col("due_date").alias("surface_when"), F.when(F.col("confidence") == "very_low", None).otherwise(F.col("confidence")).alias("priority"), F.when(F.col("status") == "paid", "done").otherwise("pending").alias("status"), F.col("due_date").alias("created_at"))
    due, order = roster.due_followups(rows, DAY)
    return ledger.page(due, order, 100).select("id", "surface_when", "priority_rank")


def _goals(spark, d):
    a = adapters.accounts(spark, d)
    return a.select(
        F.col("account_id").alias("id"), F.when(F.col("account_id") % 4 != 0, F.col("account_id")).alias("source_account"), F.when(F.col("account_id") % 5 == 0, F.col("balance")).alias("override")
    )


def goal_progress(spark, d):
    i = adapters.instances(spark, d).where("direction = 'inflow'").select(F.col("entity_id").alias("account_id"), "amount", "due_date", "status")
    return roster.goal_progress(_goals(spark, d), balances.latest(adapters.snapshots(spark, d), BEFORE), i, DAY)


def guardrail_verdicts(spark, d):
    a = adapters.accounts(spark, d)
    starting = a.select(F.col("account_id").alias("entity_id"), F.col("balance").alias("starting"))
    low = projection.trough(projection.events(adapters.instances(spark, d), "1998-01-01", 365), starting, "1998-01-01").select("entity_id", "low")
    held = balances.aged(balances.latest(adapters.snapshots(spark, d)), "2024-01-31").select(F.col("account_id").alias("entity_id"), "stale")
    return roster.floor_verdicts(low, held, a.where("kind = 'loan'").select(F.col("account_id").alias("entity_id")), 2500, 365)


def recurring_summary(spark, d):
    i = adapters.instances(spark, d).where("direction = 'outflow'")
    return roster.recurring_summary(i.select(F.col("entity_id").alias("account_id"), "id", F.col("amount").alias("monthly"), "confidence"), 3)


def payee_mode(spark, d):
    return roster.most_frequent(adapters.transactions(spark, d), "account_id", "payee")


def resume_date(spark, d):
    return roster.resume_date(adapters.transactions(spark, d), "1998-12-01", lookback=4000)


def account_classes(spark, d):
    a = adapters.accounts(spark, d)
    return a.select("account_id", identity.account_class(F.concat(_pick(F.col("account_id"), WORDS), F.lit(" "), F.col("name")), F.when(F.col("account_id") % 11 == 0, "Charles Schwab").otherwise(F.col("org"))).alias("class"))


def reminder_fields(spark, d):
    i = adapters.instances(spark, d).withColumn("said", _pick(F.col("id"), REMINDERS))
    said = F.col("said")
    return i.select("id", identity.amount_in(said).alias("amount"), identity.month_day(said, 2026).alias("day"), identity.surface_key(said).alias("key"), identity.label_slug(said).alias("slug"))


def derived_ids(spark, d):
    i = adapters.instances(spark, d).withColumn("said", _pick(F.col("id"), REMINDERS))
    fact = {"calendar_id": F.lit(None).cast("string"), "date": F.date_format("due_date", "yyyy-MM-dd"), "external_id": F.col("id").cast("string"), "fact_type": F.lit("closure"), "related_entity_id": F.lit(None).cast("string"), "related_entity_type": F.lit(None).cast("string"), "source": F.col("status")}
    return i.select(
        "id",
        identity.digest_id("mem", {"kind": F.col("status"), "source": F.col("confidence"), "text": F.col("said")}).alias("memory_id"),
        identity.digest_id("calendar_fact", fact, ",", ":").alias("fact_id"),
        identity.content_hash(F.col("said"), F.col("status"), F.col("due_date"), F.lit(None).cast("int")).alias("content_hash"),
    )


def income_generate(spark, d):
    kinds = dates.semi_monthly(spark, (15, 31), "1998-01-01", "1998-05-30").withColumn("schedule", F.lit("semi_monthly"))
    every = dates.every_two_weeks(spark, "1997-12-26", "1998-01-01", "1998-05-30").withColumn("schedule", F.lit("biweekly"))
    a = adapters.accounts(spark, d)
    sources = a.select(F.col("account_id").alias("source_id"), F.when(F.col("account_id") % 2 == 0, "semi_monthly").otherwise("biweekly").alias("schedule"), F.abs("balance").alias("amount"))
    i = adapters.instances(spark, d)
    mine = i.join(sources, F.col("entity_id") == F.col("source_id"))
    same = mine.groupBy("source_id", F.col("due_date").alias("pay_date")).agg(F.min(F.when(F.col("id") % 2 == 0, sources["amount"]).otherwise(i["amount"])).alias("amount"), F.min("status").alias("status"))
    return roster.expand_income(sources, kinds.unionByName(every), same, "1998-01-01", "1998-05-30")


ALL = (
    ledger_upsert, ledger_insert_absent, ledger_update, ledger_delete, ledger_acknowledge, superseded_manual, list_obligations, list_obligations_page, list_due_followups, goal_progress,
    guardrail_verdicts, recurring_summary, payee_mode, resume_date, account_classes, reminder_fields, derived_ids, income_generate,
)


def _one_of(key: str, options: tuple) -> str:
    return "([" + ", ".join("'" + x.replace("'", "''") + "'" for x in options) + f"])[({key} % {len(options)} + 1)::INT]"


_SNAP = "SELECT account_id, balance, source FROM snap WHERE recorded_at::DATE <= DATE '{}' QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY source = 'manual' DESC, recorded_at DESC, id DESC) = 1"
_A, _B = f"({_SNAP.format(BEFORE)})", f"({_SNAP.format(AFTER)})"
_MANUAL = "(SELECT * FROM snap WHERE source = 'manual' QUALIFY row_number() OVER (PARTITION BY account_id, recorded_at::DATE ORDER BY recorded_at DESC, id DESC) > 1)"
_OBL = "(SELECT obligation_id, 'Plan ' || split_part(obligation_id, ':', 2) AS name, min(direction) AS kind, string_agg(id::VARCHAR, ',' ORDER BY due_date, id) AS ids, count(*) AS n, sum(amount)::DOUBLE AS total, min(due_date)::VARCHAR AS next_due FROM inst GROUP BY obligation_id HAVING kind = 'outflow' AND (lower(name) LIKE '%high%' OR lower(obligation_id) LIKE '%high%'))"
_SAID = _one_of("id", REMINDERS)
_JSON = "'\"' || replace(replace({0}, '\"', '\\\"'), chr(10), '\\n') || '\"'"
_PAY = """(WITH h(day) AS (VALUES (DATE '1997-12-25'), (DATE '1998-01-01'), (DATE '1998-01-19'), (DATE '1998-02-16'), (DATE '1998-05-25')),
  c AS (SELECT d::DATE AS day FROM generate_series(DATE '1997-12-01', DATE '1998-06-30', INTERVAL 1 DAY) t(d)),
  b AS (SELECT day FROM c WHERE dayofweek(day) NOT IN (0, 6) AND day NOT IN (SELECT day FROM h)),
  p AS (SELECT c.day, (SELECT max(b.day) FROM b WHERE b.day <= c.day) AS pay FROM c)
  SELECT DISTINCT 'semi_monthly' AS schedule, pay AS pay_date FROM p WHERE day >= DATE '1998-01-01' AND day <= DATE '1998-05-31' AND (day(day) = 15 OR day = last_day(day)) AND pay BETWEEN DATE '1998-01-01' AND DATE '1998-05-30'
  UNION SELECT DISTINCT 'biweekly', pay FROM p WHERE (day - DATE '1997-12-26') % 14 = 0 AND day BETWEEN DATE '1998-01-01' AND DATE '1998-05-30' AND pay BETWEEN DATE '1998-01-01' AND DATE '1998-05-30')"""
SQL = {
    "ledger_upsert": f"SELECT coalesce(a.account_id, b.account_id) AS account_id, coalesce(b.balance, a.balance)::DOUBLE AS balance, coalesce(a.source, b.source) AS source FROM {_A} a FULL JOIN {_B} b ON a.account_id IS NOT DISTINCT FROM b.account_id",
    "ledger_insert_absent": f"SELECT account_id, balance::DOUBLE AS balance, source FROM {_A} UNION ALL SELECT account_id, balance::DOUBLE, source FROM {_B} WHERE account_id NOT IN (SELECT account_id FROM {_A})",
    "ledger_update": f"SELECT id, CASE WHEN status = 'expected' AND due_date < DATE '{DAY}' THEN 'overdue' ELSE status END AS status, due_date::VARCHAR AS due_date FROM inst",
    "ledger_delete": f"SELECT id, account_id, source FROM snap WHERE id NOT IN (SELECT id FROM {_MANUAL})",
    "ledger_acknowledge": "SELECT id, CASE WHEN status = 'paid' THEN 'resolved' WHEN discretionary THEN 'acknowledged' ELSE 'active' END AS status, CASE WHEN status <> 'paid' AND discretionary THEN 'seen' END AS note FROM inst",
    "superseded_manual": f"SELECT id, account_id FROM {_MANUAL}",
    "list_obligations": f"SELECT * FROM {_OBL}",
    "list_obligations_page": f"SELECT obligation_id, n FROM {_OBL} ORDER BY kind, lower(name), obligation_id LIMIT 25 OFFSET 10",
    "list_due_followups": f"SELECT id, due_date::VARCHAR AS surface_when, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END::BIGINT AS priority_rank FROM inst WHERE status <> 'paid' AND due_date <= DATE '{DAY}' ORDER BY due_date, priority_rank DESC, id LIMIT 100",
    "goal_progress": f"""SELECT g.account_id AS id, coalesce(CASE WHEN g.account_id % 5 = 0 THEN g.balance END, s.balance, CASE WHEN g.account_id % 4 = 0 THEN (SELECT sum(amount) FROM inst WHERE direction = 'inflow' AND due_date <= DATE '{DAY}') ELSE f.total END, 0)::DOUBLE AS progress,
  (g.account_id % 5 = 0 AND g.balance IS NOT NULL) OR s.balance IS NOT NULL OR coalesce(f.n, 0) > 0 OR (g.account_id % 4 = 0 AND EXISTS (SELECT 1 FROM inst WHERE direction = 'inflow' AND due_date <= DATE '{DAY}')) AS trackable
  FROM acc g LEFT JOIN {_A} s ON s.account_id = g.account_id AND g.account_id % 4 <> 0 LEFT JOIN (SELECT entity_id, sum(amount) AS total, count(*) AS n FROM inst WHERE direction = 'inflow' AND due_date <= DATE '{DAY}' GROUP BY 1) f ON f.entity_id = g.account_id AND g.account_id % 4 <> 0""",
    "recurring_summary": "SELECT entity_id AS account_id, count(*) AS total, count(*) FILTER (r > 3) AS more_count, coalesce(sum(amount) FILTER (r > 3), 0)::DOUBLE AS more_monthly, sum(amount)::DOUBLE AS all_monthly, count(*) FILTER (confidence IN ('medium', 'high')) AS confident_count FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY amount DESC, id) AS r FROM inst WHERE direction = 'outflow') GROUP BY 1",
    "payee_mode": "SELECT account_id, payee FROM (SELECT account_id, payee, count(*) AS n FROM txn GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY n DESC, payee) = 1",
    "resume_date": "SELECT greatest(min(p) - 3, DATE '1998-12-01' - 4000)::VARCHAR AS start FROM (SELECT max(posted) AS p FROM txn GROUP BY account_id)",
    "account_classes": f"""SELECT account_id, CASE WHEN contains(n, 'ckg') OR contains(n, 'checking') THEN 'checking' WHEN contains(n, 'saving') THEN 'savings' WHEN contains(n, 'loan') THEN 'loan' WHEN contains(o, 'schwab') OR contains(n, 'pcra') OR contains(n, 'trust') THEN 'investment'
  WHEN contains(o, 'american express') OR contains(o, 'apple card') OR contains(n, 'visa') OR contains(n, 'mastercard') OR contains(n, 'card') THEN 'card' ELSE 'other' END AS class
  FROM (SELECT account_id, lower({_one_of("account_id", WORDS)} || ' ' || name) AS n, CASE WHEN account_id % 11 = 0 THEN 'charles schwab' ELSE lower(org) END AS o FROM acc)""",
    "reminder_fields": f"""SELECT id, try_cast(replace(regexp_extract(t, '\\$\\s*([0-9][0-9,]*(?:\\.[0-9]{{1,2}})?)', 1), ',', '') AS DECIMAL(18,2))::DOUBLE AS amount, (['2026-01-31', NULL, NULL, NULL, '2026-03-05'])[(id % 5 + 1)::INT] AS day,
  nullif(trim(regexp_extract(t, '\\[fa:([^\\]]*)\\]', 1)), '') AS key, left(trim(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '_'), 48) AS slug FROM (SELECT id, {_SAID} AS t FROM inst)""",
    "derived_ids": f"""SELECT id, 'mem_' || left(sha256('{{"kind": ' || {_JSON.format("status")} || ', "source": ' || coalesce({_JSON.format("confidence")}, 'null') || ', "text": ' || {_JSON.format("t")} || '}}'), 16) AS memory_id,
  'calendar_fact_' || left(sha256('{{"calendar_id":null,"date":"' || due_date::VARCHAR || '","external_id":"' || id::VARCHAR || '","fact_type":"closure","related_entity_id":null,"related_entity_type":null,"source":"' || status || '"}}'), 16) AS fact_id,
  left(sha256(t || chr(10) || status || chr(10) || due_date::VARCHAR || chr(10)), 16) AS content_hash FROM (SELECT *, {_SAID} AS t FROM inst)""",
    "income_generate": f"""SELECT coalesce(w.source_id, h.source_id) AS source_id, coalesce(w.pay_date, h.pay_date)::VARCHAR AS pay_date, coalesce(w.amount, h.amount)::DOUBLE AS amount,
  CASE WHEN w.source_id IS NULL THEN 'cancelled' WHEN h.source_id IS NULL THEN 'created' WHEN w.amount = h.amount THEN 'kept' ELSE 'updated' END AS action
  FROM (SELECT account_id AS source_id, pay_date, abs(balance) AS amount FROM acc JOIN {_PAY} p ON p.schedule = CASE WHEN account_id % 2 = 0 THEN 'semi_monthly' ELSE 'biweekly' END) w
  FULL JOIN (SELECT * FROM (SELECT entity_id AS source_id, due_date AS pay_date, min(CASE WHEN id % 2 = 0 THEN abs(balance) ELSE amount END) AS amount, min(status) AS status FROM inst JOIN acc ON entity_id = account_id GROUP BY ALL)
    WHERE status = 'expected' AND pay_date BETWEEN DATE '1998-01-01' AND DATE '1998-05-30') h ON w.source_id = h.source_id AND w.pay_date = h.pay_date""",
    "guardrail_verdicts": """SELECT * FROM (SELECT t.entity_id, CASE WHEN l.account_id IS NULL THEN 'missing_working_balance' WHEN DATE '2024-01-31' - l.day NOT BETWEEN 0 AND 3 THEN 'stale_working_balance'
  WHEN a.kind = 'loan' THEN 'missing_account_data' WHEN t.low < 2500 THEN 'breach' END AS verdict, CASE verdict WHEN 'breach' THEN 'medium' ELSE 'low' END AS severity, (CASE WHEN verdict = 'breach' THEN t.low - 2500 END)::DOUBLE AS impact
  FROM tro t JOIN acc a ON a.account_id = t.entity_id LEFT JOIN (SELECT account_id, recorded_at::DATE AS day FROM snap QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY source = 'manual' DESC, recorded_at DESC, id DESC) = 1) l ON l.account_id = t.entity_id)
  WHERE verdict IS NOT NULL""",
}
