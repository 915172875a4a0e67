"""Queries of what wants attention and of the digest over the whole tables, and their SQL (after oracle.BASE).

Notes, rejections, runs, stored tasks and who pays by hand, which the test tables lack, are made from keys by rule, alike in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balances, digest, findings, projection, surface
from ..sources import adapters
from ..sources.tables import saved
from .rosters import REMINDERS, _pick

DAY, SEEN, NOW, OLD = "1998-06-30", "2024-01-31", "2024-02-01 00:00:00", "2024-02-25"
MATERIAL, ESTIMATE = 200000, 300000


def _by_hand(spark, d):
    return adapters.instances(spark, d).withColumn("autopay", F.col("id") % 3 != 0)


def _rejections(spark, d):
    i = adapters.instances(spark, d).where("id % 5 = 0")
    return i.select(F.col("id").alias("instance_id"), F.date_add("due_date", (F.col("id") % 7 - 3).cast("int")).alias("rejected_on"))


def _bills(spark, d):
    return surface.bills(_by_hand(spark, d), _rejections(spark, d), DAY)


def _notes(spark, d):
    i = adapters.instances(spark, d).where("id % 6 = 5")
    return i.select("id", "entity_id", F.col("due_date").alias("surface_when"), F.when(F.col("status") == "paid", "resolved").otherwise("pending").alias("status"), _pick(F.col("id"), REMINDERS).alias("text"))


def _stale(spark, d):
    aged = balances.aged(balances.latest(adapters.snapshots(spark, d)), SEEN)
    return aged.select(F.col("account_id").alias("entity_id"), "stale", "recorded_at")


def _band(spark, d):
    from . import catalog

    t = projection.trough(catalog.window_events(spark, d), catalog.starting(spark, d), catalog.START)
    return t, projection.band(catalog.window_events(spark, d), t).join(t.select("entity_id", "low_date"), "entity_id")


def _guardrails(spark, d, drift):
    """Warnings, the entities whose balance is old, and the drift warnings that are snoozed."""
    stale = _stale(spark, d).where("stale").select("entity_id")
    name = lambda rule: F.concat(F.lit(f"{rule}:"), F.col("entity_id").cast("string"))
    row = lambda rows, rule, severity, impact, advice: rows.select(name(rule).alias("id"), F.lit(rule).alias("rule_type"), F.lit(severity).alias("severity"), "entity_id", impact.cast(adapters.MONEY).alias("impact"), advice.alias("advisory"))
    sums = findings.drift_sum(drift)
    found = surface.united([
        row(_band(spark, d)[0].where("low < 2500"), "cash_floor", "medium", F.col("low") - 2500, F.lit(False)),
        row(sums, "drift_threshold", "medium", F.col("total"), F.lit(False)),
        row(stale, "window_age", "low", F.lit(None), F.col("entity_id") % 4 == 0),
    ])
    e = F.col("entity_id")
    said = drift.select(
        name("drift_threshold").alias("warning_id"), F.when(e % 5 == 0, None).when(F.col("id") % 50 == 0, "resolved").otherwise("active").alias("status"),
        F.date_sub(F.lit(DAY).cast("date"), (e % 3).cast("int")).alias("updated_on"), F.when(e % 7 == 0, F.abs("impact") + 1).otherwise(F.col("impact")).cast(adapters.MONEY).alias("impact"),
    )
    return found, stale, surface.snoozed(sums.select(name("drift_threshold").alias("warning_id"), "total"), said, DAY)


def _candidates(spark, d, t=None):
    from . import catalog

    grade = adapters.by_value(F.col("confidence"), {"high": "in_review", "medium": "proposed"}, "discovered")
    return catalog._recurring(spark, d, t).select(F.when(F.col("disposition") == "surface", grade).otherwise("parked").alias("status"))


def _items(spark, d):
    from . import catalog

    i, day = adapters.instances(spark, d), F.date_add(F.lit("2024-05-01").cast("date"), (F.col("id") * 37 % 400).cast("int"))
    stale = findings.stale_estimates(i, DAY).select("id")
    t, taken, asked, queue = _from_transactions(spark, d)
    drift = saved(catalog.drift_payment(spark, d, t).select("id", "entity_id", "impact"))
    review = taken.where("match_type = 'needs_review'").select(F.col("instance_id").alias("id"))
    runs = adapters.read(spark, d, "events").select(F.col("event_type").alias("run_type"), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"), F.col("ts").alias("finished_at"))
    return surface.united([
        surface.followups(_notes(spark, d), DAY),
        surface.goals(catalog.goal_pace(spark, d).withColumn("deadline", F.when(F.col("id") % 10 != 0, day))),
        _bills(spark, d),
        surface.estimates(i.join(stale, "id", "left_semi")),
        surface.snapshots(balances.latest(adapters.snapshots(spark, d)), OLD),
        surface.troughs(_band(spark, d)[1]),
        surface.stale_balances(_stale(spark, d)),
        surface.guardrails(*_guardrails(spark, d, drift)),
        surface.matches(i.join(review, "id", "left_semi").withColumnRenamed("id", "instance_id")),
        asked,
        surface.stale_jobs(runs, runs, NOW),
        queue,
    ])


def surface_items(spark, d):
    return _items(spark, d)


def _from_transactions(spark, d):
    """The transactions, the matches, and the items of check questions and of the queue, each saved: the joins behind them are planned and run once,
    and only one of them holds shuffle files at a time."""
    from . import catalog

    t = saved(adapters.transactions(spark, d))
    taken = saved(catalog.matches(spark, d, t).select("instance_id", "transaction_id", "match_type"))
    held = adapters.instances(spark, d).select(F.col("id").alias("instance_id"), "amount")
    asked = catalog.check_suggestions(spark, d, t, taken).select("suggestion_id", "instance_id").join(held, "instance_id")
    return t, taken, saved(surface.check_questions(asked)), saved(surface.onboarding(_candidates(spark, d, t)))


def _bill_items(spark, d):
    i = adapters.instances(spark, d)
    _, _, asked, queue = _from_transactions(spark, d)
    return saved(surface.united([_bills(spark, d), surface.estimates(i.join(findings.stale_estimates(i, DAY).select("id"), "id", "left_semi")), asked, queue]))


def surface_by_subject(spark, d):
    return surface.one_a_subject(_bill_items(spark, d)).select("surface_key", "type", "subject")


def surface_retire(spark, d):
    i, k = adapters.instances(spark, d), F.col("id")
    items = _bill_items(spark, d)
    pay = i.where("id % 2 = 0").select(F.concat_ws(":", F.lit("obligation-due"), "obligation_id", "due_date").alias("surface_key"), F.when(k % 8 == 6, "retired").otherwise("open").alias("status"))
    rest = [
        i.where("id % 3 = 0").select(F.concat_ws(":", F.lit("estimate-review"), "obligation_id", "due_date").alias("surface_key"), F.lit("open").alias("status")),
        i.where("id % 500 = 0").select(F.concat(F.lit("check-suggestion:"), k.cast("string")).alias("surface_key"), F.lit("open").alias("status")),
        items.where("type in ('check_suggestion', 'onboarding_digest')").select("surface_key", F.lit("open").alias("status")),
    ]
    stored = saved(surface.united([pay, *rest]).groupBy("surface_key").agg(F.min("status").alias("status")))
    return surface.retire_keys(items, stored, i)


def digest_coverage(spark, d):
    from . import catalog

    return digest.coverage(_by_hand(spark, d).select("obligation_id", F.col("confidence").isin("very_low", "low").alias("autopay")), catalog.window_events(spark, d), _bills(spark, d), _candidates(spark, d))


def digest_gaps(spark, d):
    return digest.gaps(adapters.instances(spark, d), "1998-01-01", 365)


def digest_risks(spark, d):
    from . import catalog

    i = adapters.instances(spark, d)
    late = i.join(catalog.past_due_carry(spark, d).select("id"), "id", "left_semi").withColumn("carried", F.lit(True))
    ahead = catalog.window_events(spark, d).select(*i.columns).withColumn("carried", F.lit(False))
    events = ahead.unionByName(late).withColumn("cadence", F.when(F.col("id") % 11 != 0, F.col("cadence")))
    return digest.open_risks(events, _notes(spark, d), "1998-01-01", "1998-12-31", MATERIAL)


def digest_board(spark, d):
    from . import catalog

    tasks = _bills(spark, d).select(F.col("on_date").alias("last_seen"))
    return digest.board_health(tasks, catalog.drift_payment(spark, d))


def status_color(spark, d):
    """Every input from its own check: stored sums, latest balances, low points, estimates, unexpected charges, open money."""
    from . import catalog

    t, band = _band(spark, d)
    i = adapters.instances(spark, d)
    flag = lambda rows, name: rows.select("entity_id").distinct().withColumn(name, F.lit(True))
    wrong = i.join(catalog.verify_statement_identity(spark, d).select(F.col("cycle_id").alias("id")), "id", "left_semi")
    twice = i.join(findings.duplicate_instances(i).select("obligation_id", "due_date"), ["obligation_id", "due_date"], "left_semi")
    big = catalog.window_events(spark, d).where((F.col("amount_status") == "estimated") & (F.col("amount") >= ESTIMATE))
    extra = catalog.unexpected_recurring(spark, d).groupBy(F.col("account_id").alias("entity_id")).agg(F.sum("monthly").alias("unmodeled_monthly"))
    e = band.select("entity_id", "low", (F.col("low") - F.col("downside")).alias("low_estimate"), "breach")
    for rows in (flag(wrong, "verify_error"), _stale(spark, d).select("entity_id", F.col("stale").alias("stale_balance")), extra, flag(big, "material_estimate"), flag(twice, "verify_warning"), flag(digest_risks(spark, d).where("blocks"), "open_risk")):
        e = e.join(rows, "entity_id", "left")
    return findings.status_color(e.withColumn("worst_guardrail", F.when(F.col("low") < -500000, 3).when((F.col("low") >= 0) & (F.col("low") < 2500), 2).otherwise(0)))


ALL = (surface_items, surface_by_subject, surface_retire, digest_coverage, digest_gaps, digest_risks, digest_board, status_color)

_BILLS = """bil AS (SELECT i.*, 'obligation-due:' || obligation_id || ':' || due_date AS key FROM inst i WHERE status <> 'paid' AND id % 3 = 0 AND due_date <= DATE '1998-06-30' + 5
  AND (due_date >= DATE '1998-06-30' OR EXISTS (SELECT 1 FROM (SELECT id AS r, due_date + (id % 7 - 3)::INT AS rejected FROM inst WHERE id % 5 = 0) x WHERE x.r = i.id AND x.rejected >= i.due_date)))"""
_NOTES = """nts AS (SELECT id, entity_id, due_date AS surface_when, status <> 'paid' AS pending, ([{}])[(id % {} + 1)::INT] AS said FROM inst WHERE id % 6 = 5)""".format(
    ", ".join("'" + x.replace("'", "''") + "'" for x in REMINDERS), len(REMINDERS)
)
_TASKS = """bit AS (SELECT key AS surface_key, 'obligation_due' AS type, CASE WHEN due_date <= DATE '1998-06-30' THEN 'critical' WHEN due_date <= DATE '1998-06-30' + 2 THEN 'high' ELSE 'medium' END AS severity, 'obligation-instance:' || id AS subject, due_date AS on_date, amount FROM bil
  UNION ALL SELECT 'estimate-review:' || obligation_id || ':' || due_date, 'estimate_review', CASE WHEN amount >= 1000 THEN 'high' ELSE 'medium' END, 'obligation-instance:' || id, due_date, amount FROM inst WHERE estimated AND status <> 'paid' AND due_date - 30 <= DATE '1998-06-30'
  UNION ALL SELECT 'check-suggestion:' || suggestion_id, 'check_suggestion', 'medium', 'obligation-instance:' || instance_id, NULL, i.amount FROM (@check_suggestions@) c JOIN inst i ON i.id = instance_id
  UNION ALL SELECT 'onboarding-digest', 'onboarding_digest', 'medium', NULL, NULL, count(*) FROM (@recurring_triage@) q WHERE disposition = 'surface' HAVING count(*) > 0)"""
_ALL_ITEMS = """lat AS (@latest_balance@),
old AS (SELECT account_id AS entity_id, recorded_at::TIMESTAMP::DATE AS day FROM lat WHERE DATE '2024-01-31' - recorded_at::TIMESTAMP::DATE NOT BETWEEN 0 AND 3),
ban AS (@trough_band@),
drs AS (SELECT entity_id, sum(abs(impact::DECIMAL(18,2))) AS total FROM drifts GROUP BY 1 HAVING sum(abs(impact::DECIMAL(18,2))) > 200),
qui AS (SELECT s.entity_id FROM drs s JOIN drifts f USING (entity_id) GROUP BY s.entity_id, total
  HAVING s.entity_id % 5 <> 0 AND s.entity_id % 3 <> 0 AND bool_and(f.id % 50 <> 0) AND sum(CASE WHEN s.entity_id % 7 = 0 THEN abs(impact::DECIMAL(18,2)) + 1 ELSE abs(impact::DECIMAL(18,2)) END) = total),
itm AS (SELECT * FROM bit
  UNION ALL SELECT 'followup:' || id, 'followup', 'medium', NULL, surface_when, NULL FROM nts WHERE pending AND surface_when <= DATE '1998-06-30'
  UNION ALL SELECT 'goal:' || id, 'goal_review', CASE status WHEN 'due_soon' THEN 'high' ELSE 'medium' END, NULL, CASE WHEN id % 10 <> 0 THEN DATE '2024-05-01' + (id * 37 % 400)::INT END, remaining FROM (@goal_pace@) g WHERE status IN ('behind', 'due_soon')
  UNION ALL SELECT 'snapshot-due:' || account_id, 'snapshot_refresh', 'medium', NULL, recorded_at::TIMESTAMP::DATE, NULL FROM lat WHERE source = 'manual' AND DATE '2024-02-25' - recorded_at::TIMESTAMP::DATE >= 30
  UNION ALL SELECT 'trough-breach:' || b.entity_id, 'trough_breach_risk', CASE WHEN b.low::DECIMAL(18,2) - b.downside::DECIMAL(18,2) < 0 THEN 'high' ELSE 'medium' END, NULL, t.low_date, b.low::DECIMAL(18,2) - b.downside::DECIMAL(18,2)
    FROM ban b JOIN tro t USING (entity_id) WHERE downside > 0 AND b.low::DECIMAL(18,2) - b.downside::DECIMAL(18,2) < 2500
  UNION ALL SELECT 'confirm-live-balance:' || entity_id, 'confirm_live_balance', 'medium', NULL, day, NULL FROM old
  UNION ALL SELECT 'guardrail:cash_floor:' || entity_id, 'guardrail_warning', 'medium', NULL, NULL, low - 2500 FROM tro WHERE low < 2500 AND entity_id NOT IN (SELECT entity_id FROM old)
  UNION ALL SELECT 'guardrail:drift_threshold:' || entity_id, 'guardrail_warning', 'medium', NULL, NULL, total FROM drs WHERE entity_id NOT IN (SELECT entity_id FROM old) AND entity_id NOT IN (SELECT entity_id FROM qui)
  UNION ALL SELECT 'guardrail:window_age:' || entity_id, 'guardrail_warning', 'low', NULL, NULL, NULL FROM old WHERE entity_id % 4 <> 0
  UNION ALL SELECT 'match:' || instance_id, 'match_confirmation', 'high', NULL, i.due_date, i.amount FROM match m JOIN inst i ON i.id = m.instance_id WHERE match_type = 'needs_review'
  UNION ALL SELECT 'stale-job:' || event_type, 'stale_job', 'high', NULL, max(ts) FILTER (event_type <> 'error')::DATE, NULL FROM events GROUP BY event_type
    HAVING coalesce(max(ts) FILTER (event_type <> 'error') < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 26 HOUR, true))"""
_WON = "row_number() OVER (PARTITION BY subject ORDER BY CASE WHEN surface_key LIKE 'check-%' THEN 0 WHEN surface_key LIKE 'obligation-due:%' THEN 1 ELSE 2 END, surface_key)"
_STORED = """stt AS (SELECT key AS surface_key, min(status) AS status FROM (SELECT 'obligation-due:' || obligation_id || ':' || due_date AS key, CASE WHEN id % 8 = 6 THEN 'retired' ELSE 'open' END AS status FROM inst WHERE id % 2 = 0
  UNION ALL SELECT 'estimate-review:' || obligation_id || ':' || due_date, 'open' FROM inst WHERE id % 3 = 0 UNION ALL SELECT 'check-suggestion:' || id, 'open' FROM inst WHERE id % 500 = 0
  UNION ALL SELECT surface_key, 'open' FROM bit WHERE type IN ('check_suggestion', 'onboarding_digest')) GROUP BY 1),
win AS (SELECT subject, arg_min(surface_key, n) AS winner FROM (SELECT *, {} AS n FROM bit WHERE subject IS NOT NULL) GROUP BY 1)""".format(_WON)
_RISKS = """rsk AS (SELECT 'payment' AS kind, entity_id, id::VARCHAR AS ref_id, due_date AS on_date, amount, concat_ws('; ', CASE WHEN carried THEN 'past due and unreconciled' END, CASE WHEN estimated THEN 'amount is still an estimate' END,
    CASE WHEN id % 11 = 0 THEN 'one-time payment (no recurring schedule on file)' END) AS why, true AS counted
  FROM (SELECT id, entity_id, due_date, amount, direction, estimated, false AS carried FROM ev UNION ALL SELECT id, entity_id, due_date, amount, direction, estimated, true FROM inst WHERE status <> 'paid' AND due_date < DATE '1998-01-01' AND id NOT IN (SELECT instance_id FROM match))
  WHERE direction = 'outflow' AND amount >= 200000
  UNION ALL SELECT 'follow_up', entity_id, id::VARCHAR, surface_when, try_cast(replace(nullif(regexp_extract(said, '\\$\\s*([0-9][0-9,]*(?:\\.[0-9]{1,2})?)', 1), ''), ',', '') AS DECIMAL(18,2)),
    'reminder is still unresolved' || CASE WHEN surface_when < DATE '1998-01-01' THEN ' (past its surface date)' ELSE '' END, false FROM nts WHERE pending AND surface_when <= DATE '1998-12-31')"""

SQL = {
    "surface_items": "SELECT surface_key, type, severity, subject, on_date::VARCHAR AS on_date, amount::DOUBLE AS amount FROM itm",
    "surface_by_subject": f"SELECT surface_key, type, subject FROM bit WHERE subject IS NULL UNION ALL SELECT surface_key, type, subject FROM (SELECT *, dense_rank() OVER (PARTITION BY subject ORDER BY {_WON.split('ORDER BY ')[1][:-1]}) AS n FROM bit WHERE subject IS NOT NULL) WHERE n = 1",
    "surface_retire": """SELECT surface_key, CASE min(n) WHEN 1 THEN 'queue_empty' WHEN 2 THEN 'check_decided' WHEN 3 THEN 'subject' ELSE 'settled' END AS reason FROM (
  SELECT surface_key, 2 AS n FROM stt WHERE status = 'open' AND surface_key LIKE 'check-suggestion:%' AND surface_key NOT IN (SELECT surface_key FROM bit)
  UNION ALL SELECT surface_key, 1 FROM stt WHERE status = 'open' AND surface_key = 'onboarding-digest' AND surface_key NOT IN (SELECT surface_key FROM bit)
  UNION ALL SELECT s.surface_key, 3 FROM stt s JOIN bit b USING (surface_key) JOIN win w USING (subject) WHERE status = 'open' AND s.surface_key NOT LIKE 'obligation-due:%' AND split_part(winner, ':', 1) <> split_part(s.surface_key, ':', 1)
  UNION ALL SELECT surface_key, 4 FROM stt WHERE status = 'open' AND surface_key LIKE 'obligation-due:%' AND surface_key NOT IN (SELECT 'obligation-due:' || obligation_id || ':' || due_date FROM inst WHERE status <> 'paid')
    AND regexp_replace(surface_key, ':[^:]*$', '') NOT IN (SELECT regexp_replace(key, ':[^:]*$', '') FROM bil WHERE key NOT IN (SELECT surface_key FROM stt))) GROUP BY 1""",
    "digest_coverage": """SELECT m.*, w.*, (SELECT count(*) FROM bil) AS surfaced, c.* FROM (SELECT count(*) AS modeled, count(*) FILTER (a) AS autopay_silent, count(*) FILTER (NOT a) AS manual_attention FROM (SELECT obligation_id, bool_or(estimated) AS a FROM inst GROUP BY 1)) m,
  (SELECT count(*) AS in_window, count(*) FILTER (a) AS in_window_autopay, count(*) FILTER (NOT a) AS in_window_manual FROM (SELECT obligation_id, bool_or(estimated) AS a FROM ev GROUP BY 1)) w,
  (SELECT count(*) AS waiting, count(*) FILTER (confidence NOT IN ('high', 'medium')) AS waiting_discovered, count(*) FILTER (confidence = 'medium') AS waiting_proposed, count(*) FILTER (confidence = 'high') AS waiting_in_review FROM (@recurring_triage@) WHERE disposition = 'surface') c""",
    "digest_gaps": """SELECT obligation_id, count(*) FILTER (covered AND NOT coalesce(before, false)) AS n_islands, count(*) FILTER (NOT covered) AS gap_days, coalesce(max(len) FILTER (NOT covered), 0) AS longest_gap, coalesce(max(day) FILTER (covered) + 1, DATE '1998-01-01')::VARCHAR AS covered_until
  FROM (SELECT *, count(*) OVER (PARTITION BY obligation_id, covered, day - r::INT) AS len FROM (SELECT *, lag(covered) OVER (PARTITION BY obligation_id ORDER BY day) AS before, row_number() OVER (PARTITION BY obligation_id, covered ORDER BY day) AS r FROM (
    SELECT a.obligation_id, a.day, c.day IS NOT NULL AS covered FROM (SELECT obligation_id, (DATE '1998-01-01' + n::INT) AS day FROM (SELECT DISTINCT obligation_id FROM inst), range(365) t(n)) a LEFT JOIN (
      SELECT DISTINCT obligation_id, (due_date + k::INT) AS day FROM (SELECT obligation_id, due_date, unnest(range(CASE confidence WHEN 'very_low' THEN 7 WHEN 'low' THEN 14 WHEN 'high' THEN 92 ELSE 31 END)) AS k FROM inst)) c ON c.obligation_id = a.obligation_id AND c.day = a.day))) GROUP BY 1""",
    "digest_risks": "SELECT kind, entity_id, ref_id, on_date::VARCHAR AS on_date, amount::DOUBLE AS amount, CASE WHEN why = '' THEN 'confirmed recurring payment, not paid yet' ELSE why END AS why, counted, why <> '' AS blocks FROM rsk",
    "digest_board": "SELECT max(due_date)::VARCHAR AS last_seen, (SELECT count(*) FROM drifts WHERE abs(impact) > 200) AS n_big_drifts, max(due_date) IS NOT NULL AND (SELECT count(*) FROM drifts WHERE abs(impact) > 200) = 0 AS managed_clean FROM bil",
    "status_color": """SELECT entity_id, r[1] AS color, r[2] AS reason FROM (SELECT b.entity_id, CASE WHEN b.entity_id IN (SELECT entity_id FROM inst WHERE id IN (SELECT cycle_id FROM (@verify_statement_identity@))) THEN ['RED', 'verify_error']
    WHEN coalesce(DATE '2024-01-31' - l.recorded_at::TIMESTAMP::DATE NOT BETWEEN 0 AND 3, false) THEN ['YELLOW', 'stale_balance'] WHEN low < -500000 THEN ['RED', 'guardrail'] WHEN low < 0 THEN ['RED', 'below_zero'] WHEN low::DECIMAL(18,2) - downside::DECIMAL(18,2) < 0 THEN ['RED', 'estimates_below_zero']
    WHEN low < 2500 THEN ['YELLOW', 'guardrail'] WHEN breach THEN ['YELLOW', 'breach_risk'] WHEN u.m >= 100 THEN ['YELLOW', 'unmodeled_recurring'] WHEN b.entity_id IN (SELECT entity_id FROM ev WHERE estimated AND amount >= 300000) THEN ['YELLOW', 'material_estimate']
    WHEN b.entity_id IN (SELECT split_part(obligation_id, ':', 1)::BIGINT FROM (@verify_duplicates@)) THEN ['YELLOW', 'verify_warning'] WHEN b.entity_id IN (SELECT entity_id FROM rsk WHERE why <> '') THEN ['YELLOW', 'open_risk'] ELSE ['GREEN', 'clear'] END AS r
  FROM (@trough_band@) b LEFT JOIN (@latest_balance@) l ON l.account_id = b.entity_id LEFT JOIN (SELECT account_id, sum(monthly) AS m FROM (@unexpected_recurring@) GROUP BY 1) u ON u.account_id = b.entity_id)""",
}


def _steps() -> dict[str, str]:
    every = ",".join((_BILLS, _NOTES, _TASKS, _ALL_ITEMS))
    return {
        "surface_items": every, "surface_by_subject": f"{_BILLS},{_TASKS}", "surface_retire": ",".join((_BILLS, _TASKS, _STORED)), "digest_coverage": _BILLS, "digest_board": _BILLS,
        "digest_risks": f"{_NOTES},{_RISKS}", "status_color": f"{_NOTES},{_RISKS}",
    }


def _filled(text: str) -> str:
    """`text` with each @query@ as that query's own SQL."""
    from . import oracle

    for name in ("check_suggestions", "recurring_triage", "latest_balance", "trough_band", "goal_pace", "verify_statement_identity", "verify_duplicates", "unexpected_recurring"):
        text = text.replace(f"@{name}@", oracle.BODY[name])
    return text


def steps() -> dict[str, str]:
    return {k: _filled(v) for k, v in _steps().items()}


def sql() -> dict[str, str]:
    return {k: _filled(v) for k, v in SQL.items()}
