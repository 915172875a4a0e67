"""The engine's own queries: each runs an operator over the adapter views of the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, text
from ..operators import audit, balances, estimates, findings, ledger, projection, reconcile, recurring, spending
from ..sources import adapters
from ..sources.tables import saved
from . import attention, feeds, ledgers, listings, manuals, oracle, rosters, settlements

FLAGSHIP = "spending_by_category"
YEAR = ("1998-01-01", "1998-12-31")
START, HORIZON = "1998-01-01", 365
#: Amounts of the test tables are in the hundred thousands, so pairs need wide tolerances to exist at all.
WIDE = reconcile.Options(amount_abs="50000.00", amount_pct="0.500")


def plain(df: DataFrame) -> DataFrame:
    """Money as doubles, dates and times as ISO text, whole numbers as long: what both engines print alike."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        out.append(c.alias(f.name))
    return df.select(*out)


def named(spark: SparkSession, d: str) -> DataFrame:
    return adapters.instances(spark, d).withColumn("name", F.concat(F.lit("Brand "), F.element_at(F.split("obligation_id", ":"), 2)))


def starting(spark: SparkSession, d: str) -> DataFrame:
    return adapters.accounts(spark, d).select(F.col("account_id").alias("entity_id"), F.col("balance").alias("starting"))


def window_events(spark: SparkSession, d: str) -> DataFrame:
    return projection.events(adapters.instances(spark, d), START, HORIZON)


def pairs(spark: SparkSession, d: str, t: DataFrame | None = None) -> DataFrame:
    """`t`, here and below: the transactions where a query has saved them."""
    return reconcile.candidates(named(spark, d), adapters.transactions(spark, d) if t is None else t, WIDE)


def matches(spark: SparkSession, d: str, t: DataFrame | None = None) -> DataFrame:
    return reconcile.best(pairs(spark, d, t)).where("match_type <> 'below_threshold'")


def spending_by_category(spark, d):
    return spending.summarize(adapters.transactions(spark, d), *YEAR)


def spending_by_merchant(spark, d):
    return spending.summarize(adapters.transactions(spark, d), *YEAR, by="merchant", top_n=1000)


def spending_by_month(spark, d):
    return spending.monthly(adapters.transactions(spark, d), "1995-01-01", "2001-12-31")


def spending_samples(spark, d):
    return spending.samples(adapters.transactions(spark, d), *YEAR, by="merchant")


def list_transactions(spark, d):
    return spending.listing(adapters.transactions(spark, d), adapters.accounts(spark, d), *YEAR, query="widget", min_amount=1000, include_pending=False, limit=100)


def latest_balance(spark, d):
    return balances.latest(adapters.snapshots(spark, d))


def asof_balance(spark, d):
    return balances.latest(adapters.snapshots(spark, d), "2024-01-15")


def balance_coverage(spark, d):
    return balances.coverage(adapters.accounts(spark, d), adapters.snapshots(spark, d), "2024-01-31")


def project_running_balance(spark, d):
    return projection.running(window_events(spark, d), starting(spark, d)).select("entity_id", "id", "seq", "signed", "balance")


def project_trough(spark, d):
    return projection.trough(window_events(spark, d), starting(spark, d), START)


def project_capped_fold(spark, d):
    return projection.capped_trough(window_events(spark, d), starting(spark, d), START)


def past_due_carry(spark, d):
    settled = matches(spark, d).select(F.col("instance_id").alias("id"))
    return projection.past_due(adapters.instances(spark, d), START, settled).select("id", "entity_id", "due_date", "amount")


def roll_forward(spark, d):
    snaps = adapters.accounts(spark, d).select(F.col("account_id").alias("entity_id"), "balance", F.lit("1997-10-01").cast("date").alias("snapshot_date"))
    return projection.roll_forward(adapters.instances(spark, d), snaps, START)


def trough_band(spark, d):
    ev = window_events(spark, d)
    return projection.band(ev, projection.trough(ev, starting(spark, d), START))


def recon_candidates(spark, d):
    return pairs(spark, d).select("instance_id", "transaction_id", "days", "delta", "amount_score", "date_score", "merchant_score", "score", "match_type")


def recon_best(spark, d):
    return reconcile.best(pairs(spark, d)).select("instance_id", "transaction_id", "score", "match_type")


def recon_greedy(spark, d):
    return reconcile.greedy(pairs(spark, d))


#: Two to four bills of an entity are a few hundred thousand together, so sums must come close.
CLOSE = reconcile.Options(window=30, amount_abs="500.00", amount_pct="0.010")


def _with_lumps(spark, d):
    """The transactions and, as the test tables have none, one payment for the two to four instances of a month."""
    month = adapters.instances(spark, d).groupBy("entity_id", "direction", F.date_format("due_date", "yyyy-MM").alias("month"))
    sums = month.agg(F.count("*").alias("n"), F.sum("amount").alias("sum"), F.max("due_date").alias("posted")).where("n between 2 and 4")
    lumps = sums.select(
        F.concat_ws("-", F.lit("lump"), "entity_id", "direction", "month").alias("id"), F.col("entity_id").alias("account_id"), "posted", F.when(F.col("direction") == "inflow", F.col("sum")).otherwise(-F.col("sum")).cast(adapters.MONEY).alias("amount"),
        F.lit("Brand").alias("payee"), F.lit("month").alias("description"), F.lit(False).alias("pending"),
    )
    return adapters.transactions(spark, d).unionByName(lumps)


def recon_shared_groups(spark, d):
    return reconcile.shared(named(spark, d), _with_lumps(spark, d), CLOSE)


def recon_run(spark, d):
    return reconcile.run(named(spark, d), _with_lumps(spark, d), "1998-06-30", opts=CLOSE)


def recon_unmatched(spark, d):
    return reconcile.unmatched(adapters.instances(spark, d), matches(spark, d), "1998-06-30")


def prior_amount_change(spark, d):
    paid = adapters.instances(spark, d).select("obligation_id", F.col("id").alias("instance_id"), "due_date", F.col("amount").alias("observed"), F.col("discretionary").alias("grouped"))
    return reconcile.price_changes(paid).select("instance_id", "previous", "changed")


def post_cancellation(spark, d):
    t = saved(adapters.transactions(spark, d).drop("pending"))
    taken = saved(matches(spark, d, t).select("transaction_id"))
    ended = (
        named(spark, d)
        .groupBy("obligation_id", "entity_id", "name", "direction")
        .agg(F.max(F.struct("due_date", "id", "amount")).alias("m"))
        .select("obligation_id", "entity_id", "name", "direction", F.col("m.amount").alias("last_amount"), F.col("m.due_date").alias("cancelled_on"))
    )
    return reconcile.after_cancellation(ended, t, taken, WIDE).drop("entity_id")


def recurring_stats(spark, d):
    s = recurring.statistics(adapters.transactions(spark, d), adapters.accounts(spark, d))
    return s.select("account_id", "merchant_key", "class", "n", F.round("mean", 6).alias("mean"), F.round("median_amount", 6).alias("median_amount"), "low", "high", F.round("cv", 6).alias("cv"), "median_gap", "months_covered", "span_months")


def _recurring(spark, d, t=None):
    return recurring.triage(recurring.candidates(recurring.statistics(adapters.transactions(spark, d) if t is None else t, adapters.accounts(spark, d))))


def recurring_triage(spark, d):
    return _recurring(spark, d).select("account_id", "merchant_key", "cadence", "method", "confidence", "candidate_type", F.round(F.col("priority").cast("decimal(28,10)"), 6).alias("priority"), "disposition")


def apply_schedule(spark, d):
    return recurring.schedule(_recurring(spark, d).where("confidence in ('medium', 'high')")).select("account_id", "merchant_key", "due_date")


def drift_payment(spark, d, t=None):
    loose = reconcile.Options(amount_abs="50000.00", amount_pct="0.900")
    return findings.payment_drift(named(spark, d), adapters.transactions(spark, d) if t is None else t, "1998-06-30", WIDE, loose)


def stale_estimates(spark, d):
    return findings.stale_estimates(adapters.instances(spark, d), "1998-06-30")


def arrived_deposits(spark, d):
    return findings.arrived_deposits(adapters.transactions(spark, d), adapters.accounts(spark, d), matches(spark, d), "2000-06-30")


def guardrail_floor(spark, d):
    return findings.cash_floor(projection.trough(window_events(spark, d), starting(spark, d), START), HORIZON)


def debt_avalanche(spark, d):
    a = adapters.accounts(spark, d).where("kind in ('card', 'loan')")
    return findings.avalanche(
        a.select(F.col("account_id").alias("id"), F.col("org").alias("entity_id"), (F.col("account_id") % 30 + 5).cast("decimal(5,2)").alias("apr"), "balance", (F.col("kind") == "card").alias("is_revolving"))
    )


def goal_pace(spark, d):
    s = adapters.read(spark, d, "supplier")
    k = F.col("s_suppkey")
    goals = s.select(
        k.alias("id"), F.lit("5000.00").cast(adapters.MONEY).alias("target"), F.col("s_acctbal").cast(adapters.MONEY).alias("progress"), F.lit("2024-01-01").cast("date").alias("created"),
        F.when(k % 10 != 0, F.date_add(F.lit("2024-05-01").cast("date"), (k * 37 % 400).cast("int"))).alias("deadline"), (F.col("s_nationkey") % 2 == 0).alias("trackable"),
    )
    return findings.goal_pace(goals, "2024-06-01")


def _statements(spark, d):
    i = adapters.instances(spark, d)
    urgent = F.element_at(F.split("obligation_id", ":"), 2) == "1-URGENT"
    return i.where(urgent).select("id", F.col("entity_id").alias("target"), F.col("due_date").alias("closes")), i.where(~urgent & (F.col("direction") == "outflow")).select("id", F.col("entity_id").alias("target"), "due_date", "amount")


def statement_cycles(spark, d):
    return findings.cycles(_statements(spark, d)[0])


def statement_rollup(spark, d):
    statements, inputs = _statements(spark, d)
    return findings.rollup(inputs, statements)


def verify_duplicates(spark, d):
    return findings.duplicate_instances(adapters.instances(spark, d))


def verify_signs(spark, d):
    return findings.wrong_signs(adapters.snapshots(spark, d).withColumnRenamed("balance", "amount")).select("id", "amount")


def verify_coverage_horizon(spark, d):
    return findings.short_horizon(adapters.instances(spark, d), START)


def surface_queue(spark, d):
    f = findings.payment_drift(named(spark, d), adapters.transactions(spark, d), "1998-06-30", WIDE, reconcile.Options(amount_abs="50000.00", amount_pct="0.900"))
    items = f.select("id", F.col("finding_type").alias("kind"), findings.severity_rank(F.col("severity")).alias("severity_rank"), F.when(F.col("finding_type") == "amount_changed", 2).otherwise(1).alias("kind_rank"))
    return ledger.ranked_queue(items, 50)


def snapshot_diff(spark, d):
    s = adapters.snapshots(spark, d)
    return ledger.snapshot_diff(balances.latest(s, "2024-01-02"), balances.latest(s, "2024-01-20"), ["account_id"], ["balance", "source"])


def emission_actions(spark, d):
    o = adapters.read(spark, d, "orders")
    status = adapters.by_value(F.col("o_orderstatus"), {"F": "completed", "P": "open"}, "retired")
    key = lambda n, at, other: F.concat(F.when(F.col("o_orderkey") % n == at, "pay:").otherwise(other), F.col("o_orderkey").cast("string")).alias("surface_key")
    old = o.select(key(2, 0, "gone:"), status.alias("status"), F.col("o_orderpriority").alias("content_hash"))
    new = o.select(key(3, 0, "new:"), F.when(F.col("o_totalprice") > 200000, "1-URGENT").otherwise(F.col("o_orderpriority")).alias("content_hash"))
    return ledger.emission_actions(new, old, o.select(key(5, 4, "none:")))


def subject_winners(spark, d):
    i = adapters.instances(spark, d).where("status <> 'paid'")
    items = i.select("id", F.when(F.col("direction") == "outflow", F.col("entity_id")).alias("subject"), F.when(F.col("discretionary"), 1).otherwise(0).alias("rank"), F.col("id").alias("position"))
    return ledger.winners(items).select("id", "subject", "rank")


def synthetic_ids(spark, d):
    t = adapters.transactions(spark, d).withColumn("position", F.col("id"))
    return ledger.synthetic_ids(t).select("id", "ordinal", "synthetic_id")


def memory_search(spark, d):
    docs = adapters.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = adapters.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return ledger.memory_search(docs, asked)


def income_semi_monthly(spark, d):
    return dates.semi_monthly(spark, (15, 31), "2026-01-01", "2026-12-31")


def business_days(spark, d):
    return dates.calendar(spark, "2026-01-01", "2027-12-31")


def income_biweekly(spark, d):
    return dates.every_two_weeks(spark, "2026-01-02", "2026-01-01", "2026-12-31")


def working_account(spark, d):
    return audit.working_account(adapters.accounts(spark, d), hint="0000007")


def guardrail_drift_sum(spark, d):
    return findings.drift_sum(drift_payment(spark, d))


def check_suggestions(spark, d, t=None, taken=None):
    """Checks are drawn on checking accounts, so only bills of those can meet one."""
    t = saved(adapters.transactions(spark, d)) if t is None else t
    taken = saved(matches(spark, d, t).select("instance_id", "transaction_id")) if taken is None else taken
    i, number = adapters.instances(spark, d), F.element_at(F.split("id", "-"), 1)
    checking = adapters.accounts(spark, d).where("kind = 'checking'").select(F.col("account_id").alias("entity_id"))
    bills = i.where("direction = 'outflow' and status = 'expected' and due_date <= '2000-12-31'").join(taken.select(F.col("instance_id").alias("id")), "id", "left_anti").join(checking, "entity_id", "left_semi")
    drawn = t.where("not pending").withColumn("description", F.concat(F.lit("CHECK #"), number))
    paid = i.where("status = 'paid'").select("obligation_id", F.col("entity_id").alias("account_id"))
    return estimates.check_suggestions(bills, drawn, paid, amount_abs="50000.00", amount_pct="0.500", spoken_for=taken.select("transaction_id"))


def brand_of(c):
    """One of the 25 brands' merchant keys for an account."""
    return F.concat(F.lit("brand_"), (c % 5 + 1).cast("string"), (F.floor(c / 5) % 5 + 1).cast("string"))


def _estimated(spark, d):
    live = adapters.instances(spark, d).where("status <> 'paid'").groupBy("obligation_id", F.col("entity_id").alias("account_id"), "cadence")
    rows = live.agg(F.median(F.col("amount").cast("double")).alias("amount"), F.bool_and((F.col("amount_status") == "estimated") & (F.col("direction") == "outflow")).alias("fit"))
    return rows.where("fit").withColumn("merchant_key", brand_of(F.col("account_id")))


def dormant_accounts(spark, d):
    held = adapters.accounts(spark, d).select("account_id", F.when(F.col("account_id") % 3 != 0, F.col("balance")).otherwise(0).alias("balance"))
    return estimates.dormant(_estimated(spark, d), held, adapters.transactions(spark, d), "1998-06-30").select("obligation_id", "account_id")


def _flat(spark, d):
    """Balances are set back 9497 days, to the days of the transactions."""
    shown = adapters.snapshots(spark, d).withColumn("recorded_at", F.col("recorded_at") - F.expr("INTERVAL 9497 DAYS"))
    return estimates.flat(_estimated(spark, d).select("obligation_id", "account_id"), shown, "1998-01-10")


def contradicted_estimates(spark, d):
    return estimates.contradicted(_estimated(spark, d), adapters.transactions(spark, d), "1998-06-30", days=270, floor=500000.0, flat=_flat(spark, d))


def contradicted_by_balance(spark, d):
    """Wide ratios, since amounts of the test tables are far above what one merchant takes."""
    return estimates.contradicted(_estimated(spark, d), adapters.transactions(spark, d), "1998-06-30", days=270, ratio=48.0, floor=100000.0, flat=_flat(spark, d), flat_ratio=12.0)


def estimates_resolved(spark, d):
    i, k = adapters.instances(spark, d), F.col("id")
    rows = i.select("id", "obligation_id", "amount", "amount_status", F.when(k % 4 == 0, estimates.LOWERED).when(k % 4 == 1, "average").alias("amount_source"), "status")
    return estimates.resolved(rows, contradicted_by_balance(spark, d)).drop("obligation_id", "amount_status", "status")


def estimate_provenance(spark, d):
    i = adapters.instances(spark, d).where("amount_status = 'estimated' and status <> 'paid'")
    rows = i.select("id", F.col("entity_id").alias("account_id"), brand_of(F.col("entity_id")).alias("merchant_key"), "due_date")
    return estimates.provenance(rows, adapters.transactions(spark, d).select("account_id", text.slug(F.col("payee")).alias("merchant_key"), "posted"))


#: Notes by order key modulo 6, as the test tables have none.
NOTES = ("Quarterly now", "account closed", "placeholder, was weekly or bi-weekly", "no longer active", "annually; estimate", "")


def note_contradictions(spark, d):
    note = F.element_at(F.array(*[F.lit(n) for n in NOTES]), (F.col("id") % 6 + 1).cast("int"))
    return estimates.note_conflicts(adapters.instances(spark, d).withColumn("note", note))


def backfill_dates(spark, d):
    return estimates.backfill(adapters.instances(spark, d), "1997-06-30", 600)


def unexpected_recurring(spark, d):
    label = F.concat(F.when(F.col("confidence") == "high", "Brand ").otherwise("Plan "), "obligation_id")
    held = adapters.instances(spark, d).where("status <> 'paid'").select("entity_id", label.alias("label"))
    found = estimates.unexpected(_recurring(spark, d).where("disposition = 'surface'"), held)
    return found.select("account_id", "merchant_key", F.round("impact", 6).alias("impact"), F.round("monthly", 6).alias("monthly"))


def verify_statement_identity(spark, d):
    again = statement_rollup(spark, d).where("cycle_id is not null")
    stored = again.withColumn("input_sum", F.when(F.col("cycle_id") % 7 == 0, F.col("input_sum") + 1).otherwise(F.col("input_sum")))
    return findings.rolled_sums_differ(stored, again).select("cycle_id", "input_sum", F.col("sum2").alias("recomputed"))


def verify_projection_identity(spark, d):
    ev = window_events(spark, d)
    return audit.projection_identity(ev, projection.trough(ev, starting(spark, d), START))


def verify_overlap(spark, d):
    grade = F.substring(F.element_at(F.split("obligation_id", ":"), 2), 1, 1)
    name = F.concat(F.lit("Lease plan no "), F.when(grade == "3", "2").otherwise(grade))
    return audit.overlaps(adapters.instances(spark, d).withColumn("name", name).withColumn("kind", F.col("direction")))


def grounding_checks(spark, d):
    facts = adapters.accounts(spark, d).select(F.col("account_id").alias("key"), F.col("balance").alias("value"))
    off = F.when(F.col("key") % 5 == 0, F.lit("0.02").cast(adapters.MONEY)).otherwise(F.lit("0.01").cast(adapters.MONEY))
    return audit.grounding(facts.select(F.when(F.col("key") % 7 == 0, -F.col("key") - 1).otherwise(F.col("key")).alias("key"), (F.col("value") + off).cast(adapters.MONEY).alias("value")), facts)


def grounding_counts(spark, d):
    i = adapters.instances(spark, d)
    turned = lambda n: i.withColumn("direction", F.when(F.col("id") % n == 0, "unknown").otherwise(F.col("direction")))
    return audit.count_differences(turned(9), turned(8), ["entity_id", "direction"])


def migration_dedup(spark, d):
    t = adapters.transactions(spark, d)
    rows = t.select("id", F.col("account_id").alias("entity_id"), F.when(F.col("amount") < 0, "outflow").otherwise("inflow").alias("direction"), F.col("posted").alias("on_date"), F.abs("amount").alias("amount"), F.col("payee").alias("label"))
    return audit.already_modeled(rows, named(spark, d), amount_pct="0.600")


_ALL = (
    income_biweekly, working_account, guardrail_drift_sum, check_suggestions, dormant_accounts, contradicted_estimates, contradicted_by_balance, estimates_resolved, estimate_provenance, note_contradictions, backfill_dates,
    unexpected_recurring, verify_statement_identity, verify_projection_identity, verify_overlap, grounding_checks, grounding_counts, migration_dedup,
    spending_by_category, spending_by_merchant, spending_by_month, spending_samples, list_transactions, latest_balance, asof_balance, balance_coverage,
    project_running_balance, project_trough, project_capped_fold, past_due_carry, roll_forward, trough_band, recon_candidates, recon_best, recon_greedy, recon_shared_groups, recon_run,
    recon_unmatched, prior_amount_change, post_cancellation, recurring_stats, recurring_triage, apply_schedule, drift_payment, stale_estimates, arrived_deposits,
    guardrail_floor, debt_avalanche, goal_pace, statement_cycles, statement_rollup, verify_duplicates, verify_signs, verify_coverage_horizon,
    surface_queue, snapshot_diff, emission_actions, subject_winners, synthetic_ids, memory_search, income_semi_monthly, business_days,
)


def queries() -> dict:
    return {f.__name__: (lambda spark, d, f=f: plain(f(spark, d))) for f in _ALL + rosters.ALL + listings.ALL + ledgers.ALL + feeds.ALL + attention.ALL + settlements.ALL + manuals.ALL}


def oracle_sql() -> dict:
    return oracle.sql()
