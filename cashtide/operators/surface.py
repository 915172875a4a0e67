"""What wants attention: items of eleven kinds in one form, one item a subject, and the open tasks that may go.

An item has surface_key, type, severity, subject (the bill instance it speaks for, or null), on_date and amount. The kinds are
built apart and united, each from its own tables; nothing is ranked or cut here."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import emissions
from .projection import FLOOR, PROJECTABLE

MONEY = "decimal(18,2)"
#: States of runs that count as done, days before a bill shows, days after which a balance by hand is old, hours a job may rest, a high amount.
HEALTHY = ("succeeded", "succeeded_with_warnings", "partial_success")
LEAD_DAYS, SNAPSHOT_DAYS, JOB_HOURS, HIGH_AMOUNT = 5, 30, 26, 1000
#: Rules judged from balances, states of goals that show, and who speaks first for a subject.
BALANCE_RULES = ("cash_floor", "drift_threshold")
GOAL_STATES = ("behind", "due_soon")
PRECEDENCE = {"check-suggestion": 0, "obligation-due": 1, "estimate-review": 2}
PAY = "obligation-due"


def item(rows: DataFrame, kind: str, key: Column, severity: Column, subject: Column | None = None, on_date: Column | None = None, amount: Column | None = None) -> DataFrame:
    """`rows` as items of one kind."""
    none = F.lit(None)
    return rows.select(
        key.alias("surface_key"), F.lit(kind).alias("type"), severity.alias("severity"), (none if subject is None else subject).cast("string").alias("subject"),
        (none if on_date is None else on_date).cast("date").alias("on_date"), (none if amount is None else amount).cast(MONEY).alias("amount"),
    )


def _key(*parts) -> Column:
    return F.concat_ws(":", *[F.lit(p) if i == 0 else F.col(p).cast("string") for i, p in enumerate(parts)])


def _bill(c: str = "instance_id") -> Column:
    return F.concat(F.lit("obligation-instance:"), F.col(c).cast("string"))


def _day(as_of: str) -> Column:
    return F.lit(as_of).cast("date")


def followups(notes: DataFrame, as_of: str) -> DataFrame:
    """Pending notes (id, surface_when, status) that are due."""
    due = notes.where((F.col("status") == "pending") & (F.col("surface_when") <= _day(as_of)))
    return item(due, "followup", _key("followup", "id"), F.lit("medium"), on_date=F.col("surface_when"))


def goals(paced: DataFrame) -> DataFrame:
    """Goals (id, status, deadline, remaining) behind their pace or near their date."""
    rows = paced.where(F.col("status").isin(*GOAL_STATES))
    return item(rows, "goal_review", _key("goal", "id"), F.when(F.col("status") == "due_soon", "high").otherwise("medium"), on_date=F.col("deadline"), amount=F.col("remaining"))


def bills(instances: DataFrame, rejections: DataFrame, as_of: str, lead: int = LEAD_DAYS) -> DataFrame:
    """Open instances (id, obligation_id, due_date, amount, status, autopay) that nothing pays by itself and that are due within
    `lead` days, and past ones of which a check's rejection (instance_id, rejected_on) is dated on or after the due date.

    A rejection before the due date was about an earlier check and brings nothing back. Only the last rejection of an
    instance can matter, so they are aggregated before the join."""
    day = _day(as_of)
    last = rejections.groupBy(F.col("instance_id").alias("_i")).agg(F.max("rejected_on").alias("_rejected"))
    rows = instances.where(F.col("status").isin(*PROJECTABLE) & ~F.col("autopay") & (F.col("due_date") <= F.date_add(day, lead))).join(last, F.col("id") == F.col("_i"), "left")
    left = F.datediff("due_date", day)
    rows = rows.where((left >= 0) | (F.col("_rejected") >= F.col("due_date")))
    severity = F.when(left <= 0, "critical").when(left <= 2, "high").otherwise("medium")
    return item(rows, "obligation_due", _key(PAY, "obligation_id", "due_date"), severity, _bill("id"), F.col("due_date"), F.col("amount"))


def estimates(stale: DataFrame) -> DataFrame:
    """Estimated instances (id, obligation_id, due_date, amount) whose review date has come."""
    severity = F.when(F.abs("amount") >= HIGH_AMOUNT, "high").otherwise("medium")
    return item(stale, "estimate_review", _key("estimate-review", "obligation_id", "due_date"), severity, _bill("id"), F.col("due_date"), F.col("amount"))


def snapshots(latest: DataFrame, as_of: str, days: int = SNAPSHOT_DAYS) -> DataFrame:
    """Accounts (account_id, recorded_at, source) whose latest balance was entered by hand that many days ago or more."""
    rows = latest.where((F.lower("source") == "manual") & (F.datediff(_day(as_of), F.to_date("recorded_at")) >= days))
    return item(rows, "snapshot_refresh", _key("snapshot-due", "account_id"), F.lit("medium"), on_date=F.to_date("recorded_at"))


def troughs(bands: DataFrame, floor: int = FLOOR) -> DataFrame:
    """Entities whose poorly known outflows (entity_id, low, downside, low_date) could take the low point under the floor."""
    low = F.col("low") - F.col("downside")
    return item(bands.where((F.col("downside") > 0) & (low < floor)), "trough_breach_risk", _key("trough-breach", "entity_id"), F.when(low < 0, "high").otherwise("medium"), on_date=F.col("low_date"), amount=low)


def stale_balances(aged: DataFrame) -> DataFrame:
    """Working accounts (entity_id, stale, recorded_at) whose balance is old; it suppresses balance-derived warnings."""
    return item(aged.where("stale"), "confirm_live_balance", _key("confirm-live-balance", "entity_id"), F.lit("medium"), on_date=F.to_date("recorded_at"))


def snoozed(warnings: DataFrame, contributors: DataFrame, as_of: str) -> DataFrame:
    """warning_id of drift warnings (warning_id, total) that say what an earlier day said: every contributor (warning_id,
    finding status, updated_on, impact) is stored as active and unchanged since before that day, and they still sum to it.

    A contributor that was never stored has a null status. A warning without contributors is not snoozed."""
    old = F.coalesce((F.col("status") == "active") & (F.col("updated_on") < _day(as_of)), F.lit(False))
    per = contributors.groupBy("warning_id").agg(F.bool_and(old).alias("_old"), F.sum(F.abs(F.coalesce("impact", F.lit(0)))).cast(MONEY).alias("_sum"))
    return warnings.join(per, "warning_id").where(F.col("_old") & (F.col("_sum") == F.col("total").cast(MONEY))).select("warning_id")


def guardrails(findings: DataFrame, stale: DataFrame, quiet: DataFrame) -> DataFrame:
    """Warnings of rules (id, rule_type, severity, entity_id, impact, advisory) but advice, balance-derived ones of entities whose
    balance is old (`stale`: entity_id), and drift warnings that are snoozed (`quiet`: warning_id)."""
    rows = findings.where(~F.coalesce("advisory", F.lit(False)))
    doubted = stale.select(F.col("entity_id").alias("_e")).distinct()
    rows = rows.join(doubted, (F.col("entity_id") == F.col("_e")) & F.col("rule_type").isin(*BALANCE_RULES), "left_anti")
    rows = rows.join(quiet, (F.col("id") == F.col("warning_id")) & (F.col("rule_type") == "drift_threshold"), "left_anti")
    return item(rows, "guardrail_warning", _key("guardrail", "id"), F.col("severity"), amount=F.col("impact"))


def matches(review: DataFrame) -> DataFrame:
    """Matches (instance_id, due_date, amount) that wait for a person."""
    return item(review, "match_confirmation", _key("match", "instance_id"), F.lit("high"), on_date=F.col("due_date"), amount=F.col("amount"))


def check_questions(suggestions: DataFrame) -> DataFrame:
    """Checks that may pay a bill (suggestion_id, instance_id, amount)."""
    return item(suggestions, "check_suggestion", _key("check-suggestion", "suggestion_id"), F.lit("medium"), _bill(), amount=F.col("amount"))


def stale_jobs(runs: DataFrame, jobs: DataFrame, now: str, hours: int = JOB_HOURS) -> DataFrame:
    """Jobs (run_type) whose last finished healthy run (run_type, status, finished_at) is too long ago, or that have none."""
    last = runs.where(F.col("status").isin(*HEALTHY) & F.col("finished_at").isNotNull()).groupBy(F.col("run_type").alias("_t")).agg(F.max("finished_at").alias("_at"))
    since = F.lit(now).cast("timestamp").cast("long") - F.col("_at").cast("timestamp").cast("long")
    rows = jobs.select("run_type").distinct().join(last, F.col("run_type") == F.col("_t"), "left").where(F.col("_at").isNull() | (since > hours * 3600))
    return item(rows, "stale_job", _key("stale-job", "run_type"), F.lit("high"), on_date=F.to_date("_at"))


def onboarding(candidates: DataFrame) -> DataFrame:
    """One item while candidates (status) wait, none without; its amount is their number."""
    n = candidates.where(F.col("status").isin("discovered", "proposed", "in_review")).agg(F.count("*").alias("n")).where("n > 0")
    return item(n, "onboarding_digest", F.lit("onboarding-digest"), F.lit("medium"), amount=F.col("n"))


def united(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def family(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def _rank(key: Column) -> Column:
    out = F.lit(99)
    for name, n in PRECEDENCE.items():
        out = F.when(family(key) == name, n).otherwise(out)
    return out


def winners(items: DataFrame) -> DataFrame:
    """subject, winner of every subject: the key of the item that speaks for it; of one rank the smallest key. A minimum that
    combines before the shuffle."""
    return items.where("subject is not null").groupBy("subject").agg(F.min(F.struct(_rank(F.col("surface_key")).alias("r"), F.col("surface_key").alias("k")))["k"].alias("winner"))


def one_a_subject(items: DataFrame) -> DataFrame:
    """Items without a subject and each subject's winner."""
    w = winners(items).select(F.col("subject").alias("_s"), F.col("winner").alias("_w"))
    return items.join(w, F.col("subject") == F.col("_s"), "left").where(F.col("subject").isNull() | (F.col("surface_key") == F.col("_w"))).drop("_s", "_w")


def retire_keys(items: DataFrame, stored: DataFrame, instances: DataFrame) -> DataFrame:
    """surface_key, reason of open tasks (`stored`: surface_key, status) that this run's items retire; the first reason that holds.

    queue_empty: the onboarding task without an item. check_decided: a check question that is not asked any more.
    subject: another family speaks for the bill of the item that built this key now; never a pay task, and never a
    key that this run did not build. settled: a pay task of which no instance of that bill and day is open, unless
    the bill shows today under a key that was never stored (its date moved, the task will follow).

    `instances`: obligation_id, due_date, status. All are joins on keys against the open tasks."""
    opened = stored.where("status = 'open'").select("surface_key")
    fam = family(F.col("surface_key"))
    asked = items.select(F.col("surface_key").alias("_k")).distinct()
    idle = opened.where(fam.isin("onboarding-digest", "check-suggestion")).join(asked, F.col("surface_key") == F.col("_k"), "left_anti")
    idle = idle.select("surface_key", F.when(fam == "check-suggestion", 2).otherwise(1).alias("n"))

    tagged = items.where("subject is not null").select("surface_key", "subject").distinct()
    judged = opened.where(fam != PAY).join(tagged, "surface_key").join(winners(items), "subject")
    lost = judged.where((F.col("winner") != F.col("surface_key")) & (family(F.col("winner")) != fam)).select("surface_key", F.lit(3).alias("n"))

    stem = emissions.stem(F.col("surface_key"))
    moved = items.where(F.col("type") == "obligation_due").select("surface_key").join(stored.select("surface_key"), "surface_key", "left_anti").select(stem.alias("_stem")).distinct()
    alive = instances.where(F.col("status").isin(*PROJECTABLE)).select(_key(PAY, "obligation_id", "due_date").alias("_k")).distinct()
    pay = opened.where((fam == PAY) & (F.size(F.split("surface_key", ":")) >= 3)).withColumn("_s", stem)
    gone = pay.join(moved, F.col("_s") == F.col("_stem"), "left_anti").join(alive, F.col("surface_key") == F.col("_k"), "left_anti").select("surface_key", F.lit(4).alias("n"))

    names = F.array(*[F.lit(x) for x in ("queue_empty", "check_decided", "subject", "settled")])
    return united([idle, lost, gone]).groupBy("surface_key").agg(F.min("n").alias("n")).select("surface_key", F.element_at(names, F.col("n")).alias("reason"))
