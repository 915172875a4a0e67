"""Lists and summaries for a reader: obligations with their instances, due notes, goals, guardrail verdicts, income."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of follow-up priorities.
PRIORITY = {"high": 3, "medium": 2, "low": 1}


def obligations(rows: DataFrame, instances: DataFrame, name_contains: str | None = None, kind: str | None = None) -> DataFrame:
    """`rows` (obligation_id, name, kind, ...) that pass the filters, with their instances (due_date, id, amount, status)
    in due order and, over those, n, total and next_due. One pre-aggregated join; an obligation's own list is its row."""
    keep = F.lit(True)
    if name_contains is not None:
        keep = keep & (F.contains(F.lower("name"), F.lit(name_contains.lower())) | F.contains(F.lower("obligation_id"), F.lit(name_contains.lower())))
    if kind is not None:
        keep = keep & (F.col("kind") == kind)
    listed = instances.groupBy(F.col("obligation_id").alias("_o")).agg(
        F.array_sort(F.collect_list(F.struct("due_date", "id", "amount", "status"))).alias("instances"), F.count("*").alias("n"), F.sum("amount").alias("total"), F.min("due_date").alias("next_due")
    )
    out = rows.where(keep).join(listed, F.col("obligation_id") == F.col("_o"), "left").drop("_o")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def due_followups(notes: DataFrame, as_of: str) -> tuple[DataFrame, list[Column]]:
    """Pending notes (id, surface_when, priority, status, created_at) due by then, and the order to show them in."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("priority")), F.lit(0))
    due = notes.where((F.col("status") == "pending") & (F.col("surface_when") <= F.lit(as_of).cast("date"))).withColumn("priority_rank", rank)
    return due, [F.asc("surface_when"), F.desc("priority_rank"), F.asc("created_at"), F.asc("id")]


def goal_progress(goals: DataFrame, balances: DataFrame, inflows: DataFrame, as_of: str) -> DataFrame:
    """id, progress, trackable: a goal's override, else its account's live balance, else its matured inflows, else 0.

    `goals`: id, source_account, override. `balances`: account_id, balance, latest by then. `inflows`: account_id, amount,
    due_date, status; a goal without account counts those of all accounts, one global sum. Trackable: any of the
    three exists."""
    ripe = inflows.where((F.col("status") != "deleted") & (F.col("due_date") <= F.lit(as_of).cast("date")))
    per = ripe.groupBy(F.col("account_id").alias("_i")).agg(F.sum("amount").alias("_sum"), F.count("*").alias("_n"))
    every = ripe.agg(F.sum("amount").alias("_all"), F.count("*").alias("_all_n"))
    live = balances.select(F.col("account_id").alias("_b"), F.col("balance").alias("_live"))
    rows = goals.join(live, F.col("source_account") == F.col("_b"), "left").join(per, F.col("source_account") == F.col("_i"), "left").crossJoin(F.broadcast(every))  # one row
    alone = F.col("source_account").isNull()
    total, n = F.when(alone, F.col("_all")).otherwise(F.col("_sum")), F.when(alone, F.col("_all_n")).otherwise(F.coalesce("_n", F.lit(0)))
    return rows.select(
        "id",
        F.coalesce("override", "_live", total, F.lit(0)).cast("decimal(18,2)").alias("progress"),
        (F.col("override").isNotNull() | F.col("_live").isNotNull() | (n > 0)).alias("trackable"),
    )


def floor_verdicts(troughs: DataFrame, balances: DataFrame, missing: DataFrame, floor: int, window_days: int) -> DataFrame:
    """entity_id, verdict, severity, impact of each entity whose floor is broken or cannot be judged.

    `troughs`: entity_id, low. `balances`: entity_id, stale. `missing`: entity_id of those with an account without
    balance. The verdict is withheld, in this order, without a balance, with a stale one, with a missing account."""
    gone = missing.select("entity_id").distinct().withColumn("_gap", F.lit(True))
    rows = troughs.join(balances.select("entity_id", "stale"), "entity_id", "left").join(gone, "entity_id", "left")
    verdict = (
        F.when(F.col("stale").isNull(), "missing_working_balance").when(F.col("stale"), "stale_working_balance")
        .when(F.col("_gap"), "missing_account_data").when(F.col("low") < floor, "breach")
    )
    rows = rows.withColumn("verdict", verdict).where("verdict is not null")
    broken = F.col("verdict") == "breach"
    return rows.select("entity_id", "verdict", F.when(broken, "high" if window_days <= 7 else "medium").otherwise("low").alias("severity"), F.when(broken, (F.col("low") - floor).cast("decimal(18,2)")).alias("impact"))


def recurring_summary(candidates: DataFrame, top: int) -> DataFrame:
    """Per account: total, more_count, more_monthly, all_monthly, confident_count of `candidates` (account_id, id,
    monthly, confidence), the `top` largest of which are shown."""
    order = Window.partitionBy("account_id").orderBy(F.desc("monthly"), "id")
    rest, sure = F.col("_r") > top, F.col("confidence").isin("medium", "high")
    return candidates.withColumn("_r", F.row_number().over(order)).groupBy("account_id").agg(
        F.count("*").alias("total"), F.count(F.when(rest, 1)).alias("more_count"), F.coalesce(F.sum(F.when(rest, F.col("monthly"))), F.lit(0)).alias("more_monthly"),
        F.sum("monthly").alias("all_monthly"), F.count(F.when(sure, 1)).alias("confident_count"),
    )


def most_frequent(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key and its most frequent value; ties go to the smaller value. Two pre-aggregated steps."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("_n"))
    return n.groupBy(key).agg(F.min(F.struct(-F.col("_n"), F.col(value)))[value].alias(value))


def resume_date(transactions: DataFrame, today: str, overlap: int = 3, lookback: int = 90) -> DataFrame:
    """One row (start): the oldest of the accounts' newest posting dates less `overlap` days, at most `lookback` days ago;
    null without transactions."""
    newest = transactions.groupBy("account_id").agg(F.max("posted").alias("posted"))
    return newest.agg(F.min("posted").alias("d")).select(F.when(F.col("d").isNotNull(), F.greatest(F.date_sub("d", overlap), F.date_sub(F.lit(today).cast("date"), lookback))).alias("start"))


def superseded_manual(snapshots: DataFrame) -> DataFrame:
    """Observations entered by hand (id, account_id, recorded_at, source) that a later one by hand of the same day (UTC)
    replaces. Those of other days are history and stay."""
    day = F.floor(F.unix_seconds(F.col("recorded_at").cast("timestamp")) / 86400)
    by_hand = snapshots.where("source = 'manual' and recorded_at is not null")
    later = Window.partitionBy("account_id", day).orderBy(F.desc("recorded_at"), F.desc("id"))
    return by_hand.withColumn("_r", F.row_number().over(later)).where("_r > 1").drop("_r")


def expand_income(sources: DataFrame, pay_dates: DataFrame, existing: DataFrame, start: str, through: str) -> DataFrame:
    """source_id, pay_date, amount, action of each source's instances in the range: created, kept, updated (another amount
    is stored) or cancelled (stored as expected, but no pay date any more).

    `sources`: source_id, schedule, amount. `pay_dates`: schedule, pay_date. `existing`: source_id, pay_date, amount,
    status; settled ones stay out of it."""
    inside = F.col("pay_date").between(F.lit(start).cast("date"), F.lit(through).cast("date"))
    want = sources.join(pay_dates.where(inside), "schedule").select("source_id", "pay_date", "amount")
    have = existing.where(inside & (F.col("status") == "expected")).select("source_id", "pay_date", F.col("amount").alias("stored"))
    both = want.withColumn("_w", F.lit(True)).join(have.withColumn("_h", F.lit(True)), ["source_id", "pay_date"], "full")
    action = F.when(F.col("_w").isNull(), "cancelled").when(F.col("_h").isNull(), "created").when(F.col("amount") == F.col("stored"), "kept").otherwise("updated")
    return both.select("source_id", "pay_date", F.coalesce("amount", "stored").alias("amount"), action.alias("action"))
