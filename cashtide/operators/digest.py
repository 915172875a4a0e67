"""The day's digest: how much is covered and by whom, where schedules have gaps, and which money is still open."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity
from .estimates import PER_MONTH, lookup

MONEY = "decimal(18,2)"
#: States in which a candidate still waits, and the amount from which open money is named.
WAITING = ("discovered", "proposed", "in_review")
MATERIAL = 1000
#: Days that one payment of a cadence covers; any other cadence counts as monthly.
SPAN = {"weekly": 7, "biweekly": 14, "monthly": 31, "quarterly": 92, "semiannual": 184, "annual": 366, "yearly": 366}


def coverage(obligations: DataFrame, events: DataFrame, due: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: modeled, autopay_silent, manual_attention of all active `obligations` (obligation_id, autopay); in_window and its
    split of those with `events` (obligation_id); surfaced (rows of `due`); waiting candidates (status), and of each state.

    Every table is brought to one row per name and count before they meet, so the last step adds a handful of rows.
    An obligation among the events but not in the roster counts as in the window but in neither part of the split."""
    pay = F.coalesce("autopay", F.lit(False))
    roster = obligations.groupBy("obligation_id").agg(F.bool_or(pay).alias("autopay"))
    seen = events.where("obligation_id is not null").select("obligation_id").distinct().join(roster, "obligation_id", "left")
    counts = [
        roster.agg(F.count("*").alias("modeled"), F.count_if(F.col("autopay")).alias("autopay_silent"), F.count_if(~F.col("autopay")).alias("manual_attention")),
        seen.agg(F.count("*").alias("in_window"), F.count_if(F.col("autopay")).alias("in_window_autopay"), F.count_if(~F.col("autopay")).alias("in_window_manual")),
        due.agg(F.count("*").alias("surfaced")),
        candidates.agg(F.count_if(F.col("status").isin(*WAITING)).alias("waiting"), *[F.count_if(F.col("status") == s).alias(f"waiting_{s}") for s in WAITING]),
    ]
    names = [c for part in counts for c in part.columns]
    wide = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counts)
    return wide.agg(*[F.sum(c).alias(c) for c in names])


def gaps(instances: DataFrame, start: str, horizon: int) -> DataFrame:
    """obligation_id, n_islands, gap_days, longest_gap, covered_until within the horizon's days.

    `instances`: obligation_id, due_date, cadence. A payment covers its cadence's days from its date; islands are
    stretches of covered days without a gap. Gaps before the first and after the last island count. One ordered
    window per obligation; an obligation that covers no day of the horizon has none of its days covered."""
    begin = F.lit(start).cast("date")
    end = F.date_add(begin, horizon)
    span = lookup(F.col("cadence"), SPAN, SPAN["monthly"])
    rows = instances.where("due_date is not null").select("obligation_id", F.greatest("due_date", begin).alias("a"), F.least(F.date_add("due_date", span), end).alias("b"))
    every = rows.select("obligation_id").distinct()
    inside = rows.where(F.col("a") < F.col("b"))
    before = Window.partitionBy("obligation_id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    steps = inside.withColumn("held", F.max("b").over(before)).withColumn("gap", F.greatest(F.datediff("a", F.coalesce("held", begin)), F.lit(0)))
    per = steps.groupBy("obligation_id").agg(
        F.count_if(F.col("held").isNull() | (F.col("gap") > 0)).alias("n_islands"), F.sum("gap").alias("inner"), F.max("gap").alias("widest"), F.max("b").alias("covered_until")
    )
    tail = F.datediff(end, F.coalesce("covered_until", begin))
    return every.join(per, "obligation_id", "left").select(
        "obligation_id", F.coalesce("n_islands", F.lit(0)).alias("n_islands"), (F.coalesce("inner", F.lit(0)) + tail).alias("gap_days"),
        F.greatest(F.coalesce("widest", F.lit(0)), tail).alias("longest_gap"), F.coalesce("covered_until", begin).alias("covered_until"),
    )


def open_risks(events: DataFrame, notes: DataFrame, as_of: str, until: str, material: int = MATERIAL) -> DataFrame:
    """kind, entity_id, ref_id, on_date, amount, why, counted, blocks: money that is still open.

    `events`: id, entity_id, due_date, amount, direction, amount_status, status, carried, cadence: every outflow of the
    material amount or more, with what is unsettled about it; without any such reason it does not block an all-clear.
    `notes`: id, entity_id, surface_when, text, status: pending reminders dated up to `until`; they always block, and
    their amount is what their text names, null without one."""
    amount = F.round(F.abs("amount"), 2).cast(MONEY)
    cadence = F.coalesce(F.lower(F.trim("cadence")), F.lit(""))
    reasons = F.concat_ws(
        "; ", F.when(F.col("carried"), "past due and unreconciled"), F.when(F.col("amount_status") == "estimated", "amount is still an estimate"),
        F.when(F.col("status") == "needs_review", "flagged needs review"), F.when(~cadence.isin(*PER_MONTH), "one-time payment (no recurring schedule on file)"),
    )
    paid = events.where((F.col("direction") == "outflow") & (amount >= material)).withColumn("_why", reasons)
    blocks = F.col("_why") != ""
    payments = paid.select(
        F.lit("payment").alias("kind"), "entity_id", F.col("id").cast("string").alias("ref_id"), F.col("due_date").alias("on_date"), amount.alias("amount"),
        F.when(blocks, F.col("_why")).otherwise("confirmed recurring payment, not paid yet").alias("why"), F.lit(True).alias("counted"), blocks.alias("blocks"),
    )
    late = F.when(F.col("surface_when") < F.lit(as_of).cast("date"), " (past its surface date)").otherwise("")
    asked = notes.where((F.col("status") == "pending") & (F.col("surface_when") <= F.lit(until).cast("date")))
    return payments.unionByName(asked.select(
        F.lit("follow_up").alias("kind"), "entity_id", F.col("id").cast("string").alias("ref_id"), F.col("surface_when").alias("on_date"), identity.amount_in(F.col("text")).cast(MONEY).alias("amount"),
        F.concat(F.lit("reminder is still unresolved"), late).alias("why"), F.lit(False).alias("counted"), F.lit(True).alias("blocks"),
    ))


def board_health(emissions: DataFrame, drift: DataFrame, threshold: int = 200) -> DataFrame:
    """One row: last_seen of the board's tasks, n_big_drifts (impact beyond the threshold), managed_clean: a board that was
    never written is not a clean one."""
    both = emissions.agg(F.max("last_seen").alias("last_seen")).unionByName(drift.agg(F.count_if(F.abs("impact") > threshold).alias("n_big_drifts")), allowMissingColumns=True)
    one = both.agg(F.max("last_seen").alias("last_seen"), F.max("n_big_drifts").alias("n_big_drifts"))
    return one.withColumn("managed_clean", F.col("last_seen").isNotNull() & (F.col("n_big_drifts") == 0))
