"""Findings: payment drift, guardrails, goals, debts, statement cycles and data verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .projection import FLOOR, PROJECTABLE
from .reconcile import Options, candidates

SEVERITY = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def severity_rank(c):
    out = None
    for k, v in SEVERITY.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(0)


def payment_drift(instances: DataFrame, transactions: DataFrame, as_of: str, strict: Options = Options(), loose: Options | None = None) -> DataFrame:
    """id, entity_id, finding_type, severity, impact, age_days of past-due instances that are not settled cleanly.

    A strict automatic match is clean. Else the best loose pair is the same charge if its words overlap and it lies
    within three days: beyond 20 percent it is amount_changed, otherwise it is silent. No such charge and more
    than the grace days late: missing_expected (critical after 30 days). Claims play no part here."""
    loose = loose or Options(window=strict.window, amount_abs="5.00", amount_pct="0.500")
    day = F.lit(as_of).cast("date")
    late = instances.where(F.col("status").isin(*PROJECTABLE) & (F.col("due_date") < day))
    pairs = candidates(late, transactions, loose)
    tight = F.greatest(F.lit(strict.amount_abs).cast("decimal(18,2)"), F.col("expected") * F.lit(strict.amount_pct).cast("decimal(4,3)"))
    clean = F.max((F.col("match_type") == "auto") & (F.col("delta") <= tight))
    top = F.min(F.struct((-F.col("score")).alias("s"), F.abs("days").alias("d"), "delta", "transaction_id", "merchant_score", "observed"))
    seen = pairs.groupBy(F.col("instance_id").alias("id")).agg(clean.alias("clean"), top.alias("top"))
    age = F.datediff(day, "due_date")
    same = F.coalesce((F.col("top.merchant_score") > 0) & (F.col("top.d") <= 3), F.lit(False))
    moved = F.abs(F.col("top.observed") - F.col("amount"))
    changed = same & (moved > F.col("amount") * F.lit("0.20").cast("decimal(4,3)"))
    sign = F.when(F.col("direction") == "inflow", 1).otherwise(-1)
    kind = F.when(changed, "amount_changed").when(~same & (age > strict.grace), "missing_expected")
    return (
        late.join(seen, "id", "left")
        .where(~F.coalesce("clean", F.lit(False)))
        .withColumn("finding_type", kind)
        .where("finding_type is not null")
        .select(
            "id",
            "entity_id",
            "finding_type",
            F.when(F.col("finding_type") == "amount_changed", "medium").when(age > 30, "critical").otherwise("high").alias("severity"),
            F.when(F.col("finding_type") == "amount_changed", (F.col("top.observed") - F.col("amount")) * sign).otherwise(F.col("amount") * -sign).cast("decimal(18,2)").alias("impact"),
            age.alias("age_days"),
        )
    )


def stale_estimates(instances: DataFrame, as_of: str, review_after_days: int = 30) -> DataFrame:
    """Estimated open instances whose review date (due date minus the given days) has come."""
    review = F.date_sub("due_date", review_after_days)
    rows = instances.where((F.col("amount_status") == "estimated") & F.col("status").isin(*PROJECTABLE))
    return rows.where(review <= F.lit(as_of).cast("date")).select("id", "entity_id", "amount", review.alias("review_after"))


def arrived_deposits(transactions: DataFrame, accounts: DataFrame, matched: DataFrame, as_of: str, days: int = 14, least: int = 50) -> DataFrame:
    """Recent settled inflows to checking accounts that nothing expected and that are no transfers."""
    day = F.lit(as_of).cast("date")
    said = F.lower(F.concat_ws(" ", "payee", "description"))
    rows = transactions.where(
        (F.col("amount") >= least) & ~F.col("pending") & F.col("posted").between(F.date_sub(day, days), day) & ~F.contains(said, F.lit("transfer")) & ~F.contains(said, F.lit("xfer"))
    )
    rows = rows.join(accounts.where("kind = 'checking'").select("account_id"), "account_id", "left_semi")
    return rows.join(matched.select(F.col("transaction_id").alias("id")), "id", "left_anti").select("id", "account_id", "posted", "amount")


def cash_floor(troughs: DataFrame, window_days: int, floor: int = FLOOR) -> DataFrame:
    """entity_id, low, severity for windows whose low is under the floor; windows up to seven days are high."""
    return troughs.where(F.col("low") < floor).select("entity_id", "low", F.lit("high" if window_days <= 7 else "medium").alias("severity"))


def drift_sum(findings: DataFrame, threshold: int = 200) -> DataFrame:
    """entity_id, total, n of entities whose drift findings add up, signs apart, to more than the threshold."""
    return findings.groupBy("entity_id").agg(F.sum(F.abs("impact")).alias("total"), F.count("*").alias("n")).where(F.col("total") > threshold)


def avalanche(debts: DataFrame) -> DataFrame:
    """entity_id, id, rank, monthly_interest of revolving debts with a balance, dearest first.

    `debts`: id, entity_id, apr (decimal), balance (decimal), is_revolving."""
    rows = debts.where("is_revolving and balance <> 0")
    interest = F.round(F.abs("balance") * F.col("apr") / 1200, 2).cast("decimal(18,2)")
    order = Window.partitionBy("entity_id").orderBy(F.desc("apr"), "id")
    return rows.select("entity_id", "id", F.row_number().over(order).alias("rank"), interest.alias("monthly_interest"))


def goal_pace(goals: DataFrame, as_of: str) -> DataFrame:
    """`goals` (id, target, progress, created, deadline, trackable) with its status and remaining; a target of 0 that is not
    reached counts as no progress."""
    day = F.lit(as_of).cast("date")
    left = F.datediff("deadline", day)
    elapsed = F.when(F.datediff("deadline", "created") > 0, F.datediff(day, "created") / F.datediff("deadline", "created")).otherwise(F.lit(1.0))
    share = F.coalesce(F.try_divide(F.col("progress").cast("double"), F.col("target").cast("double")), F.lit(0.0))
    status = (
        F.when(F.col("progress") >= F.col("target"), "completed").when(F.col("deadline").isNull(), "no_deadline").when(left.between(0, 14), "due_soon")
        .when(~F.col("trackable"), "pending").when((elapsed < 0.10) & (left >= 0), "on_track").when(share >= elapsed, "on_track").otherwise("behind")
    )
    return goals.select("id", status.alias("status"), F.greatest(F.col("target") - F.col("progress"), F.lit(0).cast("decimal(18,2)")).alias("remaining"))


def cycles(statements: DataFrame) -> DataFrame:
    """target, cycle_id, opens, closes: each statement opens the day after the one before it closes."""
    order = Window.partitionBy("target").orderBy("closes", "id")
    return statements.select("target", F.col("id").alias("cycle_id"), F.date_add(F.lag("closes").over(order), 1).alias("opens"), "closes")


def placed(inputs: DataFrame, statements: DataFrame) -> DataFrame:
    """Statements (target, closes, id) and inputs (id, target, due_date, amount) in one table, each with `cycle`, the first that closes
    on or after its date, or null: target, at, order (0: input, 1: statement), input_id, amount, cycle.

    Both sides are laid in one ordered list per target and the next close is looked up by a window, so there is
    no range join: one shuffle by target, linear in the rows."""
    none = F.lit(None)
    marks = statements.select("target", F.col("closes").alias("at"), F.lit(1).alias("order"), F.col("id").alias("cycle_id"), none.cast("long").alias("input_id"), none.cast("decimal(18,2)").alias("amount"))
    lines = inputs.where("target is not null").select("target", F.col("due_date").alias("at"), F.lit(0).alias("order"), none.cast("long").alias("cycle_id"), F.col("id").alias("input_id"), "amount")
    onward = Window.partitionBy("target").orderBy("at", "order", "cycle_id").rowsBetween(0, Window.unboundedFollowing)
    return marks.unionByName(lines).withColumn("cycle", F.first("cycle_id", ignorenulls=True).over(onward)).drop("cycle_id")


def rollup(inputs: DataFrame, statements: DataFrame) -> DataFrame:
    """cycle_id, n_inputs, input_sum per cycle, and a row with a null cycle_id per target for unrolled inputs.

    `inputs`: id, target, due_date, amount. An input belongs to the first cycle that closes on or after its due date."""
    return placed(inputs, statements).groupBy("target", F.col("cycle").alias("cycle_id")).agg(
        F.count_if(F.col("order") == 0).alias("n_inputs"), F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(18,2)").alias("input_sum")
    )


def statement_status(cycles: DataFrame, sums: DataFrame, statements: DataFrame, as_of: str) -> DataFrame:
    """Per target: the last closed statement (closed_id, closed_amount, closed_state), the open cycle (open_id, opens, closes, spend,
    n_inputs, modeled), variance (modeled less spend) and on_track.

    `cycles`: target, cycle_id, opens, closes; `sums`: target, cycle_id, n_inputs, input_sum; `statements`: id, amount, amount_status.
    A cycle is ahead if no more is spent than the share of its days gone by times the modeled amount, else behind; null
    without an opening date, days or a modeled amount other than 0."""
    day = F.lit(as_of).cast("date")
    amounts = statements.select(F.col("id").alias("cycle_id"), F.col("amount").alias("modeled"), F.col("amount_status").alias("state"))
    spent = sums.where("cycle_id is not null").select("cycle_id", "n_inputs", F.col("input_sum").alias("spend"))
    rows = cycles.join(spent, "cycle_id", "left").join(amounts, "cycle_id", "left")
    row = F.struct("closes", "cycle_id", "opens", "spend", "n_inputs", "modeled", "state")
    both = rows.groupBy("target").agg(F.max(F.when(F.col("closes") <= day, row)).alias("c"), F.min(F.when(F.col("closes") > day, row)).alias("o"))
    days = F.datediff("o.closes", "o.opens")
    gone = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.datediff(day, "o.opens") / days))
    ahead = F.col("o.spend").cast("double") <= F.col("o.modeled").cast("double") * gone
    return both.select(
        "target", F.col("c.cycle_id").alias("closed_id"), F.col("c.modeled").alias("closed_amount"), F.col("c.state").alias("closed_state"), F.col("o.cycle_id").alias("open_id"), "o.opens", "o.closes", "o.spend", "o.n_inputs", "o.modeled",
        (F.col("o.modeled") - F.col("o.spend")).cast("decimal(18,2)").alias("variance"),
        F.when((F.col("o.modeled") != 0) & F.col("o.spend").isNotNull() & (days > 0), F.when(ahead, "ahead").otherwise("behind")).alias("on_track"),
    )


def duplicate_instances(instances: DataFrame) -> DataFrame:
    """obligation_id, due_date, n of pairs that occur more than once."""
    return instances.groupBy("obligation_id", "due_date").agg(F.count("*").alias("n")).where("n > 1")


def wrong_signs(rows: DataFrame) -> DataFrame:
    """Rows whose stored amount is below zero."""
    return rows.where(F.col("amount") < 0)


def short_horizon(instances: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Obligations without an open instance due in [as_of, as_of + days): obligation_id, last_due."""
    day = F.lit(as_of).cast("date")
    live = instances.where(F.col("status").isin(*PROJECTABLE))
    inside = (F.col("due_date") >= day) & (F.col("due_date") < F.date_add(day, days))
    return live.groupBy("obligation_id").agg(F.max("due_date").alias("last_due"), F.count_if(inside).alias("n")).where("n = 0").select("obligation_id", "last_due")


def rolled_sums_differ(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Cycles whose stored count or sum is not the recomputed one."""
    r = recomputed.select("cycle_id", F.col("n_inputs").alias("n2"), F.col("input_sum").alias("sum2"))
    return stored.join(r, "cycle_id", "left").where(~(F.col("n_inputs").eqNullSafe(F.col("n2")) & F.col("input_sum").eqNullSafe(F.col("sum2"))))


def status_color(entities: DataFrame, unmodeled_from: int = 100) -> DataFrame:
    """entity_id, color, reason from the first rule that holds; null inputs hold nothing, null amounts are no danger.

    In this order: verify_error; stale_balance (what follows would read it); worst_guardrail (rank) 3 or more; low under
    zero; low_estimate, the low point less what estimates could add, under zero; worst_guardrail 2; breach; recurring
    charges of unmodeled_monthly or more that no projection holds; material_estimate; verify_warning; open_risk."""
    rules = (
        ("verify_error", F.col("verify_error"), "RED"), ("stale_balance", F.col("stale_balance"), "YELLOW"), ("guardrail", F.col("worst_guardrail") >= 3, "RED"),
        ("below_zero", F.col("low") < 0, "RED"), ("estimates_below_zero", F.col("low_estimate") < 0, "RED"), ("guardrail", F.col("worst_guardrail") == 2, "YELLOW"),
        ("breach_risk", F.col("breach"), "YELLOW"), ("unmodeled_recurring", F.col("unmodeled_monthly") >= unmodeled_from, "YELLOW"),
        ("material_estimate", F.col("material_estimate"), "YELLOW"), ("verify_warning", F.col("verify_warning"), "YELLOW"), ("open_risk", F.col("open_risk"), "YELLOW"),
    )
    hit = F.coalesce(*[F.when(held, F.struct(F.lit(color).alias("color"), F.lit(name).alias("reason"))) for name, held, color in rules], F.struct(F.lit("GREEN").alias("color"), F.lit("clear").alias("reason")))
    return entities.select("entity_id", hit.alias("_h")).select("entity_id", "_h.color", "_h.reason")
