"""Estimates against what was observed: dormancy, contradictions, provenance, notes, backfill and check suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .projection import PROJECTABLE
from .recurring import WEIGHTS

MONEY = "decimal(18,2)"
#: Fixed value: the source of an amount that was lowered to what was observed.
LOWERED = "estimate_contradicted"
#: Occurrences in a month of thirty days.
PER_MONTH = {"weekly": 4.345, "biweekly": 2.173, "monthly": 1.0, "quarterly": 1 / 3, "semiannual": 1 / 6, "annual": 1 / 12, "yearly": 1 / 12}
#: Words of notes that name a cadence, say that a charge has stopped, or call an amount a guess.
CADENCE_WORDS = {
    "weekly": "weekly", "biweekly": "biweekly", "bi-weekly": "biweekly", "monthly": "monthly", "quarterly": "quarterly", "semiannual": "semiannual",
    "semi-annual": "semiannual", "annual": "annual", "annually": "annual", "yearly": "annual",
}
STOPPED_WORDS = ("canceled", "cancelled", "closed", "terminated", "discontinued", "no longer active")
GUESS_WORDS = ("estimate", "estimated", "placeholder", "guess", "guessed", "assumed")


def lookup(c: Column, mapping: dict, other) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(other)


def cents(c: Column) -> Column:
    """A double to two places, halves up; six places first, so that halves are halves whatever the last bit."""
    return F.round(c.cast("decimal(20,6)"), 2).cast("double")


def dormant(estimates: DataFrame, balances: DataFrame, transactions: DataFrame, as_of: str, days: int = 60) -> DataFrame:
    """The rows of `estimates` (account_id and more) whose account holds nothing and moved nothing in the last `days`.

    `balances`: account_id, balance. An account without a balance row is not known to be dormant."""
    day = F.lit(as_of).cast("date")
    moved = transactions.where(F.col("posted").between(F.date_sub(day, days), day)).select("account_id")
    empty = balances.where("balance = 0").select("account_id")
    return estimates.join(empty, "account_id", "left_semi").join(moved, "account_id", "left_anti")


def flat_accounts(snapshots: DataFrame, since: str) -> DataFrame:
    """account_id, oldest, newest (balances without sign) of accounts observed on or after `since`: the first of those and the
    latest of all, by time, then id. Two extremes of structs, combined before the shuffle."""
    at = F.struct("recorded_at", "id", F.abs("balance").alias("b"))
    inside = F.to_date("recorded_at") >= F.lit(since).cast("date")
    ends = snapshots.where("recorded_at is not null").groupBy("account_id").agg(F.min(F.when(inside, at)).alias("_o"), F.max(at).alias("_n"))
    return ends.where("_o is not null").select("account_id", F.col("_o.b").alias("oldest"), F.col("_n.b").alias("newest"))


def flat(links: DataFrame, snapshots: DataFrame, since: str) -> DataFrame:
    """obligation_id of estimates whose accounts (`links`: obligation_id, account_id) together hold no more than at the start
    of the window. Accounts not observed in it say nothing; an estimate with none such is not flat."""
    held = links.distinct().join(flat_accounts(snapshots, since), "account_id").groupBy("obligation_id").agg(F.sum("oldest").alias("_o"), F.sum("newest").alias("_n"))
    return held.where(F.col("_n") <= F.col("_o")).select("obligation_id")


def contradicted(
    estimates: DataFrame, transactions: DataFrame, as_of: str, days: int = 90, cycles: int = 2, ratio: float = 2.0, floor: float = 150.0, near_zero: float = 5.0, flat: DataFrame | None = None, flat_ratio: float = 1.5
) -> DataFrame:
    """obligation_id, modeled, observed, resolution, new_amount of estimates far above what the merchant really took.

    `estimates`: obligation_id, account_id, merchant_key, cadence, amount (double, one occurrence). The gap has to
    hold for the whole window and for each of its last `cycles` months of thirty days. Accounts without any
    transaction in the window say nothing. Spending is summed per account and merchant before it is joined. For
    obligations in `flat` (see flat(); no growing balance hides spending) the gap is `flat_ratio` instead of `ratio`."""
    day = F.lit(as_of).cast("date")
    recent = transactions.where(F.col("posted").between(F.date_sub(day, days), day))
    paid = recent.where("amount < 0").select("account_id", text.slug(F.col("payee")).alias("merchant_key"), (-F.col("amount")).alias("paid"), F.datediff(day, "posted").alias("age"))
    part = lambda i: F.sum(F.when(F.col("age").between(30 * i, 30 * i + 29), F.col("paid"))).cast("double").alias(f"m{i}")
    spent = paid.groupBy("account_id", "merchant_key").agg(F.sum("paid").cast("double").alias("total"), *[part(i) for i in range(cycles)])
    factor = lookup(F.col("cadence"), PER_MONTH, 1.0)
    rows = (
        estimates.join(recent.select("account_id"), "account_id", "left_semi")
        .join(spent, ["account_id", "merchant_key"], "left")
        .withColumns({"factor": factor, "modeled": cents(F.col("amount") * factor), "observed": cents(F.coalesce("total", F.lit(0.0)) / (days / 30)), "_ratio": F.lit(ratio)})
    )
    if flat is not None:
        calm = flat.select(F.col("obligation_id").alias("_f")).distinct()
        rows = rows.join(calm, F.col("obligation_id") == F.col("_f"), "left").withColumn("_ratio", F.when(F.col("_f").isNotNull(), flat_ratio).otherwise(ratio))
    above = lambda c: F.col("modeled") >= F.greatest(F.lit(floor), F.coalesce(c, F.lit(0.0)) * F.col("_ratio"))
    fires = above(F.col("observed"))
    for i in range(cycles):
        fires = fires & above(F.col(f"m{i}"))
    gone = F.col("observed") <= near_zero
    return rows.where(fires).select(
        "obligation_id", "modeled", "observed", F.when(gone, "dormant").otherwise("rewrite").alias("resolution"), F.when(~gone, cents(F.col("observed") / F.col("factor"))).alias("new_amount")
    )


def resolved(instances: DataFrame, found: DataFrame) -> DataFrame:
    """`instances` with what contradicted() found written back, and `action`: rewritten rows get the smaller amount and keep
    the old one as previous_amount; dormant ones only say so. Doing it again changes nothing that was written.

    `instances`: obligation_id, amount, amount_status, amount_source, status and more. Only open estimates change;
    confirmed, settled and already lowered rows stay."""
    f = found.select(F.col("obligation_id").alias("_f"), "resolution", F.col("new_amount").cast(MONEY).alias("_new"))
    rows = instances.join(f, F.col("obligation_id") == F.col("_f"), "left")
    open_ = F.col("status").isin(*PROJECTABLE) & F.col("amount_status").eqNullSafe("estimated") & ~F.col("amount_source").eqNullSafe(LOWERED)
    action = F.when(F.col("_f").isNull() | ~F.coalesce(open_, F.lit(False)), "kept").otherwise(F.col("resolution"))
    rows = rows.withColumn("action", action)
    hit = F.col("action") == "rewrite"
    values = {"amount": F.col("_new"), "amount_source": F.lit(LOWERED)}
    kept = [F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in instances.columns]
    return rows.select(*kept, F.when(hit, F.col("amount")).alias("previous_amount"), "action")


def provenance(estimates: DataFrame, evidence: DataFrame, most: int = 60) -> DataFrame:
    """id, n_covered, n_missing, first_missing, complete: the months behind an estimate and the gaps among them.

    `estimates`: id, account_id, merchant_key, due_date; `evidence`: account_id, merchant_key, posted. The span
    runs from the first month with evidence through the due month; `most` gaps are listed, as many as a report
    shows. Without evidence nothing is known to be missing, and nothing is complete. One set of months is kept per merchant."""
    month = lambda c: F.trunc(c, "MM")
    months = evidence.groupBy("account_id", "merchant_key").agg(F.collect_set(month("posted")).alias("months"))
    first, due = F.array_min("months"), month("due_date")
    span = F.when(first <= due, F.sequence(first, due, F.expr("interval 1 month"))).when(first.isNotNull(), F.array().cast("array<date>"))
    rows = estimates.join(months, ["account_id", "merchant_key"], "left").withColumn("missing", F.slice(F.array_except(span, "months"), 1, most))
    return rows.select(
        "id", F.when(F.col("months").isNull(), 0).otherwise(F.size("months")).alias("n_covered"), F.when(F.col("missing").isNotNull(), F.size("missing")).alias("n_missing"),
        F.array_min("missing").alias("first_missing"), F.coalesce(F.size("missing") == 0, F.lit(False)).alias("complete") & F.col("months").isNotNull(),
    ).toDF("id", "n_covered", "n_missing", "first_missing", "complete")


def note_conflicts(instances: DataFrame) -> DataFrame:
    """id, field, note_says, record_says: notes that disagree with their row's cadence, status or amount status.

    `instances`: id, note, cadence, status, amount_status; words count as whole words only, null notes say nothing."""
    lower = F.lower("note")
    says = lambda w: lower.rlike(f"(?<![a-z0-9_]){w}(?![a-z0-9_])")

    def first(words):
        return F.coalesce(*[F.when(says(w), w) for w in words])

    recorded = lookup(F.lower("cadence"), CADENCE_WORDS, None)
    claimed = F.array_except(F.array_distinct(F.array_compact(F.array(*[F.when(says(w), v) for w, v in CADENCE_WORDS.items()]))), F.array(recorded))
    row = lambda field, said, record: F.struct(F.lit(field).alias("field"), said.alias("note_says"), record.alias("record_says"))
    found = F.concat(
        F.when(recorded.isNotNull(), F.transform(claimed, lambda c: row("cadence", c, recorded))).otherwise(F.array()),
        F.when(F.col("status").isin(*PROJECTABLE), F.array(row("status", first(STOPPED_WORDS), F.col("status")))).otherwise(F.array()),
        F.when(F.col("amount_status") == "confirmed", F.array(row("amount_status", first(GUESS_WORDS), F.col("amount_status")))).otherwise(F.array()),
    )
    return instances.where("coalesce(note, '') <> ''").select("id", F.explode(found).alias("c")).select("id", "c.*").where("note_says is not null")


def backfill(instances: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """obligation_id, due_date, amount: past instances of outflows, by steps back from each obligation's earliest one.

    Dates lie in [as_of - days, as_of); months keep the anchor's day, clamped to their end; other cadences than
    weekly, biweekly, semimonthly (15 days) and monthly give none."""
    day = F.lit(as_of).cast("date")
    since = F.date_sub(day, days)
    first = instances.where("direction = 'outflow'").groupBy("obligation_id").agg(F.min(F.struct("due_date", "id", "amount", "cadence")).alias("t")).select("obligation_id", "t.*")
    step = lookup(F.col("cadence"), {"weekly": 7, "biweekly": 14, "biweekly_estimate": 14, "semimonthly": 15, "monthly": 28}, None)
    rows = first.withColumn("step", step).where(F.col("step").isNotNull() & (F.datediff("due_date", since) >= F.col("step")))
    count = F.floor(F.datediff("due_date", since) / F.col("step")).cast("int")
    back = F.transform(F.sequence(F.lit(1), count), lambda i: F.when(F.col("cadence") == "monthly", F.add_months("due_date", -i)).otherwise(F.date_sub("due_date", i * F.col("step"))))
    return rows.select("obligation_id", "amount", F.explode(back).alias("at")).where((F.col("at") >= since) & (F.col("at") < day)).select("obligation_id", F.col("at").alias("due_date"), "amount")


def unexpected(candidates: DataFrame, obligations: DataFrame) -> DataFrame:
    """account_id, merchant_key, impact, monthly of candidates that no obligation of their account names.

    `obligations`: entity_id, label. A label names a candidate if its slug holds one of the key's words of five
    characters or more."""
    words = F.filter(F.split("merchant_key", "_"), lambda w: (F.length(w) >= 5) & ~w.isin(*text.STOP_TOKENS))
    known = obligations.select("entity_id", text.slug(F.col("label")).alias("slug")).distinct()
    rows = candidates.withColumn("words", words)
    free = rows.join(known, (rows["account_id"] == known["entity_id"]) & F.exists(rows["words"], lambda w: F.contains(known["slug"], w)), "left_anti")
    weight = lookup(F.col("candidate_type"), {k: float(v) for k, v in WEIGHTS.items()}, None)
    return free.select("account_id", "merchant_key", F.col("priority").alias("impact"), (F.col("priority") / weight).alias("monthly"))


def check_suggestions(
    bills: DataFrame, checks: DataFrame, paid: DataFrame, grace: int = 7, amount_abs: str = "2.00", amount_pct: str = "0.025", spoken_for: DataFrame | None = None
) -> DataFrame:
    """suggestion_id, instance_id, transaction_id, score, ambiguous: unmatched bills and the checks that may have paid them.

    `bills`: id, entity_id, obligation_id, due_date, amount; `checks`: id, account_id, posted, amount, description,
    of which those that read like CHECK n count; `paid`: obligation_id, account_id of earlier payments; `spoken_for`
    (transaction_id): checks that are taken, left out of the pairs, which are far fewer than the checks. The join is on entity and
    block of days, a bill being listed under the two or three that it meets. Bills that compete for one check share its last tenth."""
    due = F.col("due_date")
    block = lambda c: F.floor(F.unix_date(c) / (grace + 1))
    read = checks.where(F.col("description").rlike(r"(?i)\bCHECK\s*(?:#\s*)?\d+\b") & (F.col("amount") < 0))
    drawn = read.select(F.col("id").alias("transaction_id"), F.col("account_id").alias("entity_id"), F.col("posted").alias("day"), F.abs("amount").alias("observed"), block(F.col("posted")).alias("block"))
    listed = bills.select("id", "entity_id", "obligation_id", "due_date", "amount", F.explode(F.sequence(block(F.date_sub(due, grace)), block(F.date_add(due, grace)))).alias("block"))
    tol = F.greatest(F.lit(amount_abs).cast(MONEY), F.col("amount") * F.lit(amount_pct).cast("decimal(4,3)"))
    delta = F.abs(F.col("observed") - F.col("amount"))
    apart = F.abs(F.datediff("day", "due_date"))
    pairs = listed.join(drawn, ["entity_id", "block"]).where((apart <= grace) & (delta <= tol))
    if spoken_for is not None:
        pairs = pairs.join(spoken_for, "transaction_id", "left_anti")
    here = paid.select("obligation_id", F.col("account_id").alias("entity_id"), F.lit(0.1).alias("here")).distinct()
    ever = paid.select("obligation_id", F.lit(0.1).alias("ever")).distinct()
    base = F.round(
        0.5 * (1 - delta.cast("double") / tol.cast("double")) + 0.3 * (1 - apart / F.lit(float(grace))) + F.coalesce("here", F.lit(0.0)) + F.coalesce("ever", F.lit(0.0)), 3
    )
    scored = pairs.join(here, ["obligation_id", "entity_id"], "left").join(ever, "obligation_id", "left").select(F.col("id").alias("instance_id"), "transaction_id", base.alias("base"))
    rivals = scored.groupBy("transaction_id").agg(F.count("*").alias("k"))
    return scored.join(rivals, "transaction_id").select(
        F.substring(F.sha2(F.concat(F.col("instance_id").cast("string"), F.lit("\0"), "transaction_id"), 256), 1, 24).alias("suggestion_id"),
        "instance_id", "transaction_id", F.round(0.9 * F.col("base") + 0.1 / F.col("k"), 3).alias("score"), (F.col("k") > 1).alias("ambiguous"),
    )
