"""Recurring charges: group statistics, cadence, amount policy, confidence, priority and triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text

#: How much each type of candidate counts for its priority.
WEIGHTS = {
    "direct_checking_outflow": "1.0", "card_statement_input": "0.9", "inflow": "0.7", "variable_spend": "0.3", "review_only": "0.2", "internal_transfer": "0.1",
}
#: Classes of accounts whose charges are paid directly.
CHECKING = ("checking", "savings")
REGULAR = ("weekly", "biweekly", "monthly", "quarterly")


def bucket(gap: Column) -> Column:
    """Cadence by days between charges."""
    return (
        F.when(gap.isNull() | (gap < 4), "unknown").when(gap <= 10, "weekly").when(gap <= 18, "biweekly").when(gap <= 37, "monthly")
        .when(gap <= 75, "irregular_multiweek").when(gap <= 100, "quarterly").otherwise("irregular")
    )


def statistics(transactions: DataFrame, accounts: DataFrame, min_n: int = 2, with_inflows: bool = False) -> DataFrame:
    """One row per (account, merchant key, class, direction): n, mean, median_amount, low, high, cv, median_gap,
    months_covered, span_months (calendar months from the first to the last), recent (the last three amounts), gaps, first_date, last_date,
    usage_said (whether a description names usage), typical_day and day_spread (of the month), display_name (the most frequent payee).

    Gaps come from one window; it and the aggregation share the partitioning on the group's key, so the rows
    are shuffled once. The window counts the charges too: most groups have fewer than `min_n`, and go before they are aggregated."""
    rows = transactions.where("coalesce(payee, '') <> '' and amount <> 0 and posted is not null").join(
        accounts.select("account_id", F.col("kind").alias("class")), "account_id"
    )
    rows = rows.select(
        "account_id", "id", "posted", "class", F.abs("amount").alias("paid"), text.slug(F.col("payee")).alias("merchant_key"),
        F.when(F.col("amount") < 0, "outflow").otherwise("inflow").alias("direction"), "payee", text.is_usage(text.slug(F.col("description"))).alias("usage_said"),
    )
    if not with_inflows:
        rows = rows.where("direction = 'outflow'")
    keys = ["account_id", "merchant_key", "class", "direction"]
    order = Window.partitionBy(*keys).orderBy("posted", "id")
    gap = F.datediff("posted", F.lag("posted").over(order))
    charges = F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = F.col("paid").cast("double")
    stats = rows.withColumns({"gap": gap, "charges": charges}).where(F.col("charges") >= min_n).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(d).alias("mean"),
        F.median(d).alias("median_amount"),
        F.min("paid").alias("low"),
        F.max("paid").alias("high"),
        F.stddev_pop(d).alias("deviation"),
        F.median("gap").alias("median_gap"),
        F.collect_list("gap").alias("gaps"),
        F.transform(F.slice(F.sort_array(F.collect_list(F.struct("posted", "id", "paid")), asc=False), 1, 3), lambda s: s["paid"]).alias("recent"),
        F.min("posted").alias("first_date"),
        F.max("posted").alias("last_date"),
        F.bool_or("usage_said").alias("usage_said"),
        F.bround(F.median(F.day("posted").cast("double")), 0).cast("int").alias("typical_day"),
        (F.max(F.day("posted")) - F.min(F.day("posted"))).alias("day_spread"),
        F.mode("payee", True).alias("display_name"),
    )
    return stats.withColumns(
        {
            "cv": F.when(F.col("mean") > 0, F.col("deviation") / F.col("mean")).otherwise(F.lit(0.0)),
            "span_months": (F.year("last_date") - F.year("first_date")) * 12 + F.month("last_date") - F.month("first_date") + 1,
            "months_covered": (F.bround(F.datediff("last_date", "first_date") / F.lit(30.44), 0) + 1).cast("long"),
        }
    )


def candidates(stats: DataFrame, usage: Column | None = None) -> DataFrame:
    """Statistics with cadence, method, amount, confidence, candidate_type and priority."""
    usage = text.is_usage(F.col("merchant_key")) | F.col("usage_said") if usage is None else usage
    label = bucket(F.col("median_gap"))
    agreeing = F.size(F.filter("gaps", lambda g: bucket(g.cast("double")) == label))
    cadence = F.when(label.isin("irregular", "irregular_multiweek") | (agreeing >= 3), label).otherwise("unknown")
    r = F.col("recent")
    stable = (F.size(r) >= 2) & (F.array_max(r) - F.array_min(r) <= F.greatest(F.lit(0.01), F.array_max(r).cast("double") * 0.01))
    checking, card, cv = F.col("class").isin(*CHECKING), F.col("class") == "card", F.col("cv")
    out = F.col("direction") != "inflow"
    method = (
        F.when(out & card & usage, "seasonal_card_spend").when(out & checking & usage & (cv > 0.08), "seasonal_multiplier").when(stable, "fixed_last")
        .when(cv <= 0.05, "fixed").when(cv <= 0.20, "average").otherwise("needs_review")
    )
    c = stats.withColumns({"cadence": cadence, "method": method})
    amount = F.when(F.col("method") == "fixed_last", F.element_at("recent", 1).cast("double")).when(F.col("method") == "needs_review", F.col("median_amount")).otherwise(F.col("mean"))
    n, months = F.col("n"), F.col("months_covered")
    regular = F.col("cadence").isin("weekly", "biweekly", "monthly")
    confidence = (
        F.when(n <= 1, "very_low").when((n >= 4) & (months >= 4) & regular & (cv <= 0.10), "high")
        .when((n >= 3) & (months >= 3) & (regular | (F.col("cadence") == "irregular_multiweek")), "medium").otherwise("low")
    )
    kind = (
        F.when(F.col("direction") == "inflow", "inflow").when(text.is_internal(F.col("merchant_key")), "internal_transfer")
        .when((F.col("method") == "needs_review") & ~usage, "variable_spend").when(F.col("class") == "card", "card_statement_input")
        .when(checking, "direct_checking_outflow").otherwise("review_only")
    )
    c = c.withColumns({"amount": amount, "confidence": confidence, "candidate_type": kind})
    weight = None
    for k, v in WEIGHTS.items():
        weight = F.when(F.col("candidate_type") == k, float(v)) if weight is None else weight.when(F.col("candidate_type") == k, float(v))
    return c.withColumn("priority", F.col("amount") * n / F.greatest("span_months", F.lit(1)) * weight)


#: What peak months take of a usage-driven amount, and what is known to be missing, in the order in which it is said.
PEAK = 1.5
GAPS = ("few_charges", "seasonal_under_a_year", "amounts_vary", "statement_cycle_unknown", "timing_lumpy")


def policies(c: DataFrame) -> DataFrame:
    """What to propose for candidates: treatment, schedule (typical_day, day_spread, next_date), amount (policy, proposed, summer and
    winter multipliers of usage-driven ones), missing evidence in fixed order and the reasons for a review, as comma-joined names.

    An expression a row; the window and the aggregation of statistics() are all that moves."""
    seasonal = F.col("method").isin("seasonal_card_spend", "seasonal_multiplier")
    treatment = F.when(F.col("direction") == "inflow", "inflow").when(F.col("class") == "card", "card_statement_input").when(F.col("class").isin(*CHECKING), "direct_checking").otherwise("review_only")
    peak = F.when(seasonal, F.lit(PEAK))
    holds = (
        F.col("n") < 4, seasonal & (F.col("months_covered") < 12), F.col("cv") > 0.20, F.col("treatment") == "card_statement_input",
        F.col("cadence").isin("irregular", "irregular_multiweek", "unknown"),
    )
    missing = F.concat_ws(",", *[F.when(h, name) for h, name in zip(holds, GAPS, strict=True)])
    flagged = F.when(F.col("candidate_type").isin("card_statement_input", "internal_transfer", "variable_spend"), F.col("candidate_type"))
    reasons = F.concat_ws(",", F.when(F.col("confidence").isin("low", "very_low"), F.concat(F.lit("confidence_"), F.col("confidence"))), flagged, F.when(F.col("missing") != "", "evidence_missing"))
    rows = c.withColumn("treatment", treatment).withColumn("missing", missing)
    return rows.select(
        "account_id", "merchant_key", "class", "direction", "display_name", "treatment", "candidate_type", "cadence", "confidence", "typical_day", "day_spread",
        F.date_add("last_date", F.bround("median_gap", 0).cast("int")).alias("next_date"), F.when(F.col("method") == "fixed_last", "fixed").otherwise(F.col("method")).alias("policy"),
        F.round(F.col("amount").cast("decimal(28,10)"), 2).cast("decimal(18,2)").alias("proposed"), peak.alias("summer_multiplier"), peak.alias("winter_multiplier"), "missing", reasons.alias("reasons"),
    )


def triage(c: DataFrame, reject_floor: float = 75.0) -> DataFrame:
    """Candidates with `disposition`: surface, park or auto_reject."""
    regular = F.col("cadence").isin(*REGULAR)
    irregular = ~regular
    guard = F.when(F.col("priority") > reject_floor, "park").otherwise("auto_reject")
    kind = F.col("candidate_type")
    return c.withColumn(
        "disposition",
        F.when(F.col("n") < 2, guard)
        .when((F.col("months_covered") < 2) & irregular, guard)
        .when(kind == "internal_transfer", "park")
        .when((kind == "variable_spend") & irregular & F.col("confidence").isin("low", "very_low"), guard)
        .when((kind == "variable_spend") & regular, "park")
        .when(kind == "review_only", "park")
        .otherwise("surface"),
    )


def schedule(c: DataFrame, horizon: int = 180) -> DataFrame:
    """Dated instances of candidates: their last charge is the anchor, the horizon's end is not included."""
    anchor = F.col("last_date")
    days = dates.due_dates(F.col("cadence"), anchor, F.date_add(anchor, horizon), F.col("median_gap"))
    return c.select("account_id", "merchant_key", "cadence", "amount", F.explode(days).alias("due_date"))
