"""Statement cycles with their inputs' confidence, guarded recomputation of statement estimates, and observed amounts."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sources of amounts that no estimate may replace, and the source of a recomputed one.
PROTECTED = ("portal_current_balance_estimate", "portal_statement_amount", "statement_known", "statement_amount", "actual", "observed")
ROLLUP = "statement_input_rollup"
MONEY = "decimal(18,2)"
#: Kinds of statements after a recomputation.
UPDATED, CONFIRMED, GUARDED, NO_CYCLE, FLOORED = "updated", "confirmed", "protected", "no_cycle", "floored"


def cycles(statements: DataFrame, inputs: DataFrame) -> DataFrame:
    """cycle_id, n_inputs, input_sum, confidence of every statement (id, target, closes): what is due in its cycle.

    `inputs`: id, target, due_date, amount, confidence. An input belongs to the first statement of its target that closes
    on or after its date; of statements that close on one day, to the one of the smallest id. The confidence is the
    lowest known one, very_low counting as low; null if none is known. One window per target instead of a range join."""
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    lines = inputs.where("target is not null").select("target", F.col("due_date").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("cycle_id"), F.abs("amount").cast(MONEY).alias("amount"), F.when(F.col("confidence").isNotNull(), rank).alias("rank"))
    marks = statements.select("target", F.col("closes").alias("at"), F.lit(1).alias("kind"), F.col("id").alias("cycle_id"), F.lit(None).cast(MONEY).alias("amount"), F.lit(None).cast("int").alias("rank"))
    onward = Window.partitionBy("target").orderBy("at", "kind", "cycle_id").rowsBetween(0, Window.unboundedFollowing)
    placed = marks.unionByName(lines).withColumn("cycle_id", F.first("cycle_id", ignorenulls=True).over(onward)).where("cycle_id is not null")
    low = F.min("rank")
    return placed.groupBy("cycle_id").agg(
        F.count("amount").alias("n_inputs"), F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY).alias("input_sum"), F.when(low == 3, "high").when(low == 2, "medium").when(low == 1, "low").alias("confidence")
    )


def recompute(statements: DataFrame, sums: DataFrame, baseline: str | None = None) -> DataFrame:
    """`statements` with estimates that their cycles' inputs improve, and `action` for each row.

    `statements`: id, amount, amount_status, amount_source, baseline (what an earlier recomputation took as not modeled),
    confidence; further columns stay. `sums`: see cycles(). Confirmed rows, rows of a protected source and rows without
    cycle stay. The new amount is the baseline and the inputs: the given baseline, else the stored one of an earlier
    recomputation, else what the amount holds beyond the inputs. Without a given baseline no estimate drops: such a
    row stays as it is. Doing it again changes nothing."""
    s = sums.select(F.col("cycle_id").alias("_c"), F.col("input_sum").alias("_sum"), F.col("confidence").alias("_conf"))
    rows = statements.join(s, F.col("id") == F.col("_c"), "left")
    held = F.coalesce(F.abs("amount"), F.lit(0)).cast(MONEY)
    kept = F.when(F.col("amount_source") == ROLLUP, F.col("baseline"))
    own = F.coalesce(kept, F.greatest(held - F.col("_sum"), F.lit(0))).cast(MONEY)
    base = own if baseline is None else F.lit(baseline).cast(MONEY)
    new = (base + F.col("_sum")).cast(MONEY)
    action = (
        F.when(~F.col("amount_status").eqNullSafe("estimated"), CONFIRMED).when(F.coalesce(F.col("amount_source").isin(*PROTECTED), F.lit(False)), GUARDED)
        .when(F.col("_c").isNull(), NO_CYCLE).when(F.lit(baseline is None) & (new < held), FLOORED).otherwise(UPDATED)
    )
    rows = rows.withColumn("_action", action)
    hit = F.col("_action") == UPDATED
    values = {"amount": new, "amount_source": F.lit(ROLLUP), "baseline": base, "confidence": F.coalesce("_conf", F.lit("low"))}
    return rows.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in statements.columns], F.col("_action").alias("action"))


def observed(statements: DataFrame, actuals: DataFrame) -> DataFrame:
    """actual_id, statement_id, outcome of observed amounts: set, unknown (no statement), ambiguous (several) or unnamed.

    `statements`: id, target, closes, due_date. `actuals`: actual_id, target, closes, due_date; either date may be null,
    the other ones must fit. Three equality joins, one for each way of naming a statement."""
    ways = []
    for given in (("closes", "due_date"), ("closes",), ("due_date",)):
        absent = [c for c in ("closes", "due_date") if c not in given]
        asked = actuals
        for c in given:
            asked = asked.where(F.col(c).isNotNull())
        for c in absent:
            asked = asked.where(F.col(c).isNull())
        side = asked.select("actual_id", *[F.col(c).alias(f"_{c}") for c in ("target", *given)])
        same = functools.reduce(lambda a, c: a & (F.col(c) == F.col(f"_{c}")), given, F.col("target") == F.col("_target"))
        ways.append(statements.join(side, same).select("actual_id", F.col("id").alias("statement_id")))
    met = functools.reduce(DataFrame.unionByName, ways).groupBy("actual_id").agg(F.count("*").alias("_n"), F.min("statement_id").alias("statement_id"))
    unnamed = F.col("closes").isNull() & F.col("due_date").isNull()
    outcome = F.when(unnamed, "unnamed").when(F.col("_n").isNull(), "unknown").when(F.col("_n") > 1, "ambiguous").otherwise("set")
    return actuals.join(met, "actual_id", "left").select("actual_id", F.when(outcome == "set", F.col("statement_id")).alias("statement_id"), outcome.alias("outcome"))


def set_actual(statements: DataFrame, actuals: DataFrame) -> DataFrame:
    """`statements` with the observed amounts of `actuals` (as in observed(), with amount, source and note), confirmed.

    Of several that name one statement the one of the largest actual_id counts. What is unknown, ambiguous or unnamed
    changes nothing. A null note leaves the row's own."""
    found = observed(statements, actuals).where("outcome = 'set'").select("actual_id", "statement_id")
    last = actuals.join(found, "actual_id").groupBy("statement_id").agg(F.max_by(F.struct("amount", "source", "note"), "actual_id").alias("_a"))
    rows = statements.join(last, F.col("id") == F.col("statement_id"), "left")
    hit = F.col("_a").isNotNull()
    values = {"amount": F.abs("_a.amount").cast(MONEY), "amount_status": F.lit("confirmed"), "amount_source": F.col("_a.source"), "confidence": F.lit("high"), "notes": F.coalesce("_a.note", "notes")}
    return rows.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in statements.columns])
