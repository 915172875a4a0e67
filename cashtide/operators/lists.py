"""Lists for a reader: filtered, ordered and paged rows of stored findings, matches, notes, facts and statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import cycles, placed
from .ledger import page


def listed(rows: DataFrame, order: list[Column], equal: dict | None = None, least: dict | None = None, most: dict | None = None, limit: int = -1, offset: int = 0) -> DataFrame:
    """A page of the rows that pass the filters, in order; a filter whose value is None does not filter.

    `equal`, `least` and `most` map columns to values; a null in a filtered column does not pass."""
    keep = F.lit(True)
    for wanted, test in ((equal, lambda c, v: c == v), (least, lambda c, v: c >= v), (most, lambda c, v: c <= v)):
        for name, value in (wanted or {}).items():
            if value is not None:
                keep = keep & test(F.col(name), F.lit(value))
    return page(rows.where(keep), order, limit, offset)


def matched(matches: DataFrame, instances: DataFrame, match_type: str | None = None, limit: int = -1, offset: int = 0) -> DataFrame:
    """Matches (instance_id, transaction_id, score, match_type, delta, days) with their instance, surest and earliest first."""
    rows = matches.select("instance_id", "transaction_id", "score", "match_type", "delta", "days").join(instances.select(F.col("id").alias("instance_id"), "obligation_id", "due_date", "amount", "status"), "instance_id")
    return listed(rows, [F.desc("score"), F.asc("due_date"), F.asc("instance_id")], {"match_type": match_type}, limit=limit, offset=offset)


def unmatched_late(unmatched: DataFrame, instances: DataFrame, past_grace_only: bool = False, limit: int = -1, offset: int = 0) -> DataFrame:
    """Unmatched instances (id, age_days, past_grace) with what they are: those past grace first, then the oldest."""
    rows = unmatched.select("id", "age_days", "past_grace").join(instances.select("id", "obligation_id", "due_date", "amount", "direction", "status"), "id")
    return listed(rows, [F.desc("past_grace"), F.desc("age_days"), F.asc("due_date"), F.asc("id")], {"past_grace": True if past_grace_only else None}, limit=limit, offset=offset)


def recently_cleared(matches: DataFrame, instances: DataFrame, transactions: DataFrame, as_of: str, lookback: int = 30) -> DataFrame:
    """Instances due in the `lookback` days up to `as_of` that a sure match cleared, with the payment: posted, paid."""
    day = F.lit(as_of).cast("date")
    due = instances.where(F.col("due_date").between(F.date_sub(day, lookback), day)).select(F.col("id").alias("instance_id"), "obligation_id", "due_date", "amount", "direction")
    paid = transactions.select(F.col("id").alias("transaction_id"), "posted", F.col("amount").alias("paid"))
    return due.join(matches.where("match_type = 'auto'").select("instance_id", "transaction_id", "score"), "instance_id").join(paid, "transaction_id", "left")


def statement_list(inputs: DataFrame, statements: DataFrame) -> DataFrame:
    """target, cycle_id, opens, closes and `inputs`, the cycle's inputs (at, input_id, amount) by date; empty where it has none.

    A cycle's list is one row, as long as one statement."""
    lines = placed(inputs, statements).where("order = 0 and cycle is not null")
    own = lines.groupBy(F.col("cycle").alias("cycle_id")).agg(F.array_sort(F.collect_list(F.struct("at", "input_id", "amount"))).alias("inputs"))
    rows = cycles(statements).join(own, "cycle_id", "left")
    return rows.withColumn("inputs", F.coalesce("inputs", F.filter(F.array(F.struct(F.col("closes").alias("at"), F.col("cycle_id").alias("input_id"), F.lit(0).cast("decimal(18,2)").alias("amount"))), lambda x: F.lit(False))))


def closures(facts: DataFrame, start: str, through: str) -> DataFrame:
    """The days of active business closures in the range, once each."""
    inside = listed(facts, [F.asc("fact_date")], {"fact_type": "business_closure", "status": "active"}, {"fact_date": start}, {"fact_date": through})
    return inside.select(F.col("fact_date").alias("day")).distinct()
