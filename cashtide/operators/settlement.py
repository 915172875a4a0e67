"""What a reconciliation leaves behind: the ledgers of matched and unmatched instances, and a person's decisions on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ledger

MATCH = ("instance_id", "transaction_id", "match_type", "score", "as_of", "created_on")
UNMATCHED = ("instance_id", "obligation_id", "due_date", "age_days", "past_grace", "as_of", "created_on")
#: Score of a match that a person asserts.
ASSERTED = 1.0


def _merge(stored: DataFrame, mine: DataFrame, others: DataFrame, as_of: str) -> DataFrame:
    """`stored` with the rows of `mine`, without the instances of `others`; a row keeps the day it was created."""
    day = F.lit(as_of).cast("date")
    changes = mine.withColumns({"as_of": day, "created_on": day}).select(*stored.columns)
    kept = [c for c in stored.columns if c not in ("instance_id", "created_on")]
    gone = others.select(F.col("instance_id").alias("_g")).distinct()
    return ledger.upsert(stored, changes, ["instance_id"], refresh=kept).join(gone, F.col("instance_id") == F.col("_g"), "left_anti")


def matches_after(stored: DataFrame, outcomes: DataFrame, as_of: str) -> DataFrame:
    """The match ledger (MATCH) after a run: its matches are written, what it could not match loses an earlier match, and
    instances that it did not look at stay. A shared payment waits for review. `outcomes`: rows of reconcile.run()."""
    hit = F.col("outcome") != "unmatched"
    kind = F.when(F.col("outcome") == "shared", "needs_review").otherwise(F.col("outcome"))
    return _merge(stored, outcomes.where(hit).withColumn("match_type", kind), outcomes.where(~hit), as_of)


def unmatched_after(stored: DataFrame, outcomes: DataFrame, instances: DataFrame, as_of: str) -> DataFrame:
    """The ledger of unmatched instances (UNMATCHED) after a run, the counterpart of matches_after(). `instances`: id,
    obligation_id, due_date."""
    hit = F.col("outcome") != "unmatched"
    bills = instances.select(F.col("id").alias("instance_id"), "obligation_id", "due_date")
    return _merge(stored, outcomes.where(~hit).join(bills, "instance_id"), outcomes.where(hit), as_of)


def decided(instances: DataFrame, matches: DataFrame, transactions: DataFrame, decisions: DataFrame) -> DataFrame:
    """decision_id, instance_id, outcome, transaction_id, score of every decision, taken in the order of decision_id.

    `decisions`: decision_id, instance_id, kind (confirm, force, unconfirm), transaction_id. Confirming needs a recorded
    match (`matches`: instance_id, transaction_id, score), or one that an earlier decision forced; a forced one replaces
    the recorded one for good, its transaction has to exist. Outcomes: paid, expected (unconfirmed), no_match,
    unknown_instance, unknown_transaction, unknown_kind. Decisions of one instance meet in one ordered window; no two
    instances depend on each other."""
    known = instances.select(F.col("id").alias("_i")).distinct()
    paid_by = transactions.select(F.col("id").alias("_t")).distinct()
    recorded = matches.groupBy(F.col("instance_id").alias("_m")).agg(F.max(F.struct("score", F.col("transaction_id").alias("t"))).alias("_r"))
    rows = decisions.join(known, F.col("instance_id") == F.col("_i"), "left").join(paid_by, F.col("transaction_id") == F.col("_t"), "left").join(recorded, F.col("instance_id") == F.col("_m"), "left")
    forced = (F.col("kind") == "force") & F.col("_i").isNotNull() & F.col("_t").isNotNull()
    so_far = Window.partitionBy("instance_id").orderBy("decision_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_f", F.last(F.when(forced, F.col("_t")), ignorenulls=True).over(so_far))
    using = F.coalesce("_f", "_r.t")
    outcome = (
        F.when(F.col("_i").isNull(), "unknown_instance").when(F.col("kind") == "unconfirm", "expected").when((F.col("kind") == "force") & F.col("_t").isNull(), "unknown_transaction")
        .when(~F.coalesce(F.col("kind").isin("confirm", "force"), F.lit(False)), "unknown_kind").when(using.isNull(), "no_match").otherwise("paid")
    )
    rows = rows.withColumn("outcome", outcome)
    paid = F.col("outcome") == "paid"
    return rows.select("decision_id", "instance_id", "outcome", F.when(paid, using).alias("transaction_id"), F.when(paid, F.when(F.col("_f").isNotNull(), F.lit(ASSERTED)).otherwise(F.col("_r.score"))).alias("score"))


def settled(instances: DataFrame, results: DataFrame) -> DataFrame:
    """`instances` (id, status, matched_transaction_id, match_confidence and more) after the last effective one of their
    decisions: paid with its transaction, or expected again without one. Others stay."""
    last = results.where(F.col("outcome").isin("paid", "expected")).groupBy("instance_id").agg(F.max_by(F.struct("outcome", "transaction_id", "score"), "decision_id").alias("_d"))
    rows = instances.join(last.withColumnRenamed("instance_id", "_l"), F.col("id") == F.col("_l"), "left")
    hit = F.col("_d").isNotNull()
    values = {"status": F.col("_d.outcome"), "matched_transaction_id": F.col("_d.transaction_id"), "match_confidence": F.col("_d.score")}
    return rows.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in instances.columns])
