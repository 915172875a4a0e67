"""Expected cash flows against observed transactions: scored pairs, claims, shared payments, price changes."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import saved

RECONCILABLE = ("expected", "needs_review", "partially_paid")


@dataclass(frozen=True)
class Options:
    """Tolerances; amounts are absolute and as a share of the expected amount, the larger one holds."""

    window: int = 3
    amount_abs: str = "2.00"
    amount_pct: str = "0.025"
    auto: float = 0.85
    review: float = 0.55
    grace: int = 7
    exact_window: int = 2
    change_pct: str = "0.10"
    change_abs: str = "5.00"


def _tolerance(amount: Column, flat: str, share: str) -> Column:
    return F.greatest(F.lit(flat).cast("decimal(18,2)"), amount * F.lit(share).cast("decimal(4,3)"))


def candidates(instances: DataFrame, transactions: DataFrame, opts: Options = Options()) -> DataFrame:
    """Scored pairs of an instance and a transaction of the same entity and direction within the window.

    The interval becomes an equality: days fall into blocks of window + 1, and an instance is listed under the two or three
    that its interval meets, so the join is a hash or sort-merge join on (entity, direction, block), never a nested loop,
    and skewed entities spread by time. `instances`: id, entity_id, name, due_date, amount, direction. Columns of a pair: instance_id,
    transaction_id, entity_id, due_date, days, delta, amount_score, date_score, merchant_score, score, match_type.
    """
    return _scored(instances, transactions, opts, _within(opts))


def _within(opts: Options) -> Column:
    return F.col("delta") <= _tolerance(F.col("expected"), opts.amount_abs, opts.amount_pct)


def _scored(instances: DataFrame, transactions: DataFrame, opts: Options, kept: Column) -> DataFrame:
    """The pairs of `candidates` that `kept`, a condition on their delta, lets through instead of the tolerance."""
    due = F.col("due_date")
    block = lambda c: F.floor(F.unix_date(c) / (opts.window + 1))
    inst = instances.select(
        F.col("id").alias("instance_id"), "entity_id", "direction", "due_date", F.col("amount").alias("expected"), "name",
        F.explode(F.sequence(block(F.date_sub(due, opts.window)), block(F.date_add(due, opts.window)))).alias("block"),
    )
    txn = transactions.where("posted is not null").select(F.col("id").alias("transaction_id"), "account_id", F.col("posted").alias("day"), F.col("amount").alias("moved"), "payee", "description")
    # Direction and block of a transaction are keys only, so that its rows shuffle without them.
    met = (F.col("entity_id") == F.col("account_id")) & (F.col("direction") == F.when(F.col("moved") < 0, "outflow").otherwise("inflow")) & (F.col("block") == block(F.col("day")))
    days = F.abs(F.datediff("day", "due_date"))
    pairs = inst.join(txn, met).where(days <= opts.window).withColumn("observed", F.abs("moved")).withColumn("delta", F.abs(F.col("observed") - F.col("expected")))
    near = pairs.where(kept)
    scored = near.withColumns(
        {
            "days": F.datediff("day", "due_date"),
            "amount_score": F.when(F.col("delta") <= 0.005, F.lit(1.0)).otherwise(F.lit(0.7)),
            "date_score": F.when(days <= 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - (days - 1) / F.lit(float(max(opts.window, 1))))),
            "merchant_score": F.round(text.similarity(text.tokens(F.col("name")), text.tokens(F.concat_ws(" ", "payee", "description"))), 3),
        }
    ).withColumn("base", F.round(0.5 * F.col("amount_score") + 0.3 * F.col("date_score") + 0.2 * F.col("merchant_score"), 3))
    exact = F.col("delta") < 0.005
    sure = exact & (F.abs("days") <= opts.exact_window)
    score = F.when(sure, F.greatest("base", F.lit(0.9))).otherwise(F.col("base"))
    kind = (
        F.when(sure, "auto")
        .when((F.col("merchant_score") == 0) & ~exact, "below_threshold")
        .when(F.col("base") >= opts.auto, "auto")
        .when(F.col("base") >= opts.review, "needs_review")
        .otherwise("below_threshold")
    )
    return scored.select(
        "instance_id", "transaction_id", "entity_id", "direction", "due_date", "expected", "observed", "days", "delta", "amount_score", "date_score", "merchant_score",
        score.alias("score"), kind.alias("match_type"),
    )


RANK = (F.desc, "score"), (F.asc, "abs_days"), (F.asc, "delta"), (F.asc, "transaction_id")


def best(pairs: DataFrame) -> DataFrame:
    """Each instance's first pair by score, days apart, amount difference and transaction id; claims ignored."""
    order = Window.partitionBy("instance_id").orderBy(*[f(c) for f, c in RANK])
    ranked = pairs.withColumn("abs_days", F.abs("days"))
    return ranked.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r", "abs_days")


def greedy(pairs: DataFrame) -> DataFrame:
    """instance_id, transaction_id, score, match_type: instances claim transactions in (due date, id) order.

    An instance takes the first of its pairs whose transaction no earlier one took; where that pair is below the threshold it
    takes nothing. Done in rounds over the whole table: each instance points at its first pair left, each transaction is held by
    the earliest instance that points at it for a claim, and pairs of later instances with a held transaction go. A holder
    only ever gives way to an earlier one, so a pair that went could never have been claimed, and where no pair
    goes any more the pointers are the claims. Rounds end with the longest chain of give-ways; nothing is gathered. Instances
    none of whose transactions is in another one's pairs need no round.
    """
    mine, its = Window.partitionBy("instance_id"), Window.partitionBy("transaction_id")
    ranked = pairs.withColumn("abs_days", F.abs("days")).select(
        "instance_id", "transaction_id", "score", "match_type", F.struct("due_date", "instance_id").alias("turn"), F.row_number().over(mine.orderBy(*[f(c) for f, c in RANK])).alias("r")
    )
    ranked = saved(ranked.withColumn("n", F.count("*").over(its)).withColumn("contested", F.max("n").over(mine) > 1).drop("n"))
    claim = F.col("match_type") != "below_threshold"
    alone, left = ranked.where("not contested and r = 1"), ranked.where("contested")
    n, before = left.count(), -1
    while n != before:
        first = left.withColumn("first", F.min("r").over(mine))
        held = first.where((F.col("r") == F.col("first")) & claim).groupBy("transaction_id").agg(F.min("turn").alias("holder"))
        left = saved(left.join(held, "transaction_id", "left").where(F.col("holder").isNull() | (F.col("turn") <= F.col("holder"))).select(*ranked.columns))
        n, before = left.count(), n
    settled = left.withColumn("first", F.min("r").over(mine)).where("r = first").drop("first")
    return alone.unionByName(settled).where(claim).select("instance_id", "transaction_id", "score", "match_type")


def unmatched(instances: DataFrame, matches: DataFrame, as_of: str, opts: Options = Options()) -> DataFrame:
    """Due, reconcilable instances without a match: id, entity_id, due_date, age_days, past_grace."""
    day = F.lit(as_of).cast("date")
    late = instances.where(F.col("status").isin(*RECONCILABLE) & (F.col("due_date") <= day))
    age = F.datediff(day, "due_date")
    return late.join(matches.select(F.col("instance_id").alias("id")).distinct(), "id", "left_anti").select(
        "id", "entity_id", "due_date", age.alias("age_days"), (age > opts.grace).alias("past_grace")
    )


def _summing(pool: Column, target: Column, slack: Column) -> Column:
    """The sets of two to four members of `pool` (array of id, cents) whose cents come within the slack of the target."""
    none = F.array(F.struct(F.lit(0).cast("long").alias("cents"), F.array().cast("array<bigint>").alias("ids")))

    def grown(sets, x):
        wider = F.transform(F.filter(sets, lambda s: F.size(s["ids"]) < 4), lambda s: F.struct((s["cents"] + x["cents"]).alias("cents"), F.concat(s["ids"], F.array(x["id"])).alias("ids")))
        return F.concat(sets, wider)

    sets = F.aggregate(pool, none, grown)
    return F.transform(F.filter(sets, lambda s: (F.size(s["ids"]) >= 2) & (F.abs(s["cents"] - target) <= slack)), lambda s: s["ids"])


def shared(instances: DataFrame, transactions: DataFrame, opts: Options = Options()) -> DataFrame:
    """(transaction_id, instance_id): one payment settling a unique set of two to four instances.

    A payment's pool are the instances of its entity, direction and window whose merchant words overlap and that no earlier
    payment (by day, then id) took; pools of fewer than two or, as the search is defined, more than twelve settle nothing.
    Rounds over the whole table: payments without a summing set go at once, since pools only shrink. A payment is decided
    when it is the first left for all of its instances, or when its entity and direction have no earlier one left
    with a pool of twelve or fewer; both mean that its pool is final."""
    return _settling(_scored(instances, transactions, opts, F.lit(True)).where("merchant_score > 0"), opts)


def _settling(pairs: DataFrame, opts: Options) -> DataFrame:
    """`shared` from its pairs: all of the window with merchant words in common, whatever their amounts."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    left = saved(pairs.select(
        "transaction_id", "instance_id", "entity_id", "direction", F.struct(F.date_add("due_date", F.col("days")).alias("day"), "transaction_id").alias("turn"), cents("expected").alias("cents"), cents("observed").alias("target"),
        (_tolerance(F.col("observed"), opts.amount_abs, opts.amount_pct) * 100).alias("slack"),
    ))
    found = []
    while not left.isEmpty():
        pools = left.groupBy("transaction_id", "entity_id", "direction", "turn", "target", "slack").agg(F.count("*").alias("n"), F.collect_list(F.struct(F.col("instance_id").alias("id"), "cents")).alias("pool")).where("n >= 2")
        small = F.col("n") <= 12
        pools = pools.withColumn("sets", F.when(small, _summing(F.col("pool"), F.col("target"), F.col("slack")))).where(~small | (F.size("sets") > 0)).drop("pool", "target", "slack")
        ahead = F.min(F.when(small, F.col("turn"))).over(Window.partitionBy("entity_id", "direction"))
        live = left.join(pools.withColumn("ahead", ahead).select("transaction_id", "n", "sets", "ahead"), "transaction_id")
        first = F.min("turn").over(Window.partitionBy("instance_id"))
        final = F.min((F.col("turn") == F.col("first")) | F.col("ahead").isNull() | (F.col("turn") <= F.col("ahead"))).over(Window.partitionBy("transaction_id"))
        live = saved(live.withColumn("first", first).withColumn("final", final))
        took = live.where("final and size(sets) = 1").select("transaction_id", F.explode(F.col("sets")[0]).alias("instance_id")).distinct()
        found.append(took)
        used = took.select("instance_id")
        left = saved(live.where("not final").join(used, "instance_id", "left_anti").select(*left.columns))
    if not found:
        return left.select("transaction_id", "instance_id")
    return functools.reduce(DataFrame.unionByName, found)


def run(instances: DataFrame, transactions: DataFrame, as_of: str, settled: DataFrame | None = None, history: DataFrame | None = None, opts: Options = Options()) -> DataFrame:
    """The whole reconciliation: one row per due, reconcilable instance with its outcome.

    `instances` also has obligation_id and status, and may have active_until (later instances are left out). `settled`
    (transaction_id): payments that belong to other instances already and found no group. `history` (obligation_id,
    instance_id, due_date, observed, grouped): charges of earlier runs. Shared payments come first, among instances that
    nothing matches alone; then claims in order; a claim at another price than the last cycle's goes to review.
    Columns: instance_id, outcome (auto, needs_review, shared, unmatched), transaction_id, score, amount_changed,
    age_days, past_grace, status (the new one)."""
    day = F.lit(as_of).cast("date")
    due = instances.where(F.col("status").isin(*RECONCILABLE) & (F.col("due_date") <= day))
    if "active_until" in instances.columns:
        due = due.where(F.col("active_until").isNull() | (F.col("due_date") <= F.col("active_until")))
    near = F.coalesce(_within(opts), F.lit(False))
    every = saved(_scored(due, transactions, opts, F.lit(True)).where(near | (F.col("merchant_score") > 0)).withColumn("near", near))
    pairs = every.where("near").drop("near")
    alone = best(pairs).where("match_type <> 'below_threshold'").select(F.col("instance_id").alias("id"))
    free = every.where("merchant_score > 0").join(alone, F.col("instance_id") == F.col("id"), "left_anti")
    if settled is not None:
        free = free.join(settled.select("transaction_id"), "transaction_id", "left_anti")
    groups = saved(_settling(free, opts))
    claims = greedy(pairs.join(groups.select("instance_id"), "instance_id", "left_anti").join(groups.select("transaction_id").distinct(), "transaction_id", "left_anti"))
    found = claims.withColumn("grouped", F.lit(False)).unionByName(groups.select("instance_id", "transaction_id", F.lit(None).cast("double").alias("score"), F.lit("needs_review").alias("match_type"), F.lit(True).alias("grouped")))
    paid = transactions.select(F.col("id").alias("transaction_id"), F.abs("amount").alias("observed"))
    found = saved(found.join(due.select(F.col("id").alias("instance_id"), "obligation_id", "due_date"), "instance_id").join(paid, "transaction_id"))
    charges = found.select("obligation_id", "instance_id", "due_date", "observed", "grouped")
    charged = charges if history is None else charges.unionByName(history.select(*charges.columns))
    moved = price_changes(charged, opts).where("changed").select("instance_id").withColumn("amount_changed", F.lit(True))
    found = found.drop("obligation_id", "due_date", "observed").join(moved, "instance_id", "left").withColumnRenamed("instance_id", "id")
    changed = F.coalesce(F.col("amount_changed") & ~F.col("grouped"), F.lit(False))
    outcome = F.when(F.col("match_type").isNull(), "unmatched").when(F.col("grouped"), "shared").when(changed, "needs_review").otherwise(F.col("match_type"))
    age = F.datediff(day, "due_date")
    late = F.col("match_type").isNull() & (age > opts.grace)
    return due.join(found, "id", "left").select(
        F.col("id").alias("instance_id"), outcome.alias("outcome"), "transaction_id", "score", changed.alias("amount_changed"), age.alias("age_days"), late.alias("past_grace"),
        F.when(outcome == "auto", "paid").when(late & (F.col("status") == "expected"), "needs_review").otherwise(F.col("status")).alias("status"),
    )


def price_changes(matches: DataFrame, opts: Options = Options(), back: int = 12) -> DataFrame:
    """Matches (obligation_id, instance_id, due_date, observed, grouped) with `previous`, the last charge that the
    same obligation paid alone among its `back` cycles before, and `changed`."""
    order = Window.partitionBy("obligation_id").orderBy("due_date", "instance_id").rowsBetween(-back, -1)
    previous = F.last(F.when(~F.col("grouped"), F.col("observed")), ignorenulls=True).over(order)
    rows = matches.withColumn("previous", previous)
    moved = F.abs(F.col("observed") - F.col("previous"))
    changed = F.coalesce((moved > F.lit(opts.change_abs).cast("decimal(18,2)")) & (moved > F.col("previous") * F.lit(opts.change_pct).cast("decimal(4,3)")), F.lit(False))
    return rows.withColumn("changed", changed)


def after_cancellation(cancelled: DataFrame, transactions: DataFrame, spoken_for: DataFrame, opts: Options = Options()) -> DataFrame:
    """Charges that look like a cancelled obligation's last bill and came after it ended.

    `cancelled`: obligation_id, entity_id, name, direction, last_amount, cancelled_on. `spoken_for`: transaction_id.
    The tolerated interval becomes an equality: amounts fall into bands that widen in proportion, and a bill is listed under each
    band that its interval meets, so the join is on entity, direction and band; what no interval can tell apart, amounts up to the
    absolute tolerance, is one band. Dates, amounts and words filter the pairs, and only then those spoken for go, as pairs
    are far fewer than transactions."""
    width = math.log(1 + max(0.05, 2 * float(opts.amount_pct)))
    least = F.lit(max(1.0, float(opts.amount_abs)))
    band = lambda amount: F.floor(F.ln(F.greatest(amount.cast("double"), least)) / width)
    near = _tolerance(F.col("last_amount"), opts.amount_abs, opts.amount_pct)
    last = F.col("last_amount")
    bills = cancelled.where(last.isNotNull()).withColumn("band", F.explode(F.sequence(band(last - near), band(last + near))))
    txn = transactions.select(F.col("id").alias("transaction_id"), "account_id", "posted", F.col("amount").alias("moved"), "payee", "description")
    met = (F.col("entity_id") == F.col("account_id")) & (F.col("direction") == F.when(F.col("moved") < 0, "outflow").otherwise("inflow")) & (F.col("band") == band(F.abs("moved")))
    pairs = bills.join(txn, met).withColumn("observed", F.abs("moved")).where(
        (F.col("posted") > F.col("cancelled_on"))
        & (F.abs(F.col("observed") - F.col("last_amount")) <= _tolerance(F.col("last_amount"), opts.amount_abs, opts.amount_pct))
        & (text.similarity(text.tokens(F.col("name")), text.tokens(F.concat_ws(" ", "payee", "description"))) > 0)
    ).select("obligation_id", "transaction_id", "entity_id", "posted", "observed", "cancelled_on")
    return pairs.join(spoken_for.select("transaction_id"), "transaction_id", "left_anti").select("obligation_id", "transaction_id", "entity_id", "posted", "observed", "cancelled_on")
