"""Running-balance projections with trough detection."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTABLE = ("expected", "needs_review", "partially_paid")
#: What discretionary payments must leave in the account.
FLOOR = 2500


def signed(amount, direction):
    return F.when(direction == "inflow", amount).otherwise(-amount)


def events(instances: DataFrame, start: str, days: int, matched: DataFrame | None = None) -> DataFrame:
    """Projectable instances due in [start, start + days) with their place, `seq`, per entity.

    With `matched` (id), past-due instances without a match are carried first, dated `start`."""
    first = F.lit(start).cast("date")
    rows = instances.where(F.col("status").isin(*PROJECTABLE))
    inside = rows.where((F.col("due_date") >= first) & (F.col("due_date") < F.date_add(first, days))).withColumn("on_date", F.col("due_date")).withColumn("carried", F.lit(False))
    if matched is not None:
        inside = inside.unionByName(past_due(rows, start, matched).withColumn("on_date", first).withColumn("carried", F.lit(True)))
    order = Window.partitionBy("entity_id").orderBy(F.desc("carried"), "due_date", "id")
    return inside.withColumn("signed", signed(F.col("amount"), F.col("direction"))).withColumn("seq", F.row_number().over(order))


def past_due(instances: DataFrame, before: str, matched: DataFrame) -> DataFrame:
    """Projectable instances due before a date that nothing has settled."""
    late = instances.where(F.col("status").isin(*PROJECTABLE) & (F.col("due_date") < F.lit(before).cast("date")))
    return late.join(matched.select("id"), "id", "left_anti")


def running(event_rows: DataFrame, balances: DataFrame) -> DataFrame:
    """Events with `balance` after each one. `balances`: entity_id, starting."""
    so_far = Window.partitionBy("entity_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return event_rows.join(balances, "entity_id").withColumn("balance", F.col("starting") + F.sum("signed").over(so_far))


def trough(event_rows: DataFrame, balances: DataFrame, start: str) -> DataFrame:
    """entity_id, starting, ending, low, low_date, n_events of every entity of `balances`.

    low is the first strict minimum; where no event goes below the starting balance it is that, at `start`."""
    r = running(event_rows, balances)
    per = r.groupBy("entity_id").agg(
        F.max_by("balance", "seq").alias("ending"),
        F.min(F.struct("balance", "seq", "on_date")).alias("m"),
        F.count("*").alias("n_events"),
    )
    below = F.coalesce(F.col("m.balance") < F.col("starting"), F.lit(False))
    return balances.join(per, "entity_id", "left").select(
        "entity_id",
        "starting",
        F.coalesce("ending", "starting").alias("ending"),
        F.when(below, F.col("m.balance")).otherwise(F.col("starting")).alias("low"),
        F.when(below, F.col("m.on_date")).otherwise(F.lit(start).cast("date")).alias("low_date"),
        F.coalesce("n_events", F.lit(0)).alias("n_events"),
    )


def capped_trough(event_rows: DataFrame, balances: DataFrame, start: str, floor: int = FLOOR) -> DataFrame:
    """Like trough(), but a discretionary outflow pays its required minimum and beyond that only what leaves `floor`.

    The amount depends on the balance before it, so each entity's ordered events are folded; the fold is one
    JVM expression. An entity's events within the horizon must fit one row."""
    money = "decimal(18,2)"
    item = F.struct("seq", "on_date", "amount", "direction", "discretionary", "required_minimum")
    lists = event_rows.groupBy("entity_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    rows = balances.join(lists, "entity_id", "left")

    def step(acc, x):
        required = F.least(x["amount"], F.greatest(x["required_minimum"], F.lit(0).cast(money)))
        room = F.greatest(acc["balance"] - required - F.lit(floor).cast(money), F.lit(0).cast(money))
        paid = F.when(
            x["discretionary"] & (x["direction"] == "outflow"), required + F.least(x["amount"] - required, room)
        ).otherwise(x["amount"])
        after = (acc["balance"] + signed(paid, x["direction"])).cast(money)
        lower = after < acc["low"]
        return F.struct(
            after.alias("balance"),
            F.when(lower, after).otherwise(acc["low"]).cast(money).alias("low"),
            F.when(lower, x["on_date"]).otherwise(acc["low_date"]).alias("low_date"),
        )

    begin = F.struct(
        F.col("starting").cast(money).alias("balance"), F.col("starting").cast(money).alias("low"), F.lit(start).cast("date").alias("low_date")
    )
    none = F.array().cast(f"array<struct<seq:int,on_date:date,amount:{money},direction:string,discretionary:boolean,required_minimum:{money}>>")
    end = F.aggregate(F.coalesce("items", none), begin, step)
    return rows.withColumn("end", end).select(
        "entity_id", "starting", F.col("end.balance").alias("ending"), F.col("end.low").alias("low"), F.col("end.low_date").alias("low_date")
    )


def roll_forward(instances: DataFrame, snapshots: DataFrame, start: str) -> DataFrame:
    """entity_id, starting: a snapshot (entity_id, balance, snapshot_date) moved by what was due strictly between."""
    due = instances.where(F.col("status").isin(*PROJECTABLE) & (F.col("due_date") < F.lit(start).cast("date")))
    moved = (
        due.join(snapshots, "entity_id")
        .where(F.col("due_date") > F.col("snapshot_date"))
        .groupBy("entity_id")
        .agg(F.sum(signed(F.col("amount"), F.col("direction"))).alias("moved"))
    )
    return snapshots.join(moved, "entity_id", "left").select("entity_id", (F.col("balance") + F.coalesce("moved", F.lit(0))).alias("starting"))


def band(event_rows: DataFrame, troughs: DataFrame, floor: int = FLOOR) -> DataFrame:
    """entity_id, low, downside, breach: what poorly known outflows up to the trough could add to it.

    An estimated outflow's downside is its amount times 0.35 (no or very low confidence) or 0.20 (low)."""
    share = F.when(F.col("confidence") == "low", F.lit("0.20").cast("decimal(3,2)")).otherwise(F.lit("0.35").cast("decimal(3,2)"))
    weak = event_rows.where(
        (F.col("direction") == "outflow") & (F.col("amount_status") == "estimated") & (F.coalesce("confidence", F.lit("very_low")).isin("very_low", "low"))
    )
    add = (
        weak.join(troughs.select("entity_id", "low_date"), "entity_id")
        .where(F.col("due_date") <= F.col("low_date"))
        .groupBy("entity_id")
        .agg(F.sum(F.round(F.col("amount") * share, 2)).alias("downside"))
    )
    return troughs.join(add, "entity_id", "left").select(
        "entity_id", "low", F.coalesce("downside", F.lit(0)).cast("decimal(18,2)").alias("downside"), (F.col("low") - F.coalesce("downside", F.lit(0)) < floor).alias("breach")
    )


def windows(instances: DataFrame, snapshots: DataFrame, matched: DataFrame, start: str, days: tuple[int, ...], floor: int = FLOOR) -> DataFrame:
    """entity_id, window_days, starting, ending, low, low_date, n_carried, n_events: several nested windows in one ordered
    pass over each entity's events.

    `snapshots`: entity_id, balance, snapshot_date. An observation from before `start` is first moved by what was due
    strictly between; then come past-due instances that nothing has settled, due by the observation's day (or before
    `start`, if it is not older), dated `start`; then what is due in the windows. Discretionary outflows are capped
    by `floor` throughout, also while moving. An entity's events up to the longest window must fit one row; entities
    without events keep their balance."""
    first, money = F.lit(start).cast("date"), "decimal(18,2)"
    held = snapshots.select(F.col("entity_id").alias("_e"), "snapshot_date")
    older = F.coalesce(F.col("snapshot_date") < first, F.lit(False))
    rows = instances.where(F.col("status").isin(*PROJECTABLE) & (F.col("due_date") < F.date_add(first, max(days)))).join(held, F.col("entity_id") == F.col("_e"))
    late = rows.where(F.when(older, F.col("due_date") <= F.col("snapshot_date")).otherwise(F.col("due_date") < first))
    late = late.join(matched.select("id"), "id", "left_anti").withColumn("phase", F.lit(1))
    moved = rows.where(older & (F.col("due_date") > F.col("snapshot_date")) & (F.col("due_date") < first)).withColumn("phase", F.lit(0))
    ahead = rows.where(F.col("due_date") >= first).withColumn("phase", F.lit(2))
    item = F.struct("phase", "due_date", "id", "amount", "direction", "discretionary", "required_minimum")
    lists = functools.reduce(DataFrame.unionByName, (moved, late, ahead)).groupBy("entity_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    balance, zero = F.col("balance").cast(money), F.lit(0).cast(money)

    def after(now, x):
        required = F.least(x["amount"], F.greatest(x["required_minimum"], zero))
        room = F.greatest(now - required - F.lit(floor).cast(money), zero)
        paid = F.when(x["discretionary"] & (x["direction"] == "outflow"), required + F.least(x["amount"] - required, room)).otherwise(x["amount"])
        return (now + signed(paid, x["direction"])).cast(money)

    def step(acc, x):
        now = after(acc["balance"], x)
        inside = [(x["phase"] < 2) | (F.datediff(x["due_date"], first) < n) for n in days]
        on = F.when(x["phase"] < 2, first).otherwise(x["due_date"])
        ends = []
        for n, hit in zip(days, inside, strict=True):
            w = acc[f"w{n}"]
            lower = hit & (x["phase"] > 0) & (now < w["low"])
            low = F.when(x["phase"] == 0, now).when(lower, now).otherwise(w["low"]).cast(money)
            ends.append(
                F.struct(
                    F.when(hit, now).otherwise(w["ending"]).cast(money).alias("ending"), low.alias("low"), F.when(lower, on).otherwise(w["low_date"]).alias("low_date"),
                    (w["n"] + F.when(hit & (x["phase"] > 0), 1).otherwise(0)).alias("n"),
                ).alias(f"w{n}")
            )
        begun = F.when(x["phase"] == 0, now).otherwise(acc["starting"]).cast(money)
        return F.struct(now.alias("balance"), begun.alias("starting"), (acc["carried"] + F.when(x["phase"] == 1, 1).otherwise(0)).alias("carried"), *ends)

    none = F.lit(0)
    begin = F.struct(balance.alias("balance"), balance.alias("starting"), none.alias("carried"), *[F.struct(balance.alias("ending"), balance.alias("low"), first.alias("low_date"), none.alias("n")).alias(f"w{n}") for n in days])
    empty = F.array().cast(f"array<struct<phase:int,due_date:date,id:long,amount:{money},direction:string,discretionary:boolean,required_minimum:{money}>>")
    end = F.aggregate(F.coalesce("items", empty), begin, step)
    each = snapshots.join(lists, "entity_id", "left").select("entity_id", end.alias("end"))
    one = F.array(*[F.struct(F.lit(n).alias("window_days"), F.col(f"end.w{n}").alias("w")) for n in days])
    return each.select("entity_id", "end", F.explode(one).alias("x")).select(
        "entity_id", "x.window_days", "end.starting", "x.w.ending", "x.w.low", "x.w.low_date", F.col("end.carried").alias("n_carried"), F.col("x.w.n").alias("n_events")
    )
