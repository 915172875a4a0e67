"""Two lists of expected cash flows compared: matched, changed, renamed, missing and extra rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import saved
from .reconcile import greedy

#: Days within which two rows are the same charge, or the same charge at another date.
NEAR, FAR = 7, 31


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_id, new_id, kind, severity, amount_delta, date_delta of every row of both lists.

    `old`: id, entity_id, direction, on_date, amount, label; `new`: id, entity_id, direction, due_date, amount, name; an id is a
    row's place in its list. Rows of `old` claim rows of `new` in order: the first of a like label that is near in days and
    amount (matched), else the first that is near in days (amount_changed) or in amount and farther in days (date_changed).
    What then is left of both, of the same amount and at most two days apart, is renamed where it is the only one. Rows with a
    null entity, direction, date or amount meet nothing. Days are met in blocks: an old row is listed under three of them."""
    block = lambda c: F.floor(F.unix_date(F.col(c)) / (FAR + 1))
    a = old.select(F.col("id").alias("instance_id"), "entity_id", "direction", "on_date", F.col("amount").alias("was"), text.tokens(F.col("label"), text.LABEL_STOP_TOKENS).alias("said"))
    b = new.select(F.col("id").alias("transaction_id"), "entity_id", "direction", F.col("due_date").alias("day"), F.col("amount").alias("now"), text.tokens(F.col("name"), text.LABEL_STOP_TOKENS).alias("words"), block("due_date").alias("block"))
    listed = a.withColumn("block", F.explode(F.sequence(block("on_date") - 1, block("on_date") + 1)))
    met = saved(listed.join(b, ["entity_id", "direction", "block"]).withColumn("apart", F.abs(F.datediff("day", "on_date"))).where(f"apart <= {FAR}"))
    close = F.abs(F.col("was") - F.col("now")) <= F.greatest(F.lit(5), F.greatest(F.abs("was"), F.abs("now")) * F.lit("0.05").cast("decimal(3,2)"))
    near = F.col("apart") <= NEAR
    kind = F.when(near & close, "matched").when(near, "amount_changed").when(close, "date_changed")
    like = met.where(F.arrays_overlap("said", "words")).withColumn("match_type", kind).where("match_type is not null")
    pairs = like.select("instance_id", "transaction_id", "match_type", F.when(F.col("match_type") == "matched", 1.0).otherwise(0.5).alias("score"), F.lit(None).cast("date").alias("due_date"), F.lit(0).alias("days"), F.lit(0).alias("delta"))
    claimed = saved(greedy(pairs).select(F.col("instance_id").alias("old_id"), F.col("transaction_id").alias("new_id"), F.col("match_type").alias("kind")))
    same = met.where("was = now and apart <= 2").select(F.col("instance_id").alias("old_id"), F.col("transaction_id").alias("new_id"), "entity_id", "direction", "was")
    left = saved(same.join(claimed.select("old_id"), "old_id", "left_anti").join(claimed.select("new_id"), "new_id", "left_anti"))
    bound = claimed.unionByName(_only_ones(left).withColumn("kind", F.lit("renamed")))
    one = old.select(F.col("id").alias("old_id"), F.col("on_date"), F.col("amount").alias("was")).join(bound, "old_id", "left")
    every = one.join(new.select(F.col("id").alias("_n"), F.col("due_date").alias("day"), F.col("amount").alias("now")), F.col("new_id") == F.col("_n"), "full")
    delta = (F.col("now") - F.col("was")).cast("decimal(18,2)")
    what = F.when(F.col("kind").isNotNull(), F.col("kind")).when(F.col("old_id").isNull(), "extra").otherwise("missing")
    rank = F.when(what == "missing", "medium").when(what.isin("extra", "date_changed"), "low").when(what == "amount_changed", F.when(F.abs(delta) >= 50, "medium").otherwise("low"))
    return every.select("old_id", F.col("_n").alias("new_id"), what.alias("kind"), rank.alias("severity"), delta.alias("amount_delta"), F.datediff("day", "on_date").alias("date_delta"))


def _only_ones(left: DataFrame) -> DataFrame:
    """old_id, new_id: in order, each old row takes its new row if just one is left to it.

    Rounds over the whole table. Rows of one amount (`was`) alone can meet; a row is decided when it is the first for all of
    its new rows, or when no earlier row of its amount has just one, since only such rows take anything."""
    found = []
    while not left.isEmpty():
        mine, its, group = Window.partitionBy("old_id"), Window.partitionBy("new_id"), Window.partitionBy("entity_id", "direction", "was")
        rows = left.withColumn("n", F.count("*").over(mine)).withColumn("first", F.min("old_id").over(its)).withColumn("ahead", F.min(F.when(F.col("n") == 1, F.col("old_id"))).over(group))
        decided = F.min((F.col("old_id") == F.col("first")) | F.col("ahead").isNull() | (F.col("old_id") <= F.col("ahead"))).over(mine)
        rows = saved(rows.withColumn("decided", decided))
        took = rows.where("decided and n = 1").select("old_id", "new_id")
        found.append(took)
        left = saved(rows.where("not decided").join(took.select("new_id"), "new_id", "left_anti").select(*left.columns))
    return functools.reduce(DataFrame.unionByName, found) if found else left.select("old_id", "new_id")
