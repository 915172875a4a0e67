"""Audits: overlapping obligations, projections recomputed, claims traced to their source, rows already modeled."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text
from ..sources.tables import saved
from .projection import PROJECTABLE


@F.pandas_udf(DoubleType())  # a type object: importing needs no session
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks of two names."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def overlaps(instances: DataFrame, ratio: float = 0.6, tokens: float = 0.4, amount: str = "0.15") -> DataFrame:
    """obligation_a, obligation_b, n_months, exact: obligations of one entity and kind that look like one bill.

    `instances`: entity_id, obligation_id, name, kind, due_date, amount, status. Pairs share a month and have the
    same name, or alike names (characters and words) and upper-median amounts within 15 percent. Alike names share
    a word, so pairs are joined on entity, kind and word, never all with all; the character ratio, which needs
    Python, is asked last and only of pairs that passed everything else."""
    live = instances.where(F.col("status").isin(*PROJECTABLE))
    each = live.groupBy("entity_id", "obligation_id", "name", "kind").agg(
        F.collect_set(F.trunc("due_date", "MM")).alias("months"), F.expr("percentile_disc(0.5) within group (order by abs(amount) desc)").alias("mid")
    )
    each = each.withColumn("low", F.lower(F.trim("name"))).withColumn("words", F.array_distinct(F.split("low", r"\s+")))
    word = each.withColumn("word", F.explode("words"))
    cols = ("obligation_id", "low", "words", "months", "mid")
    a = word.select("entity_id", "kind", "word", *[F.col(c).alias(f"{c}_a") for c in cols])
    b = word.select("entity_id", "kind", "word", *[F.col(c).alias(f"{c}_b") for c in cols])
    pairs = a.join(b, ["entity_id", "kind", "word"]).where("obligation_id_a < obligation_id_b and arrays_overlap(months_a, months_b)")
    exact = F.col("low_a") == F.col("low_b")
    near = F.abs(F.col("mid_a") - F.col("mid_b")) <= F.greatest("mid_a", "mid_b") * F.lit(float(amount))
    fit = pairs.where(exact | ((text.similarity(F.col("words_a"), F.col("words_b")) >= tokens) & near & (F.greatest("mid_a", "mid_b") > 0)))
    once = fit.select(
        F.col("obligation_id_a").alias("obligation_a"), F.col("obligation_id_b").alias("obligation_b"), F.size(F.array_intersect("months_a", "months_b")).alias("n_months"), exact.alias("exact"), "low_a", "low_b"
    ).distinct()
    return once.withColumn("ratio", name_ratio("low_a", "low_b")).where(F.col("exact") | (F.col("ratio") >= ratio)).drop("low_a", "low_b", "ratio")


def projection_identity(event_rows: DataFrame, troughs: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """entity_id, ending, recomputed, holds: the projected ending against the start plus the plain sum of events."""
    total = event_rows.groupBy("entity_id").agg(F.sum(F.when(F.col("direction") == "inflow", F.col("amount")).otherwise(-F.col("amount"))).alias("moved"))
    again = (F.col("starting") + F.coalesce("moved", F.lit(0).cast("decimal(18,2)"))).cast("decimal(18,2)")
    rows = troughs.join(total, "entity_id", "left").withColumn("recomputed", again)
    return rows.select("entity_id", "ending", "recomputed", (F.abs(F.col("ending") - F.col("recomputed")) <= F.lit(tolerance).cast("decimal(4,2)")).alias("holds"))


def grounding(claims: DataFrame, facts: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """key, claimed, found, verdict of `claims` (key, value) against `facts` (key, value; one row per key).

    grounded within the tolerance, mismatch beyond it or where one value is null, unsupported without a source row."""
    at = facts.select("key", F.col("value").alias("found"), F.lit(True).alias("known"))
    near = F.abs(F.col("value") - F.col("found")) <= F.lit(tolerance).cast("decimal(4,2)")
    verdict = F.when(F.col("known").isNull(), "unsupported").when(near, "grounded").otherwise("mismatch")
    return claims.join(at, "key", "left").select("key", F.col("value").alias("claimed"), "found", verdict.alias("verdict"))


def count_differences(claimed: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_claimed, n_found where two multisets of keys differ; counted before they are joined."""
    a = claimed.groupBy(*keys).agg(F.count("*").alias("n_claimed"))
    b = found.groupBy(*keys).agg(F.count("*").alias("n_found"))
    return a.join(b, keys, "full").select(*keys, F.coalesce("n_claimed", F.lit(0)).alias("n_claimed"), F.coalesce("n_found", F.lit(0)).alias("n_found")).where("n_claimed <> n_found")


def already_modeled(rows: DataFrame, instances: DataFrame, window: int = 7, amount_abs: str = "5.00", amount_pct: str = "0.050") -> DataFrame:
    """id, instance_id, verdict of incoming rows: the first instance (by due date, id) that already stands for one.

    `rows`: id, entity_id, direction, on_date, amount, label; `instances`: id, entity_id, direction, due_date,
    amount, name. Rows without a date or a label need review. The join is on entity, direction and block of days: the
    instances, not the rows, are listed under the two or three blocks that their interval meets. Rows and hits are saved
    between the steps; few rows have hits, so only the ids of all rows shuffle once more."""
    due = F.col("due_date")
    block = lambda c: F.floor(F.unix_date(c) / (window + 1))
    rows = saved(rows.select("id", "entity_id", "direction", "on_date", "amount", "label"))
    known = instances.select(
        F.col("entity_id").alias("_e"), F.col("direction").alias("_d"), "due_date", F.col("id").alias("instance_id"), F.col("amount").alias("expected"), "name",
        F.explode(F.sequence(block(F.date_sub(due, window)), block(F.date_add(due, window)))).alias("block"),
    )
    close = F.abs(F.col("amount") - F.col("expected")) <= F.greatest(F.lit(amount_abs).cast("decimal(18,2)"), F.greatest(F.abs("amount"), F.abs("expected")) * F.lit(amount_pct).cast("decimal(4,3)"))
    pairs = rows.join(known, (F.col("entity_id") == F.col("_e")) & (F.col("direction") == F.col("_d")) & (block(F.col("on_date")) == F.col("block")))
    near = F.abs(F.datediff("on_date", "due_date")) <= window
    hits = pairs.where(near & close & F.arrays_overlap(text.tokens(F.col("label")), text.tokens(F.col("name"))))
    first = saved(hits.groupBy("id").agg(F.min(F.struct("due_date", "instance_id"))["instance_id"].alias("instance_id")))
    unclear = F.col("on_date").isNull() | (F.coalesce("label", F.lit("")) == "")
    verdict = F.when(F.col("instance_id").isNotNull(), "already_modeled").when(F.col("unclear"), "needs_review").otherwise("new")
    return rows.select("id", unclear.alias("unclear")).join(first, "id", "left").select("id", "instance_id", verdict.alias("verdict"))


def working_account(accounts: DataFrame, account_id: int | None = None, hint: str | None = None) -> DataFrame:
    """org, account_id, name of each org's working account: the given id, else a name with the hint, else a
    checking account, else any; ties to the smallest id. A minimum, combined before the shuffle."""
    rank = (
        F.when(F.col("account_id") == F.lit(account_id), 0).when(F.contains(F.lower("name"), F.lower(F.lit(hint))), 1).when(F.col("kind") == "checking", 2).otherwise(3)
    )
    best = F.min(F.struct(rank.alias("rank"), "account_id", "name"))
    return accounts.groupBy("org").agg(best.alias("b")).select("org", "b.account_id", "b.name")
