"""Findings of several checks in one table: their merge into the stored ones, with scope, and a run's summary."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which stored states still count, by who found it: a person's acknowledgement holds for rules, not for reviews.
LIVE = {"deterministic": ("open", "acknowledged"), "adversarial": ("open",)}
REVIEW = "adversarial"


def united(parts: dict[str, tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """check_id, severity, evidence of all checks: by check its severity, its rows and the columns that identify them."""
    rows = []
    for check, (severity, found, columns) in sorted(parts.items()):
        said = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
        rows.append(found.select(F.lit(check).alias("check_id"), F.lit(severity).alias("severity"), said.alias("evidence")))
    return functools.reduce(DataFrame.unionByName, rows)


def _title(c: str = "title") -> Column:
    """Titles tell reviews apart, not rules."""
    return F.when(F.col("source") == REVIEW, F.coalesce(c, F.lit(""))).otherwise("")


def _live() -> Column:
    hit = F.lit(False)
    for source, states in LIVE.items():
        hit = hit | ((F.col("source") == source) & F.col("status").isin(*states))
    return F.coalesce(hit, F.lit(False))


def merge(stored: DataFrame, current: DataFrame, ran: DataFrame) -> DataFrame:
    """source, check_id, evidence, title, status, id, change of all stored findings and of those that are new (id null).

    `stored`: id, source, check_id, evidence, title, status. `current`: source, check_id, evidence, title. `ran`: source,
    check_id of the checks that ran; nothing else is touched. A live finding that is seen again stays, acknowledged
    or open; one that is gone is resolved; what is seen and has no live row is opened, also if a resolved row has
    the same key. Live are open rows and, for rules, acknowledged ones. Several current rows of a key open one.
    Null evidence and titles match each other."""
    keys = ["source", "check_id", "_e", "_t"]
    mark = {"_e": F.coalesce("evidence", F.lit("null")), "_t": _title()}
    scope = ran.select(F.col("source").alias("_rs"), F.col("check_id").alias("_rc")).distinct()
    inside = (F.col("source") == F.col("_rs")) & (F.col("check_id") == F.col("_rc"))
    now = current.join(scope, inside, "left_semi").withColumns(mark).groupBy(*keys).agg(F.max("evidence").alias("evidence"), F.max("title").alias("title"))
    seen = now.select(*[F.col(k).alias(f"n{k}") for k in keys], F.lit(True).alias("_seen"))
    same = functools.reduce(lambda a, k: a & (F.col(k) == F.col(f"n{k}")), keys[1:], F.col("source") == F.col("nsource"))
    old = stored.withColumns(mark).join(scope.withColumn("_ran", F.lit(True)), inside, "left").join(seen, same, "left")
    gone = _live() & F.col("_ran").isNotNull() & F.col("_seen").isNull()
    kept = old.select("source", "check_id", "evidence", "title", F.when(gone, "resolved").otherwise(F.col("status")).alias("status"), "id", F.when(gone, "resolved").otherwise("kept").alias("change"))
    held = stored.where(_live()).withColumns(mark).select(*keys).distinct()
    new = now.join(held, keys, "left_anti")
    return kept.unionByName(new.select("source", "check_id", "evidence", "title", F.lit("open").alias("status"), F.lit(None).cast(stored.schema["id"].dataType).alias("id"), F.lit("opened").alias("change")))


def summary(found: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """check_id, severity, findings, new, acknowledged per check of `found` (check_id, severity, evidence); `acknowledged`
    has check_id and evidence of what a person has seen."""
    seen = acknowledged.select(F.col("check_id").alias("_c"), F.col("evidence").alias("_e")).distinct().withColumn("_a", F.lit(1))
    rows = found.join(seen, (F.col("check_id") == F.col("_c")) & (F.col("evidence") == F.col("_e")), "left")
    return rows.groupBy("check_id", "severity").agg(F.count("*").alias("findings"), F.count_if(F.col("_a").isNull()).alias("new"), F.count("_a").alias("acknowledged"))
