"""Pulled transactions merged by id: what each pull added or changed, and the table that all pulls together give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a pulled row beside its content: who it is, when and at which place of the pull it was seen.
SEEN = ("id", "fetched_at", "seq")
FIRST, LAST = "first_seen_at", "last_seen_at"


def pulled(rows: DataFrame) -> DataFrame:
    """Pulled rows (id, fetched_at, seq and content) as rows of the table: seen first and last by this pull."""
    return rows.withColumns({FIRST: F.col("fetched_at"), LAST: F.col("fetched_at")})


def merged(rows: DataFrame) -> DataFrame:
    """One row per id of rows of the table: the content seen last (ties: the larger seq, then the larger content), the
    first and the last time seen. Null ids name nothing and go.

    The result depends on neither the order nor the repetition of rows, so pulls may come late, again or in parts, and
    merging what is merged changes nothing. It is one aggregation, combined before the shuffle."""
    content = [c for c in rows.columns if c not in (*SEEN, FIRST, LAST)]
    newest = F.max(F.struct("fetched_at", "seq", *content)).alias("_r")
    met = rows.where("id is not null").groupBy("id").agg(newest, F.min(FIRST).alias(FIRST), F.max(LAST).alias(LAST))
    return met.select(*[F.col(c) if c in ("id", FIRST, LAST) else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def pulls(rows: DataFrame) -> DataFrame:
    """pull_at, n_rows, inserted, updated per pull of pulled rows: a row inserts if its id was in no earlier pull and nowhere
    before in its own, else it updates.

    Each id says once which pull it came with, so the counts add up from two partial aggregations without ordering anything."""
    known = rows.where("id is not null and fetched_at is not null")
    new = known.groupBy("id").agg(F.min("fetched_at").alias("pull_at")).groupBy("pull_at").agg(F.count("*").alias("inserted"))
    all_rows = known.groupBy(F.col("fetched_at").alias("pull_at")).agg(F.count("*").alias("n_rows"))
    inserted = F.coalesce("inserted", F.lit(0)).cast("long")
    return all_rows.join(new, "pull_at", "left").select("pull_at", "n_rows", inserted.alias("inserted"), (F.col("n_rows") - inserted).alias("updated"))
