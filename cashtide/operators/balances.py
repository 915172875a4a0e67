"""Balances: latest and as-of observations, coverage and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(snapshots: DataFrame, as_of: str | None = None) -> DataFrame:
    """account_id, id, balance, recorded_at, source: one row per account.

    Entries by hand beat all others whatever their time, then the later one, then the larger id. A maximum of
    a struct combines map-side, so an account with very many observations costs one row a task.
    """
    rows = snapshots if as_of is None else snapshots.where(F.to_date("recorded_at") <= F.lit(as_of).cast("date"))
    key = F.struct((F.col("source") == "manual").alias("by_hand"), "recorded_at", "id", "balance", "source")
    return rows.groupBy("account_id").agg(F.max(key).alias("m")).select("account_id", "m.id", "m.balance", "m.recorded_at", "m.source")


def aged(latest_rows: DataFrame, as_of: str, stale_days: int = 3) -> DataFrame:
    """Latest rows with age_days and stale (unknown or future times count as stale)."""
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("recorded_at"))
    return latest_rows.withColumn("age_days", age).withColumn("stale", F.coalesce((age < 0) | (age > stale_days), F.lit(True)))


def coverage(accounts: DataFrame, snapshots: DataFrame, as_of: str, stale_days: int = 3) -> DataFrame:
    """One row: n_accounts, n_missing, n_stale, oldest, newest, liquid (sum of balances from 0 up), complete."""
    rows = accounts.select("account_id").join(aged(latest(snapshots), as_of, stale_days), "account_id", "left")
    missing = F.col("id").isNull()
    return rows.agg(
        F.count("*").alias("n_accounts"),
        F.count_if(missing).alias("n_missing"),
        F.count_if(~missing & F.col("stale")).alias("n_stale"),
        F.min(F.to_date("recorded_at")).alias("oldest"),
        F.max(F.to_date("recorded_at")).alias("newest"),
        F.sum(F.when(F.col("balance") >= 0, F.col("balance"))).alias("liquid"),
    ).withColumn("complete", (F.col("n_missing") == 0) & (F.col("n_stale") == 0))


def freshness(runs: DataFrame, now: str, stale_hours: int = 24) -> DataFrame:
    """One row (status): error > warning > stale > fresh of the latest run by started_at; unknown without runs.

    `runs` has started_at, finished_at, error and n_warnings."""
    last = runs.agg(F.max_by(F.struct("finished_at", "error", "n_warnings"), "started_at").alias("r"))
    hours = (F.lit(now).cast("timestamp").cast("long") - F.col("r.finished_at").cast("long")) / 3600
    return last.select(
        F.when(F.col("r").isNull(), "unknown")
        .when(F.col("r.error").isNotNull(), "error")
        .when(F.col("r.n_warnings") > 0, "warning")
        .when(hours.isNull() | (hours > stale_hours), "stale")
        .otherwise("fresh")
        .alias("status")
    )
