"""Streaming front end: balance observations into daily statistics and a latest-balance table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merging

NAMES = ("account_id", "id", "balance", "recorded_at", "source")
SCHEMA = "account_id long, id long, balance decimal(18,2), recorded_at timestamp, source string"


def daily(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """account_id, day, n, low, high by event time; state older than the watermark is dropped."""
    rows = stream.withWatermark("recorded_at", late).groupBy("account_id", F.window("recorded_at", "1 day"))
    return rows.agg(F.count("*").alias("n"), F.min("balance").alias("low"), F.max("balance").alias("high")).select(
        "account_id", F.to_date("window.start").alias("day"), "n", "low", "high"
    )


def keep_latest(stream: DataFrame, path: str, checkpoint: str, every: int = 16):
    """Starts a query that keeps, below `path`, the latest observation per account; read it with kept().

    See merging.keep: batches that run again or come after a lost checkpoint do no harm, old folders go."""
    return merging.keep(stream.select(*NAMES), path, checkpoint, merging.latest, every)


def kept(spark: SparkSession, path: str) -> DataFrame:
    """What keep_latest keeps."""
    return merging.current(spark, path, SCHEMA, merging.latest)
