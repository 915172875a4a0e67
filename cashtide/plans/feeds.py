"""Queries of pulled transactions over the whole tables, and their SQL (after oracle.BASE)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feed
from ..sources import adapters


def pulls(spark, d):
    """Each transaction comes with the pull at the end of its month; those of the last days again with the next pull, some
    twice in one pull, some corrected two months later."""
    t, day = adapters.transactions(spark, d), F.day("posted")
    end = F.last_day("posted")
    money = lambda more: (F.col("amount") + F.lit(more).cast(adapters.MONEY)).cast(adapters.MONEY)
    copies = F.array(
        F.struct(end.alias("at"), F.lit(1).alias("seq"), F.col("amount").alias("amount"), F.lit(True).alias("pending"), F.lit(True).alias("there")),
        F.struct(F.last_day(F.add_months("posted", 1)).alias("at"), F.lit(1).alias("seq"), F.col("amount").alias("amount"), F.lit(False).alias("pending"), (day >= 26).alias("there")),
        F.struct(end.alias("at"), F.lit(2).alias("seq"), money("0.50").alias("amount"), F.lit(True).alias("pending"), (day == 9).alias("there")),
        F.struct(F.last_day(F.add_months("posted", 2)).alias("at"), F.lit(1).alias("seq"), money("1.00").alias("amount"), F.lit(False).alias("pending"), (day == 7).alias("there")),
    )
    rows = t.withColumn("_c", F.explode(F.filter(copies, lambda c: c["there"])))
    return rows.select("id", F.col("_c.at").alias("fetched_at"), F.col("_c.seq").alias("seq"), "account_id", "posted", F.col("_c.amount").alias("amount"), F.col("_c.pending").alias("pending"))


def feed_upsert(spark, d):
    return feed.merged(feed.pulled(pulls(spark, d)))


def feed_pulls(spark, d):
    return feed.pulls(pulls(spark, d))


ALL = (feed_upsert, feed_pulls)

_PULLED = """pu AS (SELECT id, last_day(posted) AS pull, 1 AS seq, account_id, posted, amount, true AS pending FROM txn
  UNION ALL SELECT id, last_day(posted + INTERVAL 1 MONTH), 1, account_id, posted, amount, false FROM txn WHERE day(posted) >= 26
  UNION ALL SELECT id, last_day(posted), 2, account_id, posted, amount + 0.50, true FROM txn WHERE day(posted) = 9
  UNION ALL SELECT id, last_day(posted + INTERVAL 2 MONTH), 1, account_id, posted, amount + 1.00, false FROM txn WHERE day(posted) = 7)"""

STEPS = {"feed_upsert": _PULLED, "feed_pulls": _PULLED}
SQL = {
    "feed_upsert": """SELECT id, pull::VARCHAR AS fetched_at, seq::BIGINT AS seq, account_id, posted::VARCHAR AS posted, amount::DOUBLE AS amount, pending, min(pull) OVER (PARTITION BY id)::VARCHAR AS first_seen_at, max(pull) OVER (PARTITION BY id)::VARCHAR AS last_seen_at
  FROM pu QUALIFY row_number() OVER (PARTITION BY id ORDER BY pull DESC, seq DESC, account_id DESC, posted DESC, amount DESC, pending DESC) = 1""",
    "feed_pulls": """SELECT pull::VARCHAR AS pull_at, count(*) AS n_rows, count(*) FILTER (n = 1) AS inserted, count(*) FILTER (n > 1) AS updated FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pull, seq) AS n FROM pu) GROUP BY pull""",
}
