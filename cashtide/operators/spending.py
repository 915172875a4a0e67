"""Spending reports over transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def outflows(transactions: DataFrame, start: str, end: str, exclude_transfers: bool = True) -> DataFrame:
    """Outflows posted in [start, end] with category, merchant, month and spend (positive)."""
    rows = transactions.where((F.col("amount") < 0) & F.col("posted").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    rows = rows.withColumns(
        {
            "category": text.category(F.col("payee"), F.col("description")),
            "merchant": text.merchant(F.col("payee")),
            "month": F.date_format("posted", "yyyy-MM"),
            "spend": -F.col("amount"),
        }
    )
    return rows.where(~F.col("category").isin("Transfers", "Income")) if exclude_transfers else rows


def summarize(transactions: DataFrame, start: str, end: str, by: str = "category", exclude_transfers: bool = True, top_n: int = 10) -> DataFrame:
    """key, total, n: the `top_n` largest buckets (ties by key) of category, merchant or month.

    Only partial sums are shuffled; the top is cut after aggregation, so it is small whatever the input.
    """
    if by not in ("category", "merchant", "month"):
        raise ValueError("by must be category, merchant or month")
    sums = outflows(transactions, start, end, exclude_transfers).groupBy(F.col(by).alias("key")).agg(F.sum("spend").alias("total"), F.count("*").alias("n"))
    return sums.orderBy(F.desc("total"), "key").limit(top_n)


def samples(transactions: DataFrame, start: str, end: str, by: str = "category", k: int = 5) -> DataFrame:
    """key, rank, id, posted: each bucket's first `k` transactions by (posted, id), as evidence.

    Ranks are cut per partition before the shuffle by Spark's window-group limit, so hot buckets stay small."""
    order = Window.partitionBy("key").orderBy("posted", "id")
    rows = outflows(transactions, start, end).select(F.col(by).alias("key"), "id", "posted")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def monthly(transactions: DataFrame, start: str, end: str, exclude_transfers: bool = True) -> DataFrame:
    """month, total, n, change (against the month before it in the list)."""
    sums = summarize(transactions, start, end, "month", exclude_transfers, 1 << 20)
    return sums.select(F.col("key").alias("month"), "total", "n", (F.col("total") - F.lag("total").over(Window.orderBy("key"))).alias("change"))


def excluded(transactions: DataFrame, start: str, end: str) -> DataFrame:
    """category, n: outflows left out of spending."""
    rows = outflows(transactions, start, end, False)
    return rows.where(F.col("category").isin("Transfers", "Income")).groupBy("category").agg(F.count("*").alias("n"))


def listing(
    transactions: DataFrame, accounts: DataFrame, start=None, end=None, query=None, min_amount=None, account_id=None, include_pending: bool = True, limit: int = 50
) -> DataFrame:
    """Newest first, with the account's name; a None leaves its filter out. `truncated` tells whether more exist."""
    limit = max(1, min(500, limit))
    rows = transactions
    if start is not None:
        rows = rows.where(F.col("posted") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("posted") <= F.lit(end).cast("date"))
    if query is not None:
        hay = F.lower(F.concat_ws(" ", F.coalesce("payee", F.lit("")), F.coalesce("description", F.lit(""))))
        rows = rows.where(F.contains(hay, F.lit(query.lower())))
    if min_amount is not None:
        rows = rows.where(F.abs("amount") >= F.lit(min_amount))
    if account_id is not None:
        rows = rows.where(F.col("account_id") == F.lit(account_id))
    if not include_pending:
        rows = rows.where(~F.col("pending"))
    top = rows.orderBy(F.desc("posted"), F.desc("id")).limit(limit + 1)
    numbered = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("posted"), F.desc("id"))))
    more = numbered.withColumn("truncated", F.max("rank").over(Window.partitionBy()) > limit).where(F.col("rank") <= limit)
    return more.join(accounts.select("account_id", F.col("name").alias("account_name")), "account_id", "left")
