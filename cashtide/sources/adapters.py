"""The cash-flow tables as views of the star-schema test tables; money is decimal from the first step on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_value(c: Column, mapping: dict, other=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(other)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_id, name, org, kind, opening balance."""
    kinds = {"BUILDING": "checking", "FURNITURE": "savings", "MACHINERY": "card", "AUTOMOBILE": "loan"}
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("org"))
    return (
        read(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").alias("account_id"),
            F.col("c_name").alias("name"),
            "org",
            by_value(F.col("c_mktsegment"), kinds, "other").alias("kind"),
            F.col("c_acctbal").cast(MONEY).alias("balance"),
        )
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, account_id, balance, recorded_at, source: balance observations; sign-ups count as entered by hand."""
    value = F.col("value").cast(MONEY)
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("account_id"),
        F.when(F.col("event_type") == "error", -value).otherwise(value).alias("balance"),
        F.col("ts").alias("recorded_at"),
        F.when(F.col("event_type") == "signup", "manual").otherwise("feed").alias("source"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, account_id, posted, amount (below 0: outflow), payee, description, pending.

    Amounts, days and flags are made before the joins, so that rows are short where they shuffle; ids, which are long, after them."""
    worth = F.round(F.col("l_extendedprice").cast(MONEY) * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")), 2).cast(MONEY)
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("posted"),
        F.when(F.col("l_returnflag") == "R", worth).otherwise(-worth).alias("amount"), (F.col("l_linestatus") == "O").alias("pending"),
    )
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
            F.col("o_custkey").alias("account_id"),
            "posted",
            "amount",
            F.col("p_brand").alias("payee"),
            F.col("p_name").alias("description"),
            "pending",
        )
    )


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, entity_id, obligation_id, name, due_date, amount, direction, status, discretionary, required_minimum,
    amount_status, confidence, autopay, cadence: dated expected cash flows."""
    p = F.col("o_orderpriority")
    amount = F.col("o_totalprice").cast(MONEY)
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("entity_id"),
        F.concat_ws(":", "o_custkey", p).alias("obligation_id"),
        F.to_date("o_orderdate").alias("due_date"),
        amount.alias("amount"),
        F.when(p == "5-LOW", "inflow").otherwise("outflow").alias("direction"),
        by_value(F.col("o_orderstatus"), {"O": "expected", "P": "partially_paid"}, "paid").alias("status"),
        (p == "3-MEDIUM").alias("discretionary"),
        F.round(amount * F.lit("0.25").cast("decimal(3,2)"), 2).cast(MONEY).alias("required_minimum"),
        F.when(p.isin("1-URGENT", "2-HIGH"), "estimated").otherwise("confirmed").alias("amount_status"),
        by_value(p, {"1-URGENT": "very_low", "2-HIGH": "low", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "high"}).alias("confidence"),
        p.isin("1-URGENT", "2-HIGH").alias("autopay"),
        by_value(p, {"1-URGENT": "weekly", "2-HIGH": "biweekly", "3-MEDIUM": "monthly", "4-NOT SPECIFIED": "quarterly"}, "monthly").alias("cadence"),
    )
