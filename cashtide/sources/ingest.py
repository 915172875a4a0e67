"""Landing files as transactions: card exports in CSV and account feeds in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import synthetic_ids

CARD_COLUMNS = "`Transaction Date` string, `Clearing Date` string, Description string, Merchant string, Category string, Type string, `Amount (USD)` string"
FEED_SCHEMA = """accounts array<struct<id:string, name:string, org:struct<name:string>, type:string, currency:string, balance:string, `available-balance`:string, `balance-date`:bigint,
  transactions:array<struct<id:string, posted:bigint, `transacted-at`:bigint, amount:string, payee:string, description:string, pending:boolean>>>>, errors array<string>"""


def money(c: Column) -> Column:
    """An amount with $ signs and thousands marks; null where it is none."""
    return F.regexp_replace(c, "[$,\\s]", "").try_cast("decimal(18,2)")


def loose_date(c: Column) -> Column:
    """Month/day/year with two or four digits of year, or ISO; null where it is none of them."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) for p in ("M/d/yyyy", "yyyy-MM-dd", "M/d/yy")]).cast("date")


#: Types of a card export that bring money in, and the headers by which a column is known, first one first.
INFLOW_TYPES = ("payment", "daily cash", "credit")
HEADERS = {
    "date": ("transaction date", "date", "posted date"),
    "amount": ("amount (usd)", "amount"),
    "debit": ("debit",),
    "credit": ("credit",),
    "payee": ("merchant", "description", "payee", "name"),
}
#: A dated money line, a balance and a closing date of a statement's text.
LINE = r"^(\d{2}/\d{2}/\d{4})\s+(.+?)\s+\$?(-?[\d,]+\.\d{2})$"
TOTAL = r"(?i)(?:new balance|total balance)\D*\$?(-?[\d,]+\.\d{2})"
CLOSES = r"(?i)statement closing date\D*(\d{2}/\d{2}/\d{4})"


def _place() -> Column:
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("n")).alias("position")


def _trimmed(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def _kept(rows: DataFrame, prefix: str) -> DataFrame:
    good = synthetic_ids(rows.where("posted is not null and amount is not null"), prefix)
    return good.select(F.col("synthetic_id").alias("id"), "account_id", "posted", "amount", "payee", "description", F.lit(False).alias("pending"))


def skipped(rows: DataFrame) -> DataFrame:
    """One row (n_rows, n_skipped) of lines as read: those without a readable date or amount are skipped."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(F.col("posted").isNull() | F.col("amount").isNull()).alias("n_skipped"))


def card_lines(spark: SparkSession, path: str, account_id: str) -> DataFrame:
    """The lines of a card export (account_id, posted, amount, payee, description, position); posted or amount is null where it
    cannot be read. Payments, cash back and credits come in, everything else goes out, whatever the sign says."""
    raw = spark.read.schema(CARD_COLUMNS).csv(path, header=True)
    size, comes_in = F.abs(money(F.col("Amount (USD)"))), F.lower(_trimmed("Type")).isin(*INFLOW_TYPES)
    payee, said = _trimmed("Merchant"), _trimmed("Description")
    return raw.select(
        F.lit(account_id).alias("account_id"), loose_date(_trimmed("Transaction Date")).alias("posted"), F.when(comes_in, size).otherwise(-size).cast("decimal(18,2)").alias("amount"),
        F.when(payee != "", payee).otherwise(said).alias("payee"), F.when(said != "", said).otherwise(payee).alias("description"), _place(),
    )


def card_transactions(spark: SparkSession, path: str, account_id: str, prefix: str = "card") -> DataFrame:
    """A card export as transactions; rows without date or amount are left out (see `skipped`).

    Ids follow from account, date, amount, payee and the place among equal rows, so an import repeated is the same."""
    return _kept(card_lines(spark, path, account_id), prefix)


def generic_lines(spark: SparkSession, path: str, account_id: str) -> DataFrame:
    """The lines of an export with other headers (see HEADERS; case and blanks around them do not count), as `card_lines` gives them.

    A signed amount column counts as it is. Else a debit goes out and a credit comes in; a line with both above zero has
    no amount. Files of one call share their header; without a date or any amount column there are no lines."""
    raw = spark.read.csv(path, header=True)
    known = {name.strip().lower(): name for name in raw.columns}
    found = {k: next((known[n] for n in names if n in known), None) for k, names in HEADERS.items()}
    column = lambda k: F.lit("") if found[k] is None else F.trim(F.coalesce(F.col(f"`{found[k]}`"), F.lit("")))
    debit, credit = money(column("debit")), money(column("credit"))
    net = F.when((debit != 0) & (credit != 0), None).when(debit.isNotNull() | credit.isNotNull(), F.coalesce(F.abs(credit), F.lit(0)) - F.coalesce(F.abs(debit), F.lit(0)))
    amount = money(column("amount")) if found["amount"] else net
    lines = raw.select(
        F.lit(account_id).alias("account_id"), loose_date(column("date")).alias("posted"), amount.cast("decimal(18,2)").alias("amount"), column("payee").alias("payee"), column("payee").alias("description"), _place()
    )
    usable = found["date"] and (found["amount"] or found["debit"] or found["credit"])
    return lines if usable else lines.where(F.lit(False))


def generic_transactions(spark: SparkSession, path: str, account_id: str, prefix: str = "card") -> DataFrame:
    return _kept(generic_lines(spark, path, account_id), prefix)


def statements(spark: SparkSession, path: str) -> DataFrame:
    """file, text of statement texts; a statement is a small file, so each is one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def layout(text: Column) -> Column:
    """card_csv, statement, generic_csv or unknown, from a file's text."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), "^\\s+", "")
    head = F.trim(F.regexp_extract(body, "^[^\r\n]*", 0))
    squeezed = F.lower(F.replace(head, F.lit(" "), F.lit("")))
    dated = F.exists(F.split(body, "\r\n|\r|\n"), lambda line: F.trim(line).rlike(LINE))
    return (
        F.when(body == "", "unknown").when(F.contains(squeezed, F.lit("transactiondate")) & F.contains(squeezed, F.lit("amount")), "card_csv")
        .when(dated, "statement")
        .when(F.contains(head, F.lit(",")) & head.rlike("(?i)\\bamount\\b"), "generic_csv").otherwise("unknown")
    )


def statement_lines(texts: DataFrame, account_id: str) -> DataFrame:
    """The dated money lines of `statements`, as `card_lines` gives them; an amount below zero in the text comes in."""
    lines = texts.select("file", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("n", "line")).withColumn("line", F.trim("line")).where(F.col("line").rlike(LINE))
    payee = F.trim(F.regexp_extract("line", LINE, 2))
    return lines.select(
        F.lit(account_id).alias("account_id"), loose_date(F.regexp_extract("line", LINE, 1)).alias("posted"), (-money(F.regexp_extract("line", LINE, 3))).cast("decimal(18,2)").alias("amount"),
        payee.alias("payee"), payee.alias("description"), F.struct("file", "n").alias("position"),
    )


def statement_transactions(texts: DataFrame, account_id: str, prefix: str = "card") -> DataFrame:
    return _kept(statement_lines(texts, account_id), prefix)


def statement_totals(texts: DataFrame) -> DataFrame:
    """file, total, closes of `statements`: the first balance, without sign, and closing date in each; null where there is none."""
    total = money(F.nullif(F.regexp_extract("text", TOTAL, 1), F.lit("")))
    return texts.select("file", F.abs(total).alias("total"), loose_date(F.nullif(F.regexp_extract("text", CLOSES, 1), F.lit(""))).alias("closes"))


def _time(c: Column) -> Column:
    return F.timestamp_seconds(F.nullif(c, F.lit(0)))


def feed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accounts, balance observations, transactions) of JSON feed documents; times are epoch seconds, 0 is none.

    The currency is USD unless said; what is available is the balance unless said."""
    a = spark.read.schema(FEED_SCHEMA).json(path, multiLine=True).select(F.explode("accounts").alias("a")).select("a.*")
    accounts = a.select(F.col("id").alias("account_id"), "name", F.col("org.name").alias("org"), F.col("type").alias("kind"), F.coalesce("currency", F.lit("USD")).alias("currency"))
    seen = a.select(F.col("id").alias("account_id"), money(F.col("balance")).alias("balance"), F.coalesce(money(F.col("available-balance")), money(F.col("balance"))).alias("available"), _time(F.col("balance-date")).alias("recorded_at"), F.lit("feed").alias("source"))
    t = a.select(F.col("id").alias("account_id"), F.explode("transactions").alias("t"))
    rows = t.select(
        F.col("t.id").alias("id"), "account_id", F.coalesce(_time(F.col("t.posted")), _time(F.col("t.transacted-at"))).cast("date").alias("posted"),
        money(F.col("t.amount")).alias("amount"), F.coalesce("t.payee", F.lit("")).alias("payee"), F.coalesce("t.description", F.lit("")).alias("description"), F.coalesce("t.pending", F.lit(False)).alias("pending"),
    )
    return accounts, seen, rows
