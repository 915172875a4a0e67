"""Landing files: card exports, other exports, statement texts and feeds."""

import json
from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from cashtide.operators import ledger
from cashtide.sources import ingest


def land(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def amounts(df):
    return sorted((str(r["posted"]), r["amount"], r["payee"]) for r in df.collect())


CARD = "Transaction Date,Clearing Date,Description,Merchant,Category,Type,Amount (USD)\n"


def test_card_signs_follow_the_type_and_bad_lines_are_counted(spark, tmp_path):
    path = land(tmp_path, "c.csv", CARD + '06/01/2026,,Beans,Cafe,Food,Purchase,"$1,004.50"\n06/02/2026,,Thanks,,Pay,Payment,50.00\n06/03/2026,,Back,,x,Daily Cash,-1.25\n06/04/2026,,Refund,,x,Purchase,-7\nsoon,,x,y,z,Purchase,1\n06/05/2026,,x,y,z,Purchase,much\n')
    assert amounts(ingest.card_transactions(spark, path, "a")) == [("2026-06-01", D("-1004.50"), "Cafe"), ("2026-06-02", D("50.00"), "Thanks"), ("2026-06-03", D("1.25"), "Back"), ("2026-06-04", D("-7.00"), "Refund")]
    assert tuple(ingest.skipped(ingest.card_lines(spark, path, "a")).head()) == (6, 2)


def test_other_exports_by_header(spark, tmp_path):
    signed = land(tmp_path, "s.csv", "Posted Date , AMOUNT,Name\n2026-06-01,-12.30,Gas\n6/2/26,5,Pay\n")
    assert amounts(ingest.generic_transactions(spark, signed, "a")) == [("2026-06-01", D("-12.30"), "Gas"), ("2026-06-02", D("5.00"), "Pay")]
    split = land(tmp_path, "d.csv", "Date,Debit,Credit,Description\n2026-06-01,10,,Out\n2026-06-02,,4,In\n2026-06-03,3,0,Zero\n2026-06-04,3,2,Both\n2026-06-05,,,None\n")
    assert amounts(ingest.generic_transactions(spark, split, "a")) == [("2026-06-01", D("-10.00"), "Out"), ("2026-06-02", D("4.00"), "In"), ("2026-06-03", D("-3.00"), "Zero")]
    assert ingest.skipped(ingest.generic_lines(spark, split, "a")).head()["n_skipped"] == 2
    assert ingest.generic_transactions(spark, land(tmp_path, "n.csv", "When,How much\n2026-06-01,5\n"), "a").count() == 0


STATEMENT = "Card statement\nStatement closing date: 06/30/2026\n06/01/2026  Corner Cafe  $12.50\n06/02/2026 Payment thanks -$1\n 06/03/2026 Refund  -4.00 \n06/99/2026 Odd 1.00\nNew Balance\n  $1,234.56\n"


def test_statement_texts(spark, tmp_path):
    texts = ingest.statements(spark, land(tmp_path, "s.txt", STATEMENT))
    assert amounts(ingest.statement_transactions(texts, "a")) == [("2026-06-01", D("-12.50"), "Corner Cafe"), ("2026-06-03", D("4.00"), "Refund")]
    assert ingest.skipped(ingest.statement_lines(texts, "a")).head()["n_skipped"] == 1
    assert tuple(ingest.statement_totals(texts).select("total", "closes").head()) == (D("1234.56"), date(2026, 6, 30))
    assert tuple(ingest.statement_totals(texts.withColumn("text", F.lit("nothing"))).select("total", "closes").head()) == (None, None)


@pytest.mark.parametrize(("text", "want"), [(CARD, "card_csv"), ("\n" + CARD, "card_csv"), (STATEMENT, "statement"), ("Day,Amount\n1,2", "generic_csv"), ("Day,Amounts", "unknown"), ("", "unknown"), (None, "unknown"), ("New Balance $5.00", "unknown")])
def test_layouts(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(ingest.layout(F.col("t"))).head()[0] == want


def test_an_import_repeated_adds_nothing(spark, tmp_path):
    path = land(tmp_path, "c.csv", CARD + "06/01/2026,,Tea,Cafe,Food,Purchase,3\n06/01/2026,,Tea,Cafe,Food,Purchase,3\n")
    once = ingest.card_transactions(spark, path, "a")
    assert once.count() == 2 and ledger.insert_absent(once, ingest.card_transactions(spark, path, "a"), ["id"]).count() == 2


def test_feed_defaults(spark, tmp_path):
    doc = {"accounts": [{"id": "x", "name": "n", "balance": "5.10", "transactions": [{"id": "t", "posted": 0, "transacted-at": 1767225600, "amount": "-2"}]}, {"id": "y", "name": "m", "org": {"name": "o"}, "currency": "EUR", "balance": "1", "available-balance": "0.5", "balance-date": 1767225600}]}
    accounts, seen, rows = ingest.feed(spark, land(tmp_path, "f.json", json.dumps(doc)))
    assert {(r["account_id"], r["org"], r["currency"]) for r in accounts.collect()} == {("x", None, "USD"), ("y", "o", "EUR")}
    assert {(r["account_id"], r["balance"], r["available"], r["recorded_at"] is None) for r in seen.collect()} == {("x", D("5.10"), D("5.10"), True), ("y", D("1.00"), D("0.50"), False)}
    assert [(r["id"], str(r["posted"]), r["amount"], r["payee"], r["pending"]) for r in rows.collect()] == [("t", "2026-01-01", D("-2.00"), "", False)]
