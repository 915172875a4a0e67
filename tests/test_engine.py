"""The engine's operators: against their SQL on the small tables, and on fixtures worked out by hand."""

from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from cashtide.functions import dates, text
from cashtide.operators import audit, balances, estimates, findings, ledger, projection, reconcile
from cashtide.plans import catalog
from cashtide.sources import ingest
from cashtide.streaming import balances as stream_balances
from tests import compare

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()
MONEY = "decimal(18,2)"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert compare.differences(spark, SF, catalog.queries()[name], SQL[name], duck) is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).columns


def test_categories_and_merchants(spark):
    rows = [("Corner Coffee", "coffee"), ("Shell 4411", "fuel"), ("Online Transfer", ""), (None, None), ("o'neil mc-donald #123", "x")]
    got = spark.createDataFrame(rows, "p string, d string").select(text.category(F.col("p"), F.col("d")), text.merchant(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("Dining", "Corner Coffee"), ("Transport", "Shell"), ("Transfers", "Online Transfer"), ("Other", "Unknown"), ("Other", "O'Neil Mc-Donald")]


def test_manual_balance_beats_later_feed(spark):
    s = spark.createDataFrame(
        [(1, 1, D("100"), datetime(2026, 6, 20), "feed"), (2, 1, D("80"), datetime(2026, 6, 10), "manual"), (3, 1, D("120"), datetime(2026, 6, 25), "feed")],
        f"id long, account_id long, balance {MONEY}, recorded_at timestamp, source string",
    )
    assert balances.latest(s).head()["balance"] == D("80.00")
    assert balances.latest(s, "2026-06-09").count() == 0


def _instances(spark, rows):
    return spark.createDataFrame(rows, f"id long, entity_id long, due_date date, amount {MONEY}, direction string, status string, discretionary boolean, required_minimum {MONEY}")


def test_capped_projection(spark):
    rows = [
        (1, 1, date(2026, 7, 1), D("400"), "outflow", "expected", False, D("0")),
        (2, 1, date(2026, 7, 3), D("600"), "outflow", "expected", True, D("100")),
        (3, 1, date(2026, 7, 5), D("1000"), "inflow", "expected", False, D("0")),
        (4, 1, date(2026, 7, 6), D("200"), "outflow", "expected", True, D("0")),
        (5, 1, date(2026, 7, 31), D("9999"), "outflow", "expected", False, D("0")),
    ]
    ev = projection.events(_instances(spark, rows), "2026-07-01", 30)
    start = spark.createDataFrame([(1, D("3000")), (2, D("7"))], f"entity_id long, starting {MONEY}")
    got = {r["entity_id"]: r for r in projection.capped_trough(ev, start, "2026-07-01").collect()}
    assert (got[1]["ending"], got[1]["low"], got[1]["low_date"]) == (D("3300.00"), D("2500.00"), date(2026, 7, 3))
    assert (got[2]["ending"], got[2]["low"], got[2]["low_date"]) == (D("7.00"), D("7.00"), date(2026, 7, 1))


def _recon(spark, inst, txn):
    i = spark.createDataFrame(inst, f"id long, entity_id long, name string, due_date date, amount {MONEY}, direction string")
    t = spark.createDataFrame(txn, f"id string, account_id long, posted date, amount {MONEY}, payee string, description string")
    return i, t


def test_scores_and_claims(spark):
    i, t = _recon(
        spark,
        [(1, 1, "Acme Water", date(2026, 6, 1), D("100"), "outflow"), (2, 1, "Acme Water", date(2026, 6, 2), D("100"), "outflow")],
        [("a", 1, date(2026, 6, 2), D("-100"), "Acme", "")],
    )
    pairs = reconcile.candidates(i, t)
    assert {(r["instance_id"], r["match_type"], r["score"]) for r in pairs.collect()} == {(1, "auto", 0.9), (2, "auto", 0.9)}
    assert [(r["instance_id"], r["transaction_id"]) for r in reconcile.greedy(pairs).collect()] == [(1, "a")]


def test_claims_equal_one_by_one(spark):
    pairs = catalog.pairs(spark, SF)
    rows = sorted(pairs.collect(), key=lambda r: (r["due_date"], r["instance_id"], -r["score"], abs(r["days"]), r["delta"], r["transaction_id"]))
    taken, done, want = set(), set(), set()
    for r in rows:
        if r["instance_id"] in done or r["transaction_id"] in taken:
            continue
        done.add(r["instance_id"])
        if r["match_type"] != "below_threshold":
            taken.add(r["transaction_id"])
            want.add((r["instance_id"], r["transaction_id"]))
    assert {(r["instance_id"], r["transaction_id"]) for r in reconcile.greedy(pairs).collect()} == want


def test_shared_payment_needs_one_subset(spark):
    i, t = _recon(
        spark,
        [(1, 1, "Acme Water", date(2026, 6, 1), D("75"), "outflow"), (2, 1, "Acme Sewer", date(2026, 6, 1), D("40"), "outflow"), (3, 2, "Acme", date(2026, 6, 1), D("50"), "outflow"),
         (4, 2, "Acme", date(2026, 6, 1), D("50"), "outflow"), (5, 2, "Acme", date(2026, 6, 1), D("50"), "outflow")],
        [("a", 1, date(2026, 6, 2), D("-115"), "Acme", ""), ("b", 2, date(2026, 6, 2), D("-100"), "Acme", "")],
    )
    assert {tuple(r) for r in reconcile.shared(i, t).collect()} == {("a", 1), ("a", 2)}


def test_observed_holidays_and_semi_monthly(spark):
    off = {str(r["day"]) for r in dates.holidays(spark, 2026, 2026).collect()}
    assert {"2026-07-03", "2026-01-19", "2026-11-26", "2026-05-25"} <= off
    pay = [str(r["pay_date"]) for r in dates.semi_monthly(spark, (15, 31), "2026-02-01", "2026-02-28").orderBy("pay_date").collect()]
    assert pay == ["2026-02-13", "2026-02-27"]


def test_due_dates(spark):
    df = spark.createDataFrame([("monthly", date(2026, 1, 31), date(2026, 4, 30), 30.0), ("weekly", date(2026, 1, 1), date(2026, 1, 15), None), ("irregular", date(2026, 1, 1), date(2026, 2, 1), None)], "c string, a date, t date, g double")
    got = [[str(x) for x in r[0]] for r in df.select(dates.due_dates(F.col("c"), F.col("a"), F.col("t"), F.col("g"))).collect()]
    assert got[0] == ["2026-01-31", "2026-02-28", "2026-03-31"] and got[1] == ["2026-01-01", "2026-01-08"]


def test_statement_rollup(spark):
    s = spark.createDataFrame([(1, 1, date(2026, 6, 21)), (2, 1, date(2026, 7, 21))], "id long, target long, closes date")
    i = spark.createDataFrame([(1, 1, date(2026, 6, 10), D("50")), (2, 1, date(2026, 6, 21), D("25")), (3, 1, date(2026, 6, 22), D("10")), (4, 1, date(2026, 7, 25), D("5"))], f"id long, target long, due_date date, amount {MONEY}")
    got = {(r["cycle_id"], r["n_inputs"], r["input_sum"]) for r in findings.rollup(i, s).collect()}
    assert got == {(1, 2, D("75.00")), (2, 1, D("10.00")), (None, 1, D("5.00"))}


def test_ledgers(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("c", 2), (None, 4)], "k string, v int")
    assert {tuple(r) for r in ledger.snapshot_diff(old, new, ["k"], ["v"]).collect()} == {("a", "unchanged"), ("b", "resolved"), ("c", "created"), (None, "updated")}
    t = spark.createDataFrame([("a", 1, "human"), ("b", 2, "human")], "k string, v int, s string")
    n = spark.createDataFrame([("a", 9, "auto"), ("c", 3, "auto")], "k string, v int, s string")
    assert {tuple(r) for r in ledger.upsert(t, n, ["k"], ["v"]).collect()} == {("a", 9, "human"), ("b", 2, "human"), ("c", 3, "auto")}


def test_empty_tables(spark):
    i, t = _recon(spark, [], [])
    assert reconcile.greedy(reconcile.candidates(i, t)).count() == 0
    ev = projection.events(_instances(spark, []), "2026-07-01", 30)
    assert projection.trough(ev, spark.createDataFrame([], f"entity_id long, starting {MONEY}"), "2026-07-01").count() == 0


def test_card_file(spark, tmp_path):
    (tmp_path / "card.csv").write_text(
        'Transaction Date,Clearing Date,Description,Merchant,Category,Type,Amount (USD)\n06/01/2026,06/02/2026,COFFEE,Cafe,Food,Purchase,"1,234.50"\n06/01/2026,06/02/2026,COFFEE,Cafe,Food,Purchase,"1,234.50"\nbad,,x,y,z,Purchase,1\n'
    )
    got = ingest.card_transactions(spark, str(tmp_path / "card.csv"), "acct").collect()
    assert len({r["id"] for r in got}) == 2 and {r["amount"] for r in got} == {D("-1234.50")} and {r["posted"] for r in got} == {date(2026, 6, 1)}


def test_stream_keeps_latest(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, D("1"), datetime(2026, 1, 1), "feed"), (2, 1, D("2"), datetime(2026, 1, 2), "feed"), (3, 2, D("3"), datetime(2026, 1, 1), "manual")], f"id long, account_id long, balance {MONEY}, recorded_at timestamp, source string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    stream_balances.keep_latest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {(r["account_id"], r["id"]) for r in stream_balances.kept(spark, str(tmp_path / "out")).collect()} == {(1, 2), (2, 3)}


def test_notes_against_records(spark):
    rows = [(1, "Quarterly now", "monthly", "expected", "estimated"), (2, "account CLOSED", "monthly", "paid", "estimated"), (3, "no longer active", "monthly", "expected", None),
            (4, "a guess", "annual", "expected", "confirmed"), (5, "yearly", "annual", "expected", "confirmed"), (6, None, None, None, None), (7, "disclosed", "monthly", "expected", "confirmed")]
    got = estimates.note_conflicts(spark.createDataFrame(rows, "id long, note string, cadence string, status string, amount_status string"))
    assert sorted(map(tuple, got.collect())) == [(1, "cadence", "quarterly", "monthly"), (3, "status", "no longer active", "expected"), (4, "amount_status", "guess", "confirmed")]


def test_check_suggestion_scores(spark):
    bills = [(1, 9, "rent", date(2026, 6, 1), D("300"))]
    checks = [("t", 9, date(2026, 6, 3), D("-302"), "Check # 17"), ("u", 9, date(2026, 6, 3), D("-302"), "Checking 17"), ("v", 9, date(2026, 6, 20), D("-300"), "CHECK 3")]
    b = lambda rows: spark.createDataFrame(rows, f"id long, entity_id long, obligation_id string, due_date date, amount {MONEY}")
    c = spark.createDataFrame(checks, f"id string, account_id long, posted date, amount {MONEY}, description string")
    paid = spark.createDataFrame([("rent", 9)] * 3, "obligation_id string, account_id long")
    got = estimates.check_suggestions(b(bills), c, paid).collect()
    assert [(r["instance_id"], r["transaction_id"], r["score"], r["ambiguous"]) for r in got] == [(1, "t", 0.803, False)]
    both = estimates.check_suggestions(b(bills + [(2, 9, "rent", date(2026, 6, 1), D("300"))]), c, paid).collect()
    assert [(r["score"], r["ambiguous"]) for r in both] == [(0.753, True)] * 2


def test_contradicted_and_dormant(spark):
    e = spark.createDataFrame([("a", 1, "gym", "monthly", 400.0), ("b", 1, "tv", "monthly", 400.0), ("c", 2, "gym", "monthly", 400.0), ("d", 1, "food", "monthly", 400.0)], "obligation_id string, account_id long, merchant_key string, cadence string, amount double")
    t = [(1, date(2026, 6, 20), D("-100"), "TV"), (1, date(2026, 5, 20), D("-100"), "TV"), (1, date(2026, 6, 20), D("-390"), "Food"), (1, date(2026, 1, 1), D("-900"), "gym")]
    t = spark.createDataFrame(t, f"account_id long, posted date, amount {MONEY}, payee string")
    got = {r["obligation_id"]: (r["observed"], r["resolution"], r["new_amount"]) for r in estimates.contradicted(e, t, "2026-06-30").collect()}
    assert got == {"a": (0.0, "dormant", None), "b": (66.67, "rewrite", 66.67)}
    held = spark.createDataFrame([(1, D("0")), (2, D("0"))], f"account_id long, balance {MONEY}")
    assert [r["obligation_id"] for r in estimates.dormant(e, held, t, "2026-06-30").collect()] == ["c"]


def test_provenance_and_backfill(spark):
    e = spark.createDataFrame([(1, 1, "gym", date(2026, 5, 9)), (2, 1, "none", date(2026, 5, 9)), (3, 1, "gym", date(2025, 5, 9))], "id long, account_id long, merchant_key string, due_date date")
    seen = spark.createDataFrame([(1, "gym", date(2026, 1, 31)), (1, "gym", date(2026, 3, 1)), (1, "gym", date(2026, 3, 9))], "account_id long, merchant_key string, posted date")
    got = sorted(tuple(r) for r in estimates.provenance(e, seen).collect())
    assert got == [(1, 2, 3, date(2026, 2, 1), False), (2, 0, None, None, False), (3, 2, 0, None, True)]
    i = spark.createDataFrame([(1, "rent", date(2026, 5, 31), D("10"), "outflow", "monthly"), (2, "rent", date(2026, 6, 30), D("10"), "outflow", "monthly"), (3, "pay", date(2026, 5, 31), D("1"), "inflow", "weekly")], f"id long, obligation_id string, due_date date, amount {MONEY}, direction string, cadence string")
    assert sorted(r["due_date"] for r in estimates.backfill(i, "2026-06-01").collect()) == [date(2026, 3, 31), date(2026, 4, 30)]


def test_audits(spark):
    i = [(1, "a", "Old lease", "rent", date(2026, 6, 1), D("100"), "expected"), (1, "b", "old lease ", "rent", date(2026, 6, 9), D("900"), "expected"), (1, "c", "Old leases", "rent", date(2026, 6, 9), D("100"), "expected"),
         (1, "d", "Old lease", "rent", date(2026, 7, 9), D("100"), "expected"), (2, "e", "Old lease", "rent", date(2026, 6, 9), D("100"), "expected"), (1, "f", "the old lease", "rent", date(2026, 6, 9), D("110"), "expected")]
    got = audit.overlaps(spark.createDataFrame(i, f"entity_id long, obligation_id string, name string, kind string, due_date date, amount {MONEY}, status string"))
    assert sorted((r["obligation_a"], r["obligation_b"], r["exact"]) for r in got.collect()) == [("a", "b", True), ("a", "f", False)]
    f = spark.createDataFrame([("x", D("1.00")), ("y", None)], f"key string, value {MONEY}")
    c = spark.createDataFrame([("x", D("1.01")), ("x", D("1.02")), ("y", D("1")), ("z", D("1"))], f"key string, value {MONEY}")
    assert sorted((r["key"], r["verdict"]) for r in audit.grounding(c, f).collect()) == [("x", "grounded"), ("x", "mismatch"), ("y", "mismatch"), ("z", "unsupported")]
    rows = spark.createDataFrame([(1, 1, "outflow", date(2026, 6, 5), D("100"), "Old lease"), (2, 1, "outflow", None, D("1"), "x"), (3, 1, "inflow", date(2026, 6, 5), D("100"), "Old lease")], f"id long, entity_id long, direction string, on_date date, amount {MONEY}, label string")
    known = spark.createDataFrame([(8, 1, "outflow", date(2026, 6, 12), D("104"), "lease"), (7, 1, "outflow", date(2026, 6, 12), D("104"), "lease")], f"id long, entity_id long, direction string, due_date date, amount {MONEY}, name string")
    assert sorted(tuple(r) for r in audit.already_modeled(rows, known).collect()) == [(1, 7, "already_modeled"), (2, None, "needs_review"), (3, None, "new")]
