"""Keyed tables, schedules, ids and verdicts on fixtures worked out by hand."""

from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from cashtide.functions import dates, identity, text
from cashtide.operators import findings, ledger, roster

ROW = "k string, a long, b string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upsert_and_insert_with_null_and_repeated_keys(spark):
    table = spark.createDataFrame([("x", 1, "old"), (None, 2, "old"), ("z", 3, "old")], ROW)
    more = spark.createDataFrame([("x", 5, "new"), ("x", 6, "new"), (None, 7, "new"), ("y", 8, "new"), ("y", 9, "new")], ROW)
    assert rows(ledger.upsert(table, more, ["k"])) == sorted([("x", 6, "new"), (None, 7, "new"), ("y", 9, "new"), ("z", 3, "old")], key=repr)
    assert rows(ledger.upsert(table, more, ["k"], refresh=["a"])) == sorted([("x", 6, "old"), (None, 7, "old"), ("y", 9, "new"), ("z", 3, "old")], key=repr)
    assert rows(ledger.insert_absent(table, more, ["k"])) == sorted([("x", 1, "old"), (None, 2, "old"), ("z", 3, "old"), ("y", 8, "new")], key=repr)
    assert ledger.upsert(table.limit(0), more.limit(0), ["k"]).count() == 0


def test_update_delete_acknowledge_and_page(spark):
    t = spark.createDataFrame([(1, "active", None), (2, "resolved", None), (3, None, None)], "id long, status string, note string")
    assert rows(ledger.update_where(t, F.col("status") == "active", {"note": F.lit("n")})) == [(1, "active", "n"), (2, "resolved", None), (3, None, None)]
    assert rows(ledger.delete_where(t, F.col("status") == "active")) == [(2, "resolved", None), (3, None, None)]
    assert rows(ledger.acknowledge(t, t.select("id"), "ok")) == [(1, "acknowledged", "ok"), (2, "resolved", None), (3, None, None)]
    assert [r.id for r in ledger.page(t, [F.desc("id")], 1, 1).collect()] == [2] and ledger.page(t, [F.asc("id")], offset=2).count() == 1


def test_schedules_at_the_edges_of_a_range(spark):
    assert [r.pay_date for r in dates.semi_monthly(spark, (15, 31), "2026-01-01", "2026-01-30").orderBy("pay_date").collect()] == [date(2026, 1, 15), date(2026, 1, 30)]
    assert dates.every_two_weeks(spark, "2026-05-01", "2026-01-01", "2026-02-01").count() == 0
    assert [r.pay_date for r in dates.every_two_weeks(spark, "2026-01-02", "2026-01-10", "2026-02-01").orderBy("pay_date").collect()] == [date(2026, 1, 16), date(2026, 1, 30)]


def test_titles_beyond_ascii_and_goals_of_nothing(spark):
    assert spark.range(1).select(text.titled(F.lit("cafés du monde o'neil"))).head()[0] == "Cafés Du Monde O'Neil"
    g = spark.createDataFrame([(1, D(0), D(-5), date(2026, 1, 1), date(2026, 12, 31), True)], "id long, target decimal(18,2), progress decimal(18,2), created date, deadline date, trackable boolean")
    assert findings.goal_pace(g, "2026-06-30").head()["status"] == "behind"


def test_ids_follow_from_their_fields(spark):
    import hashlib
    import json

    fields = {"kind": "note", "source": None, "text": 'é "q" \\ a\nb'}
    got = spark.range(1).select(identity.digest_id("mem", {k: F.lit(v).cast("string") for k, v in fields.items()})).head()[0]
    assert got == "mem_" + hashlib.sha256(json.dumps(fields, sort_keys=True).encode()).hexdigest()[:16]
    said = "Pay [fa: x:1 ] $1,200.5 by March 3"
    one = spark.range(1).select(identity.surface_key(F.lit(said)), identity.amount_in(F.lit(said)), identity.month_day(F.lit(said), 2026), identity.month_day(F.lit("feb 30"), 2026)).head()
    assert tuple(one) == ("x:1", D("1200.50"), date(2026, 3, 3), None)


def test_income_is_created_kept_updated_and_cancelled(spark):
    money = "decimal(18,2)"
    src = spark.createDataFrame([(1, "m", D(100))], f"source_id long, schedule string, amount {money}")
    pay = spark.createDataFrame([("m", date(2026, 1, d)) for d in (5, 6, 7)], "schedule string, pay_date date")
    old = spark.createDataFrame([(1, date(2026, 1, d), D(a), s) for d, a, s in ((5, 100, "expected"), (6, 90, "expected"), (8, 100, "expected"), (9, 100, "paid"))], f"source_id long, pay_date date, amount {money}, status string")
    assert [(r.pay_date.day, r.action) for r in roster.expand_income(src, pay, old, "2026-01-01", "2026-01-31").orderBy("pay_date").collect()] == [(5, "kept"), (6, "updated"), (7, "created"), (8, "cancelled")]


def test_floor_verdict_is_withheld(spark):
    low = spark.createDataFrame([(k, D(v)) for k, v in ((1, 5), (2, 5), (3, 5), (4, 5), (5, 9000))], "entity_id long, low decimal(18,2)")
    held = spark.createDataFrame([(2, True), (3, False), (4, False), (5, False)], "entity_id long, stale boolean")
    got = roster.floor_verdicts(low, held, spark.createDataFrame([(3,)], "entity_id long"), 2500, 7)
    assert [(r.entity_id, r.verdict, r.severity) for r in got.orderBy("entity_id").collect()] == [(1, "missing_working_balance", "low"), (2, "stale_working_balance", "low"), (3, "missing_account_data", "low"), (4, "breach", "high")]
