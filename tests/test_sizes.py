"""What queries plan at once and leave on disk, on small tables."""

import time
from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from cashtide.operators import audit, estimates, reconcile, recurring
from cashtide.plans import attention
from cashtide.sources import adapters
from cashtide.sources.tables import CLEANUP, saved

SMALL, MONEY = "/root/testdata/sf0.001", "decimal(18,2)"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}


def _left(spark, before):
    """Shuffle files besides those of `before`; they go in the background."""
    for _ in range(40):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.25)
    return _shuffle_files(spark) - before


def test_saved_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    was = spark.conf.get(CLEANUP)
    df = saved(spark.range(3000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not _left(spark, before)
    assert spark.conf.get(CLEANUP) == was and sorted(map(tuple, df.collect()))[:2] == [(0, 429), (1, 429)]


def test_amounts_and_days_are_made_before_the_joins(spark):
    plan = _plan(adapters.transactions(spark, SMALL))
    assert plan.index("Join") < plan.index("l_returnflag") and "l_returnflag" not in plan.splitlines()[0]


@pytest.mark.parametrize("query", [attention.surface_retire, attention.surface_by_subject])
def test_last_plan_reads_no_transactions(spark, query):
    plan = _plan(query(spark, SMALL))
    assert "l_orderkey" not in plan and len(plan.splitlines()) < 120


def test_checks_that_are_taken_leave_their_rivals_alone(spark):
    bills = spark.createDataFrame([(1, 9, "rent", date(2026, 6, 1), D(300)), (2, 9, "rent", date(2026, 6, 8), D(300)), (3, 9, "rent", None, D(300))], f"id long, entity_id long, obligation_id string, due_date date, amount {MONEY}")
    days = [date(2026, 5, 24), date(2026, 5, 25), date(2026, 6, 3), date(2026, 6, 15), date(2026, 6, 16), None]
    checks = spark.createDataFrame([(f"t{k}", 9, day, D(-300), "CHECK 3") for k, day in enumerate(days)], f"id string, account_id long, posted date, amount {MONEY}, description string")
    paid = spark.createDataFrame([("rent", 9)], "obligation_id string, account_id long")
    met = lambda **o: sorted((r["instance_id"], r["transaction_id"], r["ambiguous"]) for r in estimates.check_suggestions(bills, checks, paid, **o).collect())
    assert met() == [(1, "t1", False), (1, "t2", True), (2, "t2", True), (2, "t3", False)]  # seven days before and after, not eight
    taken = spark.createDataFrame([("t2",), ("t2",), ("t1",)], "transaction_id string")
    assert met(spoken_for=taken) == [(2, "t3", False)]


def test_rows_are_not_listed_by_day(spark):
    rows = spark.createDataFrame([(k, 1, "outflow", date(2026, 6, k + 1), D(100), "Old lease") for k in range(28)] + [(7, 1, "outflow", date(2026, 6, 2), D(9), "Old lease")], f"id long, entity_id long, direction string, on_date date, amount {MONEY}, label string")
    known = spark.createDataFrame([(8, 1, "outflow", date(2026, 6, 15), D(104), "lease"), (7, 1, "outflow", date(2026, 6, 16), D(104), "lease"), (5, 1, "outflow", None, D(104), "lease")], f"id long, entity_id long, direction string, due_date date, amount {MONEY}, name string")
    before = _shuffle_files(spark)
    found = audit.already_modeled(rows, known)
    assert "on_date" in _plan(found) and "explode" not in _plan(found) and not _left(spark, before)
    first = {k: 8 if 8 <= k + 1 <= 22 else 7 if k + 1 == 23 else None for k in range(28)}
    assert sorted(((r["id"], r["instance_id"]) for r in found.collect()), key=repr) == sorted([*first.items(), (7, 8)], key=repr)  # a second row of an id stays a row


def test_only_charges_that_fit_a_bill_are_asked_whether_they_are_spoken_for(spark):
    end = date(2026, 6, 1)
    bills = [("a", 1, "Gym fees", "outflow", D(30), end), ("b", 2, "Gym fees", "outflow", D(400), end), ("c", 3, "Gym fees", "outflow", None, end)]
    ended = spark.createDataFrame(bills, f"obligation_id string, entity_id long, name string, direction string, last_amount {MONEY}, cancelled_on date")
    moved = [(1, -1), (1, -80), (1, D("-80.01")), (1, 30), (1, None), (2, -350), (2, D("-349.99")), (2, -450), (2, D("-450.01")), (2, -400), (3, -30)]
    rows = [(f"t{k}", a, date(2026, 6, 2), None if m is None else D(m), "GYM", "fees") for k, (a, m) in enumerate(moved)]
    rows += [("same day", 1, end, D(-30), "GYM", "fees"), ("other", 1, date(2026, 6, 2), D(-30), "TV", "plan"), ("taken", 1, date(2026, 6, 2), D(-30), "GYM", "fees")]
    charges = spark.createDataFrame(rows, f"id string, account_id long, posted date, amount {MONEY}, payee string, description string")
    taken = spark.createDataFrame([("taken",), ("taken",), ("t99",)], "transaction_id string")
    found = reconcile.after_cancellation(ended, charges, taken, reconcile.Options(amount_abs="50.00", amount_pct="0.100"))
    assert sorted((r["obligation_id"], r["transaction_id"]) for r in found.collect()) == [("a", "t0"), ("a", "t1"), ("b", "t5"), ("b", "t7"), ("b", "t9")]
    plan = _plan(found)
    assert plan.index("LeftAnti") < plan.index("Inner")


def test_guardrail_items_read_drift_once(spark):
    plan = _plan(attention._items(spark, SMALL))
    assert "l_orderkey" not in plan and len(plan.splitlines()) < 420


def test_single_charges_are_not_aggregated(spark):
    day = lambda k: date(2026, 6, k)
    rows = [("1", 1, day(1), D(-5), "Gym", None), ("2", 1, day(1), D(-5), "gym", None), ("3", 1, day(1), D(-5), "TV", None), ("4", 1, day(2), D(5), "TV", None), ("5", 2, day(3), D(-5), "Gym", None)]
    charges = spark.createDataFrame(rows, f"id string, account_id long, posted date, amount {MONEY}, payee string, description string")
    found = recurring.statistics(charges, spark.createDataFrame([(1, "checking"), (2, "card")], "account_id long, kind string"))
    assert [(r["account_id"], r["merchant_key"], r["n"]) for r in found.collect()] == [(1, "gym", 2)]
    plan = _plan(found)
    assert plan.index("Aggregate") < plan.index("charges#") and "(n#" not in plan.split("Aggregate")[0]
