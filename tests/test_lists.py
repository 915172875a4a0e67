"""Lists and statement status on fixtures: filters, order, pages, edges."""

from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from cashtide.operators import findings, lists

MONEY = "decimal(18,2)"


def test_filters_pages_and_nulls(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "b", 1), (4, None, None)], "id int, kind string, n int")
    ids = lambda **o: [r["id"] for r in lists.listed(rows, [F.desc("n"), F.asc("id")], **o).collect()]
    assert ids() == [2, 1, 3, 4] and ids(equal={"kind": None}) == [2, 1, 3, 4]
    assert ids(equal={"kind": "a"}) == [2, 1] and ids(least={"n": 2}, most={"n": 6}) == [1]
    assert ids(limit=2, offset=1) == [1, 3] and ids(offset=3) == [4] and ids(limit=0) == []


def _card(spark, closes, inputs, amount="300"):
    s = spark.createDataFrame([(i, 1, c) for i, c in enumerate(closes)], "id long, target long, closes date")
    i = spark.createDataFrame([(10 + k, 1, d, D(a)) for k, (d, a) in enumerate(inputs)], f"id long, target long, due_date date, amount {MONEY}")
    return s, i, spark.createDataFrame([(k, D(amount), "estimated") for k in range(len(closes))], f"id long, amount {MONEY}, amount_status string")


def status(spark, closes, inputs, amount="300", day="2026-06-20"):
    s, i, held = _card(spark, closes, inputs, amount)
    return findings.statement_status(findings.cycles(s), findings.rollup(i, s), held, day).collect()


CLOSES = [date(2026, 5, 10), date(2026, 6, 10), date(2026, 7, 10)]


def test_statement_status(spark):
    (r,) = status(spark, CLOSES, [(date(2026, 6, 11), "60"), (date(2026, 6, 12), "30")])
    assert (r["closed_id"], r["open_id"], r["opens"], r["spend"], r["n_inputs"], r["variance"], r["on_track"]) == (1, 2, date(2026, 6, 11), D("90"), 2, D("210"), "ahead")
    assert status(spark, CLOSES, [(date(2026, 6, 11), "94")])[0]["on_track"] == "behind"  # 9 of 29 days: 93.10


def test_statement_status_without_a_side(spark):
    (r,) = status(spark, CLOSES[:1], [])
    assert (r["closed_id"], r["open_id"], r["spend"], r["on_track"]) == (0, None, None, None)
    (r,) = status(spark, CLOSES[2:], [(date(2026, 7, 1), "5")])  # its opening day is not known
    assert (r["closed_id"], r["open_id"], r["spend"], r["on_track"]) == (None, 0, D("5"), None)
    assert status(spark, CLOSES, [], amount="0")[0]["on_track"] is None and status(spark, [], []) == []


def test_statement_list_and_closures(spark):
    s, i, _ = _card(spark, CLOSES, [(date(2026, 6, 12), "1"), (date(2026, 6, 11), "2"), (date(2026, 8, 1), "9")])
    assert {r["cycle_id"]: [x["input_id"] for x in r["inputs"]] for r in lists.statement_list(i, s).collect()} == {0: [], 1: [], 2: [11, 10]}
    f = spark.createDataFrame([(1, "business_closure", date(2026, 1, 2), "active"), (2, "business_closure", date(2026, 1, 2), "active"), (3, "business_closure", date(2026, 1, 3), "retired"), (4, "note", date(2026, 1, 2), "active")], "id int, fact_type string, fact_date date, status string")
    assert [str(r["day"]) for r in lists.closures(f, "2026-01-01", "2026-01-31").collect()] == ["2026-01-02"]
