import random
from datetime import date, datetime, timedelta
from decimal import Decimal as D

from cashtide.operators import digest, estimates, findings, surface

INSTANCE = "id long, obligation_id string, due_date date, amount decimal(18,2), status string, autopay boolean"


def _keys(df):
    return sorted(r["surface_key"] for r in df.collect())


def test_bills_by_lead_and_rejection(spark):
    day = date(2026, 5, 10)
    rows = [(1, "o:1", day, D(5), "expected", False), (2, "o:2", day + timedelta(5), D(5), "needs_review", False), (3, "o:3", day + timedelta(6), D(5), "expected", False),
            (4, "o:4", day, D(5), "expected", True), (5, "o:5", day, D(5), "paid", False), (6, "o:6", day - timedelta(3), D(5), "expected", False), (7, "o:7", day - timedelta(3), D(5), "expected", False),
            (8, "o:8", day - timedelta(3), D(5), "expected", False), (9, "o:9", None, D(5), "expected", False), (10, "o:10", day, D(5), "expected", None)]
    rejected = spark.createDataFrame([(6, day - timedelta(3)), (6, day - timedelta(9)), (7, day - timedelta(4)), (9, day), (None, day)], "instance_id long, rejected_on date")
    got = {r["surface_key"]: (r["severity"], r["subject"]) for r in surface.bills(spark.createDataFrame(rows, INSTANCE), rejected, "2026-05-10").collect()}
    assert got == {"obligation-due:o:1:2026-05-10": ("critical", "obligation-instance:1"), "obligation-due:o:2:2026-05-15": ("medium", "obligation-instance:2"), "obligation-due:o:6:2026-05-07": ("critical", "obligation-instance:6")}


def test_drift_is_snoozed_only_if_all_is_unchanged(spark):
    warnings = spark.createDataFrame([("a", D(30)), ("b", D(30)), ("c", D(30)), ("d", D(30)), ("e", D(30)), ("f", D(0))], "warning_id string, total decimal(18,2)")
    old, today = date(2026, 5, 9), date(2026, 5, 10)
    said = [("a", "active", old, D(-10)), ("a", "active", old, D(20)), ("b", "active", old, D(30)), ("b", None, None, None), ("c", "active", today, D(30)), ("d", "resolved", old, D(30)), ("e", "active", old, D(29))]
    quiet = surface.snoozed(warnings, spark.createDataFrame(said, "warning_id string, status string, updated_on date, impact decimal(18,2)"), "2026-05-10")
    assert [r[0] for r in quiet.collect()] == ["a"]


def test_old_balances_suppress_warnings_read_from_them(spark):
    found = spark.createDataFrame(
        [("1", "cash_floor", "high", 1, False), ("2", "cash_floor", "high", 2, False), ("3", "debt_avalanche", "low", 1, False), ("4", "drift_threshold", "medium", 2, None), ("5", "window_age", "low", 2, True), ("6", "drift_threshold", "medium", None, False)],
        "id string, rule_type string, severity string, entity_id long, advisory boolean",
    ).selectExpr("*", "cast(null as decimal(18,2)) as impact")
    stale, quiet = spark.createDataFrame([(1,), (1,), (None,)], "entity_id long"), spark.createDataFrame([("6",), ("2",)], "warning_id string")
    assert _keys(surface.guardrails(found, stale, quiet)) == ["guardrail:2", "guardrail:3", "guardrail:4"]


def test_jobs_and_queue(spark):
    runs = [("a", "succeeded", datetime(2026, 5, 9, 22)), ("b", "partial_success", datetime(2026, 5, 8)), ("c", "failed", datetime(2026, 5, 9, 23)), ("d", "succeeded", None)]
    table = spark.createDataFrame(runs, "run_type string, status string, finished_at timestamp")
    assert _keys(surface.stale_jobs(table, table, "2026-05-10 00:00:00")) == ["stale-job:b", "stale-job:c", "stale-job:d"]
    waiting = lambda *s: surface.onboarding(spark.createDataFrame([(x,) for x in s], "status string")).collect()
    assert waiting("parked", None) == [] and [int(r["amount"]) for r in waiting("proposed", "in_review", "applied")] == [2]


def _item(key, subject, kind="x"):
    return (key, kind, "low", subject, None, None)


ITEM = "surface_key string, type string, severity string, subject string, on_date date, amount decimal(18,2)"


def test_one_item_a_subject(spark):
    items = spark.createDataFrame([_item("estimate-review:o:1", "s1"), _item("obligation-due:o:1", "s1"), _item("check-suggestion:9", "s1"), _item("estimate-review:o:2", "s2"), _item("goal:1", None), _item("goal:2", None)], ITEM)
    assert _keys(surface.one_a_subject(items)) == ["check-suggestion:9", "estimate-review:o:2", "goal:1", "goal:2"]


def test_retire_keys_and_what_stays(spark):
    day = date(2026, 5, 10)
    items = spark.createDataFrame([
        _item("check-suggestion:new", "obligation-instance:1"), _item("obligation-due:a:1:2026-05-10", "obligation-instance:1", "obligation_due"), _item("estimate-review:a:1:2026-05-10", "obligation-instance:1"),
        _item("obligation-due:b:2:2026-05-12", "obligation-instance:2", "obligation_due"), _item("estimate-review:c:3:2026-05-10", "obligation-instance:3"),
    ], ITEM)
    stored = spark.createDataFrame([
        ("check-suggestion:old", "open"), ("check-suggestion:new", "open"), ("check-suggestion:shut", "retired"), ("onboarding-digest", "open"),
        ("obligation-due:a:1:2026-05-10", "open"),  # loses its subject, but an unpaid bill keeps its task
        ("estimate-review:a:1:2026-05-10", "open"),  # loses its subject
        ("estimate-review:a:1:2026-04-10", "open"),  # not built now: stays
        ("estimate-review:c:3:2026-05-10", "open"),  # wins
        ("obligation-due:b:2:2026-05-02", "open"),  # settled day, but the bill shows under a new key: it will follow
        ("obligation-due:d:4:2026-05-01", "open"), ("obligation-due:d:4:2026-05-02", "completed"), ("obligation-due:e", "open"),
    ], "surface_key string, status string")
    bills = spark.createDataFrame([(1, "a:1", day, D(1), "expected", False), (2, "b:2", day + timedelta(2), D(1), "expected", False), (4, "d:4", date(2026, 5, 1), D(1), "paid", False)], INSTANCE)
    got = {r["surface_key"]: r["reason"] for r in surface.retire_keys(items, stored, bills).collect()}
    assert got == {"check-suggestion:old": "check_decided", "onboarding-digest": "queue_empty", "estimate-review:a:1:2026-05-10": "subject", "obligation-due:d:4:2026-05-01": "settled"}


def test_empty_board(spark):
    none, stored = spark.createDataFrame([], ITEM), spark.createDataFrame([], "surface_key string, status string")
    assert surface.retire_keys(none, stored, spark.createDataFrame([], INSTANCE)).count() == 0 and surface.one_a_subject(none).count() == 0


def test_gaps_equal_counting_days(spark):
    r, start = random.Random(5), date(2026, 1, 1)
    kinds = [None, "weekly", "biweekly", "monthly", "quarterly", "odd"]
    rows = [(f"o{r.randrange(12)}", start + timedelta(r.randrange(-120, 150)), r.choice(kinds)) for _ in range(60)] + [("past", date(2020, 1, 1), "weekly"), ("nodate", None, "weekly")]
    got = {x["obligation_id"]: tuple(x)[1:] for x in digest.gaps(spark.createDataFrame(rows, "obligation_id string, due_date date, cadence string"), "2026-01-01", 100).collect()}
    want = {}
    for o in {x[0] for x in rows} - {"nodate"}:
        held = [any(d <= start + timedelta(n) < d + timedelta(digest.SPAN.get(c, 31)) for k, d, c in rows if k == o and d) for n in range(100)]
        text = "".join("x" if h else "." for h in held)
        islands, free = [p for p in text.split(".") if p], [len(p) for p in text.split("x") if p]
        want[o] = (len(islands), text.count("."), max(free, default=0), start + timedelta(text.rfind("x") + 1))
    assert got == want


def test_open_risks(spark):
    event = "id long, entity_id long, due_date date, amount decimal(18,2), direction string, amount_status string, status string, carried boolean, cadence string"
    day = date(2026, 5, 10)
    rows = [(1, 1, day, D(1000), "outflow", "confirmed", "expected", False, " Monthly "), (2, 1, day, D("999.99"), "outflow", "estimated", "needs_review", True, None), (3, 1, day, D(2000), "inflow", "estimated", "expected", False, None),
            (4, 1, day, D(2000), "outflow", "estimated", "needs_review", True, None), (5, 1, day, D(2000), "outflow", None, None, None, "weekly")]
    notes = spark.createDataFrame([(7, 1, date(2026, 5, 9), "pay $1,200.50 then $3", "pending"), (8, 1, date(2026, 6, 1), None, "pending"), (9, 1, date(2026, 6, 2), "$1", "pending"), (10, 1, day, "$1", "resolved")], "id long, entity_id long, surface_when date, text string, status string")
    got = {r["ref_id"]: (r["amount"], r["why"], r["blocks"]) for r in digest.open_risks(spark.createDataFrame(rows, event), notes, "2026-05-10", "2026-06-01").collect()}
    assert got == {
        "1": (D(1000), "confirmed recurring payment, not paid yet", False),
        "4": (D(2000), "past due and unreconciled; amount is still an estimate; flagged needs review; one-time payment (no recurring schedule on file)", True),
        "5": (D(2000), "confirmed recurring payment, not paid yet", False),
        "7": (D("1200.50"), "reminder is still unresolved (past its surface date)", True), "8": (None, "reminder is still unresolved", True),
    }


def test_coverage_counts(spark):
    roster = spark.createDataFrame([("a", True), ("b", False), ("b", None), ("c", None)], "obligation_id string, autopay boolean")
    events = spark.createDataFrame([("a",), ("a",), ("c",), ("gone",), (None,)], "obligation_id string")
    due, waiting = spark.createDataFrame([(1,), (2,)], "n int"), spark.createDataFrame([("proposed",), ("parked",), (None,)], "status string")
    assert tuple(digest.coverage(roster, events, due, waiting).collect()[0]) == (3, 1, 2, 3, 1, 1, 2, 1, 0, 1, 0)
    assert set(digest.coverage(roster.limit(0), events.limit(0), due.limit(0), waiting.limit(0)).collect()[0]) == {0}


def test_board_is_clean_only_if_written(spark):
    drift, tasks = "impact decimal(18,2)", "last_seen date"
    seen = lambda t, d: tuple(digest.board_health(spark.createDataFrame(t, tasks), spark.createDataFrame(d, drift)).collect()[0])
    assert seen([], []) == (None, 0, False) and seen([(date(2026, 1, 1),)], [(D(-200),)]) == (date(2026, 1, 1), 0, True) and seen([(date(2026, 1, 1),)], [(D(-201),), (None,)])[1:] == (1, False)


def test_color_takes_the_first_rule(spark):
    names = ["verify_error", "stale_balance", "worst_guardrail", "low", "low_estimate", "breach", "unmodeled_monthly", "material_estimate", "verify_warning", "open_risk"]
    bad = [True, True, 3, -1, -1, True, 100, True, True, True]
    calm = [False, None, 0, 9000, None, False, 99, None, False, None]
    reasons = ["verify_error", "stale_balance", "guardrail", "below_zero", "estimates_below_zero", "breach_risk", "unmodeled_recurring", "material_estimate", "verify_warning", "open_risk", "clear"]
    rows = [(k, *calm[:k], *bad[k:]) for k in range(len(names) + 1)]
    types = {"worst_guardrail": "int", "low": "int", "low_estimate": "int", "unmodeled_monthly": "int"}
    table = spark.createDataFrame(rows, "entity_id int, " + ", ".join(f"{n} {types.get(n, 'boolean')}" for n in names))
    got = [(r["reason"], r["color"]) for r in findings.status_color(table).orderBy("entity_id").collect()]
    assert got == list(zip(reasons, ["RED", "YELLOW", "RED", "RED", "RED", *["YELLOW"] * 5, "GREEN"], strict=True))


def _flat_rows(spark):
    at = lambda d: datetime(2026, 1, d)
    rows = [(1, 1, D(-50), at(1)), (2, 1, D(-90), at(10)), (3, 1, D(80), at(20)),  # 90 then 80 in the window: flat, whatever came before
            (4, 2, D(10), at(10)), (5, 2, D(11), at(20)), (6, 3, D(5), at(2)), (7, 4, D(20), at(10)), (8, 5, D(7), at(10)), (9, 5, D(9), at(10))]
    return spark.createDataFrame(rows, "id long, account_id long, balance decimal(18,2), recorded_at timestamp")


def test_flat_sums_magnitudes_over_an_estimates_accounts(spark):
    links = [("a", 1), ("a", 1), ("b", 2), ("c", 3), ("d", 4), ("both", 1), ("both", 2), ("half", 2), ("half", 3), ("tie", 5), ("none", None)]
    got = {r[0] for r in estimates.flat(spark.createDataFrame(links, "obligation_id string, account_id long"), _flat_rows(spark), "2026-01-10").collect()}
    assert got == {"a", "d", "both"}  # 100 to 91 for both; an account outside the window says nothing, and of one time the larger id is the later


def test_flat_balance_takes_the_lower_ratio(spark):
    e = spark.createDataFrame([("a", 1, "shop", "monthly", 360.0), ("b", 2, "shop", "monthly", 360.0)], "obligation_id string, account_id long, merchant_key string, cadence string, amount double")
    t = spark.createDataFrame([(a, date(2026, 1, 10 + 20 * k) if k < 1 else date(2026, 2, 10) if k == 1 else date(2026, 3, 10), D(-200), "Shop") for a in (1, 2) for k in range(3)], "account_id long, posted date, amount decimal(18,2), payee string")
    links = e.select("obligation_id", "account_id")
    flat = estimates.flat(links, _flat_rows(spark), "2026-01-10")
    fires = lambda **o: sorted(r["obligation_id"] for r in estimates.contradicted(e, t, "2026-03-31", **o).collect())
    assert fires() == [] and fires(flat=flat) == ["a"] and fires(ratio=1.8) == ["a", "b"]


def test_resolved_twice_is_resolved_once(spark):
    names = "id long, obligation_id string, amount decimal(18,2), amount_status string, amount_source string, status string"
    rows = [(1, "a", D(90), "estimated", None, "expected"), (2, "a", D(90), "confirmed", None, "expected"), (3, "a", D(90), "estimated", None, "paid"), (4, "b", D(90), "estimated", "average", "expected"), (5, "c", D(90), "estimated", None, None), (6, None, D(90), "estimated", None, "expected")]
    found = spark.createDataFrame([("a", "rewrite", 30.0), ("b", "dormant", None)], "obligation_id string, resolution string, new_amount double")
    table = spark.createDataFrame(rows, names)
    once = estimates.resolved(table, found)
    assert {r["id"]: (r["amount"], r["previous_amount"], r["action"]) for r in once.collect()} == {
        1: (D(30), D(90), "rewrite"), 2: (D(90), None, "kept"), 3: (D(90), None, "kept"), 4: (D(90), None, "dormant"), 5: (D(90), None, "kept"), 6: (D(90), None, "kept")
    }
    again = estimates.resolved(once.select(*table.columns), found)
    assert sorted(map(tuple, again.select(*table.columns).collect()), key=repr) == sorted(map(tuple, once.select(*table.columns).collect()), key=repr)
