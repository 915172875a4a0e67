"""Statements, emissions, the board, findings and nested windows on fixtures worked out by hand."""

from datetime import date, datetime
from decimal import Decimal as D

from pyspark.sql import functions as F

from cashtide.operators import board, checks, emissions, ids, ledger, projection, roster, statements

MONEY = "decimal(18,2)"
STM = f"id long, target long, closes date, due_date date, amount {MONEY}, amount_status string, amount_source string, baseline {MONEY}, confidence string, notes string"
DAY = date(2026, 1, 31)


def _statement(i, amount, status="estimated", source=None, baseline=None, target=1, closes=DAY):
    return (i, target, closes, closes, D(amount), status, source, None if baseline is None else D(baseline), "high", "own")


def test_recompute_twice_changes_nothing_and_nothing_drops(spark):
    rows = [_statement(1, "500"), _statement(2, "80"), _statement(3, "500", "confirmed"), _statement(4, "500", source="actual"), _statement(5, "500"), _statement(6, "900", source=statements.ROLLUP, baseline="300"), _statement(7, "-500")]
    table = spark.createDataFrame(rows, STM)
    sums = spark.createDataFrame([(i, 1, D(s), c) for i, s, c in ((1, "120", "low"), (2, "100", None), (3, "9", None), (4, "9", None), (6, "700", "high"), (7, "120", None))], f"cycle_id long, n_inputs long, input_sum {MONEY}, confidence string")
    once = statements.recompute(table, sums)
    got = {r.id: (str(r.amount), r.amount_source, r.confidence, r.action) for r in once.collect()}
    roll = statements.ROLLUP
    assert got == {1: ("500.00", roll, "low", "updated"), 2: ("100.00", roll, "low", "updated"), 3: ("500.00", None, "high", "confirmed"), 4: ("500.00", "actual", "high", "protected"), 5: ("500.00", None, "high", "no_cycle"),
                   6: ("1000.00", roll, "high", "updated"), 7: ("500.00", roll, "low", "updated")}
    twice = statements.recompute(once.drop("action"), sums)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))
    less = sums.withColumn("input_sum", (F.col("input_sum") - 50).cast(MONEY))
    floored = {r.id: (str(r.amount), r.action) for r in statements.recompute(once.drop("action"), less).collect()}
    assert floored[1] == ("500.00", "floored") and floored[6] == ("1000.00", "floored")
    assert {r.id: str(r.amount) for r in statements.recompute(once.drop("action"), less, "10").collect()}[1] == "80.00"


def test_cycles_of_inputs(spark):
    table = spark.createDataFrame([_statement(2, "1", closes=date(2026, 1, 31)), _statement(1, "1", closes=date(2026, 2, 28)), _statement(3, "1", target=9)], STM)
    inputs = [(1, 1, date(2026, 1, 31), D("5"), "high"), (2, 1, date(2026, 2, 1), D("-7"), "very_low"), (3, 1, date(2026, 3, 1), D("9"), None), (4, None, DAY, D("1"), None), (5, 1, date(2025, 1, 1), D("2"), None)]
    got = statements.cycles(table, spark.createDataFrame(inputs, f"id long, target long, due_date date, amount {MONEY}, confidence string")).collect()
    assert {r.cycle_id: (r.n_inputs, str(r.input_sum), r.confidence) for r in got} == {2: (2, "7.00", "high"), 1: (1, "7.00", "low"), 3: (0, "0.00", None)}


def test_observed_amounts(spark):
    feb = date(2026, 2, 28)
    table = spark.createDataFrame([_statement(1, "10"), _statement(2, "20"), _statement(3, "30", closes=feb)], STM)
    asked = [(1, 1, DAY, None), (2, 1, None, feb), (3, 1, None, None), (4, 1, date(2020, 1, 1), None), (5, 1, feb, feb), (6, 1, feb, DAY)]
    actuals = spark.createDataFrame([(i, t, c, e, D(-i), "portal_statement_amount", "n" if i == 5 else None) for i, t, c, e in asked], f"actual_id long, target long, closes date, due_date date, amount {MONEY}, source string, note string")
    got = {r.actual_id: (r.statement_id, r.outcome) for r in statements.observed(table, actuals).collect()}
    assert got == {1: (None, "ambiguous"), 2: (3, "set"), 3: (None, "unnamed"), 4: (None, "unknown"), 5: (3, "set"), 6: (None, "unknown")}
    done = {r.id: (str(r.amount), r.amount_status, r.notes) for r in statements.set_actual(table, actuals).collect()}
    assert done == {1: ("10.00", "estimated", "own"), 2: ("20.00", "estimated", "own"), 3: ("5.00", "confirmed", "n")}
    kept = statements.recompute(statements.set_actual(table, actuals), spark.createDataFrame([(3, 1, D("99"), None)], f"cycle_id long, n_inputs long, input_sum {MONEY}, confidence string"))
    assert [r.action for r in kept.where("id = 3").collect()] == ["confirmed"]


RAW = "batch long, seq long, kind string, surface_key string, content_hash string, task_id string, status string, gone boolean"
JAN, FEB, MAR = (f"obligation-due:b1:2026-0{m}-01" for m in (1, 2, 3))
LIFE = [
    (1, 1, "item", JAN, "a", None, None, False), (1, 2, "item", "followup:7", "a", None, None, False), (1, 3, "bill", JAN, None, None, "open", False),
    (2, 1, "item", FEB, "a", None, None, False),  # January's bill is still open: a second task
    (3, 1, "bill", JAN, None, None, "paid", False), (3, 2, "item", MAR, "b", None, None, False),  # the oldest open task of a settled bill moves
    (3, 3, "item", FEB, "a", None, None, False), (3, 4, "retire", "followup:7", None, None, None, False), (3, 5, "item", "followup:7", "a", None, None, False),
    (4, 1, "close", MAR, None, None, "completed", False), (4, 2, "item", MAR, "c", None, None, False), (4, 3, "item", FEB, "z", None, None, True), (4, 4, "item", FEB, "z", None, None, False),
    (5, 1, "adopt", "goal", "g", "t9", None, False), (5, 2, "item", "goal", "g", None, None, False), (5, 3, "adopt", "goal", "x", "t10", None, False), (5, 4, "item", None, "g", None, None, False),
]


def test_emissions_step_by_step(spark):
    rows = emissions.replay(emissions.events(spark.createDataFrame(LIFE, RAW))).collect()
    done = {(r.batch, r.seq): (r.action, r.task_id, r.rekeyed_from) for r in rows if r.action}
    assert done == {
        (1, 1): ("created", "1-1", None), (1, 2): ("created", "1-2", None), (2, 1): ("created", "2-1", None), (3, 2): ("rekeyed", "1-1", JAN), (3, 3): ("skipped", "2-1", None), (3, 4): ("retired", "1-2", None),
        (3, 5): ("created", "3-5", None), (4, 2): ("resolved", "1-1", None), (4, 3): ("closed", "2-1", None), (4, 4): ("resolved", "2-1", None), (5, 1): ("adopted", "t9", None), (5, 2): ("skipped", "t10", None), (5, 3): ("updated", "t10", None),
    }
    ledger_ = {r.surface_key: (r.task_id, r.status, r.content_hash, r.created) for r in rows if not r.action}
    assert ledger_ == {MAR: ("1-1", "completed", "b", 1), FEB: ("2-1", "deleted_by_user", "a", 2), "followup:7": ("3-5", "open", "a", 3), "goal": ("t10", "open", "g", 5)}


def test_stream_of_emissions_equals_replay(spark, tmp_path):
    events = emissions.events(spark.createDataFrame(LIFE, RAW))
    for batch in (1, 2, 3, 4, 5):
        events.where(F.col("batch") == batch).coalesce(1).write.parquet(str(tmp_path / f"in/{batch}"))
    read = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*"))
    q = emissions.stream(read).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = spark.read.schema(emissions.RESULT).parquet(str(tmp_path / "out")).where("action is not null")
    want = emissions.replay(events).where("action is not null")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_board(spark):
    key = "[fa:bill:1]"
    tasks = [
        (10, 1, "Pay", key, True), (9, 2, "Pay", key, True), (30, 3, "Same", "", True), (29, 4, "Same", "", True), (40, 5, "Mine", None, False), (41, 6, "Mine", None, False), (50, 7, "Lone", "", True),
        (60, 8, "Onboard charge: Gym not modeled", "", False), (61, 9, "Onboard charge: Nobody", "", True), (70, 10, None, None, None), (80, 11, "[fa:x", "[fa: ]", False),
    ]
    t = spark.createDataFrame(tasks, "task_id long, position int, content string, description string, labelled boolean")
    e = spark.createDataFrame([("bill:1", 10, "open"), ("bill:2", 77, "open"), ("bill:3", 50, "retired")], "surface_key string, task_id long, status string")
    c = spark.createDataFrame([(1, "Gym", None, "proposed"), (2, " gym ", None, "parked"), (3, None, "nobody", "proposed")], "id long, display_name string, merchant_key string, status string")
    got = {r.task_id: (r["class"], r.action, r.survivor_id) for r in board.classify(t, e, c).collect()}
    assert got == {
        10: ("managed", "kept", None), 9: ("duplicate", "would_delete", 10), 29: ("kept", "kept", None), 30: ("duplicate", "would_delete", 29), 40: ("kept", "kept", None), 41: ("kept", "kept", 40), 50: ("fa_auto_orphan", "would_delete", None),
        60: ("stale_applied", "would_delete", None), 61: ("stale_applied", "needs_review", None), 70: ("kept", "kept", None), 80: ("kept", "kept", None),
    }
    assert [tuple(r) for r in board.orphans(t, e).collect()] == [("bill:2", 77)]


def test_findings_merge(spark):
    s = "source string, check_id string, evidence string, title string"
    stored = [(1, "deterministic", "a", "x", "t", "open"), (2, "deterministic", "a", "y", "t", "acknowledged"), (3, "deterministic", "a", "z", "t", "acknowledged"), (4, "deterministic", "b", "x", "t", "open"),
              (5, "adversarial", "a", "x", "t", "open"), (6, "adversarial", "a", "x", "u", "acknowledged"), (7, "deterministic", "a", "w", "t", "resolved"), (8, "deterministic", "a", None, None, "open")]
    current = [("deterministic", "a", "x", "new title"), ("deterministic", "a", "y", "t"), ("deterministic", "a", "w", "t"), ("deterministic", "a", "w", "t"), ("adversarial", "a", "x", "u"), ("deterministic", "a", None, None), ("deterministic", "c", "x", "t")]
    ran = spark.createDataFrame([("deterministic", "a"), ("adversarial", "a")], "source string, check_id string")
    df = spark.createDataFrame(stored, f"id long, {s}, status string")
    got = checks.merge(df, spark.createDataFrame(current, s), ran).collect()
    assert {r.id: r.status for r in got if r.id} == {1: "open", 2: "acknowledged", 3: "resolved", 4: "open", 5: "resolved", 6: "acknowledged", 7: "resolved", 8: "open"}
    assert sorted((r.source, r.evidence, r.title) for r in got if not r.id) == [("adversarial", "x", "u"), ("deterministic", "w", "t")]
    assert checks.merge(df, spark.createDataFrame([], s), ran.limit(0)).where("change <> 'kept'").count() == 0


INST = f"id long, entity_id long, due_date date, amount {MONEY}, direction string, status string, discretionary boolean, required_minimum {MONEY}"


def test_windows_equal_separate_folds(spark):
    rows = [(i, i % 3, date(2026, 1, 1 + i), D(400 + 37 * i), "inflow" if i % 4 == 0 else "outflow", "expected", i % 5 == 0, D(i)) for i in range(28)]
    inst = spark.createDataFrame(rows, INST)
    held = spark.createDataFrame([(e, D("3100"), date(2026, 1, 10)) for e in range(4)], f"entity_id long, balance {MONEY}, snapshot_date date")
    none = inst.limit(0).select("id")
    for n in (3, 12):
        mine = projection.windows(inst, held, none, "2026-01-10", (3, 12)).where(f"window_days = {n}").select("entity_id", "ending", "low", "low_date")
        late = projection.events(inst, "2026-01-10", n, none)
        other = projection.capped_trough(late, held.select("entity_id", F.col("balance").alias("starting")), "2026-01-10").select("entity_id", "ending", "low", "low_date")
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, other.collect()))


def test_windows_move_the_observation_under_the_cap(spark):
    rows = [(1, 1, date(2026, 1, 5), D("900"), "outflow", "expected", True, D("100")), (2, 1, date(2026, 1, 6), D("50"), "outflow", "expected", False, D("0")), (3, 1, date(2026, 1, 1), D("30"), "outflow", "expected", False, D("0")),
            (4, 1, date(2026, 1, 1), D("70"), "outflow", "expected", False, D("0")), (5, 1, date(2026, 1, 20), D("10"), "outflow", "expected", False, D("0")), (6, 1, date(2026, 1, 10), D("5"), "inflow", "paid", False, D("0"))]
    inst = spark.createDataFrame(rows, INST)
    held = spark.createDataFrame([(1, D("2700"), date(2026, 1, 2)), (2, D("5"), None)], f"entity_id long, balance {MONEY}, snapshot_date date")
    got = projection.windows(inst, held, inst.where("id = 4"), "2026-01-10", (7, 30)).collect()
    assert {(r.entity_id, r.window_days): (str(r.starting), str(r.ending), str(r.low), str(r.low_date), r.n_carried, r.n_events) for r in got} == {
        (1, 7): ("2450.00", "2420.00", "2420.00", "2026-01-10", 1, 1), (1, 30): ("2450.00", "2410.00", "2410.00", "2026-01-20", 1, 2),
        (2, 7): ("5.00", "5.00", "5.00", "2026-01-10", 0, 0), (2, 30): ("5.00", "5.00", "5.00", "2026-01-10", 0, 0),
    }


def test_manual_rows_of_other_days_stay(spark):
    at = [datetime(2026, 1, 5, 9), datetime(2026, 2, 5, 8), datetime(2026, 2, 5, 9), datetime(2026, 2, 5, 10)]
    rows = [(i + 1, 1, t, "feed" if i == 3 else "manual") for i, t in enumerate(at)]
    gone = roster.superseded_manual(spark.createDataFrame(rows, "id long, account_id long, recorded_at timestamp, source string"))
    assert [r.id for r in gone.collect()] == [2]


def test_upsert_takes_the_latest_change(spark):
    old = spark.createDataFrame([(1, "a")], "k long, v string")
    new = spark.createDataFrame([(1, "z", 1), (1, "b", 2), (2, "c", 1)], "k long, v string, at int")
    assert {r.k: r.v for r in ledger.upsert(old, new, ["k"], latest="at").collect()} == {1: "b", 2: "c"}


def test_instance_ids(spark):
    day, at = date(2026, 7, 31), "o:2026-07-31"
    new = spark.createDataFrame([(o, day, n) for o in ("o", "p", "q", "o:2026") for n in (3, 1, 2)], "obligation_id string, due_date date, seq int")
    stored = spark.createDataFrame([(at, "o", day), ("p:2026-07-31:2", "p", day), ("p:2026-07-31:x", "p", day), ("q:2026-07-31:0", "q", day), ("other:2", "o", day)], "instance_id string, obligation_id string, due_date date")
    got = {(r.obligation_id, r.seq): r.instance_id.split("-31")[1] for r in ids.allocate(new, stored).collect()}
    assert got == {("o", 1): "", ("o", 2): ":1", ("o", 3): ":2", ("p", 1): ":1", ("p", 2): ":3", ("p", 3): ":4", ("q", 1): ":1", ("q", 2): ":2", ("q", 3): ":3", ("o:2026", 1): "", ("o:2026", 2): ":1", ("o:2026", 3): ":2"}
    assert [r.instance_id for r in ids.allocate(new.where("seq = 1 and obligation_id = 'o'"), stored).collect()] == [at]
