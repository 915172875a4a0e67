import random
from datetime import date
from decimal import Decimal as D

from cashtide.operators import settlement

OUTCOME = "instance_id long, outcome string, transaction_id string, score double, amount_changed boolean, age_days int, past_grace boolean, status string"
STORED = "instance_id long, transaction_id string, match_type string, score double, as_of date, created_on date"
OPEN = "instance_id long, obligation_id string, due_date date, age_days int, past_grace boolean, as_of date, created_on date"
OLD, NEW = date(2026, 1, 1), date(2026, 2, 1)


def test_ledgers_after_a_run_and_after_the_same_run_again(spark):
    ran = spark.createDataFrame([(1, "auto", "t1", 0.9, False, 3, False, "paid"), (2, "shared", "t2", None, False, 3, False, "expected"), (3, "unmatched", None, None, False, 9, True, "needs_review"), (4, "unmatched", None, None, False, 1, False, "expected")], OUTCOME)
    stored = spark.createDataFrame([(1, "x", "needs_review", 0.6, OLD, OLD), (3, "y", "auto", 0.9, OLD, OLD), (9, "z", "auto", 1.0, OLD, OLD)], STORED)
    held = spark.createDataFrame([(2, "o", OLD, 1, False, OLD, OLD), (4, "o", OLD, 1, False, OLD, OLD), (8, "o", OLD, 1, False, OLD, OLD)], OPEN)
    bills = spark.createDataFrame([(n, "o", OLD) for n in (1, 2, 3, 4, 8, 9)], "id long, obligation_id string, due_date date")
    once = settlement.matches_after(stored, ran, "2026-02-01")
    assert sorted(map(tuple, once.collect())) == [(1, "t1", "auto", 0.9, NEW, OLD), (2, "t2", "needs_review", None, NEW, NEW), (9, "z", "auto", 1.0, OLD, OLD)]
    rest = settlement.unmatched_after(held, ran, bills, "2026-02-01")
    assert sorted(map(tuple, rest.collect())) == [(3, "o", OLD, 9, True, NEW, NEW), (4, "o", OLD, 1, False, NEW, OLD), (8, "o", OLD, 1, False, OLD, OLD)]
    assert sorted(settlement.matches_after(once, ran, "2026-02-01").collect()) == sorted(once.collect())
    assert sorted(settlement.unmatched_after(rest, ran, bills, "2026-02-01").collect()) == sorted(rest.collect())


def test_empty_ledgers(spark):
    none, bills = spark.createDataFrame([], OUTCOME), spark.createDataFrame([], "id long, obligation_id string, due_date date")
    assert settlement.matches_after(spark.createDataFrame([], STORED), none, "2026-02-01").count() == 0 and settlement.unmatched_after(spark.createDataFrame([], OPEN), none, bills, "2026-02-01").count() == 0


def _plain(ids, recorded, paid_by, said):
    """Decisions one by one against ledgers that they change."""
    ledger, state, out = dict(recorded), {}, {}
    for n, i, kind, t in sorted(said, key=lambda x: x[0]):
        if i not in ids:
            out[n] = ("unknown_instance", None, None)
        elif kind == "unconfirm":
            out[n] = ("expected", None, None)
        elif kind == "force" and t not in paid_by:
            out[n] = ("unknown_transaction", None, None)
        elif kind not in ("confirm", "force"):
            out[n] = ("unknown_kind", None, None)
        else:
            if kind == "force":
                ledger[i] = (t, 1.0)
            out[n] = ("paid", *ledger[i]) if i in ledger else ("no_match", None, None)
        if out[n][0] in ("paid", "expected"):
            state[i] = out[n]
    return out, state


def test_decisions_equal_taking_them_one_by_one(spark):
    r = random.Random(11)
    ids, paid_by = range(12), [f"t{k}" for k in range(5)]
    recorded = {i: (f"m{i}", 0.5 + i / 100) for i in ids if i % 3}
    said = [(n, r.choice([*range(15), None]), r.choice(["confirm", "force", "unconfirm", "confirm", "force", "odd", None]), r.choice([*paid_by, "gone", None])) for n in range(150)]
    table = spark.createDataFrame([(i, "expected", None, None, D(1)) for i in ids], "id long, status string, matched_transaction_id string, match_confidence double, amount decimal(18,2)")
    matches = spark.createDataFrame([(i, *m) for i, m in recorded.items()], "instance_id long, transaction_id string, score double")
    results = settlement.decided(table, matches, spark.createDataFrame([(t,) for t in paid_by], "id string"), spark.createDataFrame(said, "decision_id long, instance_id long, kind string, transaction_id string"))
    want, state = _plain(set(ids), recorded, set(paid_by), said)
    assert {x["decision_id"]: (x["outcome"], x["transaction_id"], x["score"]) for x in results.collect()} == want
    got = {x["id"]: (x["status"], x["matched_transaction_id"], x["match_confidence"]) for x in settlement.settled(table, results).collect()}
    assert got == {i: state.get(i, ("expected", None, None)) for i in ids}
