"""Claims, shared payments and whole reconciliation runs: against one-by-one work and on fixtures."""

import random
from datetime import date, timedelta
from decimal import Decimal as D
from itertools import combinations

import pytest

from cashtide.operators import reconcile

MONEY = "decimal(18,2)"
PAIR = f"instance_id long, transaction_id string, due_date date, days int, delta {MONEY}, score double, match_type string"


def tables(spark, inst, txn):
    """Instances (id, entity, name, due, amount, obligation) of open outflows, transactions (id, account, posted, amount, payee)."""
    i = spark.createDataFrame([(a, e, n, d, D(m), "outflow", o, "expected") for a, e, n, d, m, o in inst], f"id long, entity_id long, name string, due_date date, amount {MONEY}, direction string, obligation_id string, status string")
    t = spark.createDataFrame([(a, e, d, D(m), p, "") for a, e, d, m, p in txn], f"id string, account_id long, posted date, amount {MONEY}, payee string, description string")
    return i, t


def one_by_one(pairs):
    taken, done, out = set(), set(), set()
    for r in sorted(pairs, key=lambda r: (r[2], r[0], -r[5], abs(r[3]), r[4], r[1])):
        if r[0] in done or r[1] in taken:
            continue
        done.add(r[0])
        if r[6] != "below_threshold":
            taken.add(r[1])
            out.add((r[0], r[1]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_claims_equal_one_by_one_in_dense_conflicts(spark, seed):
    rng = random.Random(seed)
    rows = [
        (i, f"t{t}", date(2026, 1, 1) + timedelta(days=i // 3), rng.randrange(-3, 4), D(rng.randrange(4)), rng.randrange(5) / 4, rng.choice(["auto", "needs_review", "below_threshold"]))
        for i in range(120) for t in {max(0, i + rng.randrange(-6, 7)) for _ in range(5)}
    ]
    got = {(r["instance_id"], r["transaction_id"]) for r in reconcile.greedy(spark.createDataFrame(rows, PAIR)).collect()}
    assert got == one_by_one(rows)


def test_a_chain_of_claims_gives_way_to_its_end(spark):
    # each instance would rather have the transaction of the one before it
    rows = [(i, f"t{t}", date(2026, 1, 1), 0, D(0), s, "auto") for i in range(12) for t, s in ((max(i - 1, 0), 0.9), (i, 0.8))]
    got = {(r["instance_id"], r["transaction_id"]) for r in reconcile.greedy(spark.createDataFrame(set(rows), PAIR)).collect()}
    assert got == one_by_one(rows)


def test_shared_payments_equal_one_by_one(spark):
    rng, day = random.Random(4), date(2026, 3, 1)
    inst = [(i, i % 2, "Acme Water", day + timedelta(days=rng.randrange(20)), rng.choice([10, 20, 35, 50, 80]), "o") for i in range(44)]
    txn = [(f"t{k:02}", k % 2, day + timedelta(days=rng.randrange(20)), -rng.choice([30, 45, 60, 115, 130, 260]), "Acme") for k in range(40)]
    opts = reconcile.Options(window=2, amount_abs="0.50", amount_pct="0.001")
    used, want = set(), set()
    for t in sorted(txn, key=lambda t: (t[2], t[0])):
        pool = [i for i in inst if i[0] not in used and i[1] == t[1] and abs((t[2] - i[3]).days) <= 2]
        sets = [c for n in (2, 3, 4) for c in combinations(pool, n) if sum(x[4] for x in c) == -t[3]] if 2 <= len(pool) <= 12 else []
        if len(sets) == 1:
            used |= {x[0] for x in sets[0]}
            want |= {(t[0], x[0]) for x in sets[0]}
    assert len(want) > 2
    assert {tuple(r) for r in reconcile.shared(*tables(spark, inst, txn), opts).collect()} == want


def test_pools_of_more_than_twelve_settle_nothing_and_end(spark):
    day = date(2026, 3, 1)
    inst = [(i, 1, "Acme", day, 10 + i, "o") for i in range(14)]
    txn = [(f"t{k}", 1, day, -25, "Acme") for k in range(30)]
    assert reconcile.shared(*tables(spark, inst, txn)).count() == 0


def run(spark, inst, txn, **more):
    return {r["instance_id"]: r for r in reconcile.run(*tables(spark, inst, txn), "2026-06-30", **more).collect()}


LUMP = [(1, 1, "Acme Water", date(2026, 6, 1), 75, "a"), (2, 1, "Acme Sewer", date(2026, 6, 1), 40, "b")], [("t", 1, date(2026, 6, 2), -115, "Acme")]


def test_run_settles_a_group_that_nothing_matches_alone(spark):
    got = run(spark, *LUMP)
    assert {k: (r["outcome"], r["transaction_id"], r["status"]) for k, r in got.items()} == {1: ("shared", "t", "expected"), 2: ("shared", "t", "expected")}


def test_run_leaves_settled_payments_and_single_matches_out_of_groups(spark):
    got = run(spark, *LUMP, settled=spark.createDataFrame([("t",)], "transaction_id string"))
    assert {r["outcome"] for r in got.values()} == {"unmatched"} and all(r["past_grace"] and r["status"] == "needs_review" for r in got.values())
    alone = (LUMP[0], LUMP[1] + [("u", 1, date(2026, 6, 1), -75, "Acme Water")])
    got = run(spark, *alone)
    assert (got[1]["outcome"], got[1]["transaction_id"], got[2]["outcome"]) == ("auto", "u", "unmatched")


def test_run_sends_a_new_price_to_review(spark):
    inst = [(1, 1, "Acme", date(2026, 5, 1), 50, "a"), (2, 1, "Acme", date(2026, 6, 1), 60, "a"), (3, 1, "Acme", date(2026, 6, 28), 60, "a"), (4, 1, "Acme", date(2026, 7, 2), 60, "a")]
    txn = [("m", 1, date(2026, 5, 1), -50, "Acme"), ("j", 1, date(2026, 6, 1), -60, "Acme")]
    got = run(spark, inst, txn)
    assert (got[1]["outcome"], got[1]["status"], got[2]["outcome"], got[2]["amount_changed"], got[2]["status"]) == ("auto", "paid", "needs_review", True, "expected")
    assert (got[3]["outcome"], got[3]["past_grace"], got[3]["status"]) == ("unmatched", False, "expected") and 4 not in got
    past = spark.createDataFrame([("a", 0, date(2026, 4, 1), D(90), False), ("a", -1, date(2026, 4, 20), D(300), True)], f"obligation_id string, instance_id long, due_date date, observed {MONEY}, grouped boolean")
    assert run(spark, inst, txn, history=past)[1]["outcome"] == "needs_review"


def test_run_ends_with_the_obligation_and_takes_empty_tables(spark):
    i, t = tables(spark, LUMP[0], LUMP[1])
    ended = i.selectExpr("*", "date'2026-05-31' as active_until")
    assert reconcile.run(ended, t, "2026-06-30").count() == 0
    assert reconcile.run(i.where("false"), t, "2026-06-30").count() == 0
    assert {r["outcome"] for r in reconcile.run(i, t.where("false"), "2026-06-30").collect()} == {"unmatched"}
