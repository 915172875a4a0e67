"""Two lists compared: against the rule done row by row, and on fixtures."""

import random
from datetime import date, timedelta
from decimal import Decimal as D

from cashtide.operators import parity

MONEY = "decimal(18,2)"
DAY = date(2026, 6, 1)


def compare(spark, old, new):
    a = spark.createDataFrame([(i, 1, w, d, D(m), n) for i, w, d, m, n in old], f"id long, entity_id long, direction string, on_date date, amount {MONEY}, label string")
    b = spark.createDataFrame([(i, 1, w, d, D(m), n) for i, w, d, m, n in new], f"id long, entity_id long, direction string, due_date date, amount {MONEY}, name string")
    return {(r["old_id"], r["new_id"], r["kind"]) for r in parity.compare(a, b).collect()}


def one_by_one(old, new):
    taken, out, rest = set(), set(), []
    for i, way, day, amount, label in old:
        met = [(n, abs((n[2] - day).days), abs(amount - n[3]) <= max(5, 0.05 * max(amount, n[3]))) for n in new if n[0] not in taken and n[1] == way and set(n[4].split()) & set(label.split())]
        kinds = [(n[0], "matched" if d <= 7 and c else "amount_changed" if d <= 7 else "date_changed" if c and d <= 31 else None) for n, d, c in met]
        best = next((k for k in kinds if k[1] == "matched"), None) or next((k for k in kinds if k[1]), None)
        if best is None:
            rest.append((i, way, day, amount))
        else:
            taken.add(best[0])
            out.add((i, *best))
    for i, way, day, amount in rest:
        hits = [n[0] for n in new if n[0] not in taken and n[1] == way and n[3] == amount and abs((n[2] - day).days) <= 2]
        if len(hits) == 1:
            taken.add(hits[0])
        out.add((i, hits[0], "renamed") if len(hits) == 1 else (i, None, "missing"))
    return out | {(None, n[0], "extra") for n in new if n[0] not in taken}


def test_equals_the_rule_done_row_by_row(spark):
    rng = random.Random(7)
    make = lambda n: [(i, rng.choice(["inflow", "outflow"]), DAY + timedelta(days=rng.randrange(25)), rng.choice([40, 41, 200]), rng.choice(["water", "acme water", "gym", "lease", "books", "tea", "shoes", "piano"])) for i in range(n)]
    old, new = make(90), make(80)
    want = one_by_one(old, new)
    assert {k for _, _, k in want} >= {"matched", "amount_changed", "date_changed", "renamed", "missing", "extra"}
    assert compare(spark, old, new) == want


def test_a_unique_row_frees_the_next(spark):
    # 1 has one row left, and takes it; only then 2 has one left
    old = [(1, "outflow", DAY, 10, "aaa"), (2, "outflow", DAY + timedelta(days=2), 10, "bbb")]
    new = [(1, "outflow", DAY + timedelta(days=1), 10, "ccc"), (2, "outflow", DAY + timedelta(days=4), 10, "ddd")]
    assert compare(spark, old, new) == one_by_one(old, new) == {(1, 1, "renamed"), (2, 2, "renamed")}


def test_edges(spark):
    assert compare(spark, [], []) == set()
    row = (1, "outflow", DAY, 10, "water")
    assert compare(spark, [row], []) == {(1, None, "missing")} and compare(spark, [], [row]) == {(None, 1, "extra")}
    assert compare(spark, [(1, "outflow", None, 10, None)], [row]) == {(1, None, "missing"), (None, 1, "extra")}
