from datetime import date, datetime
from decimal import Decimal as D

from cashtide.operators import manual

ACCOUNTS = "account_id string, entity_id long, name string, org string"
ENTRIES = "entry_id long, entity_id long, query string, balance decimal(18,2), as_of string, note string"
SNAPS = "id long, account_id string, balance decimal(18,2), recorded_at timestamp, source string"
HELD = [("a", 1, "Premier Plus CKG (4321)", "Bank North"), ("b", 1, "Premier Plus SAV (8765)", "Bank North"), ("c", 1, "Store Card", "Shopbank"), ("d", 2, "Premier Plus CKG (4321)", None), ("e", 1, None, None)]


def asked(spark, queries, masks=True):
    rows = spark.createDataFrame([(n, 1, q) for n, q in enumerate(queries)], "ask_id long, entity_id long, query string")
    return [(r.status, r.account_id) for r in manual.resolve(rows, spark.createDataFrame(HELD, ACCOUNTS), masks).orderBy("ask_id").collect()]


def test_names_with_wrong_letters_ties_marks_and_nothing(spark):
    got = asked(spark, ["store card", "Stroe Card", "stor card", "premier plus", "Premier Plus (8765)", "zzz (4321)", "nothing like it", "  ", None, "ca"])
    assert got == [("ok", "c")] * 3 + [("ambiguous", None), ("ok", "b"), ("ok", "a")] + [("not_found", None)] * 3 + [("ok", "c")]
    assert asked(spark, ["zzz (4321)"], masks=False) == [("not_found", None)]


def test_organisation_alone_and_empty_tables(spark):
    assert asked(spark, ["shopbank"]) == [("not_found", None)]
    none = spark.createDataFrame([], ACCOUNTS)
    one = spark.createDataFrame([(1, 1, "x"), (2, None, "y")], "ask_id long, entity_id long, query string")
    assert {r.status for r in manual.resolve(one, none).collect()} == {"not_found"}
    assert manual.resolve(one.limit(0), none).count() == 0


def test_entries_after_the_newest_and_same_day_replacement(spark):
    snaps = spark.createDataFrame(
        [(1, "c", D("-1100.00"), datetime(2026, 1, 5, 18), "feed"), (2, "c", D("5.00"), datetime(2026, 1, 5, 9), "manual"), (3, "c", D("6.00"), datetime(2026, 1, 4, 9), "manual"), (4, "a", D("10.00"), datetime(2026, 1, 1), "feed")], SNAPS
    )
    long, day = "n" * 501, "2026-01-05"
    rows = [
        (1, 1, "store card", D("1200.00"), day, None), (2, 1, "store card", D("-50.00"), day, "x"), (3, 1, "store card", D("9.00"), "2026-01-06", None), (4, 1, "premier plus", D("1.00"), day, None),
        (5, 1, "store card", None, day, None), (6, 1, "store card", D("1.00"), "soon", None), (7, 1, "store card", D("1.00"), day, long), (8, 1, "", D("1.00"), day, None), (9, 1, "zzz (4321)", D("-50.00"), day, None),
    ]
    done = manual.placed(spark.createDataFrame(rows, ENTRIES), spark.createDataFrame(HELD, ACCOUNTS), snaps)
    got = {r.entry_id: (r.status, r.account_id, r.balance, r.recorded_at, r.sign_corrected) for r in done.collect()}
    assert got[1] == ("ok", "c", D("-1200.00"), datetime(2026, 1, 5, 18, 0, 1), True)
    assert got[2] == ("ok", "c", D("-50.00"), datetime(2026, 1, 5, 18, 0, 2), False)
    assert got[3] == ("ok", "c", D("9.00"), datetime(2026, 1, 6, 12), False)
    assert got[9] == ("ok", "a", D("-50.00"), datetime(2026, 1, 5, 12), False)
    assert [got[n][0] for n in (4, 5, 6, 7, 8)] == ["ambiguous"] + ["invalid"] * 4
    kept = {(r.origin, r.id): r.replaced_by for r in manual.entered(done, snaps).collect()}
    assert kept == {("stored", 2): 1, ("stored", 3): None, ("entered", 1): 2, ("entered", 2): None, ("entered", 3): None, ("entered", 9): None}
    assert [r.as_of for r in done.where("entry_id = 3").collect()] == [date(2026, 1, 6)]
