import random
from datetime import datetime
from decimal import Decimal as D

from cashtide.operators import feed
from cashtide.streaming import balances, merging

SCHEMA = "id string, fetched_at timestamp, seq int, account_id long, amount decimal(18,2), pending boolean"


def _rows(n=120, ids=17, seed=3):
    r = random.Random(seed)
    rows = [(f"t{r.randrange(ids)}", datetime(2026, 1, 1 + r.randrange(9)), r.randrange(3), r.randrange(4), D(r.randrange(900)) / 4, r.random() < 0.5) for _ in range(n)]
    return rows + [(None, datetime(2026, 1, 1), 1, 1, D("1.00"), False)]


def _plain(rows):
    """Taking rows one by one by time, place and content."""
    table = {}
    for row in sorted((x for x in rows if x[0] is not None), key=lambda x: x[1:]):
        first = table[row[0]][1] if row[0] in table else row[1]
        table[row[0]] = (row, first, row[1])
    return {k: (*row, first, last) for k, (row, first, last) in table.items()}


def _got(df):
    return {r["id"]: tuple(r) for r in df.collect()}


def test_merged_equals_rows_one_by_one(spark):
    rows = _rows()
    assert _got(feed.merged(feed.pulled(spark.createDataFrame(rows, SCHEMA)))) == _plain(rows)


def test_merged_ignores_order_repeats_and_grouping(spark):
    rows = _rows()
    table = feed.pulled(spark.createDataFrame(rows, SCHEMA))
    parts = [feed.merged(feed.pulled(spark.createDataFrame(rows[a : a + 50], SCHEMA))) for a in (100, 0, 50, 0)]
    again = feed.merged(parts[0].unionByName(feed.merged(parts[1].unionByName(parts[2]))).unionByName(parts[3]))
    assert _got(again) == _got(feed.merged(table)) == _got(feed.merged(feed.merged(table)))


def test_pulls_add_up(spark):
    rows = [("a", datetime(2026, 1, 1), 1, 1, D(1), False), ("a", datetime(2026, 1, 1), 2, 1, D(2), False), ("a", datetime(2026, 1, 2), 1, 1, D(2), False), ("b", datetime(2026, 1, 2), 1, 1, D(2), False), (None, datetime(2026, 1, 2), 1, 1, D(2), False)]
    got = {r["pull_at"].day: (r["n_rows"], r["inserted"], r["updated"]) for r in feed.pulls(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (2, 1, 1), 2: (2, 1, 1)}


def test_empty_feed(spark):
    none = feed.pulled(spark.createDataFrame([], SCHEMA))
    assert feed.merged(none).count() == 0 and feed.pulls(none).count() == 0 and merging.current(spark, "/tmp/no-such-table-of-cashtide", none.schema).count() == 0


def _land(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_stream_replayed_reordered_and_compacted_equals_one_merge(spark, tmp_path):
    rows = _rows()
    schema = spark.createDataFrame([], SCHEMA).schema
    land, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in (60, 0, 30, 90, 0):
        _land(spark, rows[k : k + 31], land)
    for checkpoint in ("first", "lost"):  # the second one starts afresh over the same table, as after a lost checkpoint
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(land)
        merging.keep_transactions(stream, out, str(tmp_path / checkpoint), every=2).awaitTermination(120)
    table = merging.table_schema(schema)
    assert _got(merging.current(spark, out, table)) == _plain(rows)
    gen = merging.generation(spark, out)
    assert gen >= 3 and {n for n in (p.name for p in (tmp_path / "out" / "base").iterdir())} == {f"gen={gen - 1}", f"gen={gen}"}


def test_unfinished_folders_are_not_read(spark, tmp_path):
    rows = _rows()
    schema, out = feed.pulled(spark.createDataFrame([], SCHEMA)).schema, str(tmp_path / "out")
    feed.merged(feed.pulled(spark.createDataFrame(rows[:60], SCHEMA))).write.parquet(f"{out}/delta/gen=0/a-0")
    feed.merged(feed.pulled(spark.createDataFrame(rows[60:], SCHEMA))).write.parquet(f"{out}/delta/gen=0/a-1")
    (tmp_path / "out" / "delta" / "gen=0" / "a-1" / "_SUCCESS").unlink()
    feed.merged(feed.pulled(spark.createDataFrame(rows[60:], SCHEMA))).write.parquet(f"{out}/base/gen=1")
    (tmp_path / "out" / "base" / "gen=1" / "_SUCCESS").unlink()
    assert _got(merging.current(spark, out, schema)) == _plain(rows[:60])


def test_balances_survive_a_lost_checkpoint(spark, tmp_path):
    names = "id long, account_id long, balance decimal(18,2), recorded_at timestamp, source string"
    land, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, checkpoint in ((1, "first"), (2, "lost")):
        spark.createDataFrame([(n, n, D(n), datetime(2026, 1, n), "feed")], names).write.mode("overwrite").parquet(land)
        stream = spark.readStream.schema(names).parquet(land)
        balances.keep_latest(stream, out, str(tmp_path / checkpoint)).awaitTermination(60)
    assert {r["id"] for r in balances.kept(spark, out).collect()} == {1, 2}
