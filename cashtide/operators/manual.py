"""Accounts found by inexact names, and balances entered by hand for them."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The least score of a match and the lead that the best one needs, the score of a name that holds the words asked
#: for, the weight of the organisation (all in ten-thousandths), and the longest note.
FLOOR, BAND, HELD, ORG_SHARE, NOTE_LENGTH = 4000, 1000, 9000, 1500, 500
#: Fixed value: four digits at the end of a query, which name an account by the end of its number.
MASK = r"\(?\s*([0-9]{4})\s*\)?\s*$"


def grams(c: Column, n: int = 3) -> Column:
    """Distinct substrings of n characters; empty for shorter texts."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: c.substr(i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _alike(shared: Column, a: Column, b: Column) -> Column:
    """Twice the shared share of two sets of trigrams, in ten-thousandths, cut to a whole number."""
    return F.when(a + b > 0, F.floor(shared * 20000 / (a + b))).otherwise(F.lit(0)).cast("long")


def resolve(asked: DataFrame, accounts: DataFrame, masks: bool = True) -> DataFrame:
    """ask_id, status (ok, ambiguous, not_found), account_id (of ok alone), score and n_close of every row asked for.

    `asked`: ask_id, entity_id, query; `accounts`: account_id, entity_id, name, org. Names are compared by shared trigrams, so one or two
    wrong letters do no harm; a name that holds the query counts at least 0.9, and the organisation adds at most 0.15. Below 0.4 nothing is found; with
    others within 0.1 of the best the answer is ambiguous. Four digits at the end prefer the accounts whose name or id has
    them, a single such account at score 1. Rows meet on entity and gram, counted before they shuffle, and only accounts that share
    one are scored: none else can reach the floor. Null and blank queries and queries of null entities find nothing.
    Scores are in ten-thousandths."""
    said = F.btrim(F.lower(F.coalesce("query", F.lit(""))), F.lit(" \t\r\n"))
    mask = F.regexp_extract(said, MASK, 1)
    bare = F.btrim(F.regexp_replace(said, MASK, ""), F.lit(" (*.-x"))
    q = asked.select("ask_id", "entity_id", said.alias("q"), F.lit(None).cast("string").alias("mask"))
    if masks:
        q = asked.select("ask_id", "entity_id", F.when((mask != "") & (bare != ""), bare).otherwise(said).alias("q"), F.when(mask != "", mask).alias("mask"))
    own = accounts.select("account_id", "entity_id", F.lower(F.coalesce("name", F.lit(""))).alias("name"), F.lower(F.coalesce("org", F.lit(""))).alias("org"))
    digits = F.array_distinct(F.concat(grams(F.col("name"), 4), grams(F.col("account_id").cast("string"), 4)))
    ends = own.select("account_id", "entity_id", F.explode(F.filter(digits, lambda g: g.rlike("^[0-9]{4}$"))).alias("mask"))
    carried = q.where("mask is not null").join(ends, ["entity_id", "mask"]).select("ask_id", "account_id", F.lit(True).alias("carries"))

    keys = F.when(F.length("q") >= 3, grams(F.col("q"))).when(F.length("q") > 0, F.array("q"))
    sought = q.select("ask_id", "entity_id", F.explode(keys).alias("gram"))
    listed = own.select("account_id", "entity_id", F.explode(F.concat(grams(F.col("name")), grams(F.col("name"), 2), grams(F.col("name"), 1))).alias("gram"))
    shared = sought.join(listed, ["entity_id", "gram"]).groupBy("ask_id", "account_id").agg(F.count("*").alias("shared"))
    met = shared.join(carried, ["ask_id", "account_id"], "full").join(q.drop("entity_id"), "ask_id").join(own.drop("entity_id"), "account_id")
    name = _alike(F.when(F.length("q") >= 3, F.coalesce("shared", F.lit(0))).otherwise(0), F.size(grams(F.col("q"))), F.size(grams(F.col("name"))))
    name = F.when(F.contains("name", "q"), F.greatest(name, F.lit(HELD))).otherwise(name)
    org_grams = grams(F.col("org"))
    org = _alike(F.size(F.array_intersect(grams(F.col("q")), org_grams)), F.size(grams(F.col("q"))), F.size(org_grams))
    words = F.filter(F.split("q", r"\s+"), lambda w: w != "")
    org = F.when((F.col("org") != "") & (F.contains("org", "q") | F.exists(words, lambda w: F.contains(F.col("org"), w))), F.greatest(org, F.lit(HELD))).otherwise(org)

    ask = Window.partitionBy("ask_id")
    rated = met.withColumn("score", F.when(F.col("q") == "", 0).otherwise(name + F.floor(org * ORG_SHARE / 10000)))
    rated = rated.withColumn("n_carry", F.count("carries").over(ask)).where("n_carry = 0 or carries")
    rated = rated.withColumn("score", F.when(F.col("n_carry") == 1, 10000).otherwise(F.col("score")).cast("long"))
    close = rated.withColumn("top", F.max("score").over(ask)).where((F.col("top") >= FLOOR) & (F.col("top") - F.col("score") <= BAND))
    best = close.groupBy("ask_id").agg(F.max("top").alias("score"), F.count("*").alias("n_close"), F.max_by("account_id", "score").alias("account_id"))
    one = F.col("n_close") == 1
    return q.select("ask_id").join(best, "ask_id", "left").select(
        "ask_id", F.when(F.col("n_close").isNull(), "not_found").when(one, "ok").otherwise("ambiguous").alias("status"), F.when(one, F.col("account_id")).alias("account_id"), "score", F.coalesce("n_close", F.lit(0)).alias("n_close")
    )


def placed(entries: DataFrame, accounts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """What becomes of balances entered by hand, in order of entry_id: one row each with status, account_id, balance, recorded_at and sign_corrected.

    `entries`: entry_id, entity_id, query, balance, as_of (text or date), note. Blank queries, no balance, no such day and notes over 500
    characters are `invalid`; else see resolve(). An entry is recorded at noon UTC of its day, or a second after the newest
    observation of its account if that is not earlier, entries before it included: entry n at the running maximum of noon less
    its number, so no row waits for another. A sign opposite to the newest observation of the feed is turned if the
    magnitudes are within four times."""
    day = F.try_to_date(F.col("as_of").cast("string"), "yyyy-MM-dd")
    sound = (F.btrim(F.coalesce("query", F.lit("")), F.lit(" \t\r\n")) != "") & F.col("balance").isNotNull() & day.isNotNull() & (F.coalesce(F.length("note"), F.lit(0)) <= NOTE_LENGTH)
    rows = entries.withColumn("as_of", day).withColumn("sound", sound)
    found = resolve(rows.where("sound").select(F.col("entry_id").alias("ask_id"), "entity_id", "query"), accounts).withColumnRenamed("ask_id", "entry_id")
    seconds = F.unix_seconds(F.col("recorded_at").cast("timestamp"))
    feed = (F.col("source") != "manual") & (F.col("balance") != 0)
    held = snapshots.groupBy("account_id").agg(F.max(seconds).alias("newest"), F.max(F.when(feed, F.struct("recorded_at", "id", "balance")))["balance"].alias("feed"))
    both = rows.join(found, "entry_id", "left").join(held, "account_id", "left")
    order = Window.partitionBy("account_id").orderBy("entry_id")
    n = F.sum(F.when(F.col("status") == "ok", 1)).over(order)
    both = both.withColumn("n", n).withColumn("at", F.max(F.unix_date("as_of") * F.lit(86400).cast("long") + 43200 - F.col("n")).over(order))
    stamp = F.greatest("at", "newest") + F.col("n")
    size, was = F.abs("balance"), F.abs("feed")
    turned = F.coalesce((F.col("balance") != 0) & ((F.col("balance") < 0) != (F.col("feed") < 0)) & (size * 4 >= was) & (size <= was * 4), F.lit(False))
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    return both.select(
        "entry_id", F.coalesce("status", F.lit("invalid")).alias("status"), "account_id", F.when(ok, F.when(turned, -F.col("balance")).otherwise(F.col("balance"))).alias("balance"),
        F.when(ok, F.timestamp_seconds(stamp)).alias("recorded_at"), F.when(ok, F.col("as_of")).alias("as_of"), F.when(ok, F.col("note")).alias("note"), (ok & turned).alias("sign_corrected"),
    )


def entered(done: DataFrame, snapshots: DataFrame) -> DataFrame:
    """All observations by hand with what replaces them: origin (stored or entered), id, account_id, balance, recorded_at, replaced_by.

    `done`: see placed(). An entry replaces what was entered by hand for its account before it and recorded on its day (UTC).
    Rows with replaced_by leave the table, entered ones without it come in; observations of the feed are not touched. Days of an account
    are looked at in one ordered pass."""
    utc = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / 86400)
    old = snapshots.where("source = 'manual' and recorded_at is not null").select(F.lit("stored").alias("origin"), "id", "account_id", "balance", F.col("recorded_at").cast("timestamp").alias("recorded_at"), utc("recorded_at").alias("day"), F.lit(None).cast("long").alias("turn"))
    ok = done.where("status = 'ok'")
    new = ok.select(F.lit("entered").alias("origin"), F.col("entry_id").alias("id"), "account_id", "balance", "recorded_at", utc("recorded_at").alias("day"), F.col("entry_id").alias("turn"))
    marks = ok.select("account_id", F.unix_date("as_of").cast("long").alias("day"), F.col("entry_id").alias("turn"), F.col("entry_id").alias("mark"))
    every = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (old, new, marks))
    after = Window.partitionBy("account_id", "day").orderBy(F.col("turn").asc_nulls_first(), F.col("mark").isNull()).rowsBetween(1, Window.unboundedFollowing)
    return every.withColumn("replaced_by", F.first("mark", ignorenulls=True).over(after)).where("origin is not null").select("origin", "id", "account_id", "balance", "recorded_at", "replaced_by")
