"""Keyed ledgers: snapshot differences, upserts, emission decisions and ranked queues as set operations."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """keys and action: created, updated, unchanged or resolved (gone from `new`, still active in `old`).

    One full outer join on the keys; null keys match null keys. Content is compared null-safely."""
    a = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in content], F.lit(True).alias("_old"))
    b = new.select(*[F.col(k).alias(f"new_{k}") for k in keys], *content, F.lit(True).alias("_new"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"new_{k}"))
    same = F.lit(True)
    for c in content:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(c))
    action = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "resolved").when(same, "unchanged").otherwise("updated")
    return a.join(b, on, "full").select(*[F.when(F.col("_old").isNull(), F.col(f"new_{k}")).otherwise(F.col(k)).alias(k) for k in keys], action.alias("action"))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], refresh: list[str] | None = None, latest: str | None = None) -> DataFrame:
    """`table` with the rows of `changes` merged in by key; with `refresh`, only those columns of existing rows change.

    Null keys match null keys. Of several changes of one key that of the largest `latest` counts (a column of `changes`),
    ties and without it the largest (its columns compared in order); keys that `table` repeats keep their rows, each changed alike."""
    others = [c for c in table.columns if c not in keys]
    refresh = others if refresh is None else refresh
    last = changes.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg((F.max(F.struct(*others)) if latest is None else F.max(F.struct(latest, F.struct(*others).alias("_row")))["_row"]).alias("_c"))
    new = last.select(*[f"_k_{k}" for k in keys], *[F.col(f"_c.{c}").alias(f"_n_{c}") for c in others], F.lit(True).alias("_has"))
    old = table.withColumn("_had", F.lit(True))
    value = lambda c: F.when(F.col("_had").isNull() | (F.col("_has").isNotNull() & F.lit(c in refresh)), F.col(f"_n_{c}")).otherwise(F.col(c))
    same = functools.reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_k_{k}")), keys, F.lit(True))
    key = lambda k: F.when(F.col("_had").isNull(), F.col(f"_k_{k}")).otherwise(F.col(k)).alias(k)
    return old.join(new, same, "full").select(*[key(k) for k in keys], *[value(c).alias(c) for c in others]).select(*table.columns)


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """`table` and those of `rows` whose key it lacks; of several new rows of one key the smallest. Null keys match."""
    others = [c for c in table.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_c")).select(*keys, *[F.col(f"_c.{c}").alias(c) for c in others])
    had = table.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    same = functools.reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_k_{k}")), keys, F.lit(True))
    return table.unionByName(one.join(had, same, "left_anti").select(*table.columns))


def update_where(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """`table` with new values in the rows where the condition is true; false and null leave a row as it is."""
    hit = F.coalesce(condition, F.lit(False))
    return table.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """`table` without the rows where the condition is true; a null condition keeps a row."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def acknowledge(findings: DataFrame, ids: DataFrame, note: str) -> DataFrame:
    """`findings` (id, status, note, ...) with the active ones among `ids` acknowledged; others stay as they are."""
    named = ids.select(F.col("id").alias("_id")).distinct()
    hit = findings.join(named, F.col("id") == F.col("_id"), "left")
    return update_where(hit, F.col("_id").isNotNull() & (F.col("status") == "active"), {"status": F.lit("acknowledged"), "note": F.lit(note)}).drop("_id")


def page(rows: DataFrame, order: list[Column], limit: int = -1, offset: int = 0) -> DataFrame:
    """The rows from `offset` on in that order, `limit` of them or, with -1, all."""
    out = rows.orderBy(*order).offset(offset)
    return out if limit < 0 else out.limit(limit)


def emission_actions(items: DataFrame, emissions: DataFrame, retire: DataFrame) -> DataFrame:
    """surface_key, action of a batch (surface_key, content_hash) against the ledger (surface_key, status, content_hash).

    Tombstoned open keys are retired first. Completed and deleted ones stay resolved; an open one with the same
    content is skipped, with other content updated; anything else is created, retired ones too."""
    tomb = retire.select(F.col("surface_key")).distinct().withColumn("tomb", F.lit(True))
    old = emissions.select("surface_key", "status", F.col("content_hash").alias("old_hash")).join(tomb, "surface_key", "left")
    both = items.select("surface_key", "content_hash", F.lit(True).alias("asked")).join(old, "surface_key", "full")
    is_open = F.col("status") == "open"
    return both.select(
        "surface_key",
        F.when(is_open & F.col("tomb"), "retire")
        .when(F.col("asked").isNull(), F.lit(None))
        .when(F.col("status").isin("completed", "deleted_by_user"), "resolved")
        .when(is_open & (F.col("old_hash") == F.col("content_hash")), "skip")
        .when(is_open, "update")
        .otherwise("create")
        .alias("action"),
    ).where("action is not null")


def winners(items: DataFrame) -> DataFrame:
    """Items without a subject, and of each subject the one of lowest rank, then position."""
    order = Window.partitionBy("subject").orderBy("rank", "position")
    tagged = items.where("subject is not null").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    return tagged.unionByName(items.where("subject is null"))


def ranked_queue(items: DataFrame, limit: int) -> DataFrame:
    """The first `limit` items (id, kind, severity_rank, kind_rank) with their place; a top-k report."""
    order = (F.desc("severity_rank"), F.desc("kind_rank"), F.asc("id"))
    top = items.orderBy(*order).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def synthetic_ids(rows: DataFrame, prefix: str = "card") -> DataFrame:
    """Rows (account_id, posted, amount, payee, position) with a stable id; equal rows are told apart by their order."""
    same = ["account_id", "posted", "amount", "payee"]
    n = F.row_number().over(Window.partitionBy(*same).orderBy("position")) - 1
    key = F.concat_ws("|", F.col("account_id").cast("string"), F.date_format("posted", "yyyy-MM-dd"), F.col("amount").cast("string"), F.regexp_replace(F.lower("payee"), "[^a-z0-9]", ""), n.cast("string"))
    return rows.withColumn("ordinal", n).withColumn("synthetic_id", F.concat(F.lit(f"{prefix}:"), F.sha1(key)))


def memory_search(memories: DataFrame, queries: DataFrame, k: int = 5, least: float = 0.1, budget: int = 200) -> DataFrame:
    """query_id, rank, id, score, n_tokens: cosine of term counts, then threshold, top k and a token budget.

    Inputs: id and text, query_id and text. Terms are joined on the term itself; the first hit is always kept, and
    a hit that would overrun the budget is passed over while later, smaller ones may still enter. The budget is
    a fold over at most k hits."""

    def counts(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*text.STOP_TOKENS))
        tf = rows.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
        return tf, tf.groupBy(key).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf")).cast("double")).alias(f"{key}_norm"), F.sum("tf").alias(f"{key}_tokens"))

    mt, mn = counts(memories, "id")
    qt, qn = counts(queries, "query_id")
    dot = mt.join(qt.withColumnRenamed("tf", "qf"), "term").groupBy("query_id", "id").agg(F.sum(F.col("tf") * F.col("qf")).alias("dot"))
    scored = dot.join(mn, "id").join(qn, "query_id").withColumn("score", F.round(F.col("dot") / (F.col("id_norm") * F.col("query_id_norm")), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = scored.where(F.col("score") >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    hits = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", F.col("id_tokens").alias("n_tokens")))).alias("hits"))

    def step(acc, h):
        fits = (acc["used"] + h["n_tokens"] <= budget) | (h["rank"] == 1)
        return F.struct(
            F.when(fits, acc["used"] + h["n_tokens"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.array_append(acc["kept"], h["rank"])).otherwise(acc["kept"]).alias("kept"),
        )

    kept = F.aggregate("hits", F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept")), step)["kept"]
    return hits.select("query_id", F.explode(F.filter("hits", lambda h: F.array_contains(kept, h["rank"]))).alias("h")).select("query_id", "h.*")
