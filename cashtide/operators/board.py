"""What each task of a listed board is: managed, stale, a copy, an orphan or somebody's own; and what may be deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity

#: The title of tasks from before markers, how it ends, and the states in which a candidate is decided.
LEGACY, LEGACY_END = "Onboard charge:", "not modeled"
DECIDED = ("in_review", "accepted", "applied", "rejected", "deferred", "needs_more_evidence", "merged", "split", "parked")


def classify(tasks: DataFrame, emissions: DataFrame, candidates: DataFrame) -> DataFrame:
    """task_id, class, action, survivor_id of every task; the first that holds: managed, stale_applied, duplicate, then
    fa_auto_orphan, else kept.

    `tasks`: task_id (a number), position, content, description, labelled. `emissions`: surface_key, task_id, status.
    `candidates`: id, display_name, merchant_key, status; of several of one name the largest id counts.

    Copies share the marker in the description or, without one, content and description. The copy that an open
    emission names stays, else the smallest id; it stays even if it is an orphan, so a run never deletes all copies.
    Other copies go only if what stays is managed or labelled. Only three kinds may go: orphans, copies of such
    tasks, and legacy titles of decided candidates. Groups are joined by their key after a partial aggregation, so
    a large group of copies is never gathered."""
    key = identity.surface_key(F.col("description"))
    none = F.lit(None).cast("string")
    text_of = F.concat(F.lit("hash:"), identity.content_hash(F.coalesce("content", F.lit("")), F.coalesce("description", F.lit("")), none, none))
    opened = emissions.where("status = 'open'")
    named = opened.select(F.col("task_id").alias("_open")).distinct().where("_open is not null")
    of_key = opened.select(F.col("surface_key").alias("_k"), F.col("task_id").alias("_t"))
    t = tasks.withColumns({"_key": key, "_group": F.coalesce(key, text_of)})
    t = t.join(named, F.col("task_id") == F.col("_open"), "left").join(of_key, F.col("_key") == F.col("_k"), "left")
    t = t.withColumns({"_managed": F.coalesce(F.col("_t") == F.col("task_id"), F.lit(False)), "_named": F.col("_open").isNotNull()})
    who = F.struct(F.when(F.col("_named"), 0).otherwise(1).alias("a"), F.when(F.col("_named"), F.col("position")).otherwise(F.col("task_id")).alias("b"), F.col("task_id").alias("id"), F.col("_managed").alias("managed"), F.col("labelled").alias("labelled"))
    groups = t.groupBy("_group").agg(F.min(who).alias("_s"), F.count("*").alias("_n")).where("_n > 1").withColumnRenamed("_group", "_g")
    t = t.join(groups, F.col("_group") == F.col("_g"), "left")

    rest = F.trim(F.substring("content", len(LEGACY) + 1, 1 << 30))
    named_so = F.lower(F.when(F.endswith(F.lower(rest), F.lit(LEGACY_END)), F.trim(F.expr(f"left({_sql('content')}, length({_sql('content')}) - {len(LEGACY_END)})"))).otherwise(rest))
    legacy = F.coalesce(F.startswith("content", F.lit(LEGACY)), F.lit(False))
    for name, column in (("_d", "display_name"), ("_m", "merchant_key")):
        last = candidates.where(F.col(column) != "").groupBy(F.lower(F.trim(column)).alias(f"{name}_name")).agg(F.max_by(F.coalesce("status", F.lit("")), "id").alias(f"{name}_status"))
        t = t.join(last, F.when(legacy, named_so) == F.col(f"{name}_name"), "left")
    decided = F.coalesce(F.coalesce("_d_status", "_m_status").isin(*DECIDED), F.lit(False))
    copy = F.col("_s").isNotNull() & (F.col("_s.id") != F.col("task_id"))
    backed = F.col("_s.managed") | F.coalesce("_s.labelled", F.lit(False))
    label = F.coalesce("labelled", F.lit(False))
    kind = (
        F.when(F.col("_managed"), "managed").when(legacy, "stale_applied").when(copy & backed, "duplicate").when(copy, "kept")
        .when(F.col("_s").isNotNull(), "kept").when(label, "fa_auto_orphan").otherwise("kept")
    )
    action = F.when(kind == "stale_applied", F.when(decided, "would_delete").otherwise("needs_review")).when(kind.isin("duplicate", "fa_auto_orphan"), "would_delete").otherwise("kept")
    survivor = F.when(~F.col("_managed") & ~legacy & copy, F.col("_s.id"))
    return t.select("task_id", kind.alias("class"), action.alias("action"), survivor.alias("survivor_id"))


def _sql(column: str) -> str:
    return f"trim(substring({column}, {len(LEGACY) + 1}))"


def orphans(tasks: DataFrame, emissions: DataFrame) -> DataFrame:
    """surface_key, task_id of open emissions whose task is not on the board; sound only for a whole list."""
    return emissions.where("status = 'open'").join(tasks.select("task_id"), "task_id", "left_anti").select("surface_key", "task_id")
