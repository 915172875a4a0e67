"""Mixing sources to target weights by capped water-filling, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, word_count

#: Leading hex digits of a document's hash that make its bucket: 4096 buckets a source, so that a source with a third of
#: 10^10 documents has windows of under a million rows.
BUCKET_DIGITS = 3
#: The weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sizes: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """Water-filling over one row per source (source, source_size).

    A source's target is min(max_epochs * size, level * weight). Sorted by cap / weight, the sources below
    the level are the capped ones, so the level follows from running sums: no iteration. Works on one row
    per source (never on documents), so the unpartitioned windows are small. A source without words gets 0;
    an empty table gives an empty table; null sources come last in code-point order.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("source_no") % len(weights) + 1)
    s = sizes.withColumn("source_no", F.row_number().over(order) - 1).withColumn("weight", w)
    s = s.withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    everything = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(0, Window.unboundedFollowing)
    s = (
        s.withColumn("asked", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("asked") - F.col("filled")) / F.sum("weight").over(onward))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("source_no"), F.col("level")))).over(everything)
    s = s.withColumn("level", level["level"])
    return s.select(
        "source_no",
        "source",
        "source_size",
        F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"),
    )


#: Names that mix() and repeated() give to columns of their own.
USED = ("size", "source_size", "target", "taken", "_h", "_b", "_s", "_sb", "_before", "_within", "_whole", "_extra", "_times", "_copy")


def mix(docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights=WEIGHTS, seed: str = "mix") -> DataFrame:
    """The rows of `docs` with size, source_size, target and taken.

    taken = whole repetitions of the document plus a seeded fractional one. Each source needs
    target / source_size repetitions: its whole part goes to every document, and the rest is a budget of
    words handed out in the order of a seeded hash, so only one document of a source is cut. The running
    sum is two-level (by the hash's first hex digits, then within those), so a source holding a third of the rows
    is spread over 4096 window groups. Counts cover all rows; nothing is dropped.

    Null text: size 0, taken 0. Null source: a source of its own, ordered last. Repeated rows count as rows
    of their own. Empty table: empty result. Columns of `docs` with the names added here are replaced.
    """
    added = ("size", "source_size", "target", "taken")
    keep = [c for c in docs.columns if c not in added]
    d = docs.select(*keep).withColumns(
        {
            "size": word_count(F.col("text")),
            "_h": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
        }
    )
    d = d.withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    buckets = d.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    targets = source_targets(
        buckets.groupBy("source").agg(F.sum("_n").alias("source_size")), share, max_epochs, weights
    )
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        buckets.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .select(F.col("source").alias("_s"), F.col("_b").alias("_sb"), "_before", "source_size", "target")
    )
    within = (
        Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    budget = F.floor(F.col("target") - F.col("_whole") * F.col("source_size") + F.lit(0.5))
    return (
        d.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_sb")))
        .withColumn("_whole", whole)
        .withColumn("_extra", F.greatest(F.lit(0), F.least("size", budget - F.col("_before") - F.col("_within"))))
        .withColumn("taken", (F.col("_whole") * F.col("size") + F.col("_extra")).cast("long"))
        .select(*keep, *added)
    )


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: each document as often as it is taken, the cut one whole if half of it or more is taken.

    Every column of `docs` comes out as it went in, also those with a name that mix() uses. Texts of any length are
    repeated or left out whole."""
    names = docs.columns
    docs, back = aside(docs, USED)
    m = mix(docs, **options)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).otherwise(F.lit(0)).cast("int")
    return m.withColumn("_times", times).where("_times > 0").select(
        *docs.columns, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")
    ).select(*docs.columns).withColumnsRenamed(back).select(*names)
