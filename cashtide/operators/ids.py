"""Ids of dated instances: one a day without a number, further ones with the smallest free number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def allocate(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """`rows` (obligation_id, due_date, seq) with instance_id, as if they were taken one by one in the order of seq.

    `stored`: instance_id, obligation_id, due_date. The id of a day is obligation:day. The first row of a day reuses it, so
    applying a single row again changes nothing, unless the day has numbered ids already; every other row takes
    the smallest number from 1 on that neither a stored id nor an earlier row has. No row waits for another: the k-th
    one takes the k-th free number, found from the day's used ones alone."""
    base = F.concat_ws(":", "obligation_id", F.date_format("due_date", "yyyy-MM-dd"))
    held = stored.withColumn("_base", base)
    tail = F.when(F.startswith("instance_id", F.concat("_base", F.lit(":"))), F.expr("substring(instance_id, length(_base) + 2)"))
    number = F.when(F.regexp_like(tail, F.lit("^[0-9]+$")), tail.try_cast("int"))
    used = held.withColumn("_n", number).where("_n is not null").groupBy("_base").agg(F.array_sort(F.collect_set(F.when(F.col("_n") > 0, F.col("_n")))).alias("_used")).withColumnRenamed("_base", "_b")
    order = Window.partitionBy("obligation_id", "due_date").orderBy("seq")
    new = rows.withColumns({"_base": base, "_k": F.row_number().over(order)}).join(used, F.col("_base") == F.col("_b"), "left")
    numbered = F.col("_used").isNotNull()
    nth = F.when(numbered, F.col("_k")).otherwise(F.col("_k") - 1)
    free = F.filter(F.sequence(F.lit(1), F.greatest(nth, F.lit(1)) + F.coalesce(F.size("_used"), F.lit(0))), lambda n: ~F.coalesce(F.array_contains(F.col("_used"), n), F.lit(False)))
    name = F.when(nth == 0, F.col("_base")).otherwise(F.concat_ws(":", "_base", F.get(free, nth - 1).cast("string")))
    return new.select(*rows.columns, name.alias("instance_id"))
