"""Calendars as DataFrames: business days with observed US federal holidays, and dated schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Holidays on a date (month, day), and on the n-th weekday of a month (n = -1: the last one).
FIXED_HOLIDAYS = ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))
FLOATING_HOLIDAYS = ((1, "Mon", 3), (2, "Mon", 3), (5, "Mon", -1), (9, "Mon", 1), (10, "Mon", 2), (11, "Thu", 4))


def nth_weekday(first: Column, weekday: str, n: int) -> Column:
    """The n-th such weekday of the month that starts at `first`; the last one for n = -1."""
    if n < 0:
        return F.next_day(F.date_sub(F.last_day(first), 7), weekday)
    return F.date_add(F.next_day(F.date_sub(first, 1), weekday), 7 * (n - 1))


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(day): observed federal holidays; a Saturday's is kept on Friday, a Sunday's on Monday, also across years."""
    years = spark.range(first_year - 1, last_year + 2).select(F.col("id").cast("int").alias("y"))
    fixed = F.array(*[F.make_date("y", F.lit(m), F.lit(d)) for m, d in FIXED_HOLIDAYS])
    floating = F.array(*[nth_weekday(F.make_date("y", F.lit(m), F.lit(1)), w, n) for m, w, n in FLOATING_HOLIDAYS])
    observed = F.transform(
        fixed, lambda d: F.when(F.dayofweek(d) == 7, F.date_sub(d, 1)).when(F.dayofweek(d) == 1, F.date_add(d, 1)).otherwise(d)
    )
    return years.select(F.explode(F.concat(observed, floating)).alias("day")).distinct()


def calendar(spark: SparkSession, start: str, through: str, closures: DataFrame | None = None) -> DataFrame:
    """(day, is_business, previous_business): every day of the range; one row a day, so small at any scale.

    previous_business is the day itself if it is one. `closures` (day) adds days off.
    """
    first, last = int(start[:4]), int(through[:4])
    off = holidays(spark, first, last)
    if closures is not None:
        off = off.unionByName(closures.select("day")).distinct()
    days = spark.sql("select explode(sequence(date_sub(date(:a), 14), date(:b), interval 1 day)) as day", {"a": start, "b": through})
    marked = days.join(off.withColumn("off", F.lit(True)), "day", "left").select(
        "day", (~F.dayofweek("day").isin(1, 7) & F.col("off").isNull()).alias("is_business")
    )
    back = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("previous_business", F.last(F.when(F.col("is_business"), F.col("day")), ignorenulls=True).over(back)).where(
        F.col("day") >= F.lit(start).cast("date")
    )


def clamped(month_start: Column, day: Column) -> Column:
    """That day of the month, or the month's last one."""
    return F.least(F.date_add(month_start, day - 1), F.last_day(month_start))


def due_dates(cadence: Column, anchor: Column, through: Column, gap: Column) -> Column:
    """Array of dates from `anchor` up to, not including, `through`: weekly 7, biweekly 14, quarterly 91 days,
    monthly on the anchor's day clamped to the month's end, else every `gap` days (half to even, at least 1);
    an unknown gap gives the anchor alone."""
    step = F.when(cadence == "weekly", 7).when(cadence == "biweekly", 14).when(cadence == "quarterly", 91).otherwise(F.greatest(F.lit(1), F.bround(gap, 0).cast("int")))
    last = F.date_sub(through, 1)
    by_days = F.transform(F.sequence(F.lit(0), F.floor(F.datediff(last, anchor) / F.greatest(step, F.lit(1))).cast("int")), lambda i: F.date_add(anchor, i * F.greatest(step, F.lit(1))))
    months = F.transform(F.sequence(F.lit(0), F.ceil(F.months_between(through, anchor)).cast("int") + 1), lambda i: F.add_months(anchor, i))
    monthly = F.filter(months, lambda d: d < through)
    return (
        F.when(anchor >= through, F.array().cast("array<date>"))
        .when(cadence == "monthly", monthly)
        .when(step.isNull(), F.array(anchor))
        .otherwise(by_days)
    )


def semi_monthly(spark: SparkSession, days: tuple[int, ...], start: str, through: str) -> DataFrame:
    """(pay_date): those days of each month, clamped to its end and moved back to a business day, in the range."""
    cal = spark.sql("select cast(last_day(date(:b)) as string) as d", {"b": through}).head()["d"]
    cal = calendar(spark, start, cal).select("day", "previous_business")  # to the month's end: a later day may move back into the range
    months = spark.sql("select explode(sequence(trunc(date(:a), 'MM'), date(:b), interval 1 month)) as m", {"a": start, "b": through})
    return (
        months.select(F.explode(F.array(*[clamped(F.col("m"), F.lit(d)) for d in days])).alias("day"))
        .join(F.broadcast(cal), "day")  # one row a day of the asked range
        .select(F.col("previous_business").alias("pay_date"))
        .where((F.col("pay_date") >= F.lit(start).cast("date")) & (F.col("pay_date") <= F.lit(through).cast("date")))
        .distinct()
    )


def every_two_weeks(spark: SparkSession, anchor: str, start: str, through: str) -> DataFrame:
    """(pay_date): every 14th day from `anchor` on that lies in the range, moved back to a business day if that does too;
    none where the anchor lies after the range."""
    cal = calendar(spark, start, through).select("day", "previous_business")
    due = spark.sql("select explode(filter(transform(sequence(0, greatest(0, datediff(date(:b), date(:a))) div 14), i -> date_add(date(:a), cast(i * 14 as int))), d -> d <= date(:b))) as day", {"a": anchor, "b": through})
    moved = due.join(F.broadcast(cal), "day").select(F.col("previous_business").alias("pay_date"))  # one row a day of the asked range
    return moved.where((F.col("pay_date") >= F.lit(start).cast("date")) & (F.col("pay_date") <= F.lit(through).cast("date"))).distinct()
