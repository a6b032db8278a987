"""Working days: Easter, the holidays of Poland, steps back over working days, lead-time windows."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Month and day of the holidays that don't move, and the days after Easter Sunday of those that do.
FIXED_HOLIDAYS = [(1, 1), (1, 6), (5, 1), (5, 3), (8, 15), (11, 1), (11, 11), (12, 25), (12, 26)]
AFTER_EASTER = [0, 1, 49, 60]
#: Working days of notice to a warehouse; days of a window before and after a delivery.
NOTICE_DAYS, DAYS_BEFORE, DAYS_AFTER = 2, 0, 1


def easter(year: Column) -> Column:
    """Easter Sunday, by Gauss's rule with the lunar corrections of the Gregorian calendar."""
    year = year.cast("int")
    century = F.floor(year / 100)
    moon = (F.lit(15) + century - F.floor(century / 4) - F.floor((century * 8 + 13) / 25)) % 30
    age = ((year % 19) * 19 + moon) % 30
    late = F.when((age == 29) | ((age == 28) & (year % 19 > 10)), 1).otherwise(0)
    full = F.date_add(F.make_date(year, F.lit(3), F.lit(21)), (age - late).cast("int"))
    return F.next_day(full, "Sunday")


def holidays(year: Column) -> Column:
    """The year's holidays, as an array of days."""
    fixed = [F.make_date(year, F.lit(m), F.lit(d)) for m, d in FIXED_HOLIDAYS]
    return F.array(*fixed, *[F.date_add(easter(year), n) for n in AFTER_EASTER])


def is_working_day(day: Column) -> Column:
    return (F.weekday(day) < 5) & ~F.array_contains(holidays(F.year(day)), day)


def working_days_before(day: Column, n: int) -> Column:
    """The n-th working day before a day. 14 + 3 n days back hold it: no fortnight has fewer than four."""
    back = F.reverse(F.sequence(F.date_sub(day, 14 + 3 * n), F.date_sub(day, 1)))
    return F.get(F.filter(back, is_working_day), F.lit(n - 1)) if n else day


#: Up to so many days a calendar (some 20 bytes a day) is broadcast, after they were counted.
BROADCAST_DAYS = 1_000_000


def calendar(spark: SparkSession, first: datetime.date, last: datetime.date) -> DataFrame:
    """day, worked, before: every day from one to another, and how many working days of the calendar lie before it.

    Holidays are worked out once a year. One task numbers the days, of which a century has 36,525.
    """
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    years = spark.range(first.year, last.year + 1).select(F.explode(holidays(F.col("id").cast("int"))).alias("day")).distinct().withColumn("holiday", F.lit(True))
    known = days.join(F.broadcast(years), "day", "left").select("day", ((F.weekday("day") < 5) & F.col("holiday").isNull()).alias("worked"))
    order = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return known.withColumn("before", F.coalesce(F.sum(F.col("worked").cast("int")).over(order), F.lit(0)))


def working_day_steps(spark: SparkSession, first: datetime.date, last: datetime.date, steps: tuple[int, ...]) -> DataFrame:
    """day, worked, and for each n back_n: the n-th working day before, of the days from first to last."""
    early = first - datetime.timedelta(days=14 + 3 * max(steps, default=0))
    days = calendar(spark, early, last)
    numbered = days.filter("worked").select(F.col("day").alias("told"), F.col("before").alias("nr"))
    out = days.filter(F.col("day") >= F.lit(first))
    for n in steps:
        out = out.join(numbered.select(F.col("told").alias(f"back_{n}"), (F.col("nr") + n).alias("before")), "before", "left") if n else out.withColumn("back_0", F.col("day"))
    return out.select("day", "worked", *[f"back_{n}" for n in steps])


def with_working_days_before(df: DataFrame, day: str, n: int, out: str) -> DataFrame:
    """df and the n-th working day before a column of days, by a calendar of the days between the first and the last."""
    first, last = df.agg(F.min(day), F.max(day)).first()
    if first is None:
        return df.withColumn(out, F.lit(None).cast("date"))
    steps = working_day_steps(df.sparkSession, first, last, (n,)).select(F.col("day").alias("calendar_day"), F.col(f"back_{n}").alias(out))
    steps = F.broadcast(steps) if (last - first).days <= BROADCAST_DAYS else steps
    return df.join(steps, df[day] == steps["calendar_day"], "left").drop("calendar_day")


def shifted(ymd: Column, days: int) -> Column:
    """A day as yyyyMMdd, so many days later, or null for what is no day."""
    return F.date_format(F.date_add(F.try_to_date(ymd, "yyyyMMdd"), days), "yyyyMMdd")


def dotted(ymd: Column) -> Column:
    """yyyyMMdd as dd.MM.yyyy."""
    return F.concat_ws(".", F.substring(ymd, 7, 2), F.substring(ymd, 5, 2), F.substring(ymd, 1, 4))


def warehouse_day(own: Column, delivery: Column) -> Column:
    """The day a warehouse is told: the row's own, else NOTICE_DAYS working days before the delivery, else null."""
    return F.coalesce(own, working_days_before(delivery, NOTICE_DAYS))


def lead_time(delivery: Column, before: Column, after: Column) -> Column:
    """struct(start, end) around a delivery. Empty numbers take the default, a typed 0 stays, other texts are 0."""
    days = lambda x, default: F.when(F.coalesce(x.cast("string"), F.lit("")) == "", F.lit(default)).otherwise(F.coalesce(x.cast("string").try_cast("int"), F.lit(0)))
    return F.when(delivery.isNotNull(), F.struct(F.date_sub(delivery, days(before, DAYS_BEFORE)).alias("start"), F.date_add(delivery, days(after, DAYS_AFTER)).alias("end")))


def months_between(start: Column, end: Column) -> Column:
    """The first days of all months from one day's to the other's."""
    return F.when(start <= end, F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))


def shown_months(today: Column, start: Column, end: Column) -> Column:
    """At most three months from today's to the window's: the first, and of the others those that hold the window's ends."""
    months = months_between(F.least(today, start), F.greatest(today, end))
    holds = lambda m, i: (i == 0) | (m == F.trunc(start, "month")) | (m == F.trunc(end, "month"))
    return F.when(F.size(months) > 3, F.slice(F.filter(months, holds), 1, 3)).otherwise(months)
