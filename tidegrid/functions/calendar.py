"""Calendar and holiday columns, all from built-in date expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _flag(condition: Column) -> Column:
    return condition.cast("tinyint")


def calendar_columns(time: str) -> dict[str, Column]:
    t = F.col(time)
    hour, weekday = F.hour(t), F.weekday(t)
    weekend = weekday >= 5
    rush = (hour.between(7, 9) | hour.between(17, 19)) & ~weekend
    late = hour.between(22, 23) | (hour <= 2)
    return {
        "hour_of_day": hour.cast("tinyint"),
        "day_of_week": weekday.cast("tinyint"),
        "day_of_month": F.dayofmonth(t).cast("tinyint"),
        "month": F.month(t).cast("tinyint"),
        "year": F.year(t).cast("smallint"),
        "quarter": F.quarter(t).cast("tinyint"),
        "is_weekend": _flag(weekend),
        "is_rush_hour": _flag(rush),
        "is_late_night": _flag(late),
    }


def add_calendar_features(df: DataFrame, time: str = "hour") -> DataFrame:
    """Hour, weekday (Monday 0), day, month, year, quarter and the three flags."""
    return df.withColumns(calendar_columns(time))


def week_of_year(time: str) -> Column:
    return F.weekofyear(F.col(time)).cast("tinyint")


def nth_weekday(year: Column, month: int, weekday: str, n: int) -> Column:
    """The n-th ``weekday`` (for example ``MON``) of a month."""
    before = F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1)
    return F.date_add(F.next_day(before, weekday), 7 * (n - 1))


def last_weekday(year: Column, month: int, weekday: str) -> Column:
    last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.next_day(F.date_sub(last, 7), weekday)


def thanksgiving(year: Column) -> Column:
    return nth_weekday(year, 11, "THU", 4)


# US federal holidays. (name, month, day, first year) on fixed dates,
# (name, month, weekday, n-th, first year) on weekdays.
FIXED_DATES = (
    ("New Year's Day", 1, 1, 1870),
    ("Juneteenth", 6, 19, 2021),
    ("Independence Day", 7, 4, 1870),
    ("Veterans Day", 11, 11, 1938),
    ("Christmas Day", 12, 25, 1870),
)
NTH_WEEKDAYS = (
    ("Martin Luther King Jr. Day", 1, "MON", 3, 1986),
    ("Washington's Birthday", 2, "MON", 3, 1971),
    ("Labor Day", 9, "MON", 1, 1894),
    ("Columbus Day", 10, "MON", 2, 1971),
    ("Thanksgiving", 11, "THU", 4, 1942),
)
MEMORIAL_DAY = ("Memorial Day", 5, "MON", 1971)


def holiday_calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Holiday dimension ``(day, holiday)`` by rule, including observed days.

    A fixed-date holiday on Saturday is also observed on the Friday before, on
    Sunday on the Monday after. About twelve rows per year.
    """
    years = spark.range(first_year, last_year + 2).select(F.col("id").cast("int").alias("y"))
    y = F.col("y")
    entries = []
    for name, month, day, since in FIXED_DATES:
        date = F.make_date(y, F.lit(month), F.lit(day))
        observed = F.when(F.weekday(date) == 5, F.date_sub(date, 1)).when(
            F.weekday(date) == 6, F.date_add(date, 1)
        )
        entries.append(F.struct(date.alias("day"), F.lit(name).alias("holiday"), F.lit(since).alias("since")))
        entries.append(
            F.struct(observed.alias("day"), F.lit(f"{name} (observed)").alias("holiday"), F.lit(since).alias("since"))
        )
    for name, month, weekday, n, since in NTH_WEEKDAYS:
        entries.append(
            F.struct(
                nth_weekday(y, month, weekday, n).alias("day"),
                F.lit(name).alias("holiday"),
                F.lit(since).alias("since"),
            )
        )
    name, month, weekday, since = MEMORIAL_DAY
    entries.append(
        F.struct(last_weekday(y, month, weekday).alias("day"), F.lit(name).alias("holiday"), F.lit(since).alias("since"))
    )
    return (
        years.select(y, F.explode(F.array(*entries)).alias("h"))
        .filter(F.col("h.day").isNotNull() & (y >= F.col("h.since")))
        .filter(F.year("h.day").between(first_year, last_year))
        .select("h.day", "h.holiday")
    )


def is_federal_holiday(time: str) -> Column:
    """The holiday rules as one expression on the day itself: no join is needed."""
    day = F.to_date(F.col(time))
    year = F.year(day)

    def observed(date: Column) -> Column:
        return (
            (day == date)
            | ((F.weekday(date) == 5) & (day == F.date_sub(date, 1)))
            | ((F.weekday(date) == 6) & (day == F.date_add(date, 1)))
        )

    rule = F.lit(False)
    for _, month, dom, since in FIXED_DATES:
        rule = rule | ((year >= since) & observed(F.make_date(year, F.lit(month), F.lit(dom))))
        if (month, dom) == (1, 1):
            # A Saturday New Year is observed on December 31 of the year before.
            rule = rule | observed(F.make_date(year + 1, F.lit(1), F.lit(1)))
    for _, month, weekday, n, since in NTH_WEEKDAYS:
        rule = rule | ((year >= since) & (day == nth_weekday(year, month, weekday, n)))
    _, month, weekday, since = MEMORIAL_DAY
    return rule | ((year >= since) & (day == last_weekday(year, month, weekday)))


def holiday_columns(time: str) -> dict[str, Column]:
    day = F.to_date(F.col(time))
    month, dom, year = F.month(day), F.dayofmonth(day), F.year(day)
    after_thanksgiving = F.datediff(day, thanksgiving(year))
    to_christmas = F.datediff(day, F.make_date(year, F.lit(12), F.lit(25)))
    return {
        "is_federal_holiday": _flag(is_federal_holiday(time)),
        "is_christmas_week": _flag(((month == 12) & (dom >= 24)) | ((month == 1) & (dom == 1))),
        "is_nye": _flag((month == 12) & (dom == 31)),
        "is_nyd": _flag((month == 1) & (dom == 1)),
        "is_thanksgiving_week": _flag(after_thanksgiving.between(-1, 3)),
        "is_halloween_eve": _flag((month == 10) & (dom == 31)),
        "days_to_christmas": F.when(F.abs(to_christmas) <= 30, to_christmas).otherwise(99).cast("smallint"),
    }


def add_holiday_features(df: DataFrame, time: str = "hour") -> DataFrame:
    """US holiday flags, week flags and the distance to Christmas (99 beyond 30 days)."""
    return df.withColumns(holiday_columns(time))


def join_holidays(df: DataFrame, holidays: DataFrame, time: str = "hour") -> DataFrame:
    """``is_federal_holiday`` from a stored holiday dimension, for other countries."""
    days = holidays.select(F.col("day").alias("__day")).distinct().withColumn("__hit", F.lit(1))
    return (
        df.withColumn("__day", F.to_date(F.col(time)))
        .join(days, "__day", "left")
        .withColumn("is_federal_holiday", F.coalesce(F.col("__hit"), F.lit(0)).cast("tinyint"))
        .drop("__day", "__hit")
    )
