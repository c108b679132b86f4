"""Calendar keys, periods and holidays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def monday_week(ts: Column) -> Column:
    """Year and week, Mondays first; days before the first Monday are week 00."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
    return F.format_string("%d-W%02d", F.year(ts), week.cast("int"))


def iso_week(ts: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def period_key(ts: Column, span_days: Column) -> Column:
    """Days for spans of up to 30 days, ISO weeks to 90, months to 365, else quarters."""
    quarter = F.format_string("%d-Q%d", F.year(ts), F.quarter(ts))
    return F.when(span_days <= 30, F.date_format(ts, "yyyy-MM-dd")).when(span_days <= 90, iso_week(ts)).when(span_days <= 365, month_key(ts)).otherwise(quarter)


def season(ts: Column, south: bool = False) -> Column:
    names = ["summer", "autumn", "winter", "spring"] if south else ["winter", "spring", "summer", "autumn"]
    return F.get(F.array(*[F.lit(n) for n in names]), (F.month(ts) % 12 / 3).cast("int"))


def season_year(ts: Column, south: bool = False) -> Column:
    """The year in which the season that spans the new year began."""
    return F.year(ts) - F.when(F.month(ts) <= 2, 1).otherwise(0)


def easter(year: Column) -> Column:
    """The date of Easter Sunday in the Gregorian calendar."""
    y = year.cast("int")
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = y % 19, div(y, 100), y % 100
    d, e, g = div(b, 4), b % 4, div(8 * b + 13, 25)
    h = (19 * a + b - d - g + 15) % 30
    k, r = div(c, 4), c % 4
    w = (32 + 2 * e + 2 * k - h - r) % 7
    m = div(a + 11 * h + 19 * w, 433)
    n = h + w - 7 * m + 90
    month = div(n, 25)
    day = (h + w - 7 * m + 33 * month + 19) % 32
    return F.make_date(y, month, day)


def nth_weekday(year: Column, month: int, weekday: int, nth: int) -> Column:
    """The nth weekday (0: Monday) of a month."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, (F.lit(weekday) - F.weekday(first) + 7) % 7 + 7 * (nth - 1))


def parsed_date(text: Column) -> Column:
    """ISO, then year/month/day, day/month/year, month/day/year; null if none fits."""
    return F.coalesce(*[F.try_to_timestamp(F.when(text.rlike(shape), text), F.lit(form)).cast("date") for shape, form in DATE_FORMS])


#: Shapes and forms of dates in the order of trial.
DATE_FORMS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
)


def period_months_days(text: Column) -> Column:
    """struct<months, days> of periods such as 6m, 1y, 2w or 30d, any case, spaces around; null if of another form."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, r"^(\d+)[dwmy]$", 1).try_cast("int")
    unit = F.regexp_extract(t, r"^\d+([dwmy])$", 1)
    months = F.when(unit == "m", n).when(unit == "y", n * 12).otherwise(0)
    days = F.when(unit == "d", n).when(unit == "w", n * 7).otherwise(0)
    return F.when(n.isNotNull(), F.struct(months.alias("months"), days.alias("days")))


def end_of_period(start: Column, period: Column) -> Column:
    """The last day of the period that begins at start; ends of months stay within the month."""
    p = period_months_days(period)
    return F.date_sub(F.date_add(F.add_months(start, p["months"]), p["days"]), 1)


def anniversary(day: Column, year: Column) -> Column:
    """The day's return in a year; 29 February becomes 28 in common years, null stays null."""
    return F.when(day.isNotNull(), F.make_date(year, F.month(day), F.least(F.dayofmonth(day), F.dayofmonth(F.last_day(F.make_date(year, F.month(day), F.lit(1)))))))


def day_start(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def day_end(ts: Column) -> Column:
    """The last microsecond of the day."""
    return F.date_trunc("day", ts) + F.expr("interval 1 day") - F.expr("interval 1 microsecond")


def schedule_dates(kind: Column, fire: Column) -> tuple[Column, Column, Column]:
    """year, month and day that a schedule of a kind means when it fires."""
    before = F.add_months(fire.cast("date"), -1)
    monthly = kind == "monthly_highlights"
    year = F.when(kind.isin("year_in_review", "trip"), F.year(fire) - 1).when(monthly, F.year(before)).when(kind != "on_this_day", F.year(fire))
    return year, F.when(monthly, F.month(before)), F.when(kind == "on_this_day", fire.cast("date"))


def slid_window(length: Column, start: Column, end: Column, size: float) -> Column:
    """struct window<from, to>: the size around a segment's middle, slid into the file; longer segments and shorter files whole."""
    high = F.least(length, F.greatest((start + end) / 2 + size / 2, F.lit(size)))
    whole, short = end - start >= size, length <= size
    low = F.when(whole, start).when(short, 0.0).otherwise(high - size)
    return F.struct(low.alias("from"), F.when(whole, end).when(short, length).otherwise(high).alias("to")).alias("window")
