"""What a request for a memory means: its type, its range of days and its dividers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mosaiq.functions import calendar
from mosaiq.functions.boundaries import let

# The first and last month of each season in the north, and which northern season a southern one is.
SEASONS = {"spring": (3, 5), "summer": (6, 8), "fall": (9, 11), "winter": (12, 2)}
SOUTHERN = {"spring": "fall", "summer": "winter", "fall": "spring", "winter": "summer"}


def inferred_type(given: Column, year: Column, month: Column, person: Column, season: Column, birthday: Column, album: Column) -> Column:
    """The type that is asked for, else what the date says: a month of a year, or a whole year if nothing narrows it; null if it stays open.

    An album brings its own rows, so dates say nothing about it. Empty texts count as null.
    """
    held = lambda c: c.isNotNull() & (c.cast("string") != "")
    narrowed = F.coalesce(person, F.lit(False)) | held(season) | held(birthday)
    by_date = F.when(year.isNotNull(), F.when(month.isNotNull(), "monthly_highlights").when(~narrowed, "year_in_review"))
    return F.when(held(given) | held(album), F.nullif(given, F.lit(""))).otherwise(by_date)


def days_of(start: Column, end: Column) -> Column:
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.cast("date").alias("start"), end.cast("date").alias("end")))


def season_range(season: Column, year: Column, south: Column) -> Column:
    """struct<start,end> of a season; winter begins in its year and ends in the next. Null for other words."""
    months = {"autumn": SEASONS["fall"]} | SEASONS
    southern = {"autumn": SEASONS[SOUTHERN["fall"]]} | {name: SEASONS[other] for name, other in SOUTHERN.items()}
    of = lambda known: F.create_map(*[x for name, (first, last) in known.items() for x in (F.lit(name), F.struct(F.lit(first).alias("first"), F.lit(last).alias("last")))])
    found = F.when(south, F.try_element_at(of(southern), F.lower(season))).otherwise(F.try_element_at(of(months), F.lower(season)))
    return let(found, lambda m: days_of(F.make_date(year, m["first"], F.lit(1)), F.last_day(F.make_date(year + (m["first"] > m["last"]).cast("int"), m["last"], F.lit(1)))))


def month_range(year: Column, month: Column) -> Column:
    return days_of(F.make_date(year, month, F.lit(1)), F.last_day(F.make_date(year, month, F.lit(1))))


def year_range(year: Column) -> Column:
    return days_of(F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31)))


def resolved(kind: Column, year: Column, month: Column, season: Column, birthday: Column, start: Column, end: Column, period: Column, south: Column) -> Column:
    """struct<start,end> of the days that are meant, null if the request doesn't say.

    Days that are given by hand (start with end, or with a period) come first. Without a type a birthday's year, then the
    calendar year follows. A season and a month need their year; a spotlight on a person may go from birthday to birthday; other
    types take the month, if there is one, or the year. Types that need something else than what is there have no range, whatever is given by hand.
    """

    def of(x: Column) -> Column:
        by_hand = F.coalesce(days_of(x["start"], x["end"]), days_of(x["start"], calendar.end_of_period(x["start"], period)))
        of_birthday = days_of(calendar.anniversary(x["born"], year), F.date_sub(calendar.anniversary(x["born"], year + 1), 1))
        typed = F.when(x["typed"].isNotNull(), F.coalesce(by_hand, F.when(kind == "person_spotlight", of_birthday), x["typed"]))
        return F.when(kind.isNotNull(), typed).otherwise(F.coalesce(by_hand, of_birthday, year_range(year)))

    of_type = F.when(kind == "season", season_range(season, year, south)).when(kind == "monthly_highlights", month_range(year, month)).otherwise(F.coalesce(month_range(year, month), year_range(year)))
    return let(F.struct(calendar.parsed_date(start).alias("start"), calendar.parsed_date(end).alias("end"), calendar.parsed_date(birthday).alias("born"), of_type.alias("typed")), of)


def months_spanned(start: Column, end: Column) -> Column:
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) + 1


def divider_mode(kind: Column, start: Column, end: Column) -> Column:
    """none, month or year: none for months, trips and up to three months; years for days across years and ranges over new year."""
    span = months_spanned(start, end)
    by_range = F.when(span.isNull(), "month").when(span <= 3, "none").when(F.year(start) != F.year(end), "year").otherwise("month")
    return F.when(kind.isin("monthly_highlights", "trip"), "none").when(kind == "on_this_day", "year").otherwise(by_range)
