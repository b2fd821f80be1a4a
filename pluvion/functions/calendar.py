"""Civil years of model calendars, and time axes given by a unit and an origin."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the units of a time axis, in seconds.
UNIT_SECONDS = {
    1: ("second", "seconds", "sec", "secs", "s"), 60: ("minute", "minutes", "min", "mins"), 3600: ("hour", "hours", "hr", "hrs", "h"), 86400: ("day", "days", "d"),
}


def civil_year(i: Column, t0: Column, step_min: Column, calendar: Column) -> Column:
    """Civil year of step ``i`` of an axis that begins at ``t0``: 360 or 365 days a year by the calendar's name, else that of the Gregorian calendar."""
    day = F.floor(F.floor(i * step_min / 60) / 24).cast("int")
    plain = lambda n, before: F.year(t0) + F.floor((before + day) / n).cast("int")
    before360 = (F.month(t0) - 1) * 30 + F.dayofmonth(t0) - 1
    leap = F.dayofyear(F.make_date(F.year(t0), F.lit(12), F.lit(31))) == 366
    before365 = F.dayofyear(t0) - 1 - F.when((F.month(t0) > 2) & leap, 1).otherwise(0)
    gregorian = F.year(F.date_add(t0.cast("date"), day))
    return F.when(calendar == "360_day", plain(360, before360)).when(calendar == "365_day", plain(365, before365)).otherwise(gregorian)


def unit_seconds(units: Column) -> Column:
    """Seconds of the unit of '<unit> since <origin>'; NULL for another text."""
    word = F.lower(F.regexp_extract(units, r"^\s*([A-Za-z]+)\s+since\s", 1))
    out = F.lit(None).cast("long")
    for seconds, names in UNIT_SECONDS.items():
        out = F.when(word.isin(list(names)), F.lit(seconds)).otherwise(out)
    return out


def origin(units: Column) -> Column:
    """The origin of '<unit> since <origin>', a date with or without a time of day; NULL for another text."""
    text = F.regexp_extract(units, r"\ssince\s+(\d{1,4}-\d{1,2}-\d{1,2})(?:[T ]+(\d{1,2}:\d{2}(?::\d{2})?))?", 0)
    day = F.regexp_extract(units, r"\ssince\s+(\d{1,4}-\d{1,2}-\d{1,2})", 1)
    time = F.regexp_extract(units, r"\ssince\s+\d{1,4}-\d{1,2}-\d{1,2}[T ]+(\d{1,2}:\d{2}(?::\d{2})?)", 1)
    return F.when(text != "", F.to_timestamp_ntz(F.concat_ws(" ", day, F.when(time == "", "00:00").otherwise(time))))


def at(value: Column, units: Column) -> Column:
    """The time that a number of an axis stands for, to the microsecond."""
    us = F.unix_micros(origin(units).cast("timestamp")) + F.bround(value.cast("double") * unit_seconds(units) * 1_000_000).cast("long")
    return F.timestamp_micros(us).cast("timestamp_ntz")
