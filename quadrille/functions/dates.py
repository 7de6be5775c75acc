"""Dates of the web: seconds since 1970 as W3C date-times and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONED = r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:T(\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?)?)?$"


def date_time(seconds: Column, offset_minutes: int = 0) -> Column:
    """Seconds as ``2004-02-03T04:05:06Z``, or with the zone's offset in minutes instead of Z."""
    local = F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(secs=seconds + 60 * offset_minutes)
    sign, m = ("-" if offset_minutes < 0 else "+"), abs(offset_minutes)
    zone = f"{sign}{m // 60:02d}:{m % 60:02d}" if offset_minutes else "Z"
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone))


def parse_date_time(text: Column) -> Column:
    """The seconds that a date-time, date, month or year begins at, its zone taken into account; NULL for other text."""
    part = lambda k: F.regexp_extract(text, ZONED, k)
    number = lambda k, default: F.when(part(k) == "", default).otherwise(part(k).try_cast("int"))
    day = F.datediff(F.try_make_timestamp_ntz(number(1, None), number(2, 1), number(3, 1), F.lit(0), F.lit(0), F.lit(0)).cast("date"), F.lit("1970-01-01").cast("date"))
    clock = number(4, 0) * 3600 + number(5, 0) * 60 + number(6, 0)
    zone = part(7)
    shift = F.when(zone.isin("", "Z"), 0).otherwise((F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")) * 60 * F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1))
    return F.when(text.rlike(ZONED), day.cast("long") * 86400 + clock - shift)
