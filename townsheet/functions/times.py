"""Times as columns. Local times are TIMESTAMP_NTZ; instants become local through the city's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _try(c: Column, pattern: str) -> Column:
    return F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz")


def parse_naive(c: Column) -> Column:
    """Date, date and minutes, or date and seconds; a fraction is cut. Anything else is null."""
    s = F.substring_index(F.replace(F.trim(c), F.lit("T"), F.lit(" ")), ".", 1)
    shape = lambda p, f: F.when(s.rlike(p), _try(s, f))
    return F.coalesce(
        shape(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
        shape(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
        shape(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    )


def combine(day: Column, clock: Column) -> Column:
    """The date of one field with the hour and minute of another; without a clock, the day as it is."""
    made = F.to_timestamp_ntz(F.concat(F.date_format(day, "yyyy-MM-dd "), F.date_format(clock, "HH:mm")), F.lit("yyyy-MM-dd HH:mm"))
    return F.when(day.isNotNull() & clock.isNotNull(), made).otherwise(day)


def local_from_iso(c: Column, zone: str) -> Column:
    """An ISO instant as local time; a time without an offset is local already."""
    offset = r"(Z|[+-]\d{2}:?\d{2})$"
    aware = F.when(c.rlike(r"T.*" + offset), F.try_to_timestamp(c))
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(aware, F.current_timezone()), "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.coalesce(local, F.when(~c.rlike(r"T.*" + offset), parse_naive(c)))


def local_from_millis(c: Column, zone: str) -> Column:
    """Milliseconds since the epoch as local time."""
    utc = F.timestamp_add("MILLISECOND", c, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def local_to_utc(c: Column, zone: str) -> Column:
    """A local time as UTC wall clock; the earlier reading of a repeated hour."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), c)


def band(c: Column) -> Column:
    h = F.hour(c)
    return F.when(h < 12, "morning").when(h < 17, "afternoon").when(h < 21, "evening").when(h.isNotNull(), "late")


def repaired_end(start: Column, end: Column) -> Column:
    """An end before its start is on the next day."""
    return F.when(end < start, end + F.expr("interval 1 day")).otherwise(end)


def dropped_end(start: Column, end: Column) -> Column:
    """An end before its start is no end."""
    return F.when(end >= start, end)


def event_id(venue_slug: Column, start: Column, title_slug: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", venue_slug, F.date_format(start, "yyyy-MM-dd'T'HH:mm"), F.substring(title_slug, 1, 40)).cast("binary")), 1, 16)


def schema_date(c: Column) -> Column:
    """The shapes that markup states dates in, read as local where no offset is given."""
    patterns = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
    return F.coalesce(*[_try(c, p) for p in patterns])


def clock12(c: Column) -> Column:
    return F.lower(F.date_format(c, "h:mm a"))


def walk_minutes(meters: Column) -> Column:
    """Eighty metres a minute, one minute at least, halves rounded up."""
    return F.greatest(F.lit(1), F.floor(meters / 80.0 + 0.5)).cast("int")
