"""iCalendar bodies to event rows, on built-in functions: unfold, split, then one pass of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PROP = r"^([A-Za-z0-9-]+)((?:;[^:]*)?):(.*)$"


def _untext(c: Column) -> Column:
    """Escapes undone in one pass: backslashes are parked on a character that text does not hold."""
    parked = F.replace(c, F.lit("\\\\"), F.lit("\u0001"))
    for a, b in (("\\n", "\n"), ("\\N", "\n"), ("\\,", ","), ("\\;", ";")):
        parked = F.replace(parked, F.lit(a), F.lit(b))
    return F.trim(F.replace(parked, F.lit("\u0001"), F.lit("\\")))


def _when(value: Column, params: Column, default_zone: str) -> tuple[Column, Column]:
    """UTC wall clock (a date at midnight) and whether it is a whole day."""
    v = F.trim(value)
    upper = F.upper(params)
    stated = upper.contains("VALUE=DATE") & ~upper.contains("DATE-TIME")
    day = F.when(v.rlike(r"^\d{8}$"), F.try_to_timestamp(v, F.lit("yyyyMMdd")).cast("timestamp_ntz"))
    clock = F.when(v.rlike(r"^\d{8}T\d{6}Z?$"), F.try_to_timestamp(F.substring(v, 1, 15), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz"))
    zone = F.regexp_replace(F.trim(F.regexp_extract(params, r"(?i)TZID=([^;:]+)", 1)), '^"|"$', "")
    known = F.when(zone.rlike(r"^[A-Z][A-Za-z_]+/[A-Za-z_/+-]+$"), zone).otherwise(default_zone)
    instant = F.when(v.endswith("Z"), clock).otherwise(F.convert_timezone(known, F.lit("UTC"), clock))
    whole = stated | v.rlike(r"^\d{8}$")
    return F.when(whole, day).otherwise(instant), whole & day.isNotNull()


def events(bodies: DataFrame, key: str, body: str = "body", default_zone: str = "UTC") -> DataFrame:
    """One row per dated VEVENT of each body, in order (key, n). The last of a repeated property wins."""
    unfolded = F.regexp_replace(F.col(body), r"\r?\n[ \t]", "")
    chunks = F.slice(F.split(unfolded, "BEGIN:VEVENT"), 2, 1 << 30)
    rows = bodies.select(key, F.posexplode_outer(chunks).alias("n", "c")).where("c is not null")
    lines = F.transform(F.split(F.substring_index("c", "END:VEVENT", 1), r"\R"), lambda x: F.trim(x))
    props = F.transform(F.filter(lines, lambda x: x.rlike(_PROP)), lambda x: F.struct(F.upper(F.regexp_extract(x, _PROP, 1)).alias("k"), F.regexp_extract(x, _PROP, 2).alias("p"), F.regexp_extract(x, _PROP, 3).alias("v")))
    rows = rows.withColumn("props", props)
    last = lambda name: F.try_element_at(F.filter("props", lambda x: x["k"] == name), F.lit(-1))
    for name in ("DTSTART", "DTEND", "SUMMARY", "DESCRIPTION", "LOCATION", "URL", "UID", "STATUS", "GEO", "ORGANIZER", "RRULE"):
        rows = rows.withColumn(f"_{name}", last(name))
    of = lambda name: F.col(f"_{name}.v")
    start, whole = _when(of("DTSTART"), F.col("_DTSTART.p"), default_zone)
    end, _ = _when(of("DTEND"), F.col("_DTEND.p"), default_zone)
    geo = F.split(of("GEO"), ";")
    lat, lon = F.get(geo, F.lit(0)).try_cast("double"), F.get(geo, F.lit(1)).try_cast("double")
    both = lat.isNotNull() & lon.isNotNull()
    kinds = F.filter("props", lambda x: x["k"] == "CATEGORIES")
    categories = F.filter(F.flatten(F.transform(kinds, lambda x: F.transform(F.split(x["v"], r"(?<!\\),"), _untext))), lambda c: c != "")
    cn = F.nullif(F.trim(F.regexp_extract(F.col("_ORGANIZER.p"), r'CN="?([^";:]+)"?', 1)), F.lit(""))
    return rows.select(
        key, "n", F.trim(of("UID")).alias("uid"), _untext(of("SUMMARY")).alias("summary"), _untext(of("DESCRIPTION")).alias("description"), _untext(of("LOCATION")).alias("location"), F.trim(of("URL")).alias("url"), F.upper(F.trim(of("STATUS"))).alias("status"),
        cn.alias("organizer"), F.trim(of("RRULE")).alias("rrule"), start.alias("start"), end.alias("end"), F.coalesce(whole, F.lit(False)).alias("all_day"), F.when(both, lat).alias("lat"), F.when(both, lon).alias("lon"), categories.alias("categories"),
    ).where("start is not null")


def upcoming(events: DataFrame, as_of: str, horizon_days: int) -> DataFrame:
    """Not yet over, and starting within the horizon; a whole day runs to its end."""
    now = F.lit(as_of).cast("timestamp_ntz")
    day = F.expr("interval 1 day")
    end = F.coalesce("end", F.when(F.col("all_day"), F.col("start") + day).otherwise(F.col("start")))
    return events.where((end >= now) & (F.col("start") <= now + F.make_interval(days=F.lit(horizon_days))))


def feed_summary(events: DataFrame, key: str, as_of: str) -> DataFrame:
    """events, future, recurring (a rule without a past UNTIL), latest start and live by feed."""
    now = F.lit(as_of).cast("timestamp_ntz")
    until = F.to_timestamp_ntz(F.nullif(F.regexp_extract(F.coalesce("rrule", F.lit("")), r"UNTIL=(\d{8})", 1), F.lit("")), F.lit("yyyyMMdd"))
    going = F.col("rrule").isNotNull() & (until.isNull() | (until >= now))
    out = events.groupBy(key).agg(F.count("*").alias("events"), F.count_if(F.col("start") >= now).alias("future"), F.count_if(going).alias("recurring"), F.max("start").alias("latest"))
    return out.withColumn("live", (F.col("future") > 0) | (F.col("recurring") > 0))
