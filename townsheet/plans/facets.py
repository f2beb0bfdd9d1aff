"""Faceted queries over listings and places. Facets are ANDed, values within one are ORed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townsheet.functions import hours


@dataclass(frozen=True)
class Facets:
    start: str | None = None
    end: str | None = None
    bands: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    areas: list[str] = field(default_factory=list)
    routes: list[str] = field(default_factory=list)
    stations: list[str] = field(default_factory=list)
    venues: list[str] = field(default_factory=list)
    text: str = ""


TEXT = ("title", "venue_name", "neighborhood_name", "borough", "subcategory")


def mentions(q: str, *columns: Column | str) -> Column:
    """Whether any column contains the text, whatever its case; nothing asked is true."""
    if not q:
        return F.lit(True)
    hits = [F.coalesce(F.lower(F.col(c) if isinstance(c, str) else c).contains(q.lower()), F.lit(False)) for c in columns]
    return F.greatest(*hits) if len(hits) > 1 else hits[0]


def matches(f: Facets, columns: set[str], text: tuple[str, ...] = TEXT) -> Column:
    """A filter that Parquet can prune by: ranges and lists over plain columns come first."""
    found = F.lit(True)
    if f.start:
        found = found & F.col("date_local").between(f.start, f.end or f.start)
    for name, values in (("time_band", f.bands), ("category", f.categories), ("neighborhood", f.areas), ("station", f.stations), ("venue_id", f.venues)):
        if values:
            found = found & F.coalesce(F.col(name).isin(values), F.lit(False))
    if f.routes:
        found = found & F.coalesce(F.arrays_overlap("routes", F.array(*[F.lit(r) for r in f.routes])), F.lit(False))
    return found & mentions(f.text, *[c for c in text if c in columns]) if f.text else found


def browse(events: DataFrame, f: Facets, limit: int = 250, offset: int = 0) -> DataFrame:
    """One page of matching events in order, with the count of each day's events in all pages."""
    found = events.where(matches(f, set(events.columns)))
    days = found.groupBy("date_local").agg(F.count("*").alias("day_count"))
    return found.orderBy("start_utc", "title", "id").offset(offset).limit(limit).join(days, "date_local")


def upcoming(events: DataFrame, as_of: str, zone: str) -> DataFrame:
    """Events on or after the city's date at an instant (UTC wall clock)."""
    today = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.lit(as_of).cast("timestamp_ntz")), "yyyy-MM-dd")
    return events.where(F.col("date_local") >= today)


def day_strip(events: DataFrame, first: str, days: int = 14) -> DataFrame:
    """Events on each of the coming days, empty days kept."""
    spark = events.sparkSession
    strip = spark.range(days).select(F.date_format(F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("date_local"))
    counts = events.groupBy("date_local").agg(F.count("*").alias("n"))
    return strip.join(counts, "date_local", "left").select("date_local", F.coalesce("n", F.lit(0)).alias("n"))


def counts(events: DataFrame, *columns: str) -> DataFrame:
    return events.groupBy(*columns).agg(F.count("*").alias("n"))


def two_level(events: DataFrame, outer: str, inner: str, order: list[str], other: str = "Elsewhere") -> DataFrame:
    """Totals by outer and by outer and inner value, in a fixed order with a bucket for the rest."""
    named = F.when(F.col(outer).isin(order), F.col(outer)).otherwise(other)
    rolled = events.select(named.alias("o"), F.col(inner).alias("i")).rollup("o", "i").agg(F.count("*").alias("n"), F.grouping_id().alias("level")).where("o is not null")
    place = F.array_position(F.array(*[F.lit(x) for x in [*order, other]]), F.col("o"))
    return rolled.select(F.col("o").alias(outer), F.col("i").alias(inner), "level", "n", place.alias("place"))


def manifest(events: DataFrame, least_events: int = 3, least_venues: int = 2) -> DataFrame:
    """Pages worth making: areas with enough events and venues, busy venues, every category."""
    area = events.where("neighborhood is not null").groupBy("neighborhood").agg(F.count("*").alias("n"), F.count_distinct("venue_id").alias("v")).where((F.col("n") >= least_events) & (F.col("v") >= least_venues))
    venue = counts(events, "venue_id").where(F.col("n") >= 2)
    rows = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("key"), "n")
    return rows(area, "area", "neighborhood").unionByName(rows(venue, "venue", "venue_id")).unionByName(rows(counts(events, "category"), "category", "category"))


def with_counts(base: DataFrame, events: DataFrame, base_key: str, event_key: str, least: int = 0) -> DataFrame:
    """base with n, its events; rows without any keep 0."""
    n = events.groupBy(F.col(event_key).alias("_k")).agg(F.count("*").alias("n"))
    return base.join(n, F.col(base_key) == F.col("_k"), "left").drop("_k").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") >= least)


def options(values: DataFrame, events: DataFrame, value_key: str, event_key: str) -> DataFrame:
    """Facet values that have events in scope."""
    return values.join(events.select(F.col(event_key).alias(value_key)).distinct(), value_key, "left_semi")


def random_pick(events: DataFrame, seed: int) -> DataFrame:
    """One row by a digest of its id and a seed: repeatable, and a top-one, not a sort."""
    return events.orderBy(F.md5(F.concat_ws(":", "id", F.lit(str(seed)))), "id").limit(1)


def places_open(places: DataFrame, weekday: int | None, bands: list[str], strict: bool) -> DataFrame:
    """Places with open: true, false or unknown; strict drops the unknown, else only the shut ones go."""
    asked = places.withColumn("open", hours.is_open(F.col("hours_mask"), weekday, bands))
    return asked.where("open") if strict else asked.where("open is null or open")


def ranked_places(places: DataFrame) -> DataFrame:
    """By notability, one more if known open, then by name."""
    score = F.col("notability") + F.coalesce(F.col("open"), F.lit(False)).cast("int")
    return places.withColumn("score", score).orderBy(F.desc("score"), "name", "id")


def photo_first(places: DataFrame, limit: int = 8) -> DataFrame:
    return places.orderBy(F.col("image").isNull(), "ord").limit(limit)


def stop_search(stops: DataFrame, q: str) -> DataFrame:
    """One letter asks for a route; two for the start of a word; three for any part; over three also for the line's name."""
    q, name = q.strip().lower(), F.lower(F.col("name"))
    if len(q) <= 1:
        return stops.where(F.lower("route") == q)
    if len(q) == 2:
        return stops.where((F.lower("route") == q) | name.rlike(f"(?U)\\b\\Q{q}\\E"))
    found = name.contains(q)
    return stops.where(found | F.lower("line").contains(q) if len(q) > 3 else found)


PLACE_TEXT = ("name", "kind_label", "neighborhood_name", "borough", "station_name")


def places(rows: DataFrame, f: Facets) -> DataFrame:
    """Places that match: category, area, routes and id of the nearest station, text."""
    return rows.where(matches(Facets(categories=f.categories, areas=f.areas, routes=f.routes, stations=f.stations, text=f.text), set(rows.columns), PLACE_TEXT))


def scoped(events: DataFrame, area: str | None = None, category: str | None = None, venue: str | None = None) -> DataFrame:
    """Events of one area, category or venue page."""
    for column, value in (("neighborhood", area), ("category", category), ("venue_id", venue)):
        events = events.where(F.col(column) == value) if value else events
    return events


def option_search(options: DataFrame, group: str, name: str, q: str) -> DataFrame:
    """Options whose name holds the text, with the number of those in their group; empty groups are gone."""
    found = options.where(mentions(q.strip(), name))
    return found.join(found.groupBy(group).agg(F.count("*").alias("in_group")), group)
