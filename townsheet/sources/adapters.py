"""Saved bodies to raw feed rows: one projection per kind of source, to the columns of ``feeds.SCHEMAS``.

Bodies (JSON or calendar text) are columns, read from files or tables; nothing is fetched here. A body
that does not parse gives no rows. Times of as_of are UTC wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townsheet.functions import text
from townsheet.functions.rules import _table

VENUE = (
    "host string, name string, venue_name string, origin string, url string, feed string, mode string, events int, links int, "
    "locations array<string>, lat double, lon double, borough string, skip boolean, why string"
)
VENUES = f"venues array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in VENUE.split(', '))}>>"

# ---- Fixed values: borough names by station code, by location code and by stated locality. ----
STATION_BOROUGHS = {"M": "Manhattan", "Bk": "Brooklyn", "B": "Brooklyn", "Q": "Queens", "Bx": "Bronx", "X": "Bronx", "SI": "Staten Island", "R": "Staten Island"}
CODE_BOROUGHS = {"M": "Manhattan", "B": "Brooklyn", "Q": "Queens", "X": "Bronx", "R": "Staten Island"}
LOCALITY_BOROUGHS = {"brooklyn": "Brooklyn", "bronx": "Bronx", "the bronx": "Bronx", "queens": "Queens", "staten island": "Staten Island", "manhattan": "Manhattan"}


def borough(code: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(_table(names), code)


def registry(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Venues of saved registries."""
    return bodies.select(F.explode(F.from_json(body, VENUES)["venues"]).alias("v")).select("v.*")


def readable(floor: int = 2) -> Column:
    """Whether a venue's pages can be read: detail pages need links, listings events, and none is skipped by hand."""
    enough = F.when(F.col("mode") == "detail", F.coalesce("links", F.lit(0)) > 0).otherwise(F.coalesce("events", F.lit(0)) >= floor)
    return ~F.coalesce("skip", F.lit(False)) & enough


def areas(features: DataFrame, value: str = "value", order: str = "ord") -> DataFrame:
    """Polygons from GeoJSON features: ord, slug, name, borough, kind, rings; the first of a slug stays, of any kind."""
    point = "array<double>"
    props = "properties struct<name:string,borough:string,nta_type:string>, geometry struct<type:string,coordinates:string>"
    f = features.select(F.col(order).alias("ord"), F.from_json(value, props).alias("f")).select("ord", "f.properties.*", "f.geometry.*")
    many = F.when(F.col("type") == "MultiPolygon", F.from_json("coordinates", f"array<array<array<{point}>>>")).otherwise(F.array(F.from_json("coordinates", f"array<array<{point}>>")))
    ring = lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    rings = F.transform(many, lambda p: F.struct(ring(F.get(p, F.lit(0))).alias("outer"), F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), ring).alias("holes")))
    rows = f.where("name <> '' and type is not null").select("ord", text.area_slug(F.col("name")).alias("slug"), "name", "borough", F.col("nta_type").alias("kind"), rings.alias("rings")).where("slug <> ''")
    return rows.groupBy("slug").agg(F.min_by(F.struct("ord", "name", "borough", "kind", "rings"), "ord").alias("r")).select("slug", "r.*")


def _between(ms: Column, as_of: str, days: int) -> Column:
    at = F.unix_millis(F.lit(f"{as_of}+00:00").cast("timestamp"))
    return (ms > at - 86_400_000) & (ms < at + days * 86_400_000)


def squarespace(saved: DataFrame, as_of: str, days: int) -> DataFrame:
    """saved: host, name, origin, collection_url, body. Records lie under ``upcoming``; past ones are dropped."""
    item = (
        "id:string,title:string,startDate:bigint,endDate:bigint,fullUrl:string,excerpt:string,assetUrl:string,"
        "location:struct<mapLat:double,mapLng:double>,tags:array<string>,categories:array<string>"
    )
    it = saved.select("host", "name", "origin", "collection_url", F.explode(F.from_json("body", f"upcoming array<struct<{item}>>")["upcoming"]).alias("e"))
    none = F.array().cast("array<string>")
    return it.where(_between(F.col("e.startDate"), as_of, days)).select(
        F.col("host").alias("venue_host"), F.col("name").alias("venue_name"), "origin", "collection_url", "e.id", "e.title", "e.startDate", "e.endDate", "e.fullUrl", "e.excerpt", "e.assetUrl", "e.location",
        F.coalesce("e.tags", none).alias("tags"), F.coalesce("e.categories", none).alias("categories"),
    )


def _at_venue() -> list[Column]:
    return [F.col("host").alias("venue_host"), F.coalesce(F.nullif("venue_name", F.lit("")), "name").alias("venue_name"), F.col("v_lat").alias("lat"), F.col("v_lon").alias("lon"), F.col("borough")]


def tribe(saved: DataFrame) -> DataFrame:
    """saved: venue columns (v_lat, v_lon for its point) and body. Times are local as stated; the payload's own address goes along."""
    item = (
        "global_id:string,id:string,title:string,url:string,start_date:string,end_date:string,all_day:boolean,status:string,cost:string,excerpt:string,description:string,"
        "categories:array<struct<name:string>>,tags:array<struct<name:string>>,venue:struct<address:string,geo_lat:string,geo_lng:string>"
    )
    it = saved.select("*", F.explode(F.from_json("body", f"events array<struct<{item}>>")["events"]).alias("e"))
    names = lambda c: F.coalesce(F.col(f"e.{c}.name"), F.array().cast("array<string>")).alias(c)
    return it.select(
        *_at_venue(), F.lit("tribe").alias("feed"), F.coalesce("e.global_id", "e.id").alias("id"), "e.title", "e.url", F.col("e.start_date").alias("start"), F.col("e.end_date").alias("end"), F.coalesce("e.all_day", F.lit(False)).alias("all_day"), "e.status",
        F.nullif("e.cost", F.lit("")).alias("cost"), F.coalesce(F.nullif("e.excerpt", F.lit("")), "e.description").alias("description"), names("categories"), names("tags"),
        F.col("e.venue.address").alias("venue_address"), F.col("e.venue.geo_lat").alias("venue_lat"), F.col("e.venue.geo_lng").alias("venue_lon"),
    )


def _iso(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias(c)


def calendar_venues(events: DataFrame, venues: DataFrame, key: str) -> DataFrame:
    """Events of venues' calendar exports (from ``calendars.events``, by key) in the same columns as ``tribe``."""
    e, none = events.alias("e"), F.lit(None).cast("string")
    return venues.join(e, venues[key] == F.col(f"e.{key}")).select(
        *_at_venue(), F.lit("ics").alias("feed"), F.col("e.uid").alias("id"), F.col("e.summary").alias("title"), F.col("e.url"), _iso("e.start").alias("start"), _iso("e.end").alias("end"), F.col("e.all_day"), F.col("e.status"), none.alias("cost"), F.col("e.description"),
        F.coalesce("e.categories", F.array().cast("array<string>")).alias("categories"), F.array().cast("array<string>").alias("tags"), F.col("e.location").alias("venue_address"), F.col("e.lat").cast("string").alias("venue_lat"), F.col("e.lon").cast("string").alias("venue_lon"),
    )


def luma(events: DataFrame, calendars: DataFrame, as_of: str | None = None, days: int = 90) -> DataFrame:
    """Events of community calendars, those within the horizon if one is given; calendars: calendar_id, calendar_name."""
    if as_of is not None:
        events = events.where(_inside(F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss"), as_of, days))
    fields = ("uid", "summary", "description", "location", "organizer", "status", "lat", "lon", "all_day")
    return calendars.join(events, "calendar_id").select("calendar_id", "calendar_name", *fields, _iso("start"), _iso("end"))


DRUPAL = (
    "data array<struct<id:string,attributes:struct<title:string,field_date:struct<value:string,end_value:string>,body:struct<summary:string,value:string>,path:struct<alias:string>,"
    "field_event_virtual:boolean,field_hybrid:boolean,field_event_offsite:boolean,field_event_offsite_address:string>,relationships:map<string,struct<data:string>>>>,"
    "included array<struct<id:string,type:string,attributes:struct<name:string,title:string>>>"
)


def drupal(pages: DataFrame, body: str = "body") -> DataFrame:
    """Rows of saved JSON:API pages; related entities, given once for all pages, become names in their stated order."""
    parsed = pages.select(F.from_json(body, DRUPAL).alias("j"))
    it = parsed.select(F.explode("j.data").alias("d")).select("d.id", F.col("d.attributes").alias("a"), F.col("d.relationships").alias("rel"))
    terms = parsed.select(F.explode("j.included").alias("i")).select(F.col("i.id").alias("term"), F.coalesce("i.attributes.name", "i.attributes.title").alias("named")).where("named <> ''")
    terms = terms.groupBy("term").agg(F.min("named").alias("named"))
    # to-one and to-many relations alike: the ids in the order of the text
    asked = it.select("id", F.explode("rel").alias("field", "to")).select("id", "field", F.posexplode(F.regexp_extract_all("to.data", F.lit(r'"id"\s*:\s*"([^"]*)"'), F.lit(1))).alias("pos", "term"))
    lists = asked.join(terms, "term").groupBy("id", "field").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "named"))), lambda s: s["named"]).alias("names"))
    of = {"location": "field_location", "branches": "field_participating_branches", "kind": "field_event_type_parent", "audience": "field_age", "tags": "field_tags"}
    wide = lists.groupBy("id").agg(*[F.max(F.when(F.col("field") == f, F.col("names"))).alias(n) for n, f in of.items()])
    flag = lambda c: F.coalesce(f"a.{c}", F.lit(False))
    return it.join(wide, "id", "left").select(
        "id", "a.title", F.col("a.field_date.value").alias("start"), F.col("a.field_date.end_value").alias("end"), F.coalesce(F.nullif("a.body.summary", F.lit("")), "a.body.value").alias("body"), F.col("a.path.alias").alias("path"),
        flag("field_event_virtual").alias("virtual"), flag("field_hybrid").alias("hybrid"), flag("field_event_offsite").alias("offsite"), F.get("location", F.lit(0)).alias("location"), "branches", F.get("kind", F.lit(0)).alias("kind"), "audience",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.col("a.field_event_offsite_address").alias("address"),
    )


def _inside(start: Column, as_of: str, days: int) -> Column:
    """Whether a stated time, UTC where it states no offset, lies from a day before as_of to the horizon, both ends in."""
    now = F.lit(f"{as_of}+00:00").cast("timestamp")
    when = F.coalesce(F.try_to_timestamp(start), F.try_to_timestamp(F.concat(start, F.lit("+00:00"))))
    return F.coalesce(when.between(now - F.make_interval(days=F.lit(1)), now + F.make_interval(days=F.lit(days))), F.lit(False))


def dice(events: DataFrame, as_of: str | None = None, days: int = 90) -> DataFrame:
    """Marked-up events (``pages.markup_events``) of ticket pages within the horizon; events: city_slug, page_url and lastmod besides."""
    rows = events if as_of is None else events.where(_inside(F.col("start"), as_of, days))
    lastmod = F.col("lastmod") if "lastmod" in events.columns else F.lit(None).cast("string")
    return rows.select(
        F.coalesce("url", "page_url").alias("url"), "city_slug", F.col("title").alias("name"), "type", F.col("start").alias("startDate"), F.col("end").alias("endDate"), F.col("status").alias("eventStatus"), "description", F.col("venue").alias("venue_name"),
        F.col("address").alias("venue_address"), "lat", "lon", "organizer", "image", lastmod.alias("lastmod"),
    )


def jsonld(events: DataFrame, venues: DataFrame, key: str) -> DataFrame:
    """Marked-up events of venues' own pages.

    On listing pages the event's room is the venue, and the registry's name stands in; on detail pages it
    is the other way round. A row with neither point nor address takes the registry's point, unless the
    registry knows several rooms.
    """
    v = venues.select(key, *[F.col(c).alias(f"v_{c}") for c in ("host", "name", "venue_name", "mode", "url", "locations", "lat", "lon", "borough")])
    rows = events.join(v, key)
    own = F.coalesce(F.nullif("v_venue_name", F.lit("")), "v_name")
    pointless = F.col("lat").isNull() | F.col("lon").isNull()
    borrow = pointless & F.col("address").isNull() & (F.size(F.coalesce("v_locations", F.array().cast("array<string>"))) <= 1)
    return rows.select(
        F.col("v_host").alias("venue_host"), F.when(F.col("v_mode") == "detail", own).otherwise(F.coalesce(F.nullif(text.squeeze(F.col("venue")), F.lit("")), own)).alias("venue_name"), "address",
        F.coalesce(borough(F.lower(F.trim("locality")), LOCALITY_BOROUGHS), "v_borough").alias("borough"), text.squeeze(F.col("title")).alias("title"), "type", F.coalesce("url", "v_url").alias("url"), "start", "end", "status", "description",
        F.col("price").alias("price_min"), F.when(F.col("price").isNotNull(), F.col("price") == 0).alias("is_free"), "image",
        F.when(borrow, F.col("v_lat")).when(~pointless, F.col("lat")).alias("lat"), F.when(borrow, F.col("v_lon")).when(~pointless, F.col("lon")).alias("lon"),
    )
