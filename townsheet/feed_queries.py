"""Queries over saved bodies, page signals, the single feeds and reports, each beside its SQL.

As in ``queries``, rows are derived from the driver's tables: a row becomes a saved body (JSON, markup,
calendar text) that holds its columns, and the query reads them back through the library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townsheet.functions import text, times
from townsheet.operators import snapshots
from townsheet.plans import facets, lines, places, reports
from townsheet.queries import AS_OF, LISTED, _points, listed, query, table
from townsheet.sources import adapters, feeds, pages, signals

ZONE = "America/New_York"


def js(*fields) -> F.Column:
    return F.to_json(F.struct(*fields))


def s(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# ---- saved bodies ----


@query("""WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'detail' ELSE 'listing' END AS mode, c_custkey % 5 AS events, c_custkey % 4 AS links, c_custkey % 7 = 0 AS skip FROM customer)
SELECT 'h' || c_custkey AS host, mode FROM v WHERE NOT skip AND CASE WHEN mode = 'detail' THEN links > 0 ELSE events >= 2 END""")
def venue_registries(spark, d):
    """Saved registries, and the venues in them that can be read."""
    k = F.col("c_custkey")
    venue = F.struct(F.concat(F.lit("h"), s(k)).alias("host"), F.col("c_name").alias("name"), F.when(k % 3 == 0, "detail").otherwise("listing").alias("mode"), (k % 5).alias("events"), (k % 4).alias("links"), (k % 7 == 0).alias("skip"))
    bodies = table(spark, d, "customer").select(js(F.array(venue).alias("venues")).alias("body"))
    return adapters.registry(bodies).where(adapters.readable(2)).select("host", "mode")


@query("""WITH n AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 6 = 0 THEN 'Area (' || c_nationkey || ')' ELSE 'Area/' || c_custkey END AS name FROM customer), g AS (SELECT *, regexp_replace(regexp_replace(lower(name), '[()]', '', 'g'), '[ /]+', '-', 'g') AS slug FROM n)
SELECT slug, min(ord) AS ord, arg_min(name, ord) AS name, CASE WHEN min(ord) % 2 = 0 THEN 2 ELSE 1 END AS parts, CASE WHEN min(ord) % 2 = 0 THEN 0 ELSE 1 END AS holes FROM g GROUP BY 1""")
def area_polygons(spark, d):
    """A3: GeoJSON features to rings; the first of a slug stays."""
    k = F.col("c_custkey")
    ring = lambda a: F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((a, a), (4 - a, a), (4 - a, 4 - a), (a, 4 - a))])
    name = F.when(k % 6 == 0, F.concat(F.lit("Area ("), s("c_nationkey"), F.lit(")"))).otherwise(F.concat(F.lit("Area/"), s(k)))
    props = js(name.alias("name"), F.col("c_mktsegment").alias("borough"))
    one, many = js(F.lit("Polygon").alias("type"), F.array(ring(0), ring(1)).alias("coordinates")), js(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring(0)), F.array(ring(1))).alias("coordinates"))
    value = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), F.when(k % 2 == 0, many).otherwise(one), F.lit("}"))
    found = adapters.areas(table(spark, d, "customer").select(k.alias("ord"), value.alias("value")))
    return found.select("slug", "ord", "name", F.size("rings").alias("parts"), F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r["holes"])).alias("holes"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Talk ' || o_orderkey AS title, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus || ' hall' END AS location, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || '|' || o_orderstatus || ' hall' ELSE '' END AS tags, o_orderkey % 5 = 0 AS virtual FROM orders""")
def sidecar_pages(spark, d):
    """JSON:API pages with related names given once for all pages, to-one and to-many."""
    k = F.col("o_orderkey")
    ref = lambda c: F.struct(c.alias("id"))
    attributes = F.struct(F.concat(F.lit("Talk "), s(k)).alias("title"), (k % 5 == 0).alias("field_event_virtual"))
    relations = F.struct(F.struct(F.when(k % 3 > 0, ref(F.col("o_orderstatus"))).alias("data")).alias("field_location"), F.struct(F.when(k % 2 == 0, F.array(ref(F.col("o_orderpriority")), ref(F.col("o_orderstatus")))).alias("data")).alias("field_tags"))
    entity = lambda i, n: F.struct(i.alias("id"), F.lit("t").alias("type"), F.struct(n.alias("name")).alias("attributes"))
    body = js(F.array(F.struct(s(k).alias("id"), attributes.alias("attributes"), relations.alias("relationships"))).alias("data"), F.array(entity(F.col("o_orderstatus"), F.concat("o_orderstatus", F.lit(" hall"))), entity(F.col("o_orderpriority"), F.col("o_orderpriority"))).alias("included"))
    rows = adapters.drupal(table(spark, d, "orders").select(body.alias("body")))
    return rows.select("id", "title", "location", F.array_join("tags", "|").alias("tags"), "virtual")


@query(f"""SELECT CAST(event_id AS VARCHAR) AS id, event_type AS title, epoch_ms(date_trunc('second', ts)) AS start_ms, CASE WHEN event_id % 2 = 0 THEN value END AS lat, event_type || '|x' AS tags FROM events WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND ts < TIMESTAMP '{AS_OF}' + INTERVAL 7 DAY""")
def site_builder_rows(spark, d):
    """A site builder's collection, upcoming records within the horizon."""
    item = F.struct(s("event_id").alias("id"), F.col("event_type").alias("title"), F.unix_millis(F.col("ts").cast("timestamp")).alias("startDate"), F.when(F.col("event_id") % 2 == 0, F.struct(F.col("value").alias("mapLat"))).alias("location"), F.array(F.col("event_type"), F.lit("x")).alias("tags"))
    saved = table(spark, d, "events").select(F.lit("h").alias("host"), F.lit("n").alias("name"), F.lit("https://h").alias("origin"), F.lit("c").alias("collection_url"), js(F.array(item).alias("upcoming"), F.array(item).alias("past")).alias("body"))
    return adapters.squarespace(saved, AS_OF, 7).select("id", "title", (F.col("startDate") - F.pmod("startDate", F.lit(1000))).alias("start_ms"), F.col("location.mapLat").alias("lat"), F.array_join("tags", "|").alias("tags"))


@query("""SELECT CAST(event_id AS VARCHAR) AS id, event_type AS title, 'Hall ' || user_id AS venue_name, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '$5' END AS cost, CASE WHEN event_id % 2 = 0 THEN '40.5' END AS venue_lat, event_type AS categories FROM events""")
def blog_calendar_rows(spark, d):
    """B1: a blog calendar's route: cost as stated, the payload's own address, an empty venue list."""
    k = F.col("event_id")
    item = js(s(k).alias("id"), F.col("event_type").alias("title"), F.when(k % 3 == 0, "").otherwise("$5").alias("cost"), F.array(F.struct(F.col("event_type").alias("name"))).alias("categories"))
    venue = F.when(k % 2 == 0, '{"geo_lat":"40.5","geo_lng":"-73.9"}').otherwise("[]")
    body = F.concat(F.lit('{"events":['), F.regexp_replace(item, r"\}$", ""), F.lit(',"venue":'), venue, F.lit("}]}"))
    saved = table(spark, d, "events").select(F.lit("h").alias("host"), F.concat(F.lit("Hall "), s("user_id")).alias("name"), F.lit("").alias("venue_name"), F.lit(1.0).alias("v_lat"), F.lit(2.0).alias("v_lon"), F.lit(None).cast("string").alias("borough"), body.alias("body"))
    return adapters.tribe(saved).select("id", "title", "venue_name", "cost", "venue_lat", F.array_join("categories", "|").alias("categories"))


def _markup(spark, d) -> DataFrame:
    """An event in each row's markup, as object or list, with a postal address, a plain one or none."""
    k = F.col("event_id")
    postal = '{"streetAddress":"1 Main St","addressLocality":"Brooklyn"}'
    where = F.concat(F.lit('{"name":"Room '), s(k % 4), F.lit('"'), F.when(k % 3 == 0, f',"address":{postal}').when(k % 3 == 1, ',"address":"2 Side St"').otherwise(""), F.when(k % 2 == 0, ',"geo":{"latitude":40.5,"longitude":-73.9}').otherwise(""), F.lit("}"))
    ld = F.concat(F.lit('{"@type":["Event","MusicEvent"],"startDate":"2024-01-20","name":" A  show '), s(k), F.lit('","location":'), F.when(k % 5 == 0, F.concat(F.lit("["), where, F.lit("]"))).otherwise(where), F.when(k % 4 == 0, ',"offers":{"price":0}').otherwise(""), F.lit("}"))
    return table(spark, d, "events").select("event_id", F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>")).alias("html"))


MARKUP = "SELECT event_id, 'Room ' || (event_id % 4) AS room, CASE event_id % 3 WHEN 0 THEN '1 Main St, Brooklyn' WHEN 1 THEN '2 Side St' END AS address, event_id % 2 = 0 AS point, event_id % 4 = 0 AS free FROM events"


@query(f"""WITH m AS ({MARKUP}) SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'House' ELSE room END AS venue_name, address, CASE WHEN event_id % 3 = 0 THEN 'Brooklyn' ELSE 'Queens' END AS borough, 'A show ' || event_id AS title, CASE WHEN free THEN TRUE END AS is_free, CASE WHEN point THEN 40.5 WHEN address IS NULL THEN 1.5 END AS lat FROM m""")
def venue_page_rows(spark, d):
    """venues' own markup: whose name and point win, addresses of parts."""
    k = F.col("event_id")
    venues = table(spark, d, "events").select("event_id", s(k).alias("host"), F.lit("House").alias("name"), F.lit(None).cast("string").alias("venue_name"), F.when(k % 7 == 0, "detail").otherwise("listing").alias("mode"), F.lit("u").alias("url"), F.array(F.lit("one")).alias("locations"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"), F.lit("Queens").alias("borough"))
    rows = adapters.jsonld(pages.markup_events(_markup(spark, d), "event_id"), venues, "event_id")
    return rows.select(F.col("venue_host").cast("long").alias("event_id"), "venue_name", "address", "borough", "title", "is_free", "lat")


@query(f"""WITH m AS ({MARKUP}), e AS (SELECT event_id // 2 AS page, room, event_id % 3 <> 1 AS dated FROM m) SELECT page, count(*) FILTER (dated) AS events, coalesce(string_agg(DISTINCT room, ',' ORDER BY room) FILTER (dated), '') AS locations, CASE WHEN bool_or(dated) THEN 'MusicEvent' ELSE '' END AS types,
CASE WHEN count(*) FILTER (dated) >= 2 THEN 'listing' ELSE 'detail' END AS mode, CASE WHEN count(*) FILTER (dated) >= 2 OR page % 2 = 1 THEN 0 ELSE 1 END AS links FROM e GROUP BY page""")
def listing_modes(spark, d):
    """Rooms and types of each page; two dated events make a listing, else its links are followed."""
    k = F.col("event_id")
    one = _markup(spark, d).withColumn("html", F.when(k % 3 == 1, F.regexp_replace("html", '"startDate"', '"date"')).otherwise(F.col("html")))
    rows = one.groupBy(F.floor(k / 2).alias("page")).agg(F.array_join(F.sort_array(F.collect_list("html")), "").alias("html"))
    modes = signals.listing_modes(rows, pages.markup_events(rows, "page"), rows.where("page % 2 = 0").select("page"), "page")
    return modes.select("page", F.col("events").cast("long").alias("events"), F.array_join("locations", ",").alias("locations"), F.array_join("types", ",").alias("types"), "mode", F.col("links").cast("int").alias("links"))


# ---- signals ----

HOSTS = ("www.eventbrite.com", "lu.ma", "example.org", "axsome.org", "shop.tixr.com")


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'eventbrite' WHEN 1 THEN 'luma' WHEN 4 THEN 'tixr' ELSE '' END AS platforms, CASE WHEN page_id % 3 = 0 THEN 'drupal,wix' ELSE '' END AS cms, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^(https?://[^/]+)', 1) || '/feed.ics' ELSE '' END AS ics, 'Event,Place' AS types, page_id % 4 = 0 AS wp FROM pages""")
def page_signals(spark, d):
    """Ticket platforms by host pattern, builders, feeds, types of blocks that do not parse."""
    k = F.col("page_id")
    link = F.concat(F.lit('<a href="https://'), F.element_at(F.array(*map(F.lit, HOSTS)), (k % 5 + 1).cast("int")), F.lit('/x">t</a>'))
    more = F.concat(
        link, F.when(k % 3 == 0, '<img src="/sites/default/files/a.png"><b id="_wixCIDX">').otherwise(""), F.when(k % 2 == 0, '<link type="text/calendar" href="/feed.ics">').otherwise(""), F.when(k % 4 == 0, '<link rel="https://api.w.org/" href="/">').otherwise(""),
        F.lit('<script type="application/ld+json">{"@type": "Event", "location": {"@type": ["Place"]},}</script>'),
    )
    found = signals.page_signals(table(spark, d, "pages").select("page_id", "url", F.concat("html", more).alias("html")), "page_id")
    return found.select("page_id", *[F.array_join(c, ",").alias(c) for c in ("platforms", "cms", "ics", "types")], "wp")


@query("""SELECT page_id // 3 AS host, string_agg(DISTINCT CASE page_id % 2 WHEN 0 THEN 'dice' ELSE 'tixr' END, ',' ORDER BY CASE page_id % 2 WHEN 0 THEN 'dice' ELSE 'tixr' END) AS platforms, bool_or(page_id % 3 = 2) AS jsonld_event FROM pages GROUP BY 1""")
def site_signals(spark, d):
    """Signals of a site's pages united, event types met."""
    k = F.col("page_id")
    html = F.concat(F.when(k % 2 == 0, '<a href="https://dice.fm/x">').otherwise('<a href="https://tixr.com/x">'), F.lit('<script type="application/ld+json">{"@type":"MusicEvent"}</script>'))
    rows = table(spark, d, "pages").select(F.floor(k / 3).alias("host"), F.element_at(F.array(F.lit("landing"), F.lit("listing"), F.lit("detail")), (k % 3 + 1).cast("int")).alias("role"), "url", F.concat("html", html).alias("html"))
    return signals.site_signals(signals.page_signals(rows, "host", "role")).select("host", F.array_join("platforms", ",").alias("platforms"), F.coalesce("jsonld_event", F.lit(False)).alias("jsonld_event"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 2 = 0 THEN 'tribe_events:events' ELSE 'show' || page_id || ':s' END AS types, CASE WHEN page_id % 3 = 0 THEN 'event_date,start_time' ELSE 'start_time' END AS dated FROM pages""")
def content_types(spark, d):
    """Event-like content types without noise, real date keys against those of the page."""
    k = F.col("page_id")
    name = F.when(k % 2 == 0, "tribe_events").otherwise(F.concat(F.lit("show"), s(k)))
    body = F.when(k % 4 == 0, "not json").otherwise(F.concat(F.lit('{"'), name, F.lit('":{"rest_base":"'), F.when(k % 2 == 0, "events").otherwise("s"), F.lit('"},"page":{"rest_base":"pages"},"dt_slideshow":{"rest_base":"x"},"concert":{}}')))
    keys = F.array_compact(F.array(F.lit("modified"), F.when(k % 3 == 0, "event_date"), F.lit("start_time"), F.lit("colour")))
    rows = table(spark, d, "pages").select("page_id", signals.wp_types(body).alias("t"), F.array_join(signals.date_meta(keys), ",").alias("dated"))
    return rows.select("page_id", F.when(F.size("t") > 0, F.array_join(F.transform(F.map_entries("t"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")).alias("types"), "dated")


@query("""WITH o AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS o FROM pages) SELECT page_id, CASE page_id % 3 WHEN 0 THEN o || '/shows?x=1&ical=1,' WHEN 1 THEN '' ELSE '' END || o || '/events/?ical=1,' || o || '/?post_type=tribe_events&ical=1' AS urls FROM o""")
def calendar_candidates(spark, d):
    """Up to three addresses to ask, in order, once each."""
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    listing = F.when(F.col("page_id") % 3 == 0, F.concat(origin, F.lit("/shows?x=1"))).when(F.col("page_id") % 3 == 1, F.concat(origin, F.lit("/events/"))).otherwise(F.concat(origin, F.lit("/about")))
    return table(spark, d, "pages").select("page_id", F.array_join(signals.calendar_candidates(F.col("url"), listing), ",").alias("urls"))


# ---- single feeds ----


def _fed(df: DataFrame, feed: str) -> DataFrame:
    return feeds.TRANSFORMS[feed](df.withColumns({"source_id": F.lit(feed), "row_pos": F.col("event_id")}), ZONE).select("row_pos", F.coalesce("reject", F.concat_ws("/", "category", "subcategory")).alias("outcome"))


def _raw(spark, d, feed: str, rows: DataFrame | None = None, /, **columns) -> DataFrame:
    """Rows of a feed's schema, columns that are not given null."""
    names = [(f.name, f.dataType) for f in spark.createDataFrame([], feeds.SCHEMAS[feed]).schema.fields]
    rows = table(spark, d, "events") if rows is None else rows
    return rows.select("event_id", *[(columns[n] if n in columns else F.lit(None)).cast(t).alias(n) for n, t in names if n != "event_id"])


def K(name: str) -> F.Column:
    return F.col(name)


def _day() -> F.Column:
    return F.date_format("ts", "yyyy-MM-dd")


@query("""SELECT event_id AS row_pos, CASE event_id % 5 WHEN 0 THEN 'unparseable start time' WHEN 1 THEN 'no location named' WHEN 2 THEN 'sports/basketball' WHEN 3 THEN 'music/concert' ELSE 'outdoors/park-programming' END AS outcome FROM events""")
def park_feed(spark, d):
    """Day and hour from two fields, categories by priority, a default."""
    k = K("event_id") % 5
    named = F.when(k == 2, "Sports|Basketball/Netball").when(k == 3, "Music").otherwise("unknown")
    return _fed(_raw(spark, d, "parks", title=F.lit("Zzz qqq"), startdate=F.when(k != 0, _day()), starttime=F.lit("1999-01-01 10:00"), location=F.when(k != 1, "The Lawn"), categories=named), "parks")


@query("""SELECT event_id AS row_pos, CASE event_id % 6 WHEN 0 THEN 'internal record: Meeting' WHEN 1 THEN 'virtual only, has no place' WHEN 2 THEN 'no branch named' WHEN 3 THEN 'recurring language course' WHEN 4 THEN 'learning/class' ELSE 'unparseable start time' END AS outcome FROM events""")
def library_feed(spark, d):
    """Internal records, services by tag, online only, branches."""
    k = K("event_id") % 6
    rows = _raw(
        spark, d, "library", title=F.lit("Zzz qqq"), start=F.when(k != 5, F.concat(_day(), F.lit("T10:00:00+00:00"))), kind=F.when(k == 0, "Meeting").otherwise("Program"), virtual=(k == 1) | (k == 4), hybrid=k == 4,
        location=F.when(k != 2, "DeKalb Library, room 2"), tags=F.when(k == 3, F.array(F.lit("other"), F.lit("ESOL"))).otherwise(F.array().cast("array<string>")),
    )
    return _fed(rows, "library")


@query("""SELECT event_id AS row_pos, CASE event_id % 6 WHEN 0 THEN 'status: cancelled' WHEN 1 THEN 'date TBA/TBD' WHEN 2 THEN 'venue has no coordinates' WHEN 3 THEN 'music/jazz' WHEN 4 THEN 'unclassified ticketmaster event' ELSE 'unparseable start time' END AS outcome FROM events""")
def ticket_feed(spark, d):
    """Statuses, dates to be announced, points, genres."""
    k = K("event_id") % 6
    name = lambda c: F.struct(c.alias("name"))
    none = F.lit(None).cast("string")
    rows = _raw(
        spark, d, "ticketmaster", name=F.concat(F.lit("Zzz qqq "), s("event_id")), dates=F.struct(F.struct(F.when(k != 5, _day()).alias("localDate"), F.lit("20:00:00").alias("localTime"), (k == 1).alias("dateTBA"), F.lit(False).alias("dateTBD"), F.lit(False).alias("noSpecificTime")).alias("start"), F.struct(F.when(k == 0, "Cancelled").otherwise("onsale").alias("code")).alias("status")),
        _embedded=F.struct(F.array(F.struct(F.lit("Zzz").alias("name"), F.struct(F.when(k != 2, "40.7").alias("latitude"), F.when(k != 2, "-73.9").alias("longitude")).alias("location"))).alias("venues")),
        classifications=F.array(F.struct(name(none).alias("segment"), name(F.when(k == 3, "Jazz")).alias("genre"), name(none).alias("subGenre"))),
    )
    return _fed(rows, "ticketmaster")


@query("""SELECT event_id AS row_pos, CASE event_id % 5 WHEN 0 THEN 'status: eventcancelled' WHEN 1 THEN 'no coordinates, cannot place' WHEN 2 THEN 'performance/comedy' WHEN 3 THEN 'music/concert' ELSE 'unclassified dice event' END AS outcome FROM events""")
def marked_up_feed(spark, d):
    """Schema.org statuses, specific types before default ones."""
    k = K("event_id") % 5
    rows = _raw(spark, d, "dice", name=F.lit("Zzz qqq"), type=F.when(k == 2, "ComedyEvent").when(k == 3, "MusicEvent").otherwise("Event"), startDate=F.concat(_day(), F.lit("T10:00:00Z")), eventStatus=F.when(k == 0, "https://schema.org/EventCancelled"), lat=F.when(k != 1, F.lit(40.7)), lon=F.lit(-73.9))
    return _fed(rows, "dice")


@query("""SELECT event_id AS row_pos, CASE event_id % 5 WHEN 0 THEN 'status: cancelled' WHEN 1 THEN 'no coordinates, cannot place' WHEN 2 THEN 'music/jazz' WHEN 3 THEN 'unclassified luma event' ELSE 'unparseable start time' END AS outcome FROM events""")
def community_feed(spark, d):
    """The calendar's name classifies where the title does not."""
    k = K("event_id") % 5
    rows = _raw(spark, d, "luma", summary=F.lit("Zzz qqq"), calendar_name=F.when(k == 2, "Jazz nights").otherwise("Zzz"), status=F.when(k == 0, "Cancelled"), lat=F.when(k != 1, F.lit(40.7)), lon=F.lit(-73.9), start=F.when(k != 4, F.concat(_day(), F.lit("T10:00:00Z"))))
    return _fed(rows, "luma")


@query("""SELECT event_id AS row_pos, CASE event_id % 4 WHEN 0 THEN 'unclassified squarespace event' WHEN 1 THEN 'music/jazz' WHEN 2 THEN 'unparseable start time' ELSE 'title too short to be an event' END AS outcome FROM events""")
def builder_feed(spark, d):
    """Tags before the title."""
    k = K("event_id") % 4
    return _fed(_raw(spark, d, "squarespace", title=F.when(k == 3, "Zz").otherwise("Zzz qqq"), venue_name=F.lit("Hall"), startDate=F.when(k != 2, F.unix_millis(F.col("ts").cast("timestamp"))), tags=F.array(F.when(k == 1, "jazz").otherwise("zzz"))), "squarespace")


@query("""SELECT event_id AS row_pos, CASE event_id % 5 WHEN 0 THEN 'status: draft' WHEN 1 THEN 'learning/talk' WHEN 2 THEN 'unclassified wordpress event' WHEN 3 THEN 'no venue could be resolved' ELSE 'music/jazz' END AS outcome FROM events""")
def blog_feed(spark, d):
    """States of a post, exact terms before words of the title."""
    k = K("event_id") % 5
    rows = _raw(spark, d, "wordpress", title=F.when(k == 4, "Jazz qqq").otherwise("Zzz qqq"), venue_name=F.when(k == 3, "").otherwise("Zzz"), venue_host=F.when(k == 3, ""), status=F.when(k == 0, "draft").otherwise("publish"), start=F.concat(_day(), F.lit(" 10:00:00")), categories=F.array(F.when(k == 1, "Talk").otherwise("zzz")))
    return _fed(rows, "wordpress")


# ---- facets, reports, places, lines ----


@query("""SELECT p_partkey AS id FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_size % 2 = 0 AND p_partkey % 3 = 1 AND contains(lower(p_name), 'ring')""")
def place_facets(spark, d):
    """Category, area, routes of the nearest station and text of places."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("id"), F.col("p_type").alias("category"), F.when(F.col("p_size") % 2 == 0, "even").alias("neighborhood"), F.when(k % 3 > 0, F.array(F.lit("X"), F.when(k % 3 == 1, "A").otherwise("B"))).alias("routes"), F.col("p_name").alias("name"))
    return facets.places(rows, facets.Facets(categories=["ECONOMY", "PROMO"], areas=["even"], routes=["A"], text="Ring")).select("id")


@query("""WITH f AS (SELECT r_name AS region, n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(n_name), 'ion_1') AND r_name <> 'ASIA') SELECT region, nation, count(*) OVER (PARTITION BY region) AS in_group FROM f""")
def option_search(spark, d):
    """Options by name, groups without any hidden."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.when(F.col("r_name") == "ASIA", "none").otherwise(F.col("n_name")).alias("nation"))
    return facets.option_search(rows, "region", "nation", " Ion_1")


@query(LISTED + "SELECT category, count(*) AS n FROM listed WHERE neighborhood = 'n3' GROUP BY 1")
def scoped_counts(spark, d):
    """One area's page."""
    return facets.counts(facets.scoped(listed(spark, d), area="n3"), "category")


@query("""WITH s AS (SELECT c_custkey AS k, c_custkey % 5 <> 0 AS readable, c_nationkey IN (1, 3) AS blocked FROM customer), m AS (SELECT count(*) FILTER (readable AND NOT blocked) AS of, count(*) FILTER (readable AND NOT blocked AND k % 2 = 0) AS jsonld_event, count(*) FILTER (readable AND NOT blocked AND k % 3 = 0) AS ics,
count(*) FILTER (readable AND NOT blocked AND k % 4 = 0) AS wp, count(*) FILTER (readable AND NOT blocked AND k % 7 = 0) AS no_listing FROM s), l AS (SELECT of, unnest([{'metric': 'jsonld_event', 'n': jsonld_event}, {'metric': 'ics', 'n': ics}, {'metric': 'rss', 'n': 0}, {'metric': 'wp', 'n': wp}, {'metric': 'post_types', 'n': ics}, {'metric': 'tribe', 'n': 0}, {'metric': 'node_types', 'n': 0}, {'metric': 'squarespace_json', 'n': 0}, {'metric': 'any_jsonld', 'n': jsonld_event}, {'metric': 'client_rendered', 'n': 0}, {'metric': 'no_listing', 'n': no_listing}]) AS m FROM m)
SELECT m.metric AS metric, m.n AS n, CAST(round_even(m.n * 100.0 / greatest(of, 1), 1) AS DOUBLE) AS share FROM l""")
def capability_report(spark, d):
    """Eleven rates among the sites that can be read."""
    k = F.col("c_custkey")
    some, none = lambda cond: F.when(cond, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")), F.array().cast("array<string>")
    sites = table(spark, d, "customer").select(
        (k % 5 != 0).alias("readable"), F.col("c_nationkey").isin(1, 3).alias("blocked"), (k % 2 == 0).alias("jsonld_event"), some(k % 3 == 0).alias("ics"), none.alias("rss"), (k % 4 == 0).alias("wp"), some(k % 3 == 0).alias("post_types"), F.lit(None).cast("boolean").alias("tribe"), none.alias("node_types"),
        F.lit(False).alias("squarespace_json"), some(k % 2 == 0).alias("jsonld_home"), none.alias("jsonld_detail"), F.lit(False).alias("client_rendered"), F.when(k % 7 != 0, "u").alias("listing_url"),
    )
    return reports.capability_rates(sites)


@query("""WITH h AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'https://x/events/?ical=1' WHEN 1 THEN 'https://x/?post_type=tribe_events&ical=1' WHEN 2 THEN 'https://x/shows?ical=1' END AS hit FROM orders) SELECT CASE WHEN contains(hit, '/events/?ical') THEN '/events/?ical=1' WHEN contains(hit, 'post_type') THEN '?post_type=tribe_events' ELSE 'listing?ical=1' END AS shape, count(*) AS n FROM h WHERE hit IS NOT NULL GROUP BY 1""")
def hit_shapes(spark, d):
    """Which guess found a calendar."""
    return reports.hit_shapes(_probed(spark, d))


def _probed(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    hit = F.when(k % 4 == 0, "https://x/events/?ical=1").when(k % 4 == 1, "https://x/?post_type=tribe_events&ical=1").when(k % 4 == 2, "https://x/shows?ical=1")
    return table(spark, d, "orders").select(s(k).alias("name"), hit.alias("hit"), (k % 3 == 0).alias("live"), F.col("o_totalprice").cast("long").alias("future"))


@query("""WITH p AS (SELECT o_orderkey % 4 < 3 AS hit, o_orderkey % 3 = 0 AS live FROM orders), c AS (SELECT count(*) AS of, unnest([{'metric': 'hit', 'n': count(*) FILTER (hit)}, {'metric': 'live', 'n': count(*) FILTER (hit AND live)}, {'metric': 'stale', 'n': count(*) FILTER (hit AND NOT live)}]) AS m FROM p) SELECT m.metric AS metric, m.n AS n, CAST(round_even(m.n * 100.0 / greatest(of, 1), 1) AS DOUBLE) AS share FROM c""")
def probe_report(spark, d):
    """Rates of a calendar probe."""
    return reports.probe_report(_probed(spark, d))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS name, CAST(round_even(o_totalprice, 0) AS BIGINT) AS future FROM orders WHERE false UNION ALL SELECT name, future FROM (SELECT CAST(o_orderkey AS VARCHAR) AS name, CAST(trunc(o_totalprice) AS BIGINT) AS future FROM orders WHERE o_orderkey % 4 < 3 AND o_orderkey % 3 = 0 ORDER BY future DESC, name LIMIT 20)""")
def top_feeds(spark, d):
    """The largest live feeds."""
    return reports.top_feeds(_probed(spark, d)).select("name", "future")


@query("""WITH e AS (SELECT count(*) AS of, count(*) FILTER (c_custkey % 2 = 0) AS registered, count(*) FILTER (c_custkey % 3 = 0) AS answering, count(*) FILTER (c_custkey % 6 = 0) AS dated, coalesce(sum(CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN c_custkey ELSE 0 END), 0) AS total FROM customer),
l AS (SELECT of, unnest([{'metric': 'registered', 'n': registered, 'p': true}, {'metric': 'answering', 'n': answering, 'p': true}, {'metric': 'dated', 'n': dated, 'p': true}, {'metric': 'endpoints', 'n': answering, 'p': false}, {'metric': 'rows', 'n': CAST(total AS BIGINT), 'p': false}]) AS m FROM e)
SELECT m.metric AS metric, m.n AS n, CASE WHEN m.p THEN CAST(round_even(m.n * 100.0 / greatest(of, 1), 1) AS DOUBLE) END AS share FROM l""")
def sweep_report(spark, d):
    """A type is registered, an endpoint answers, dates are in the payload."""
    k = F.col("c_custkey")
    open_ = F.when(k % 3 == 0, F.array(F.struct(F.when(k % 5 == 0, "many").otherwise(s(k)).alias("total"), (k % 2 == 0).alias("dated")))).otherwise(F.array().cast("array<struct<total:string,dated:boolean>>"))
    none = F.array().cast("array<string>")
    return reports.sweep_report(table(spark, d, "customer").select(F.when(k % 2 == 0, F.array(F.lit("event"))).otherwise(none).alias("wp_types"), none.alias("drupal_types"), open_.alias("open")))


@query("""WITH v AS (SELECT count(*) AS of, count(*) FILTER (c_custkey % 2 = 0) AS a, count(*) FILTER (c_custkey % 2 = 0 AND c_custkey % 4 > 0) AS b, coalesce(sum(CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 4 END), 0) AS c FROM customer), l AS (SELECT of, unnest([{'metric': 'with_collection', 'n': a, 'p': true}, {'metric': 'live', 'n': b, 'p': true}, {'metric': 'upcoming', 'n': CAST(c AS BIGINT), 'p': false}]) AS m FROM v)
SELECT m.metric AS metric, m.n AS n, CASE WHEN m.p THEN CAST(round_even(m.n * 100.0 / greatest(of, 1), 1) AS DOUBLE) END AS share FROM l""")
def collection_report(spark, d):
    """Collections of a registry, live ones, events to be had."""
    k = F.col("c_custkey")
    held = F.when(k % 2 == 0, F.array(F.struct(F.lit("u").alias("url"), (k % 4).alias("upcoming")))).otherwise(F.array().cast("array<struct<url:string,upcoming:bigint>>"))
    return reports.collection_report(table(spark, d, "customer").select(held.alias("collections")))


@query("SELECT coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, 'none') AS slug, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS undated FROM orders GROUP BY 1")
def slug_report(spark, d):
    """Ticket pages by city, undated ones."""
    return reports.slug_report(table(spark, d, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("city_slug"), F.when(F.col("o_orderkey") % 3 != 0, "2024").alias("lastmod")))


@query("""WITH r AS (SELECT n_nationkey, 'src' || n_nationkey AS source, CASE WHEN n_nationkey % 4 = 0 THEN 'timed out' END AS error FROM nation), c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT source, error IS NULL AS ok, CASE WHEN error IS NULL THEN coalesce(n, 0) ELSE 0 END AS n, error, CASE WHEN error IS NULL THEN '2024-01-15' END AS fetched_at FROM r LEFT JOIN c ON c_nationkey = n_nationkey""")
def load_ledger(spark, d):
    """What each source gave, and what failed."""
    src = lambda c: F.concat(F.lit("src"), s(c)).alias("source")
    loads = table(spark, d, "nation").select(src("n_nationkey"), F.when(F.col("n_nationkey") % 4 == 0, "timed out").alias("error"), F.lit("2024-01-15").alias("fetched_at"))
    return reports.ledger(loads, table(spark, d, "customer").select(src("c_nationkey")))


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 1 AND c_mktsegment = 'BUILDING' AND c_mktsegment NOT IN (SELECT c_mktsegment FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment <> 'BUILDING')""")
def kept_rows(spark, d):
    """Last run's rows of hosts that were not read this time."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    now, failed = c.where("c_custkey % 2 = 0"), c.where("c_mktsegment = 'BUILDING'").select("c_mktsegment")
    kept = snapshots.kept_rows(now.where("c_mktsegment <> 'BUILDING'"), c.where("c_custkey % 2 = 1"), failed, "c_mktsegment")
    return kept.unionByName(now.where("c_mktsegment = 'BUILDING'"))


@query("""SELECT p_partkey AS ord, CASE WHEN p_size % 2 = 0 AND p_size % 5 > 0 THEN 'own' WHEN p_size % 3 = 0 THEN 'lead' END AS credit FROM part""")
def attributed_images(spark, d):
    """The map's own file, then the article's photo; none without attribution."""
    k, n = F.col("p_partkey"), F.col("p_size")
    url = F.concat(F.lit("https://upload.wikimedia.org/wikipedia/commons/a/ab/"), s(k), F.lit(".jpg"))
    rows = table(spark, d, "part").select(k.alias("ord"), F.concat(F.lit("en:"), s(k)).alias("wikipedia"), F.create_map(F.lit("image"), F.when(n % 2 == 0, url).otherwise("https://drive.example/x")).alias("tags"))
    files = table(spark, d, "part").select(F.concat(s(k), F.lit(".jpg")).alias("file"), url.alias("url"), F.when(n % 5 > 0, "own").otherwise("").alias("credit"))
    leads = table(spark, d, "part").where("p_size % 3 = 0").select(F.concat(F.lit("Lead"), s(k), F.lit(".jpg")).alias("file"), url.alias("url"), F.lit("lead").alias("credit"))
    box = F.concat(F.lit('<img src="//upload.wikimedia.org/wikipedia/commons/thumb/a/ab/Old_logo.png/9px-Old_logo.png"><img class="x" src="//upload.wikimedia.org/wikipedia/commons/thumb/a/ab/Lead'), s(k), F.lit('.jpg/250px-Lead.jpg">'))
    articles = table(spark, d, "part").where("p_size % 3 = 0").select(F.concat(F.lit("en:"), s(k)).alias("wikipedia"), places.infobox_image(box).alias("file"))
    return places.with_images(rows, files.unionByName(leads), articles).select("ord", F.col("image_credit").alias("credit"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'A,C' ELSE 'B' END AS routes, s_suppkey % 3 IN (1, 2) AS ada, CASE s_suppkey % 4 WHEN 0 THEN 'Manhattan' WHEN 1 THEN 'Brooklyn' WHEN 2 THEN 'Staten Island' END AS borough FROM supplier WHERE s_suppkey % 5 > 0""")
def station_feed(spark, d):
    """Coordinates that parse, routes split, step-free access, borough codes."""
    k = F.col("s_suppkey")
    raw = table(spark, d, "supplier").select(k.alias("id"), F.lit("c").alias("complex_id"), F.col("s_name").alias("name"), F.when(k % 2 == 0, " A  C ").otherwise("B").alias("routes"), F.element_at(F.array(*map(F.lit, ("M", "Bk", "SI", "?"))), (k % 4 + 1).cast("int")).alias("borough"), F.when(k % 5 > 0, "40.5").otherwise("n/a").alias("lat"), F.lit("-73.9").alias("lon"), s(k % 3).alias("ada"))
    return lines.stations(raw).select("id", F.array_join("routes", ",").alias("routes"), "ada", adapters.borough(F.col("borough"), adapters.STATION_BOROUGHS).alias("borough"))


@query("""WITH o AS (SELECT DISTINCT l_returnflag AS route, l_suppkey AS stop FROM lineitem), s AS (SELECT s_suppkey // 2 AS station, s_suppkey AS stop FROM supplier WHERE s_suppkey % 3 > 0), j AS (SELECT route, station, min(stop) AS pos FROM o JOIN s USING (stop) WHERE route <> 'N' GROUP BY 1, 2) SELECT route, station, row_number() OVER (PARTITION BY route ORDER BY pos, station) - 1 AS pos FROM j""")
def attached_stops(spark, d):
    """Stops of lines joined to stations that the line serves, each station once."""
    order = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("route"), F.col("l_suppkey").alias("stop"), F.col("l_suppkey").alias("pos")).distinct()
    k = F.col("s_suppkey")
    stations = table(spark, d, "supplier").where("s_suppkey % 3 > 0").groupBy(F.floor(k / 2).alias("id")).agg(F.min("s_name").alias("name"), F.array(F.lit("A"), F.lit("R")).alias("routes"), F.collect_list("s_suppkey").alias("stops"))
    return lines.attach(order, stations).select("route", "station", F.col("pos").cast("long").alias("pos"))


@query("""WITH a AS (SELECT c_custkey AS id, CAST(floor(lat) * 5 + floor(lon) AS INT) AS ord, lon - floor(lon) AS fx, lat - floor(lat) AS fy FROM (SELECT c_custkey, (c_custkey * 37 % 1100) / 200.0 AS lon, (c_custkey * 91 % 1100) / 200.0 AS lat FROM customer) WHERE lon < 5 AND lat < 5)
SELECT n_name AS area, count(*) AS stations, string_agg(DISTINCT CASE WHEN id % 2 = 0 THEN 'A' ELSE 'B' END, ',' ORDER BY CASE WHEN id % 2 = 0 THEN 'A' ELSE 'B' END) AS routes FROM a JOIN nation ON n_nationkey = ord WHERE NOT (ord % 2 = 1 AND fx >= 0.25 AND fx < 0.75 AND fy >= 0.25 AND fy < 0.75) GROUP BY 1""")
def stations_in_areas(spark, d):
    """Stations in the polygons that hold them, routes and stations of each area."""
    from townsheet.operators import geo
    from townsheet.queries import _areas

    areas, points = _areas(spark, d), _points(spark, d)
    located = geo.locate(points, areas, "id", cell=0.5).join(areas.select("ord", F.col("slug").alias("area")), "ord").select("id", "area")
    stations = points.select("id", s("id").alias("name"), F.array(F.when(F.col("id") % 2 == 0, "A").otherwise("B")).alias("routes"))
    events = located.select(F.col("area").alias("neighborhood")).distinct()
    return lines.area_card(events, located, stations).select("area", F.size("stations").cast("long").alias("stations"), F.array_join("routes", ",").alias("routes"))


@query("""SELECT o_orderkey, 'a b' AS squeezed, CASE WHEN o_orderkey % 2 = 0 THEN 'https://x/y' END AS secure, CASE WHEN o_orderkey % 3 = 0 THEN TRUE END AS free, CASE o_orderkey % 2 WHEN 0 THEN 'https://h/p' ELSE 'https://other/q' END AS link, CASE WHEN o_orderkey % 2 = 0 THEN '1 Main St, Queens' ELSE 'Queens' END AS address,
'Mott Street and Prince' AS street, CAST(greatest(1, floor((o_orderkey % 1000) / 80.0 + 0.5)) AS INT) AS walk, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 2 = 0 THEN 3.5 END AS price FROM orders""")
def scalar_shapes(spark, d):
    """Spaces, links, prices, addresses, streets, walks, dates."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    stated = F.when(k % 3 == 0, F.concat(day, F.lit("T00:00:00"))).when(k % 3 == 1, day).otherwise(F.concat(day, F.lit(" 00:00")))
    prices = F.when(k % 2 == 0, F.array(F.lit("7"), F.lit("3.5"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "orders").select(
        "o_orderkey", text.squeeze(F.lit(" a \n\t b ")).alias("squeezed"), text.https_only(F.when(k % 2 == 0, "//x/y").otherwise("http://x/y")).alias("secure"), text.stated_free(F.when(k % 3 == 0, " Free ").otherwise("$20")).alias("free"),
        text.joined_url(F.lit("https://h/"), F.when(k % 2 == 0, "/p").otherwise("https://other/q")).alias("link"), text.address(F.when(k % 2 == 0, "1 Main St").otherwise(" "), F.lit("Queens")).alias("address"), text.street_query(F.lit("Mott Street between Prince and Spring")).alias("street"),
        times.walk_minutes((k % 1000).cast("double")).alias("walk"), F.date_format(times.schema_date(stated), "yyyy-MM-dd").alias("day"), text.least_price(prices).alias("price"),
    )
