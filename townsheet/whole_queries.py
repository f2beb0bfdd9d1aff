"""Whole paths: nine feeds through one plan, saved bodies to listings, line pages, reports and warnings of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townsheet.feed_queries import ZONE, _raw, js, s
from townsheet.functions import text
from townsheet.operators import snapshots
from townsheet.operators.store import saved
from townsheet.plans import events as listings
from townsheet.plans import facets, reports
from townsheet.queries import AS_OF, _areas, _bodies, query, table
from townsheet.sources import adapters, calendars, feeds, pages

FEEDS = ("dice", "jsonld", "library", "luma", "parks", "permits", "squarespace", "ticketmaster", "wordpress")


def _feed_rows(spark, d) -> DataFrame:
    """Each event as a row of one of nine feeds: a jazz night at one of a feed's venues.

    Rows with an even number have the venue's point, others its name or address, which the register or
    the gazetteer knows for every third user; every seventh row of some feeds has no point at all.
    """
    e, u = F.col("event_id"), F.col("user_id")
    x, y = u * 37 % 1100 / 200.0, u * 91 % 1100 / 200.0
    lat, lon = F.when(e % 2 == 0, y), F.when(e % 2 == 0, x)
    given = lambda c: F.when(e % 7 > 0, c)
    title = F.concat(F.lit("Jazz night "), s(u % 40))
    hall = lambda feed: F.concat(F.lit(f"Hall {feed} "), s("user_id"))
    street = F.when(e % 2 == 1, F.concat(s("user_id"), F.lit(" Main Street")))
    clock, zulu, blank = (F.date_format("ts", f"yyyy-MM-dd{mid}HH:00:00{end}") for mid, end in (("'T'", ""), ("'T'", "'Z'"), (" ", "")))
    at = F.struct(hall("ticketmaster").alias("name"), F.struct(given(y.cast("string")).alias("latitude"), given(x.cast("string")).alias("longitude")).alias("location"))
    dates = F.struct(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("localDate"), F.date_format("ts", "HH:00:00").alias("localTime"), F.lit(False).alias("dateTBA"), F.lit(False).alias("dateTBD"), F.lit(False).alias("noSpecificTime")).alias("start"), F.struct(F.lit("onsale").alias("code")).alias("status"))
    columns = {
        "parks": dict(title=title, startdate=clock, starttime=clock, location=hall("parks"), coordinates=F.concat(lat.cast("string"), F.lit(","), lon.cast("string"))),
        "permits": dict(event_name=title, event_type=F.lit("Special Event"), event_location=F.concat(hall("permits"), F.lit(": lawn")), start_date_time=clock),
        "squarespace": dict(title=title, venue_name=hall("squarespace"), startDate=F.unix_millis(F.date_trunc("hour", "ts").cast("timestamp")), location=F.when(e % 2 == 0, F.struct(y.alias("mapLat"), x.alias("mapLng")))),
        "ticketmaster": dict(name=title, dates=dates, _embedded=F.struct(F.array(at).alias("venues"))),
        "luma": dict(summary=title, calendar_name=F.lit("none"), organizer=hall("luma"), lat=given(y), lon=given(x), start=zulu),
        "dice": dict(name=title, type=F.lit("Event"), startDate=zulu, venue_name=hall("dice"), lat=given(y), lon=given(x)),
        "library": dict(title=title, start=F.concat(clock, F.lit("+00:00")), kind=F.lit("Program"), location=F.concat(hall("library"), F.lit(", room 1")), address=F.concat(s("user_id"), F.lit(" Main Street"))),
        "wordpress": dict(title=title, venue_name=hall("wordpress"), status=F.lit("publish"), start=blank, venue_lat=lat.cast("string"), venue_lon=lon.cast("string"), lat=F.when(e % 5 == 1, y + 0.01), lon=F.when(e % 5 == 1, x)),
        "jsonld": dict(title=title, venue_name=hall("jsonld"), type=F.lit("Event"), start=zulu, lat=lat, lon=lon, address=street),
    }
    mine = {f: table(spark, d, "events").where(e % 9 == i) for i, f in enumerate(FEEDS)}
    one = lambda f: _raw(spark, d, f, mine[f], **columns[f]).withColumns({"source_id": F.lit(f), "row_pos": F.col("event_id")})
    return feeds.union([feeds.TRANSFORMS[f](one(f), ZONE) for f in FEEDS])


def _whole(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    users = table(spark, d, "customer").where("c_custkey % 3 = 0").select(k, (k * 37 % 1100 / 200.0).alias("lon"), (k * 91 % 1100 / 200.0).alias("lat"))
    halls = users.select(F.explode(F.array(*map(F.lit, FEEDS))).alias("f"), k, "lat", "lon").select(text.norm(F.concat_ws(" ", F.lit("Hall"), "f", s("c_custkey"))).alias("name"), "lat", "lon")
    streets = users.select(text.norm(F.concat(s("c_custkey"), F.lit(" Main Street"))).alias("name"), "lat", "lon")
    areas = _areas(spark, d).withColumn("name", F.col("slug")).withColumn("borough", F.when(F.col("ord") % 2 == 0, "Even"))
    n = F.col("s_suppkey")
    stations = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.lpad(n.cast("string"), 5, "0")).alias("id"), (n * 91 % 1100 / 200.0 + 0.005).alias("lat"), (n * 37 % 1100 / 200.0 + 0.003).alias("lon"))
    # nine transforms are run once, not once for each join that reads their rows
    return listings.build(saved(_feed_rows(spark, d), "rows"), areas, halls, streets, stations, ZONE)


WHOLE = """WITH r0 AS (SELECT event_id AS e, user_id AS u, ts, ['dice', 'jsonld', 'library', 'luma', 'parks', 'permits', 'squarespace', 'ticketmaster', 'wordpress'][1 + event_id % 9] AS f, user_id * 37 % 1100 / 200.0 AS x, user_id * 91 % 1100 / 200.0 AS y FROM events),
r1 AS (SELECT *, date_trunc('hour', ts) - CASE WHEN f IN ('dice', 'jsonld', 'luma', 'squarespace') THEN INTERVAL 5 HOUR ELSE INTERVAL 0 HOUR END AS start, 'Jazz night ' || (u % 40) AS title, 'hall-' || f || '-' || u AS slug,
 CASE WHEN f IN ('ticketmaster', 'luma', 'dice') THEN e % 7 > 0 WHEN f IN ('parks', 'squarespace', 'jsonld') THEN e % 2 = 0 WHEN f = 'wordpress' THEN e % 5 = 1 ELSE false END AS pointed, f IN ('ticketmaster', 'luma', 'dice', 'jsonld', 'wordpress') AS needs FROM r0),
r2 AS (SELECT *, CASE WHEN pointed THEN 'coordinates' WHEN u % 3 = 0 AND (f = 'library' OR (f = 'jsonld' AND e % 2 = 1)) THEN 'gazetteer' WHEN u % 3 = 0 THEN 'register' END AS found, count(*) OVER (PARTITION BY f, title, CAST(ts AS DATE)) AS same, row_number() OVER (PARTITION BY f, title, CAST(ts AS DATE) ORDER BY e) AS nth FROM r1),
r3 AS (SELECT *, min(CASE WHEN found IS NOT NULL THEN e END) OVER (PARTITION BY slug) AS since, arg_min(CASE WHEN f = 'wordpress' AND pointed THEN y + 0.01 ELSE y END, CASE WHEN found IS NOT NULL THEN e END) OVER (PARTITION BY slug) AS vy FROM r2),
r4 AS (SELECT *, CASE WHEN f = 'wordpress' AND e % 2 = 0 THEN y WHEN f IN ('luma') AND pointed THEN y WHEN since <= e THEN vy END AS py, CASE WHEN (f = 'wordpress' AND e % 2 = 0) OR (f = 'luma' AND pointed) OR since <= e THEN x END AS px FROM r3),
r5 AS (SELECT *, CASE WHEN px < 5 AND py < 5 AND NOT ((floor(py) * 5 + floor(px)) % 2 = 1 AND px - floor(px) >= 0.25 AND px - floor(px) < 0.75 AND py - floor(py) >= 0.25 AND py - floor(py) < 0.75) THEN CAST(floor(py) * 5 + floor(px) AS INT) END AS area FROM r4),
r6 AS (SELECT *, CASE WHEN f = 'ticketmaster' AND same > 2 AND nth > 1 THEN 'collapsed' WHEN f = 'ticketmaster' AND NOT pointed THEN 'venue has no coordinates' WHEN f IN ('luma', 'dice') AND NOT pointed THEN 'no coordinates, cannot place' WHEN needs AND area IS NULL THEN CASE WHEN py IS NULL THEN 'no coordinates, cannot place' ELSE 'outside the city' END END AS reject FROM r5),
r7 AS (SELECT *, CASE WHEN reject IS NOT NULL THEN reject WHEN row_number() OVER (PARTITION BY reject IS NULL, slug, start, title ORDER BY e) > 1 THEN 'deduped' ELSE 'kept' END AS outcome FROM r6),
st AS (SELECT 's' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS sid, s_suppkey * 91 % 1100 / 200.0 + 0.005 AS slat, s_suppkey * 37 % 1100 / 200.0 + 0.003 AS slon FROM supplier),
pt AS (SELECT DISTINCT px, py FROM r7 WHERE px IS NOT NULL), m AS (SELECT px, py, sid, sqrt(power((px - slon) * 111320.0 * cos(radians(40.7)), 2) + power((py - slat) * 111320.0, 2)) AS m FROM pt, st WHERE abs(py - slat) < 0.02 AND abs(px - slon) < 0.03),
nr AS (SELECT px, py, string_agg(CAST(round_even(m, 0) AS BIGINT) || ':' || sid, ',' ORDER BY r) AS near FROM (SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY m, sid) AS r FROM m WHERE m <= 1600) WHERE r <= 2 GROUP BY 1, 2) """


@query(WHOLE + """SELECT f AS source, e AS row_pos, substr(sha1(slug || '|' || strftime(start, '%Y-%m-%dT%H:%M') || '|' || replace(lower(title), ' ', '-')), 1, 16) AS id, strftime(start, '%Y-%m-%dT%H:%M') AS start_local, strftime(start + INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M') AS start_utc, slug AS venue_id, n_name AS neighborhood,
CASE WHEN area % 2 = 0 THEN 'Even' WHEN f = 'library' THEN 'Brooklyn' END AS borough, py AS lat, CASE WHEN py IS NOT NULL THEN coalesce(found, 'coordinates') END AS location_source, coalesce(near, '') AS subway, 'music/jazz' AS category FROM r7 LEFT JOIN nation ON n_nationkey = area LEFT JOIN nr USING (px, py) WHERE outcome = 'kept'""")
def whole_path_feeds(spark, d):
    """Nine feeds to listings, with area, stations, venue and how it was placed."""
    kept = listings.listings(_whole(spark, d))
    near = F.array_join(F.transform("subway", lambda n: F.concat_ws(":", n["meters"].cast("string"), n["id"])), ",")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm").alias(c)
    return kept.select("source", "row_pos", "id", stamp("start_local"), stamp("start_utc"), "venue_id", "neighborhood", "borough", "lat", "location_source", near.alias("subway"), F.concat_ws("/", "category", "subcategory").alias("category"))


@query(WHOLE + "SELECT f AS source, outcome, count(*) AS n FROM r7 GROUP BY 1, 2")
def whole_path_rejects(spark, d):
    """The outcome of every row of nine feeds."""
    return _whole(spark, d).groupBy("source", "outcome").agg(F.count("*").alias("n"))


# ---- saved bodies to rows ----


@query(f"""SELECT event_id, event_type || '-city' AS city_slug, 'Show ' || event_id AS name, CASE WHEN event_id % 2 = 0 THEN 'https://t/' || event_id ELSE 'https://page/' || event_id END AS url, CASE WHEN event_id % 3 = 0 THEN '2024' END AS lastmod FROM events
WHERE event_id % 5 < 4 AND date_trunc('second', ts) + CASE event_id % 5 WHEN 1 THEN INTERVAL 5 HOUR ELSE INTERVAL 0 HOUR END BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND TIMESTAMP '{AS_OF}' + INTERVAL 7 DAY""")
def ticket_page_rows(spark, d):
    """Marked-up ticket pages within the horizon; offsets are applied, times without one are UTC, the rest is dropped."""
    k = F.col("event_id")
    clock = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    start = F.when(k % 5 == 0, F.concat(clock, F.lit("Z"))).when(k % 5 == 1, F.concat(clock, F.lit("-05:00"))).when(k % 5 < 4, clock).otherwise(F.lit("soon"))
    body = js(F.array(F.lit("MusicEvent")).alias("@type"), F.concat(F.lit("Show "), s(k)).alias("name"), start.alias("startDate"), F.when(k % 2 == 0, F.concat(F.lit("https://t/"), s(k))).alias("url"))
    html = F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    e = table(spark, d, "events")
    found = pages.markup_events(e.select("event_id", html.alias("html")), "event_id").join(e.select("event_id", F.concat("event_type", F.lit("-city")).alias("city_slug"), F.concat(F.lit("https://page/"), s(k)).alias("page_url"), F.when(k % 3 == 0, "2024").alias("lastmod")), "event_id")
    rows = adapters.dice(found, AS_OF, 7)
    return rows.select(F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("event_id"), "city_slug", "name", "url", "lastmod")


CALENDAR = "WITH c AS (SELECT user_id, event_id, event_type || ', at night' AS summary, event_id % 3 = 2 AS all_day, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) + INTERVAL 5 HOUR ELSE CAST(date_trunc('day', ts) AS TIMESTAMP) END AS start FROM events) "


@query(CALENDAR + f"SELECT 'cal' || user_id AS calendar_id, CAST(event_id AS VARCHAR) AS uid, summary, all_day, strftime(start, '%Y-%m-%dT%H:%M:%S+00:00') AS start FROM c WHERE user_id % 2 = 0 AND start BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY")
def community_calendar_rows(spark, d):
    """Events of listed community calendars, from their saved exports."""
    events = calendars.events(_bodies(spark, d), "user_id").withColumn("calendar_id", F.concat(F.lit("cal"), s("user_id"))).drop("user_id")
    listed = table(spark, d, "events").select("user_id").distinct().where("user_id % 2 = 0").select(F.concat(F.lit("cal"), s("user_id")).alias("calendar_id"), F.concat(F.lit("Calendar "), s("user_id")).alias("calendar_name"))
    return adapters.luma(events, listed, AS_OF, 30).select("calendar_id", "uid", "summary", "all_day", "start")


@query(CALENDAR + """, r AS (SELECT *, start - INTERVAL 5 HOUR AS local FROM c)
SELECT event_id, CASE WHEN event_type = 'view' THEN 'status: CANCELLED' ELSE 'learning/talk' END AS outcome, strftime(local, '%Y-%m-%dT%H:%M:%S') AS start, 'Hall ' || user_id AS venue_name FROM r JOIN events USING (event_id, user_id)""")
def venue_calendar_rows(spark, d):
    """venues' calendar exports through the blog feed's adapter and transform, to listing rows."""
    k = F.col("user_id")
    events = calendars.events(_bodies(spark, d), "user_id").withColumns({"status": F.when(F.col("summary").startswith("view"), "CANCELLED"), "categories": F.array(F.lit("Talk"))})
    venues = table(spark, d, "events").select("user_id").distinct().select("user_id", F.concat(F.lit("h"), s(k)).alias("host"), F.concat(F.lit("Hall "), s(k)).alias("name"), F.lit("").alias("venue_name"), F.lit(1.0).alias("v_lat"), F.lit(2.0).alias("v_lon"), F.lit(None).cast("string").alias("borough"))
    rows = adapters.calendar_venues(events, venues, "user_id").withColumns({"source_id": F.lit("wordpress"), "row_pos": F.col("id").cast("long")})
    out = feeds.wordpress(rows, ZONE)
    return out.select(F.col("row_pos").alias("event_id"), F.coalesce("reject", F.concat_ws("/", "category", "subcategory")).alias("outcome"), F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss").alias("start"), "venue_name")


# ---- line pages, reports, warnings ----


@query("""WITH ls AS (SELECT DISTINCT l_returnflag AS route, l_suppkey AS station FROM lineitem WHERE l_quantity > 45), ev AS (SELECT user_id % 120 AS station, count(*) AS n FROM events WHERE user_id % 4 > 0 GROUP BY 1)
SELECT route, station, s_name AS name, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY route) AS BIGINT) AS line_n FROM ls JOIN supplier ON s_suppkey = station LEFT JOIN ev USING (station)""")
def line_pages(spark, d):
    """C17: lines, their stations, and events nearest to each; stations without any stay, with the line's total."""
    stops = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_returnflag").alias("route"), F.col("l_suppkey").alias("station")).distinct()
    stations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("station"), F.col("s_name").alias("name"))
    events = table(spark, d, "events").where("user_id % 4 > 0").select((F.col("user_id") % 120).alias("nearest"))
    counted = facets.with_counts(stops.join(stations, "station"), events, "station", "nearest")
    totals = counted.groupBy("route").agg(F.sum("n").alias("line_n"))
    return counted.join(totals, "route").select("route", "station", "name", "n", "line_n")


SITES = """WITH s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 403 WHEN c_custkey % 13 = 0 THEN 500 ELSE 200 END AS status, CASE WHEN c_custkey % 22 = 0 THEN 'robots-denied' END AS error FROM customer),
t AS (SELECT *, coalesce(status = 200, false) AS readable, coalesce(status = 403, false) OR error IS NOT NULL AS blocked, count(*) OVER () AS of FROM s), ok AS (SELECT * FROM t WHERE readable AND NOT blocked) """


@query(SITES + """, m AS (SELECT 'readable' AS name, count(*) FILTER (readable AND NOT blocked) AS n, any_value(of) AS of FROM t UNION ALL SELECT 'blocked', count(*) FILTER (blocked), any_value(of) FROM t UNION ALL SELECT 'dead', count(*) FILTER (status IS NULL AND error IS NULL), any_value(of) FROM t UNION ALL SELECT 'other', count(*) FILTER (status = 500), any_value(of) FROM t
UNION ALL SELECT 'any_adapter', count(*) FILTER (readable AND NOT blocked AND (k % 2 = 0 OR k % 3 = 0)), any_value(of) FROM t)
SELECT 'rate' AS kind, name, n, CAST(round_even(n * 100.0 / of, 1) AS DOUBLE) AS share FROM m UNION ALL SELECT 'platform', 'tixr', count(*), NULL FROM ok WHERE k % 3 = 0 HAVING count(*) > 0 UNION ALL SELECT 'platform', 'dice', count(*), NULL FROM ok WHERE k % 6 = 0 HAVING count(*) > 0 UNION ALL SELECT 'builder', 'wix', count(*), NULL FROM ok WHERE k % 5 = 0 HAVING count(*) > 0""")
def reach_report(spark, d):
    """Reachability, platforms and builders by name, and sites that some adapter can read."""
    k = F.col("c_custkey")
    status = F.when(k % 11 == 0, None).when(k % 7 == 0, 403).when(k % 13 == 0, 500).otherwise(200)
    error = F.when(k % 22 == 0, "robots-denied")
    none = F.array().cast("array<string>")
    sites = table(spark, d, "customer").select(
        status.alias("status"), error.alias("error"), F.coalesce(status == 200, F.lit(False)).alias("readable"), pages.blocked(status, error).alias("blocked"), (k % 2 == 0).alias("jsonld_event"), none.alias("ics"), F.lit(False).alias("tribe"), F.lit(False).alias("squarespace_json"),
        F.when(k % 6 == 0, F.array(F.lit("dice"), F.lit("tixr"))).when(k % 3 == 0, F.array(F.lit("tixr"))).otherwise(none).alias("platforms"), F.when(k % 5 == 0, F.array(F.lit("wix"))).alias("cms"), none.alias("post_types"), none.alias("node_types"),
    )
    rates = reports.reachability(sites).unionByName(reports.any_adapter(sites)).select(F.lit("rate").alias("kind"), F.col("metric").alias("name"), "n", "share")
    named = [reports.named_counts(sites, c).select(F.lit(kind).alias("kind"), "name", "n", F.lit(None).cast("double").alias("share")) for kind, c in (("platform", "platforms"), ("builder", "cms"))]
    return feeds.union([rates, *named])


@query("""WITH n AS (SELECT o_orderstatus || (o_custkey % 20) AS source, o_orderkey FROM orders), b AS (SELECT source, count(*) AS n FROM n GROUP BY 1), a AS (SELECT source, count(*) AS n FROM n WHERE o_orderkey % CASE WHEN source LIKE '%7' THEN 4 ELSE 1 END = 0 AND source NOT LIKE '%3' GROUP BY 1), f AS (SELECT source, count(*) FILTER (o_orderkey % 10 < CASE WHEN source LIKE '%5' THEN 3 ELSE 1 END) AS n, count(*) AS of FROM n GROUP BY 1)
SELECT b.source AS source, 'registry halved' AS warning, coalesce(a.n, 0) AS n, b.n AS of FROM b LEFT JOIN a USING (source) WHERE coalesce(a.n, 0) * 2 < b.n UNION ALL SELECT source, 'fetches failed', n, of FROM f WHERE n > of * 0.2""")
def run_warnings(spark, d):
    """Registries that halved since last run, and sources where over a fifth of fetches failed."""
    o = table(spark, d, "orders").select(F.concat("o_orderstatus", s(F.col("o_custkey") % 20)).alias("source"), F.col("o_orderkey").alias("k"))
    now = o.where("k % case when source like '%7' then 4 else 1 end = 0 and source not like '%3'")
    fetches = o.select("source", (F.col("k") % 10 >= F.when(F.col("source").like("%5"), 3).otherwise(1)).alias("ok"))
    return snapshots.run_warnings(o, now, fetches, "source")
