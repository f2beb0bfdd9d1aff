"""Queries over the driver's tables, each beside the SQL that DuckDB runs for the same rows.

None of the tables holds listings, so each query derives its rows from columns of theirs: events are
listings, customers points, suppliers stations, nations areas, parts places, orders snapshots,
line items stopping times, documents titles, pages web pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townsheet.functions import hours, rules, text, times
from townsheet.operators import dedup, geo, resolve, snapshots
from townsheet.plans import events as listings
from townsheet.plans import facets, lines, places, quality, reports
from townsheet.sources import calendars, feeds, pages, signals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF, TODAY = "2024-01-15 12:00:00", "2024-01-15"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def listed(spark: SparkSession, d: str) -> DataFrame:
    """events as listings."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    return table(spark, d, "events").select(
        F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("id"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("title"), F.col("ts").alias("start_utc"), F.col("ts").alias("start_local"), (F.col("ts") + F.expr("interval 1 hour")).alias("end_local"),
        F.date_format("ts", "yyyy-MM-dd").alias("date_local"), times.band(F.col("ts")).alias("time_band"), F.col("event_type").alias("category"), F.col("event_type").alias("source"), k.alias("k"), F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("venue_id"),
        F.when(k % 4 > 0, F.concat(F.lit("n"), (F.col("user_id") % 25).cast("string"))).alias("neighborhood"), F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("station"), F.array(F.char((65 + k % 8).cast("long")), F.char((65 + k % 3).cast("long"))).alias("routes"), "value", "user_id",
    )


LISTED = """WITH base AS (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k FROM events),
listed AS (SELECT event_id AS ord, CAST(event_id AS VARCHAR) AS id, event_type || ' ' || user_id AS title, ts AS start_utc, strftime(ts, '%Y-%m-%d') AS date_local,
 CASE WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 17 THEN 'afternoon' WHEN hour(ts) < 21 THEN 'evening' ELSE 'late' END AS time_band,
 event_type AS category, k, 'v' || user_id AS venue_id, CASE WHEN k % 4 > 0 THEN 'n' || (user_id % 25) END AS neighborhood, 's' || (user_id % 7) AS station,
 chr(65 + k % 8) AS r1, chr(65 + k % 3) AS r2, value, user_id FROM base) """


@query(LISTED + f""", h AS (SELECT *, row_number() OVER (PARTITION BY venue_id, date_local, category ORDER BY ord) AS rn FROM listed WHERE start_utc > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND start_utc < TIMESTAMP '{AS_OF}' + INTERVAL 14 DAY)
SELECT date_local, time_band, count(*) AS n FROM h WHERE rn = 1 AND category IN ('click', 'view', 'purchase') AND (r1 IN ('A', 'C') OR r2 IN ('A', 'C')) GROUP BY 1, 2""")
def day_band_counts(spark, d):
    """Horizon, first seen, facets, counts."""
    rows = listed(spark, d).where(feeds.within_horizon(F.col("start_utc"), F.lit(AS_OF).cast("timestamp_ntz"), F.lit(14)))
    first = dedup.first_seen(rows, ["venue_id", "date_local", "category"], ["ord"])
    want = facets.Facets(categories=["click", "view", "purchase"], routes=["A", "C"])
    return first.where(facets.matches(want, set(first.columns))).groupBy("date_local", "time_band").agg(F.count("*").alias("n"))


@query(LISTED + """, f AS (SELECT * FROM listed WHERE date_local BETWEEN '2024-01-10' AND '2024-01-12' AND time_band IN ('evening', 'late') AND (r1 = 'B' OR r2 = 'B'))
SELECT id, title, date_local, time_band, count(*) OVER (PARTITION BY date_local) AS day_count FROM f ORDER BY start_utc, title, id LIMIT 250""")
def faceted_page(spark, d):
    """A page of results with day headers' counts."""
    want = facets.Facets("2024-01-10", "2024-01-12", bands=["evening", "late"], routes=["B"])
    return facets.browse(listed(spark, d), want).select("id", "title", "date_local", "time_band", "day_count")


@query(LISTED + "SELECT category, count(*) AS n FROM listed WHERE date_local >= '2024-01-15' AND (contains(lower(title), 'click 1') OR contains(lower(coalesce(neighborhood, '')), 'click 1') OR contains('x', 'click 1')) GROUP BY 1")
def upcoming_search(spark, d):
    """From the city's date on, text in any field."""
    rows = facets.upcoming(listed(spark, d), AS_OF, "America/New_York")
    return facets.counts(rows.where(facets.mentions("Click 1", "title", "neighborhood")), "category")


@query(LISTED + "SELECT count(*) AS events, CAST(round_even(count(neighborhood) * 100.0 / greatest(count(*), 1), 1) AS DOUBLE) AS neighborhood FROM listed")
def coverage(spark, d):
    """Counts and shares."""
    rows = listed(spark, d)
    null = F.lit(None).cast("string")
    full = rows.withColumns({"lat": null, "borough": null, "url": null, "price_min": null, "subway": F.array()})
    return listings.coverage(full).select("events", F.col("neighborhood").cast("double").alias("neighborhood"))


@query(LISTED + "SELECT coalesce(neighborhood, 'unresolved') AS value, count(*) AS n FROM listed GROUP BY 1")
def area_histogram(spark, d):
    """D2."""
    return listings.histogram(listed(spark, d), "neighborhood")


@query(LISTED + """, m AS (SELECT *, row_number() OVER (PARTITION BY venue_id, date_local ORDER BY ord) AS rn FROM listed WHERE k % 10 <> 0)
SELECT 'rejected:no permit' AS counter, count(*) AS n FROM listed WHERE k % 10 = 0 HAVING count(*) > 0 UNION ALL SELECT 'deduped', count(*) FROM m WHERE rn > 1 HAVING count(*) > 0 UNION ALL SELECT 'kept:' || category, count(*) FROM m WHERE rn = 1 GROUP BY category""")
def pipeline_outcomes(spark, d):
    """Every row has one outcome."""
    rows = listed(spark, d).withColumn("open", F.col("k") % 10 != 0).withColumn("rn", dedup.seen_rank(["open", "venue_id", "date_local"], ["ord"]))
    outcome = F.when(~F.col("open"), "no permit").when(F.col("rn") > 1, "deduped").otherwise("kept")
    return listings.outcomes(rows.withColumn("outcome", outcome))


@query(LISTED + """SELECT 'area' AS kind, neighborhood AS key, count(*) AS n FROM listed WHERE neighborhood IS NOT NULL GROUP BY 2 HAVING count(*) >= 3 AND count(DISTINCT venue_id) >= 2
UNION ALL SELECT 'venue', venue_id, count(*) FROM listed GROUP BY 2 HAVING count(*) >= 2 UNION ALL SELECT 'category', category, count(*) FROM listed GROUP BY 2""")
def manifest(spark, d):
    """D4."""
    return facets.manifest(listed(spark, d))


@query(LISTED + ", s AS (SELECT strftime(DATE '2024-01-25' + CAST(i AS INT), '%Y-%m-%d') AS date_local FROM range(14) t(i)) SELECT s.date_local, count(l.id) AS n FROM s LEFT JOIN listed l USING (date_local) GROUP BY 1")
def day_strip(spark, d):
    """Empty days stay."""
    return facets.day_strip(listed(spark, d), "2024-01-25")


@query(LISTED + "SELECT station, category, count(*) AS n FROM listed GROUP BY 1, 2")
def station_counts(spark, d):
    """D6 D8."""
    return facets.counts(listed(spark, d), "station", "category")


@query("""WITH x AS (SELECT CASE WHEN r_name IN ('ASIA', 'AFRICA') THEN r_name ELSE 'Elsewhere' END AS region, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT region, nation, CAST(grouping(region, nation) AS BIGINT) AS level, count(*) AS n, CAST(CASE region WHEN 'ASIA' THEN 1 WHEN 'AFRICA' THEN 2 ELSE 3 END AS BIGINT) AS place FROM x GROUP BY ROLLUP (region, nation) HAVING region IS NOT NULL""")
def borough_totals(spark, d):
    """Two levels, fixed order, a bucket for the rest."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return facets.two_level(rows.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation")), "region", "nation", ["ASIA", "AFRICA"])


@query(LISTED + ", c AS (SELECT venue_id, category, count(*) AS n, row_number() OVER (PARTITION BY venue_id ORDER BY count(*) DESC, category) AS r FROM listed GROUP BY 1, 2) SELECT venue_id, category, n FROM c WHERE r = 1")
def dominant_category(spark, d):
    """The commonest category of each venue."""
    n = facets.counts(listed(spark, d), "venue_id", "category")
    best = n.groupBy("venue_id").agg(F.min(F.struct((-F.col("n")).alias("less"), "category")).alias("b"))
    return best.select("venue_id", "b.category", (-F.col("b.less")).alias("n"))


@query(LISTED + ", c AS (SELECT *, count(*) OVER w AS cnt, row_number() OVER (PARTITION BY title, date_local ORDER BY ord) AS rn FROM listed WINDOW w AS (PARTITION BY title, date_local)) SELECT id FROM c WHERE NOT (cnt > 2 AND rn > 1)")
def timed_entries(spark, d):
    """Over two slots of a title and day collapse to the first."""
    return dedup.collapsed(listed(spark, d), ["title", "date_local"], ["ord"]).where("not collapsed").select("id")


VENUE_ROWS = """, v AS (SELECT ord, venue_id, category, CASE WHEN k % 5 = 0 THEN k / 10.0 END AS lat FROM listed) """


@query(LISTED + VENUE_ROWS + "SELECT ord, first_value(category) OVER w AS v_kind, first_value(lat IGNORE NULLS) OVER w AS v_lat FROM v WINDOW w AS (PARTITION BY venue_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def venue_as_of(spark, d):
    """First-seen fields and the location as of each row."""
    rows = _venue_rows(spark, d)
    return dedup.venue_state(rows, "venue_id", ["ord"]).select("ord", "v_kind", "v_lat")


@query(LISTED + VENUE_ROWS + "SELECT venue_id, arg_min(category, ord) AS kind, arg_min(lat, ord) FILTER (lat IS NOT NULL) AS lat, count(*) AS rows FROM v GROUP BY 1")
def venue_register(spark, d):
    """The same state once per venue, by mergeable aggregates."""
    return dedup.venues(_venue_rows(spark, d), "venue_id", ["ord"]).select("venue_id", "kind", "lat", "rows")


def _venue_rows(spark, d):
    at = F.when(F.col("k") % 5 == 0, F.col("k") / 10.0)
    return listed(spark, d).select("ord", "venue_id", F.col("title").alias("name"), F.col("category").alias("kind"), F.lit(None).cast("string").alias("borough"), at.alias("lat"), at.alias("lon"))


@query("SELECT min(p_partkey) AS p_partkey, p_name, round(p_retailprice, 0) AS at FROM part GROUP BY p_name, round(p_retailprice, 0)")
def place_dedup(spark, d):
    """First of a name at a rounded point."""
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.round("p_retailprice", 0).alias("at"))
    return dedup.first_seen(rows, ["p_name", "at"], ["p_partkey"])


ID_ROWS = """WITH r AS (SELECT p_partkey AS k, replace(p_name, ' ', '-') || CASE WHEN p_size % 4 = 0 THEN '-2' WHEN p_size % 4 = 1 THEN '-' || lower(p_brand) ELSE '' END AS b, CASE WHEN p_size % 3 > 0 THEN lower(p_brand) END AS area FROM part),
x AS (SELECT k, regexp_replace(b, '[ #]', '-', 'g') AS b, regexp_replace(coalesce(b || '-' || area, b), '[ #]', '-', 'g') AS s FROM r) """


@query(ID_ROWS + """, g AS (SELECT list({k: k, b: b, s: s, taken: CAST([] AS VARCHAR[])} ORDER BY k) AS rows, list_transform(range(60), lambda i: repeat('-2', CAST(i AS INT))) AS tails FROM x),
f AS (SELECT list_reduce(list_prepend({k: 0, b: '', s: '', taken: CAST([] AS VARCHAR[])}, rows), lambda a, r: {k: r.k, b: r.b, s: r.s, taken: list_append(a.taken, list_filter(list_prepend(r.b, list_transform(tails, lambda t: r.s || t)), lambda c: NOT list_contains(a.taken, c))[1])}).taken AS ids, list_transform(rows, lambda r: r.k) AS ks FROM g)
SELECT unnest(ks) AS p_partkey, unnest(ids) AS id FROM f""")
def place_ids(spark, d):
    """E5: name, name-area, then -2 again and again, where names that end so by themselves are taken too."""
    n = F.col("p_size")
    tail = F.when(n % 4 == 0, "-2").when(n % 4 == 1, F.concat(F.lit("-"), F.lower("p_brand"))).otherwise("")
    base = text.place_slug(F.concat("p_name", tail))
    rows = dedup.distinct_ids(table(spark, d, "part"), base, F.when(n % 3 > 0, text.place_slug(F.concat("p_name", tail, F.lit("-"), "p_brand"))), ["p_partkey"])
    return rows.select("p_partkey", "id")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size <= 40 THEN 'https://a/' || (p_size * 30) WHEN p_size % 2 = 0 THEN 'https://b/x' END AS image FROM part""")
def best_images(spark, d):
    """Widest usable 16:9 first, no stock pictures, none over 1200."""
    im = lambda url, w, ratio, stock: F.struct(url.alias("url"), w.alias("width"), ratio.alias("ratio"), stock.alias("fallback"))
    n = F.col("p_size")
    images = F.array(
        im(F.when(n % 2 == 0, F.lit("https://b/x")), F.lit(1100), F.lit("4_3"), F.lit(False)), im(F.when(n % 3 == 0, F.concat(F.lit("https://a/"), (n * 30).cast("string"))), n * 30, F.lit("16_9"), F.lit(False)),
        im(F.lit("https://stock/y"), F.lit(1200), F.lit("16_9"), F.lit(True)), im(F.lit("http://plain/z"), F.lit(1200), F.lit("16_9"), F.lit(False)),
    )
    return table(spark, d, "part").select("p_partkey", text.best_image(images).alias("image"))


# ---- joins ----

POINTS = "SELECT c_custkey AS id, (c_custkey * 37 % 1100) / 200.0 AS lon, (c_custkey * 91 % 1100) / 200.0 AS lat FROM customer"


def _points(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (k * 37 % 1100 / 200.0).alias("lon"), (k * 91 % 1100 / 200.0).alias("lat"))


def _areas(spark, d):
    """25 unit squares in 5 rows; odd ones have a hole in their middle."""
    k = F.col("n_nationkey")
    x, y = (k % 5).cast("double"), F.floor(k / 5).cast("double")
    ring = lambda a, b: F.array(*[F.struct((x + i).alias("x"), (y + j).alias("y")) for i, j in ((a, a), (b, a), (b, b), (a, b))])
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    rings = F.array(F.struct(ring(0.0, 1.0).alias("outer"), F.when(k % 2 == 1, F.array(ring(0.25, 0.75))).otherwise(none).alias("holes")))
    return table(spark, d, "nation").select(k.alias("ord"), F.col("n_name").alias("slug"), rings.alias("rings"))


@query(f"""WITH p AS ({POINTS}), q AS (SELECT id, CAST(floor(lat) * 5 + floor(lon) AS INT) AS ord, lon - floor(lon) AS fx, lat - floor(lat) AS fy FROM p WHERE lon < 5 AND lat < 5)
SELECT id, ord FROM q WHERE NOT (ord % 2 = 1 AND fx >= 0.25 AND fx < 0.75 AND fy >= 0.25 AND fy < 0.75)""")
def point_in_polygon(spark, d):
    """The area that holds each point, holes out."""
    return geo.locate(_points(spark, d), _areas(spark, d), "id", cell=0.5)


STATIONS = "SELECT s_suppkey AS id, 40.5 + (s_suppkey * 7919 % 1000) / 2500.0 AS lat, -74.2 + (s_suppkey * 104729 % 1000) / 2000.0 AS lon FROM supplier"
NEAR_POINTS = "SELECT c_custkey AS id, 40.5 + (c_custkey * 611953 % 9973) / 24000.0 AS lat, -74.2 + (c_custkey * 7577 % 9967) / 19000.0 AS lon FROM customer"
METERS = "sqrt(power((p.lon - s.lon) * 111320.0 * cos(radians(40.7)), 2) + power((p.lat - s.lat) * 111320.0, 2))"


def _stations(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), (40.5 + k * 7919 % 1000 / 2500.0).alias("lat"), (-74.2 + k * 104729 % 1000 / 2000.0).alias("lon"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("line"))


def _near_points(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (40.5 + k * 611953 % 9973 / 24000.0).alias("lat"), (-74.2 + k * 7577 % 9967 / 19000.0).alias("lon"))


@query(f"""WITH p AS ({NEAR_POINTS}), s AS ({STATIONS}), m AS (SELECT p.id, s.id AS sid, {METERS} AS m FROM p, s WHERE {METERS} <= 1600), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, sid) AS r FROM m)
SELECT id, string_agg(CAST(round_even(m, 0) AS BIGINT) || ':' || sid, ',' ORDER BY r) AS near FROM r WHERE r <= 2 GROUP BY 1""")
def nearest_stations(spark, d):
    """Two nearest within 1600 m."""
    near = geo.nearest(_near_points(spark, d), _stations(spark, d), "id")
    return near.select("id", F.array_join(F.transform("near", lambda s: F.concat_ws(":", s["meters"].cast("string"), s["id"].cast("string"))), ",").alias("near"))


@query("""WITH reg AS (SELECT p_name AS name, min(p_partkey) AS k FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), gaz AS (SELECT p_name AS name, max(p_partkey) AS k FROM part WHERE p_partkey % 3 = 0 GROUP BY 1),
a AS (SELECT p_partkey, p_name, p_size FROM part)
SELECT p_partkey AS key, CASE WHEN p_size % 7 = 0 THEN 1.5 WHEN r.k IS NOT NULL THEN CAST(r.k AS DOUBLE) ELSE CAST(g.k AS DOUBLE) END AS lat, CASE WHEN p_size % 7 = 0 THEN 'coordinates' WHEN r.k IS NOT NULL THEN 'register' WHEN g.k IS NOT NULL THEN 'gazetteer' END AS location_source
FROM a LEFT JOIN reg r ON r.name = a.p_name LEFT JOIN gaz g ON g.name = a.p_name""")
def resolved_places(spark, d):
    """Coordinates, register (first name wins), gazetteer (last wins); bracketed variants."""
    part = table(spark, d, "part")
    parks = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("ord"), F.array(F.upper("p_name")).alias("names"), F.col("p_partkey").cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    cache = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("location"), F.struct(F.col("p_partkey").cast("double").alias("lat"), F.lit(0.0).alias("lon")).alias("hit"))
    stated = F.when(F.col("p_size") % 7 == 0, F.lit(1.5))
    asked = part.select(F.col("p_partkey").alias("key"), F.concat(F.lit("Hall ("), "p_name", F.lit(")")).alias("name"), stated.alias("lat"), stated.alias("lon"))
    return resolve.resolve(asked, resolve.register_of(parks), resolve.gazetteer_of(cache)).select("key", "lat", "location_source")


@query("WITH t AS (SELECT DISTINCT p_name FROM part WHERE p_size < 25) SELECT p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || ' library' END AS value FROM part WHERE p_name IN (SELECT p_name FROM t)")
def branch_match(spark, d):
    """C4: whole name, stem before a comma, stem with suffix; case folded, first try wins."""
    part = table(spark, d, "part")
    n = F.col("p_name")
    names = part.where("p_size < 25").select("p_name").distinct()
    branches = names.select(F.upper("p_name").alias("name"), F.col("p_name").alias("value")).unionByName(names.select(F.concat(F.initcap("p_name"), F.lit(" Library")).alias("name"), F.concat("p_name", F.lit(" library")).alias("value")))
    asks = part.select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 2 == 0, F.concat(n, F.lit(", room 2"))).otherwise(F.concat(n, F.lit(" Library"))).alias("raw"))
    raw = F.col("raw")
    return resolve.first_match(asks, [raw, F.substring_index(raw, ",", 1), F.concat(F.substring_index(raw, ",", 1), F.lit(" library"))], branches)


@query("SELECT o_orderkey, string_agg(p_name, ',' ORDER BY l_linenumber, l_partkey) AS names FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' GROUP BY 1")
def sidecar_names(spark, d):
    """Relationship ids to names, in their order."""
    links = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    named = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey").join(links, F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    return named.groupBy("o_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))), lambda s: s["p_name"]), ",").alias("names"))


@query("""WITH h AS (SELECT c_mktsegment AS host, CAST(max(c_custkey) AS VARCHAR) AS value FROM customer GROUP BY 1)
SELECT o_orderkey, coalesce(CASE WHEN c.c_custkey % 3 = 0 THEN c.c_name END, h.value) AS value FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey LEFT JOIN h ON h.host = CASE WHEN o_orderkey % 2 = 0 THEN 'BUILDING' END""")
def two_key_join(spark, d):
    """By id, else by host."""
    customer = table(spark, d, "customer")
    by_id = customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("osm_id"), F.col("c_name").alias("value"))
    by_host = customer.groupBy(F.col("c_mktsegment").alias("host")).agg(F.max("c_custkey").cast("string").alias("value"))
    asks = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("osm_id"), F.when(F.col("o_orderkey") % 2 == 0, "BUILDING").alias("host"))
    return snapshots.two_keys(asks, by_id, by_host).select("o_orderkey", "value")


@query("SELECT c_custkey AS osm_id, CASE WHEN c_custkey % 10 = 0 THEN 'New ' || c_custkey ELSE c_name END AS name, c_custkey % 20 = 0 AS warning FROM customer")
def name_overrides(spark, d):
    """Overrides by id, with a drift warning."""
    places = table(spark, d, "customer").select(F.col("c_custkey").alias("osm_id"), F.col("c_name").alias("name"))
    over = places.where("osm_id % 10 = 0").select("osm_id", F.concat(F.lit("New "), F.col("osm_id").cast("string")).alias("name"), F.when(F.col("osm_id") % 20 == 0, F.lit("was something else")).otherwise(F.col("name")).alias("was"))
    return snapshots.drifted(places, over)


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 4 = 1 AND lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey % 4 = 0 AND p_size > 30)")
def superseded_extras(spark, d):
    """Extras whose name the register has by now go."""
    part = table(spark, d, "part").withColumn("slug", text.place_slug(F.col("p_name")))
    return part.where("p_partkey % 4 = 1").join(part.where("p_partkey % 4 = 0 and p_size > 30").select("slug").distinct(), "slug", "left_anti").select("p_partkey", "p_name")


@query("""WITH b AS (SELECT p_partkey, lower(p_name) AS name FROM part WHERE p_size <= 25), a AS (SELECT c_custkey AS key, lower(c_mktsegment) || ' ' || lower(n_name) AS name FROM customer JOIN nation ON n_nationkey = c_nationkey),
x AS (SELECT key, substr(name, 2) AS name FROM a UNION ALL SELECT 1000000000 + p_partkey, substr(lower(p_name), 2, length(p_name) - 2) FROM part UNION ALL SELECT 2000000000 + p_partkey, 'the ' || lower(p_name) || ' hall' FROM part),
y AS (SELECT name, min(p_partkey) AS k FROM b GROUP BY 1), d AS (SELECT DISTINCT name FROM x), m AS (SELECT d.name, count(*) AS n, min(y.k) AS k FROM d JOIN y ON contains(d.name, y.name) OR contains(y.name, d.name) WHERE contains(d.name, ' ') AND contains(y.name, ' ') GROUP BY 1)
SELECT key, CAST(k AS DOUBLE) AS lat FROM x JOIN m USING (name) WHERE n = 1""")
def unique_substring(spark, d):
    """C11: the one multi-word name that contains the asked one, cut within words, or is contained in it."""
    part, k = table(spark, d, "part"), F.col("p_partkey")
    names = part.where("p_size <= 25").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").cast("double").alias("lat")).withColumn("lon", F.lit(0.0))
    a = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("key"), F.expr("substr(concat_ws(' ', c_mktsegment, n_name), 2)").alias("name"))
    cut = part.select((k + 1_000_000_000).alias("key"), F.expr("substr(p_name, 2, length(p_name) - 2)").alias("name"))
    longer = part.select((k + 2_000_000_000).alias("key"), F.concat(F.lit("The "), "p_name", F.lit(" hall")).alias("name"))
    return resolve.unique_contained(a.unionByName(cut).unionByName(longer), names).select("key", "lat")


SNAP = "WITH now AS (SELECT o_orderkey AS url, o_orderstatus AS lastmod FROM orders WHERE o_orderkey % 10 <> 3), was AS (SELECT o_orderkey AS url, CASE WHEN o_orderkey % 4 = 0 THEN 'old' ELSE o_orderstatus END AS lastmod FROM orders WHERE o_orderkey % 10 <> 7) "


@query(SNAP + "SELECT coalesce(n.url, w.url) AS url, CASE WHEN n.url IS NULL THEN 'evict' WHEN w.url IS NOT NULL AND n.lastmod IS NOT DISTINCT FROM w.lastmod THEN 'reuse' ELSE 'refetch' END AS action FROM now n FULL JOIN was w ON n.url = w.url")
def refresh_plan(spark, d):
    """Reuse, refetch or evict."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("url"), F.col("o_orderstatus").alias("lastmod"))
    was = o.where("url % 10 <> 7").withColumn("lastmod", F.when(F.col("url") % 4 == 0, "old").otherwise(F.col("lastmod")))
    return snapshots.refresh(o.where("url % 10 <> 3"), was)


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN ts < TIMESTAMP '2024-01-20' - INTERVAL 14 DAY WHEN ts + INTERVAL 10 DAY < TIMESTAMP '2024-01-20' THEN false ELSE ts < TIMESTAMP '2024-01-20' - INTERVAL 3 DAY END AS stale FROM events""")
def staleness(spark, d):
    """Past never, future after three days, empty after fourteen."""
    rows = table(spark, d, "events").select("event_id", F.col("ts").alias("fetched_at"), F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.expr("interval 10 days")).alias("start"))
    return snapshots.stale(rows, "2024-01-20").select("event_id", "stale")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS measured, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority ELSE 'new' END AS curated FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 3 = 0")
def curated_merge(spark, d):
    """New measurements, old curation, survivors."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("measured"), F.col("o_orderpriority").alias("curated"))
    return snapshots.merged(o.where("k % 5 <> 0"), o.where("k % 3 = 0").select("k", (F.col("measured") * 2).alias("measured"), F.lit("new").alias("curated")), "k", ["measured"], ["curated"])


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) >= 0")
def venues_with_events(spark, d):
    """Counts with zeros kept."""
    return facets.with_counts(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders"), "c_custkey", "o_custkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def facet_options(spark, d):
    """Values that have events in scope."""
    return facets.options(table(spark, d, "nation").select("n_nationkey", "n_name"), table(spark, d, "customer").where("c_acctbal > 9000"), "n_nationkey", "c_nationkey")


@query(LISTED + f""", r AS (SELECT * FROM (VALUES ('click', 10), ('view', 100000), ('signup', 10), ('silent', 5)) t(id, min_expected)), n AS (SELECT category AS id, count(*) AS n, count(*) FILTER (date_local >= '{TODAY}') AS ahead FROM listed GROUP BY 1), j AS (SELECT r.id, min_expected, coalesce(n, 0) AS n, coalesce(ahead, 0) AS ahead FROM r LEFT JOIN n USING (id))
SELECT id, min_expected, n, ahead, CASE WHEN n = 0 THEN 'none' WHEN ahead = 0 THEN 'none upcoming' WHEN n < min_expected THEN 'below floor' WHEN ahead * 4 < n * 3 THEN 'mostly past' ELSE 'ok' END AS verdict FROM j""")
def source_freshness(spark, d):
    """C19 D27 J2."""
    registry = spark.createDataFrame([("click", 10), ("view", 100000), ("signup", 10), ("silent", 5)], "id string, min_expected int")
    return quality.freshness(registry, listed(spark, d), TODAY)


@query("""WITH a AS (SELECT trim(split_part(p_name || ': room ' || p_size, ':', 1)) AS location, p_partkey AS ord, CASE WHEN p_size > 10 THEN p_brand END AS borough FROM part)
SELECT location, count(*) AS n, arg_min(borough, ord) FILTER (borough IS NOT NULL) AS borough FROM a WHERE location NOT IN (SELECT p_name FROM part WHERE p_partkey % 50 = 0) GROUP BY 1""")
def unplaced_work(spark, d):
    """Locations that were never asked, by rows that ride on them."""
    part = table(spark, d, "part")
    rows = part.select(F.concat("p_name", F.lit(": room "), F.col("p_size").cast("string")).alias("location"), F.col("p_partkey").alias("ord"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("borough"))
    return resolve.unplaced(rows, part.where("p_partkey % 50 = 0").select(F.col("p_name").alias("location")))


@query(LISTED + """, now AS (SELECT * FROM listed WHERE date_local >= '2024-01-16' AND category <> 'view'), was AS (SELECT category, CASE WHEN category = 'error' THEN 'n1' ELSE 'n2' END AS neighborhood FROM listed WHERE date_local < '2024-01-16')
SELECT 'category vanished' AS rule, category AS key FROM (SELECT DISTINCT category FROM was EXCEPT SELECT DISTINCT category FROM now) UNION ALL SELECT 'coverage fell', 'neighborhood' WHERE (SELECT count(neighborhood) * 100.0 / count(*) FROM was) - (SELECT count(neighborhood) * 100.0 / count(*) FROM now) > 10""")
def snapshot_regressions(spark, d):
    """C22 G3 J3."""
    rows = listed(spark, d)
    return quality.regressions(rows.where("date_local >= '2024-01-16' and category <> 'view'"), rows.where("date_local < '2024-01-16'").withColumn("neighborhood", F.lit("n")))


@query(LISTED + """, a AS (SELECT station, count(*) AS now FROM listed WHERE k % 2 = 0 AND station <> 's3' AND NOT (station = 's4' AND k > 30) GROUP BY 1), b AS (SELECT station, count(*) AS before FROM listed WHERE k % 2 = 1 AND station <> 's5' GROUP BY 1), j AS (SELECT coalesce(a.station, b.station) AS station, coalesce(now, 0) AS now, coalesce(before, 0) AS before FROM a FULL JOIN b USING (station))
SELECT *, CASE WHEN before = 0 THEN 'new' WHEN now = 0 THEN 'lost' WHEN now < before * 0.5 THEN 'dropped' ELSE 'ok' END AS verdict FROM j""")
def part_counts(spark, d):
    """D28 J4."""
    rows = listed(spark, d)
    return snapshots.lost(rows.where("k % 2 = 0 and station <> 's3' and not (station = 's4' and k > 30)"), rows.where("k % 2 = 1 and station <> 's5'"), "station")


@query(LISTED + """, now AS (SELECT * FROM listed WHERE k % 2 = 0 AND station NOT IN ('s3', 's5')), was AS (SELECT * FROM listed WHERE k % 2 = 1)
SELECT id, station FROM now UNION ALL SELECT id, station FROM was WHERE station = 's3' AND (SELECT count(*) FROM now WHERE station = 's3') = 0""")
def carried_rows(spark, d):
    """A silent part is carried once; with a strike it fails."""
    rows = listed(spark, d).select("id", "station", "k")
    strikes = spark.createDataFrame([("s5", 1)], "station string, strikes int")
    out, _ = snapshots.carried(rows.where("k % 2 = 0 and station not in ('s3', 's5')").drop("k"), rows.where("k % 2 = 1").drop("k"), strikes, "station")
    return out


@query("SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT o_orderpriority FROM orders WHERE o_orderpriority < '3' AND o_totalprice > 100")
def vanished_values(spark, d):
    """Priorities that the second snapshot no longer has."""
    o = table(spark, d, "orders")
    return snapshots.vanished(o.where("o_orderkey % 2 = 0"), o.where("o_orderpriority < '3' and o_totalprice > 100"), "o_orderpriority")


# ---- hours, places ----

SPECS = ("24/7", "Tu-Su 10:00-17:00", "Mo-Fr 09:00-17:00", "Mo-Th 16:00-04:00; Fr 14:00-04:00; Sa-Su 12:00-04:00", "Th, Fr 19:00-24:00; Sa, Su 16:00-24:00", "09:00-12:00,13:00-18:00", "Mo-Su 20:30-04:00", "Mo-Fr 09:00-17:00; PH off", "Su,PH 10:00-18:00", "Mo-Su 12:00-4:00", "Nov-Mar 10:00-22:00", "sunset-23:00", "Mo-Fr 09:00-17:00; Jan 01 off", "", None)
MASKS = ("fffffff", "0333333", "3333300", "fffffff", "000ccee", "7777777", "ddddddd", "3333300", "0000007", "fffffff", None, None, None, None, None)
MASK_SQL = "CASE p_size % 15 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MASKS) if m) + " END"


def _places(spark, d):
    """Parts as places; the mask is parsed from a stated text."""
    spec = F.get(F.array(*[F.lit(s).cast("string") for s in SPECS]), F.col("p_size") % 15)
    image = F.when(F.col("p_size") % 2 == 0, F.lit("https://x"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), spec.alias("spec"), hours.week_mask(spec).alias("hours_mask"), image.alias("image"), (F.col("p_size") % 9).alias("notability"), F.col("p_brand").alias("borough"))


@query(f"SELECT p_partkey AS ord, {MASK_SQL} AS hours_mask FROM part")
def week_masks(spark, d):
    """H22."""
    return _places(spark, d).select("ord", "hours_mask")


@query(f"""WITH p AS (SELECT p_partkey AS ord, {MASK_SQL} AS m FROM part) SELECT ord, CASE WHEN m IS NULL THEN 'unknown' ELSE 'open' END AS open FROM p WHERE m IS NULL OR (strpos('0123456789abcdef', substr(m, 5, 1)) - 1) & 8 > 0""")
def late_friday_open(spark, d):
    """Shut places go, unknown ones stay unknown."""
    found = facets.places_open(_places(spark, d), 4, ["late"], strict=False)
    return found.select("ord", F.when(F.col("open"), "open").when(F.col("open").isNull(), "unknown").otherwise("shut").alias("open"))


@query(f"""WITH p AS (SELECT p_partkey AS ord, p_type AS kind, p_size, {MASK_SQL} AS m FROM part) SELECT kind, count(*) FILTER (m IS NOT NULL AND substr(m, 1, 1) <> '0') AS open, count(*) FILTER (m IS NULL) AS quiet FROM p GROUP BY 1""")
def places_open_today(spark, d):
    """Strict filter, unknown hours counted."""
    asked = _places(spark, d).withColumn("open", hours.is_open(F.col("hours_mask"), 0, []))
    return asked.groupBy("kind").agg(F.count_if("open").alias("open"), F.count_if(F.col("hours_mask").isNull()).alias("quiet"))


@query(f"""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_size % 9 AS nb, {MASK_SQL} AS m FROM part), s AS (SELECT id, name, nb + CASE WHEN m IS NOT NULL AND substr(m, 6, 1) <> '0' THEN 1 ELSE 0 END AS score FROM p) SELECT id, name, CAST(score AS INT) AS score FROM s ORDER BY score DESC, name, id LIMIT 60""")
def ranked_places(spark, d):
    """F3 F2."""
    asked = _places(spark, d).withColumn("open", hours.is_open(F.col("hours_mask"), 5, []))
    return facets.ranked_places(asked).limit(60).select("id", "name", "score")


@query("SELECT p_partkey AS ord FROM part ORDER BY (p_size % 2 <> 0), p_partkey LIMIT 8")
def photo_first(spark, d):
    """F4."""
    return facets.photo_first(_places(spark, d)).select("ord")


@query(LISTED + "SELECT id, title FROM listed WHERE category = 'view' ORDER BY md5(id || ':7'), id LIMIT 1")
def random_listing(spark, d):
    """a repeatable random row of a filtered set."""
    return facets.random_pick(listed(spark, d).where("category = 'view'"), 7).select("id", "title")


# ---- text, time, rules ----

TITLE = "split_part(text, chr(10), 1)"


def _titles(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"))


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(coalesce({TITLE}, '')), '&', ' and '), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM documents")
def matching_names(spark, d):
    """H5."""
    return _titles(spark, d).select("doc_id", text.norm(F.col("title")).alias("name"))


@query(f"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(lower({TITLE}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents) SELECT doc_id, regexp_replace(substr(s, 1, 70), '-+$', '') AS slug FROM a""")
def slugs(spark, d):
    """H4."""
    return _titles(spark, d).select("doc_id", text.place_slug(F.col("title")).alias("slug"))


@query("""SELECT page_id, nullif(trim(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), chr(160), ' ')), '') AS body FROM pages""")
def page_text(spark, d):
    """H1 H2: tags out, then entities once."""
    return table(spark, d, "pages").select("page_id", text.strip_tags(F.col("html"), text.unescape_named).alias("body"))


@query(f"SELECT doc_id, nullif(substr(text, 1, 400), '') AS blurb, regexp_replace(lower({TITLE}), '[^a-z]', '', 'g') AS letters FROM documents")
def blurbs(spark, d):
    """H17."""
    return table(spark, d, "documents").select("doc_id", text.blurb(F.col("text")).alias("blurb"), F.regexp_replace(F.lower(F.substring_index("text", "\n", 1)), "[^a-z]", "").alias("letters"))


@query("""SELECT o_orderkey, o_orderdate AS parsed, strftime(o_orderdate + INTERVAL 20 HOUR, '%Y-%m-%d %H:%M') AS start, strftime(o_orderdate + INTERVAL 26 HOUR, '%Y-%m-%d %H:%M') AS repaired, CAST(NULL AS VARCHAR) AS dropped, 'evening' AS band FROM orders""")
def time_shapes(spark, d):
    """Shapes read back, day and clock from two fields, ends repaired or dropped."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    shape = F.when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("T00:00"))).otherwise(F.concat(day, F.lit("T00:00:00.000")))
    rows = table(spark, d, "orders").select("o_orderkey", times.parse_naive(shape).alias("parsed"), times.combine(times.parse_naive(shape), times.parse_naive(F.lit("1999-09-09 20:00"))).alias("start"), times.combine(times.parse_naive(shape), times.parse_naive(F.lit("1999-09-09T02:00:00"))).alias("end"))
    as_text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return rows.select("o_orderkey", "parsed", as_text(F.col("start")).alias("start"), as_text(times.repaired_end(F.col("start"), F.col("end"))).alias("repaired"), as_text(times.dropped_end(F.col("start"), F.col("end"))).alias("dropped"), times.band(F.col("start")).alias("band"))


@query("SELECT event_id, ts - INTERVAL 5 HOUR AS local, ts AS utc FROM events")
def zones(spark, d):
    """Instants to the city's clock and back."""
    rows = table(spark, d, "events").select("event_id", F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts")).alias("local"))
    return rows.select("event_id", "local", times.local_to_utc(F.col("local"), "America/New_York").alias("utc"))


@query(LISTED + "SELECT ord, substr(sha1(venue_id || '|' || strftime(start_utc, '%Y-%m-%dT%H:%M') || '|' || replace(title, ' ', '-')), 1, 16) AS id FROM listed")
def event_ids(spark, d):
    """H15."""
    return listed(spark, d).select("ord", times.event_id(F.col("venue_id"), F.col("start_utc"), text.event_slug(F.col("title"))).alias("id"))


def _case(groups, column: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({column}, '{w}')" for w in words) + f" THEN '{code}'" for words, code in groups) + " END"


#: The engine's rule tables with words of the test tables added.
PART_WORDS = ((("small ring", "gear"), "art/exhibition"), (("red",), "music/jazz"), (("widget", "bolt"), "sports/yoga"), *rules.TITLE_WORDS)


@query(f"WITH c AS (SELECT p_partkey, {_case(PART_WORDS, 'lower(p_name)')} AS code FROM part) SELECT p_partkey, split_part(code, '/', 1) AS category, split_part(code, '/', 2) AS subcategory FROM c WHERE code IS NOT NULL")
def title_classes(spark, d):
    """Ordered keyword groups."""
    found = rules.from_title(F.col("p_name"), PART_WORDS)
    rows = table(spark, d, "part").select("p_partkey", found["category"].alias("category"), found["subcategory"].alias("subcategory"))
    return rows.where(rules.valid(F.col("category"), F.col("subcategory")))


@query("""SELECT p_partkey, CASE WHEN length(trim(p_brand)) < 3 THEN 'title too short to be an event' WHEN regexp_matches(p_type, '(?i)\\b(closed|closure|closures)\\b') THEN 'closure or shutdown, not an event' WHEN regexp_matches(p_brand, '(?i)#1') THEN 'a one' WHEN regexp_matches(p_brand, '(?i)#2$') THEN 'a two' END AS reason FROM part""")
def title_rejects(spark, d):
    """First pattern that meets the title."""
    mine = (*rules.TITLE_REJECTS, ("#1", "a one"), ("#2$", "a two"))
    return table(spark, d, "part").select("p_partkey", rules.rejected_title(F.col("p_brand"), mine).alias("reason"))


PARK_CASES = ("Sports|Basketball/Netball", "Music|Best for Kids", "Seniors", "Fitness|Nature|Tours", "unknown")


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'sports' WHEN 1 THEN 'music' WHEN 3 THEN 'outdoors' END AS category, CASE p_size % 5 WHEN 0 THEN 'basketball' WHEN 1 THEN 'concert' WHEN 3 THEN 'nature' END AS subcategory, CASE p_size % 5 WHEN 1 THEN 'kids' WHEN 2 THEN 'seniors' ELSE '' END AS flags FROM part""")
def park_classes(spark, d):
    """Highest priority, first of equals; audience words are flags."""
    named = F.get(F.array(*map(F.lit, PARK_CASES)), F.col("p_size") % 5)
    found = rules.from_parks(named)
    return table(spark, d, "part").select("p_partkey", found["category"].alias("category"), found["subcategory"].alias("subcategory"), F.array_join(rules.park_flags(named), ",").alias("flags"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'music/jazz' WHEN 'view' THEN 'performance/theatre' WHEN 'error' THEN 'performance/comedy' WHEN 'signup' THEN 'learning/talk' ELSE 'art/film-screening' END AS code FROM events""")
def class_chains(spark, d):
    """The first answer of genres, permits, venue, schema types and terms."""
    kind = F.col("event_type")
    name = lambda c: F.struct(c.alias("name"))
    genres = F.array(F.struct(name(F.lit(None).cast("string")).alias("segment"), name(F.when(kind == "click", "Jazz")).alias("genre"), name(F.lit(None).cast("string")).alias("subGenre")))
    found = F.coalesce(rules.from_genres(genres), rules.from_permit(F.lit("special event")), rules.from_venue(F.when(kind == "view", "New Stage")), rules.from_schema(F.when(kind == "error", "ComedyEvent")), rules.from_term(F.when(kind == "signup", " Talk ").otherwise("film")))
    return table(spark, d, "events").select("event_id", F.concat_ws("/", found["category"], found["subcategory"]).alias("code"))


# ---- stations and lines ----


def _stops(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("route"), F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("seq"), (F.col("l_suppkey") % 12).cast("string").alias("stop"), F.lit(False).alias("northbound"))


PATTERNS = "WITH t AS (SELECT l_returnflag AS route, l_orderkey AS trip, string_agg(CAST(l_suppkey % 12 AS VARCHAR), ',' ORDER BY l_linenumber, CAST(l_suppkey % 12 AS VARCHAR)) AS stops FROM lineitem GROUP BY 1, 2), p AS (SELECT DISTINCT route, stops FROM t) "


@query(PATTERNS + "SELECT route, stops FROM p")
def stop_patterns(spark, d):
    """Distinct stopping patterns."""
    return lines.patterns(_stops(spark, d)).select("route", F.array_join("stops", ",").alias("stops"))


@query(PATTERNS + ", l AS (SELECT route, string_split(stops, ',') AS s FROM p), u AS (SELECT route, s, unnest(s) AS stop, generate_subscripts(s, 1) - 1 AS pos FROM l) SELECT route, stop, round(avg(pos / greatest(1, len(s) - 1)), 9) AS place FROM u GROUP BY 1, 2")
def stop_positions(spark, d):
    """Mean relative place."""
    return lines.positions(lines.patterns(_stops(spark, d))).select("route", "stop", F.round("place", 9).alias("place"))


@query(PATTERNS + ", l AS (SELECT route, string_split(stops, ',') AS s FROM p), u AS (SELECT route, s, unnest(s) AS a, generate_subscripts(s, 1) AS pos FROM l) SELECT DISTINCT route, a, s[pos + 1] AS b FROM u WHERE s[pos + 1] IS NOT NULL")
def stop_edges(spark, d):
    """Which stop follows which."""
    return lines.edges(lines.patterns(_stops(spark, d)))


@query(PATTERNS + """, l AS (SELECT route, string_split(stops, ',') AS s FROM p), u AS (SELECT route, s, unnest(s) AS stop, generate_subscripts(s, 1) AS pos FROM l), w AS (SELECT route, stop, round(avg((pos - 1) / greatest(1, len(s) - 1)), 9) AS place FROM u GROUP BY 1, 2),
e AS (SELECT DISTINCT route, stop AS a, s[pos + 1] AS b FROM u WHERE s[pos + 1] IS NOT NULL), c AS (SELECT e.route, count(*) FILTER ((x.place, x.stop) >= (y.place, y.stop)) AS cut FROM e JOIN w x ON x.route = e.route AND x.stop = e.a JOIN w y ON y.route = e.route AND y.stop = e.b GROUP BY 1)
SELECT w.route, count(*) AS stops, any_value(cut) AS cut, CAST(0 AS BIGINT) AS against FROM w JOIN c USING (route) GROUP BY 1""")
def line_orders(spark, d):
    """One running order per route: its stops, the edges left out, and that no other runs against it."""
    patterns = lines.patterns(_stops(spark, d))
    order, place = lines.line_order(patterns), lines.positions(patterns).withColumn("place", F.round("place", 9))
    at = order.join(place, ["route", "stop"])
    a, b = (at.select("route", F.col("stop").alias(x), F.col("pos").alias(f"p{x}"), F.struct("place", "stop").alias(f"m{x}")) for x in "ab")
    against = lines.edges(patterns).join(a, ["route", "a"]).join(b, ["route", "b"]).groupBy("route").agg(F.count_if((F.col("ma") < F.col("mb")) & (F.col("pa") > F.col("pb"))).alias("against"))
    return order.groupBy("route").agg(F.count("*").alias("stops"), F.max("cut").cast("long").alias("cut")).join(against, "route")


@query("SELECT CAST(s_nationkey AS VARCHAR) AS complex, min(s_suppkey) AS id, arg_min(s_name, s_suppkey) AS name, string_agg(DISTINCT chr(CAST(65 + s_suppkey % 5 AS INT)), ',' ORDER BY chr(CAST(65 + s_suppkey % 5 AS INT))) AS routes, count(*) AS stops, bool_or(s_suppkey % 11 = 0) AS ada FROM supplier GROUP BY 1")
def merged_stations(spark, d):
    """Complexes united."""
    rows = _stations(spark, d).select(F.col("id").alias("ord"), "id", F.col("line").cast("string").alias("complex_id"), "name", F.array(F.char(65 + F.col("id") % 5)).alias("routes"), "lat", "lon", (F.col("id") % 11 == 0).alias("ada"))
    out = lines.merged(rows)
    return out.select("complex", "id", "name", F.array_join("routes", ",").alias("routes"), F.size("stops").cast("long").alias("stops"), "ada")


@query("SELECT l_returnflag AS route, count(*) AS stops, CAST(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS BIGINT) AS place FROM (SELECT DISTINCT l_returnflag, l_suppkey FROM lineitem) GROUP BY 1")
def trunk_order(spark, d):
    """F5."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("route"), F.col("l_suppkey").alias("station")).distinct()
    return lines.by_trunk(rows, ["R", "A"]).select("route", "stops", F.col("place").cast("long").alias("place"))


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_suppkey % 7 <> 3)")
def orphan_stations(spark, d):
    """Stations on no line."""
    served = table(spark, d, "lineitem").where("l_quantity > 49 and l_suppkey % 7 <> 3").select(F.col("l_suppkey").alias("station"))
    return lines.orphans(_stations(spark, d).select("id"), served)


@query("""WITH s AS (SELECT s_suppkey AS id, chr(CAST(65 + s_suppkey % 5 AS INT)) AS route, CASE s_suppkey % 4 WHEN 0 THEN 'Canal St' WHEN 1 THEN 'Old Bergen' WHEN 2 THEN 'New Canal' ELSE 'Xcanal' END AS name, CASE s_suppkey % 3 WHEN 0 THEN 'Canalside line' ELSE 'Main' END AS line FROM supplier)
SELECT 'B' AS q, id FROM s WHERE route = 'B' UNION ALL SELECT 'ca', id FROM s WHERE name IN ('Canal St', 'New Canal') UNION ALL SELECT 'nal', id FROM s WHERE contains(lower(name), 'nal') UNION ALL SELECT 'Canal', id FROM s WHERE contains(lower(name), 'canal') OR contains(lower(line), 'canal')""")
def stop_search(spark, d):
    """A route, the start of a word, any part, and over three letters the line's name as well."""
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, "Canal St").when(k % 4 == 1, "Old Bergen").when(k % 4 == 2, "New Canal").otherwise("Xcanal")
    rows = table(spark, d, "supplier").select(k.alias("id"), F.char(65 + k % 5).alias("route"), name.alias("name"), F.when(k % 3 == 0, "Canalside line").otherwise("Main").alias("line"))
    found = [facets.stop_search(rows, q).select(F.lit(q).alias("q"), "id") for q in ("B", "ca", "nal", "Canal")]
    return feeds.union(found)


# ---- pages and calendars ----

LINKS = """WITH h AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin, unnest(regexp_extract_all(html, '(?i)href=["'']([^"''#]+)["'']', 1)) AS href FROM pages), l AS (SELECT page_id, origin || replace(href, '&amp;', '&') AS link FROM h WHERE starts_with(href, '/') AND NOT starts_with(href, '//')) """


@query(LINKS + "SELECT DISTINCT page_id, link FROM l")
def page_links(spark, d):
    """Own links, entities decoded, distinct."""
    return pages.links(table(spark, d, "pages"), "page_id").select("page_id", "link")


@query(LINKS + ", s AS (SELECT link, regexp_extract(link, '^https?://[^/]+/([^/?]+)', 1) AS segment FROM l) SELECT segment, count(DISTINCT link) AS n, bool_or(regexp_matches(segment, '(?i)the|and')) AS eventish FROM s WHERE segment <> '' GROUP BY 1")
def link_segments(spark, d):
    """D23."""
    return pages.segments(table(spark, d, "pages"), "page_id", "the|and")


@query("SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', '') AS host, count(*) AS n FROM pages GROUP BY 1")
def host_facet(spark, d):
    """D25 B22."""
    return table(spark, d, "pages").groupBy(text.registrable_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("SELECT page_id, 0 AS pos, url AS loc, CASE WHEN page_id % 2 = 0 THEN '2024-01-02' END AS lastmod FROM pages UNION ALL SELECT page_id, 1, url || '/x', NULL FROM pages")
def sitemap_rows(spark, d):
    """A10: blocks with and without lastmod."""
    u = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    body = F.concat(F.lit("<urlset><url><loc>"), u, F.lit("</loc>"), F.when(F.col("page_id") % 2 == 0, "<lastmod>2024-01-02</lastmod>").otherwise(""), F.lit("</url>\n<url><loc>"), u, F.lit("/x</loc></url></urlset>"))
    return pages.sitemap(table(spark, d, "pages").select("page_id", body.alias("body")), "page_id")


def _bodies(spark, d):
    """A calendar for each user, folded lines and all three shapes of a start."""
    e = table(spark, d, "events")
    stamp = F.date_format("ts", "yyyyMMdd'T'HHmmss")
    start = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("DTSTART:"), stamp, F.lit("Z"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("DTSTART;TZID=America/New_York:"), stamp)).otherwise(F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format("ts", "yyyyMMdd")))
    lines_ = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("event_id").cast("string")), start, F.concat(F.lit("SUMMARY:"), "event_type", F.lit("\\, at\r\n  night")), F.when(F.col("event_id") % 5 == 0, F.lit("RRULE:FREQ=WEEKLY")), F.lit("CATEGORIES:A\\,B,C"), F.lit("END:VEVENT"))
    rows = e.select("user_id", F.struct("event_id", lines_.alias("v")).alias("s"))
    return rows.groupBy("user_id").agg(F.concat(F.lit("BEGIN:VCALENDAR\r\n"), F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["v"]), "\r\n"), F.lit("\r\nEND:VCALENDAR")).alias("body"))


ICS = "WITH c AS (SELECT user_id, CAST(event_id AS VARCHAR) AS uid, event_type || ', at night' AS summary, event_id % 3 = 2 AS all_day, event_id % 5 = 0 AS rule, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) + INTERVAL 5 HOUR ELSE CAST(date_trunc('day', ts) AS TIMESTAMP) END AS start FROM events) "


@query(ICS + "SELECT user_id, uid, summary, all_day, start, 'A,B|C' AS categories FROM c")
def calendar_events(spark, d):
    """Unfolded, unescaped, three shapes of a start."""
    return calendars.events(_bodies(spark, d), "user_id").select("user_id", "uid", "summary", "all_day", "start", F.array_join("categories", "|").alias("categories"))


@query(ICS + f"SELECT user_id, count(*) AS n FROM c WHERE CASE WHEN all_day THEN start + INTERVAL 1 DAY ELSE start END >= TIMESTAMP '{AS_OF}' AND start <= TIMESTAMP '{AS_OF}' + INTERVAL 7 DAY GROUP BY 1")
def calendar_upcoming(spark, d):
    """B4."""
    return facets.counts(calendars.upcoming(calendars.events(_bodies(spark, d), "user_id"), AS_OF, 7), "user_id")


@query(ICS + f"SELECT user_id, count(*) AS events, count(*) FILTER (start >= TIMESTAMP '{AS_OF}') AS future, count(*) FILTER (rule) AS recurring, max(start) AS latest, count(*) FILTER (rule OR start >= TIMESTAMP '{AS_OF}') > 0 AS live FROM c GROUP BY 1")
def feed_summaries(spark, d):
    """D22 D12."""
    return calendars.feed_summary(calendars.events(_bodies(spark, d), "user_id"), "user_id", AS_OF)


@query("""SELECT event_id, event_type AS title, CASE event_id % 2 WHEN 0 THEN 'ComedyEvent' ELSE 'MusicEvent' END AS type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS start, 'Hall ' || user_id AS venue, CASE WHEN event_id % 2 = 0 THEN value END AS price FROM events""")
def markup_events(spark, d):
    """Events at any depth of a page's markup."""
    e = F.struct(
        F.when(F.col("event_id") % 2 == 0, F.array(F.lit("Event"), F.lit("ComedyEvent"))).otherwise(F.array(F.lit("MusicEvent"))).alias("@type"), F.col("event_type").alias("name"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("startDate"),
        F.struct(F.concat(F.lit("Hall "), F.col("user_id").cast("string")).alias("name")).alias("location"), F.when(F.col("event_id") % 2 == 0, F.array(F.struct(F.col("value").alias("price")))).alias("offers"),
    )
    graph = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.array(F.struct(F.struct(e.alias("item")).alias("element"))).alias("@graph")))
    html = F.concat(F.lit('<html><script type="application/ld+json">'), graph, F.lit('</script><script type="application/ld+json">{bad</script></html>'))
    return pages.markup_events(table(spark, d, "events").select("event_id", html.alias("html")), "event_id").select("event_id", "title", "type", "start", "venue", "price")


# ---- gates and the whole path ----


FAULTY = LISTED + """, x AS (SELECT CASE WHEN k % 13 = 0 THEN 'twice' || (ord % 50) ELSE id END AS id, CASE WHEN k % 5 = 0 THEN '' ELSE title END AS title, CASE WHEN k % 7 = 0 THEN NULL ELSE venue_id END AS venue_id, CASE k % 4 WHEN 0 THEN 'music' WHEN 1 THEN 'music' WHEN 2 THEN 'nonsense' ELSE 'art' END AS category,
 CASE k % 4 WHEN 0 THEN 'jazz' WHEN 1 THEN 'no such' WHEN 2 THEN 'jazz' ELSE 'jazz' END AS sub, k % 3 = 0 AS backwards, k % 2 = 0 AS free, CASE WHEN k % 6 = 0 THEN 4.0 WHEN k % 6 = 2 THEN 0.0 END AS price FROM listed) """


@query(FAULTY + """SELECT 'error' AS severity, 'missing ' || CASE WHEN title = '' THEN 'title' ELSE 'venue_id' END AS rule, id AS key FROM x WHERE title = '' OR venue_id IS NULL UNION ALL SELECT 'error', 'out of vocabulary', id FROM x WHERE NOT (category = 'music' AND sub = 'jazz')
UNION ALL SELECT 'warning', 'ends before it starts', id FROM x WHERE backwards UNION ALL SELECT 'error', 'free with a price', id FROM x WHERE free AND price > 0 UNION ALL SELECT 'error', 'duplicate id', id FROM x GROUP BY id HAVING count(*) > 1""")
def structure_faults(spark, d):
    """Each of the five rules, the first missing field alone, and repeated ids once."""
    k = F.col("k")
    rows = listed(spark, d).withColumns({
        "id": F.when(k % 13 == 0, F.concat(F.lit("twice"), (F.col("ord") % 50).cast("string"))).otherwise(F.col("id")), "title": F.when(k % 5 == 0, "").otherwise(F.col("title")), "venue_id": F.when(k % 7 != 0, F.col("venue_id")),
        "category": F.when(k % 4 < 2, "music").when(k % 4 == 2, "nonsense").otherwise("art"), "subcategory": F.when(k % 4 == 1, "no such").otherwise("jazz"), "end_local": F.when(k % 3 == 0, F.col("start_local") - F.expr("interval 1 hour")).otherwise(F.col("end_local")),
        "is_free": k % 2 == 0, "price_min": F.when(k % 6 == 0, 4.0).when(k % 6 == 2, 0.0),
    })
    return quality.structure(rows)


@query(LISTED + "SELECT count(*) AS n, CASE WHEN count(*) < 25 THEN 'error' WHEN count(*) < 100 THEN 'warning' ELSE 'ok' END AS verdict FROM listed WHERE date_local BETWEEN '2024-01-15' AND '2024-01-21'")
def next_week(spark, d):
    """D27 J2."""
    return quality.next_week(listed(spark, d), TODAY)


def built(spark: SparkSession, d: str) -> DataFrame:
    """Events as a permit feed, taken through the whole path."""
    e = table(spark, d, "events")
    kinds = {"click": "Farmers Market", "view": "Parade", "error": "Sport - Youth", "signup": "Special Event", "purchase": "Street Festival"}
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type"))
    raw = e.select(
        F.lit("permits").alias("source_id"), F.col("event_id").cast("int").alias("row_pos"), F.concat(F.when(F.col("event_id") % 6 == 0, F.lit("Jazz night ")).otherwise(F.lit("Gathering no ")), (F.col("user_id") % 30).cast("string")).alias("event_name"), kind.alias("event_type"),
        F.lit(None).cast("string").alias("event_borough"), F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"), F.lit(": lawn")).alias("event_location"), F.date_format("ts", "yyyy-MM-dd'T'HH:00:00").alias("start_date_time"), F.date_format("ts", "yyyy-MM-dd'T'HH:30:00").alias("end_date_time"),
    )
    pts = _points(spark, d).join(table(spark, d, "customer"), F.col("id") == F.col("c_custkey"))
    register = pts.select(text.norm(F.col("c_name")).alias("name"), "lat", "lon")
    areas = _areas(spark, d).withColumn("name", F.col("slug")).withColumn("borough", F.lit(None).cast("string"))
    stations = _stations(spark, d).select(F.col("id").cast("string").alias("id"), (F.col("lat") - 40.5).alias("lat"), (F.col("lon") + 74.2).alias("lon"))
    return listings.build(feeds.permits(raw, "America/New_York"), areas, register, register.limit(0), stations, "America/New_York")


BUILT = """WITH r AS (SELECT event_id, user_id, CASE WHEN event_id % 6 = 0 THEN 'Jazz night ' ELSE 'Gathering no ' END || (user_id % 30) AS title, event_type, strftime(ts, '%Y-%m-%dT%H:00') AS start FROM events),
c AS (SELECT *, CASE WHEN event_type = 'error' THEN 'league field permit, not a public event' WHEN event_type = 'signup' AND event_id % 6 <> 0 THEN 'unclassified event_type: Special Event' END AS reject FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY reject IS NULL, user_id, start, title ORDER BY event_id) AS rn FROM c), o AS (SELECT *, CASE WHEN reject IS NOT NULL THEN reject WHEN rn > 1 THEN 'deduped' ELSE 'kept' END AS outcome FROM k) """


@query(BUILT + "SELECT CASE WHEN outcome = 'kept' THEN 'kept:permits' WHEN outcome = 'deduped' THEN 'deduped' ELSE 'rejected:' || outcome END AS counter, count(*) AS n FROM o GROUP BY 1")
def whole_path_outcomes(spark, d):
    """Every feed row ends in one counter."""
    return listings.outcomes(built(spark, d))


@query(BUILT + f""", p AS ({POINTS}) SELECT substr(sha1('customer' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '|' || start || '|' || replace(lower(title), ' ', '-')), 1, 16) AS id, title, start, CASE event_type WHEN 'click' THEN 'market' WHEN 'view' THEN 'parade' WHEN 'signup' THEN 'jazz' ELSE 'street-fair' END AS subcategory,
CASE WHEN event_type = 'signup' THEN 'permit+title' ELSE 'permit:event_type' END AS category_source, CASE WHEN p.id IS NOT NULL THEN 'register' END AS location_source FROM o LEFT JOIN p ON p.id = user_id WHERE outcome = 'kept'""")
def whole_path_listings(spark, d):
    """Listings with provenance."""
    kept = listings.listings(built(spark, d))
    return kept.select("id", "title", F.date_format("start_local", "yyyy-MM-dd'T'HH:mm").alias("start"), "subcategory", "category_source", "location_source")


@query(BUILT + """SELECT substr(sha1('customer' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '|' || start || '|' || replace(lower(title), ' ', '-')), 1, 16) AS i, title AS t, substr(start, 1, 10) AS d, 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS vn FROM o WHERE outcome = 'kept'""")
def serving_extract(spark, d):
    """Compact JSON lines, read back."""
    lines_ = listings.extract(listings.listings(built(spark, d)))
    return lines_.select(F.json_tuple("value", "i", "t", "d", "vn").alias("i", "t", "d", "vn"))


# ---- places from map elements ----


def _elements(spark, d):
    """Parts as map elements: tags by size, points by key."""
    k, n = F.col("p_partkey"), F.col("p_size")
    pairs = [("tourism", "museum"), ("amenity", "theatre"), ("leisure", "sports_centre"), ("leisure", "dance"), ("amenity", "nightclub"), ("shop", "books")]
    at = lambda i: F.get(F.array(*[F.lit(p[i]) for p in pairs]), n % 6)
    sport = F.when(n % 12 == 2, "yoga;bouldering").when(n % 12 == 4, "roller_skating").otherwise("none")
    tags = F.map_concat(F.create_map(at(0), at(1)), F.create_map(F.lit("name"), F.when(n % 12 == 1, F.concat("p_name", F.lit(" improv"))).otherwise(F.col("p_name")), F.lit("sport"), sport, F.lit("image"), F.when(n % 2 == 0, F.concat(F.lit("File:A "), k.cast("string"), F.lit(".jpg"))).otherwise("https://drive.example/x")))
    return table(spark, d, "part").select(k.alias("ord"), k.alias("osm_id"), (k * 91 % 1100 / 200.0).alias("lat"), (k * 37 % 1100 / 200.0).alias("lon"), tags.alias("tags"))


KIND_SQL = "CASE p_size % 6 WHEN 0 THEN 'museum' WHEN 1 THEN CASE WHEN p_size % 12 = 1 THEN 'comedy-club' ELSE 'theatre' END WHEN 2 THEN CASE WHEN p_size % 12 = 2 THEN 'climbing' END WHEN 4 THEN CASE WHEN p_size % 12 = 4 THEN 'roller-rink' ELSE 'nightclub' END END"


@query(f"""WITH k AS (SELECT p_partkey AS ord, {KIND_SQL} AS kind FROM part) SELECT ord, kind, CASE kind WHEN 'museum' THEN 'art' WHEN 'nightclub' THEN 'music' WHEN 'climbing' THEN 'sports' WHEN 'roller-rink' THEN 'sports' ELSE 'performance' END AS category FROM k WHERE kind IS NOT NULL""")
def place_kinds(spark, d):
    """Activity beats building; kinds map to categories."""
    rows = _elements(spark, d).withColumn("kind", places.kind_of(F.col("tags"), places._tag(F.col("tags"), "name"))).where("kind is not null")
    return rows.select("ord", "kind", places.category_of(F.col("kind")).alias("category"))


@query("""SELECT p_partkey AS ord, CASE WHEN p_size % 2 = 0 THEN 'A ' || p_partkey || '.jpg' END AS file, 'https://upload.wikimedia.org/wikipedia/commons/thumb/a/ab/X' || p_partkey || '.jpg/500px-X' || p_partkey || '.jpg' AS thumb, CAST(3 * (p_size % 2) + 2 * (p_size % 3 = 0)::INT + (p_size % 5 = 0)::INT AS INT) AS score FROM part""")
def place_images(spark, d):
    """Stated files, smaller renditions, notability."""
    k, n = F.col("osm_id"), F.col("p_size")
    rows = _elements(spark, d).join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("ord") == F.col("p_partkey"))
    url = F.concat(F.lit("https://upload.wikimedia.org/wikipedia/commons/a/ab/X"), k.cast("string"), F.lit(".jpg"))
    flag = lambda cond: F.when(cond, "x")
    score = places.notability(flag(n % 2 == 1), flag(n % 3 == 0), flag(F.lit(False)), flag(n % 5 == 0), F.lit(""))
    return rows.select("ord", places.image_ref(F.col("tags")).alias("file"), places.thumb(url).alias("thumb"), score.alias("score"))


@query(f"""WITH k AS (SELECT *, {KIND_SQL} AS kind, CASE WHEN p_size % 12 = 1 THEN p_name || ' improv' ELSE p_name END AS name, p_partkey * 91 % 1100 / 200.0 AS lat, p_partkey * 37 % 1100 / 200.0 AS lon FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY name, round(lat, 4) ORDER BY p_partkey) AS rn FROM k WHERE kind IS NOT NULL),
g AS (SELECT p_partkey, p_size, CAST(floor(lat) * 5 + floor(lon) AS INT) AS a, lon - floor(lon) AS fx, lat - floor(lat) AS fy, lat < 5 AND lon < 5 AS inside FROM f WHERE rn = 1)
SELECT count(*) AS places, count(*) FILTER (p_size % 2 = 0) AS with_photo, count(*) FILTER (inside AND NOT (a % 2 = 1 AND fx >= 0.25 AND fx < 0.75 AND fy >= 0.25 AND fy < 0.75)) AS in_area, count(*) FILTER (p_size % 4 > 0) AS hours_stated, count(*) FILTER (p_size % 4 IN (1, 2)) AS hours_parsed FROM g""")
def place_summary(spark, d):
    """Elements to places; photos, areas, hours stated and parsed."""
    stations = _stations(spark, d).select("id", (F.col("lat") - 40.5).alias("lat"), (F.col("lon") + 74.2).alias("lon"))
    n = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 4).alias("n"))
    stated = F.when(F.col("n") == 1, "Mo-Fr 09:00-17:00").when(F.col("n") == 2, "24/7").when(F.col("n") == 3, "sunset-23:00")
    elements = _elements(spark, d).join(n, F.col("ord") == F.col("p_partkey"))
    elements = elements.withColumn("tags", F.when(F.col("n") > 0, F.map_concat("tags", F.create_map(F.lit("opening_hours"), stated))).otherwise(F.col("tags"))).drop("p_partkey", "n")
    built_ = places.build(elements, _areas(spark, d), stations)
    return places.summary(built_.withColumn("image", places.image_ref(F.col("tags"))))


@query("""SELECT p_name AS name, CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 THEN 'invalid' ELSE 'superseded' END AS warning FROM part WHERE p_partkey % 9 = 0 AND (p_size % 5 = 0 OR p_size % 7 = 0 OR p_name IN (SELECT p_name FROM part WHERE p_partkey % 9 = 1 AND p_size > 40))""")
def curated_warnings(spark, d):
    """Curated rows that are faulty or that the map has by now."""
    part = table(spark, d, "part")
    n = F.col("p_size")
    curated = part.where("p_partkey % 9 = 0").select(F.col("p_name").alias("name"), F.when(n % 5 == 0, "nonsense").otherwise("museum").alias("kind"), F.when(n % 7 != 0, "1 Main St").alias("address"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    return places.extras(part.where("p_partkey % 9 = 1 and p_size > 40").select(F.col("p_name").alias("name")), curated, ["museum"])[1]


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'new-york' WHEN page_id % 3 = 1 THEN 'brooklyn' END AS city FROM pages""")
def city_suffix(spark, d):
    """The whole listing suffix, so that a band named after a city does not match."""
    k = F.col("page_id")
    url = F.when(k % 3 == 0, "https://x/a-new-york-tickets").when(k % 3 == 1, "https://x/b-brooklyn-tickets/").otherwise("https://x/brooklyn-bristol-tickets")
    return table(spark, d, "pages").select("page_id", pages.city_listing(url, ["brooklyn", "new-york"]).alias("city"))


@query(LINKS + """, e AS (SELECT page_id, link, length(regexp_replace(regexp_replace(regexp_extract(link, '^https?://[^/]+([^?]*)', 1), '/+$', ''), '[^/]', '', 'g')) AS depth FROM l WHERE regexp_matches(lower(regexp_extract(link, '^https?://[^/]+([^?]*)', 1)), 'th|re')),
x AS (SELECT page_id, link, depth FROM e UNION ALL SELECT page_id, link || CASE WHEN page_id % 3 = 0 THEN '/there/on' ELSE '/there' END, depth + CASE WHEN page_id % 3 = 0 THEN 2 ELSE 1 END FROM e WHERE page_id % 2 = 0), t AS (SELECT page_id, arg_min(link, (depth, length(link), link)) AS listing, min(depth) AS top FROM x GROUP BY 1)
SELECT page_id, listing, arg_min(link, (length(link), link)) FILTER (depth > top) AS detail FROM t JOIN x USING (page_id) GROUP BY ALL""")
def listing_pages(spark, d):
    """the shallowest, shortest event-like link of each page as listing, the shortest deeper one as detail."""
    found = pages.links(table(spark, d, "pages"), "page_id").select("page_id", "link")
    # links of the saved pages go one level down; every other page gets links below its own
    own = found.where(F.lower(F.parse_url("link", F.lit("PATH"))).rlike("th|re"))
    below = own.where("page_id % 2 = 0").select("page_id", F.concat("link", F.when(F.col("page_id") % 3 == 0, "/there/on").otherwise("/there")).alias("link"))
    return pages.listing_and_detail(found.unionByName(below), "page_id", "th|re")


@query(LISTED + """, h AS (SELECT DISTINCT station AS area FROM listed) SELECT neighborhood AS area, count(*) AS n FROM listed WHERE neighborhood IS NOT NULL GROUP BY 1""")
def area_cards(spark, d):
    """Events, routes and stations of each area."""
    located = _stations(spark, d).select("id", F.concat(F.lit("n"), (F.col("id") % 25).cast("string")).alias("area"))
    stations = _stations(spark, d).select("id", "name", F.array(F.lit("A")).alias("routes"))
    return lines.area_card(listed(spark, d), located, stations).select("area", "n")


@query("""WITH a AS (SELECT CASE p_size % 4 WHEN 0 THEN 'register' WHEN 1 THEN 'geocoder' ELSE 'unplaced' END AS outcome, p_size AS n FROM part) SELECT outcome, count(*) AS locations, CAST(sum(n) AS BIGINT) AS n, CAST(round_even(sum(n) * 100.0 / (SELECT sum(n) FROM a), 1) AS DOUBLE) AS share FROM a GROUP BY 1""")
def geocode_report(spark, d):
    """What was asked and what placed it, weighted by the rows that ride on it."""
    size = F.col("p_size")
    asked = table(spark, d, "part").select(size.cast("long").alias("n"), F.when(size % 4 == 0, "register").when(size % 4 == 1, "geocoder").alias("source"))
    return reports.placed_report(asked, "source")


@query("""WITH w AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'https://www.facebook.com/p' || c_custkey WHEN 1 THEN 'www.Site' || (c_custkey % 50) || '.org/a' WHEN 2 THEN 'http://site' || (c_custkey % 50) || '.org/b' ELSE '' END AS raw FROM customer),
u AS (SELECT c_custkey, CASE WHEN starts_with(raw, 'http') THEN raw ELSE 'https://' || raw END AS url FROM w WHERE raw <> ''), h AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^https?://([^/]+)', 1)), '^www\\.', '') AS host FROM u)
SELECT host, arg_min(url, c_custkey) AS url, min(c_custkey) AS c_custkey FROM h WHERE host <> 'facebook.com' GROUP BY 1""")
def website_candidates(spark, d):
    """Own websites, first place of each host."""
    k = F.col("c_custkey")
    n = (k % 50).cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit("https://www.facebook.com/p"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("www.Site"), n, F.lit(".org/a"))).when(k % 4 == 2, F.concat(F.lit("http://site"), n, F.lit(".org/b"))).otherwise("")
    return pages.website_candidates(table(spark, d, "customer").select("c_custkey", raw.alias("website")), "c_custkey")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 > 0 AND NOT (c_nationkey IN (1, 3) OR c_custkey % 10 = 0) AND c_mktsegment = 'BUILDING'""")
def signal_candidates(spark, d):
    """Readable, not refused, with a signal."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    status = F.when(n == 1, 401).when(n == 3, 403).otherwise(200)
    rows = table(spark, d, "customer").withColumns({"readable": k % 3 > 0, "blocked": pages.blocked(status, F.when(k % 10 == 0, "Robots say no"))})
    return pages.candidates(rows, F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_mktsegment")


@query("""SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN 'n' || s_nationkey END AS area FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 48)""")
def line_index(spark, d):
    """Stations on lines, with their areas."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("n"))
    located = s.where("id % 3 > 0").select("id", F.concat(F.lit("n"), F.col("n").cast("string")).alias("area"))
    served = table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_suppkey").alias("station"))
    return lines.line_index(s.select("id", "name"), served, located)


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref=["'']([^"'']+)["'']')) AS INT) AS anchors, page_id % 2 = 0 AS ical FROM pages""")
def redetected_signals(spark, d):
    """Signals from saved pages, network-only ones carried."""
    p = table(spark, d, "pages")
    return pages.redetected(signals.page_signals(p, "page_id").select("page_id", "anchors"), p.select("page_id", (F.col("page_id") % 2 == 0).alias("ical")), "page_id", ["ical"])


from townsheet import feed_queries, published_queries, stored_queries, whole_queries  # noqa: E402, F401  (register more queries, which use the helpers above)
