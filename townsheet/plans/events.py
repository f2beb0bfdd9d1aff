"""Feed rows to listings: resolve, place, order-dependent venues, deduplicate, quarantine, summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townsheet.functions import text, times
from townsheet.operators import dedup, geo, resolve

ORD = ["source_id", "row_pos"]


def build(rows: DataFrame, areas: DataFrame, register: DataFrame, gazetteer: DataFrame, stations: DataFrame, zone: str) -> DataFrame:
    """All rows with ``outcome`` (kept, deduped, collapsed, dropped or the reject's reason) and event columns.

    areas: ord, slug, name, borough, rings. One plan serves listings and dead letters.
    """
    rows = rows.withColumn("key", F.xxhash64(*ORD)).withColumn("slug", text.event_slug(F.col("venue_name")))
    # names and addresses are looked up once each; own coordinates first
    asked = rows.select("key", F.coalesce("place_name", "venue_name").alias("name"), "lat", "lon")
    found = resolve.resolve(asked, register, gazetteer)
    placed = rows.join(found.select("key", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col("location_source").alias("r_source")), "key", "left")
    # a venue's location as of each row: the first row that had one, and later upgrades
    seen = dedup.venue_state(
        placed.select("*", F.col("venue_name").alias("name"), F.col("venue_kind").alias("kind")).drop("lat", "lon").withColumnsRenamed({"r_lat": "lat", "r_lon": "lon"}),
        "slug", ORD,
    )
    own = F.col("own_lat").isNotNull() & F.col("own_lon").isNotNull()
    here = seen.withColumns({"e_lat": F.when(own, F.col("own_lat")).otherwise(F.col("v_lat")), "e_lon": F.when(own, F.col("own_lon")).otherwise(F.col("v_lon"))})
    # every event stands at a resolved point or at its own, so points need neither venues nor the join above
    points = found.select(F.col("lat").alias("e_lat"), F.col("lon").alias("e_lon")).union(rows.select("own_lat", "own_lon"))
    points = points.where("e_lat is not null and e_lon is not null").distinct().withColumn("pt", F.xxhash64("e_lat", "e_lon"))
    area = geo.locate(points, areas, "pt", "e_lon", "e_lat").join(areas.select("ord", F.col("slug").alias("area_slug"), F.col("name").alias("area_name"), F.col("borough").alias("area_borough")), "ord")
    near = geo.nearest(points.select("pt", F.col("e_lat").alias("lat"), F.col("e_lon").alias("lon")), stations, "pt")
    here = here.withColumn("pt", F.xxhash64("e_lat", "e_lon")).join(area, "pt", "left").join(near, "pt", "left")
    missing = F.col("needs_area") & F.col("area_slug").isNull()
    here = here.withColumn("reject", F.coalesce("reject", F.when(missing, F.when(F.col("e_lat").isNull(), "no coordinates, cannot place").otherwise("outside the city"))))
    here = here.withColumn("id", times.event_id(F.col("slug"), F.col("start"), text.event_slug(F.col("title"))))
    incomplete = F.col("start").isNull() | (F.coalesce("title", F.lit("")) == "") | (F.coalesce("slug", F.lit("")) == "")
    here = here.withColumn("open", F.col("reject").isNull() & ~incomplete)
    # only open rows compete for an id; the others are each alone, so incomplete ones do not meet in one task
    rival = F.when(F.col("open"), F.col("id")).otherwise(F.concat(F.lit("-"), F.col("key").cast("string")))
    again = F.col("open") & (F.row_number().over(Window.partitionBy(rival).orderBy(*ORD)) > 1)
    outcome = F.when(F.col("reject").isNotNull(), F.col("reject")).when(incomplete, "dropped_incomplete").when(again, "deduped").otherwise("kept")
    return here.select(
        "id", "title", text.blurb(F.col("description")).alias("description"), times.local_to_utc(F.col("start"), zone).alias("start_utc"), F.col("start").alias("start_local"), F.col("end").alias("end_local"),
        F.date_format("start", "yyyy-MM-dd").alias("date_local"), times.band(F.col("start")).alias("time_band"), F.lit(zone).alias("tz"), F.col("slug").alias("venue_id"), F.col("v_name").alias("venue_name"), F.col("v_kind").alias("venue_kind"),
        F.col("area_slug").alias("neighborhood"), F.col("area_name").alias("neighborhood_name"), F.coalesce("area_borough", "v_borough").alias("borough"), F.col("e_lat").alias("lat"), F.col("e_lon").alias("lon"), F.when(F.col("e_lat").isNotNull(), F.coalesce("r_source", F.lit("coordinates"))).alias("location_source"),
        F.coalesce("near", F.array().cast("array<struct<meters:bigint,id:string>>")).alias("subway"), "category", "subcategory", "category_source", F.coalesce("flags", F.array().cast("array<string>")).alias("flags"), "price_min", "is_free", "url", text.https_only(F.col("image")).alias("image"),
        F.col("source_id").alias("source"), "row_pos", outcome.alias("outcome"),
    )


def listings(built: DataFrame) -> DataFrame:
    return built.where("outcome = 'kept'").drop("outcome")


def rejects(built: DataFrame) -> DataFrame:
    return built.where("outcome not in ('kept', 'deduped', 'collapsed', 'dropped_incomplete')").select("source", "title", F.col("outcome").alias("reason"), "url")


def outcomes(built: DataFrame) -> DataFrame:
    """kept by source, rejected by reason, and the other counters."""
    name = F.when(F.col("outcome") == "kept", F.concat(F.lit("kept:"), "source")).when(F.col("outcome").isin("deduped", "collapsed", "dropped_incomplete"), F.col("outcome")).otherwise(F.concat(F.lit("rejected:"), "outcome"))
    return built.groupBy(name.alias("counter")).agg(F.count("*").alias("n"))


def coverage(events: DataFrame) -> DataFrame:
    """Events and the share (one decimal) that state each field; an empty table has shares of zero."""
    share = lambda cond: F.bround(F.count_if(cond) * 100.0 / F.greatest(F.count("*"), F.lit(1)), 1)
    return events.agg(
        F.count("*").alias("events"), share(F.col("neighborhood").isNotNull()).alias("neighborhood"), share(F.col("lat").isNotNull()).alias("coordinates"), share(F.col("borough").isNotNull()).alias("borough"),
        share(F.col("url").isNotNull()).alias("url"), share(F.col("price_min").isNotNull()).alias("price"), share(F.size("subway") > 0).alias("station"),
    )


def histogram(events: DataFrame, column: str, unknown: str = "unresolved") -> DataFrame:
    return events.groupBy(F.coalesce(column, F.lit(unknown)).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def save(built: DataFrame, path: str) -> None:
    """Listings by day and source, and the dead letters."""
    listings(built).write.mode("overwrite").partitionBy("date_local").parquet(f"{path}/events")
    rejects(built).write.mode("overwrite").partitionBy("source").parquet(f"{path}/rejected")


#: Short keys of the events extract, and of sources. Fixed values.
KEYS = {
    "i": "id", "t": "title", "s": "start_local", "d": "date_local", "b": "time_band", "v": "venue_id", "vn": "venue_name", "h": "neighborhood", "hn": "neighborhood_name", "bo": "borough", "c": "category", "sc": "subcategory", "u": "url",
    "e": "end_local", "de": "description", "im": "image", "la": "lat", "lo": "lon", "src": "source",
}
SOURCE_KEYS = {"ticketmaster": "tm", "permits": "pe", "parks": "pk", "squarespace": "sq", "luma": "lu"}


def with_station(rows: DataFrame, near: Column, stations: DataFrame | None = None) -> DataFrame:
    """rows with sw, the nearest station as (i, n, r, m), null where none is near. near: (meters, id); stations: id, name, routes."""
    asked = rows.withColumn("_near", near)
    if stations is None:
        return asked.withColumn("sw", F.when(F.col("_near").isNotNull(), F.struct(F.col("_near.id").alias("i"), F.col("_near.meters").alias("m")))).drop("_near")
    known = stations.select(F.col("id").alias("_sid"), F.struct(F.col("name").alias("n"), F.col("routes").alias("r")).alias("_s"))
    joined = asked.join(known, F.col("_near.id") == F.col("_sid"), "left")
    sw = F.struct(F.col("_near.id").alias("i"), F.col("_s.n").alias("n"), F.col("_s.r").alias("r"), F.col("_near.meters").alias("m"))
    return joined.withColumn("sw", F.when(F.col("_near").isNotNull(), sw)).drop("_near", "_sid", "_s")


def extract(events: DataFrame, stations: DataFrame | None = None) -> DataFrame:
    """Short keys and the nearest station alone, as JSON lines for serving; what is not stated is left out."""
    source = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_KEYS.items() for x in kv]), F.col("source")), F.col("source"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    made = {"source": source, "start_local": stamp("start_local"), "end_local": stamp("end_local")}
    known = with_station(events, F.get("subway", F.lit(0)), stations)
    return known.select(F.to_json(F.struct(*[made.get(c, F.col(c)).alias(k) for k, c in KEYS.items()], "sw")).alias("value"))
