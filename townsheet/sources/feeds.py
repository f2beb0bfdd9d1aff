"""Raw feeds: schemas, scans of saved snapshots, and one transform per source into common rows.

``scan`` reads saved JSON snapshots ({source, fetched_at, rows}) and gives each row its order
(source_id, row_pos). Transforms take the rows of one feed and return ``COMMON`` columns; a row that
cannot be listed carries ``reject``, so listings and dead letters come from one plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from townsheet.functions import rules, text, times
from townsheet.operators.store import saved

SCHEMAS = {
    "parks": "title string, description string, startdate string, starttime string, enddate string, endtime string, location string, parknames string, coordinates string, categories string, link struct<url:string>, image struct<url:string>",
    "permits": "event_id string, event_name string, event_type string, event_borough string, event_location string, start_date_time string, end_date_time string, event_agency string",
    "squarespace": "venue_host string, venue_name string, origin string, collection_url string, id string, title string, startDate bigint, endDate bigint, fullUrl string, excerpt string, assetUrl string, location struct<mapLat:double,mapLng:double>, tags array<string>, categories array<string>",
    "ticketmaster": "id string, name string, url string, dates struct<start:struct<localDate:string,localTime:string,dateTBA:boolean,dateTBD:boolean,noSpecificTime:boolean>,status:struct<code:string>>, _embedded struct<venues:array<struct<name:string,location:struct<latitude:string,longitude:string>>>>, classifications array<struct<segment:struct<name:string>,genre:struct<name:string>,subGenre:struct<name:string>>>, priceRanges array<struct<min:double>>, images array<struct<url:string,width:int,ratio:string,fallback:boolean>>",
    "luma": "calendar_id string, calendar_name string, uid string, summary string, description string, location string, organizer string, status string, lat double, lon double, all_day boolean, start string, end string",
    "dice": "url string, city_slug string, name string, type string, startDate string, endDate string, eventStatus string, description string, venue_name string, venue_address string, lat double, lon double, organizer string, image string",
    "library": "id string, title string, start string, end string, body string, path string, virtual boolean, hybrid boolean, offsite boolean, location string, branches array<string>, kind string, audience array<string>, tags array<string>, address string",
    "wordpress": "venue_host string, venue_name string, lat double, lon double, borough string, feed string, id string, title string, url string, start string, end string, all_day boolean, status string, cost string, description string, categories array<string>, tags array<string>, venue_address string, venue_lat string, venue_lon string",
    "jsonld": "venue_host string, venue_name string, address string, borough string, title string, type string, url string, start string, end string, status string, description string, price_min double, is_free boolean, image string, lat double, lon double",
}

#: Where an event stands in its own right (touring hosts, feeds with coordinates) it has own_lat, own_lon.
COMMON = "source_id string, row_pos bigint, title string, start timestamp_ntz, end timestamp_ntz, venue_name string, venue_kind string, lat double, lon double, own_lat double, own_lon double, place_name string, borough string, category string, subcategory string, category_source string, flags array<string>, price_min double, is_free boolean, url string, description string, image string, needs_area boolean, reject string"


def scan(spark: SparkSession, path: str, source_id: str, schema: str) -> DataFrame:
    """Rows of one feed's saved snapshot, in order."""
    whole = spark.read.schema(f"source struct<id:string>, fetched_at string, rows array<struct<{_inner(schema)}>>").json(path, multiLine=True)
    return whole.select(F.lit(source_id).alias("source_id"), "fetched_at", F.posexplode("rows").alias("row_pos", "r")).select("source_id", "fetched_at", "row_pos", "r.*")


#: Most blocks of files whose places are sent to every task.
SENT_BLOCKS = 100_000


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """row_pos and value of every line that is not blank, in the order of file names and lines.

    Files may be split anywhere. One pass counts the lines of each block of a file; the sums of the blocks
    before it, in order, say where a block's lines begin; the second pass adds a line's place in its block.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m")).where(F.trim("value") != "")
    blocks = saved(lines.groupBy("_f", "_b").agg(F.count("*").alias("n"), F.min("_m").alias("_first")), "blocks")
    before = F.coalesce(F.sum("n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # within a block ids grow line by line, from wherever it begins in this very pass; gaps are blank lines
    places = blocks.select("_f", "_b", before.alias("_before"))
    places = F.broadcast(places) if blocks.count() <= SENT_BLOCKS else places
    rank = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_m")) - 1
    return lines.withColumn("_at", rank).join(places, ["_f", "_b"]).select((F.col("_before") + F.col("_at")).alias("row_pos"), "value")


def scan_folder(spark: SparkSession, folder: str, schemas: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Feeds saved as one record a line, a folder for each source: rows by source, and malformed lines.

    Rows carry (source_id, row_pos), a malformed line keeps its place and goes to the second table
    (source_id, row_pos, value). Folders that no schema names are not read.
    """
    rows, bad = {}, []
    for source, schema in sorted(schemas.items()):
        lines = placed_lines(spark, f"{folder}/{source}")
        parsed = lines.select(F.lit(source).alias("source_id"), "row_pos", "value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
        fails = F.col("r").isNull() | F.col("r._bad").isNotNull()
        rows[source] = parsed.where(~fails).select("source_id", "row_pos", "r.*").drop("_bad")
        bad.append(parsed.where(fails).select("source_id", "row_pos", "value"))
    return rows, union(bad)


def _inner(schema: str) -> str:
    depth, out, at = 0, [], 0
    for i, ch in enumerate(schema + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = schema[at:i].strip().split(" ", 1)
            out.append(f"`{name}`:{kind}")
            at = i + 1
    return ",".join(out)


def registry(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Enabled sources of a registry, or of a folder of registries parted by keys; a source that does not say so is not enabled."""
    schema = "sources array<struct<id:string,tier:int,adapter:string,enabled:boolean,min_expected:int,horizon_days:int,where_field:string>>"
    schema += "".join(f", `{k}` string" for k in keys)
    return spark.read.schema(schema).json(path, multiLine=True).select(*keys, F.explode("sources").alias("s")).select(*keys, "s.*").where("enabled")


CITY = "slug string, name string, short string, tz string, bbox array<double>, boroughs array<string>"


def city(spark: SparkSession, path: str) -> DataFrame:
    """A city's configuration as a row, its box as west, south, east and north."""
    box = [F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(("west", "south", "east", "north"))]
    return spark.read.schema(CITY).json(path, multiLine=True).select("slug", "name", "short", "tz", *box, "boroughs")


def within_horizon(start: Column, as_of: Column, days: Column) -> Column:
    """From a day before as_of to the source's horizon, both ends out."""
    day = F.make_interval(days=F.lit(1))
    return (start > as_of - day) & (start < as_of + F.make_interval(days=days))


def first_reject(*pairs: tuple[Column, Column | str]) -> Column:
    """The reason of the first condition that holds."""
    out = reduce(lambda acc, p: acc.when(*p), pairs[1:], F.when(*pairs[0]))
    return out


def _common(df: DataFrame, **columns: Column) -> DataFrame:
    parts = [c.strip().split(" ", 1) for c in COMMON.split(", ")]
    null = lambda kind: F.lit(None).cast(kind)
    given = columns | {"source_id": F.col("source_id"), "row_pos": F.col("row_pos")}
    return df.select(*[given.get(n, F.lit(False) if n == "needs_area" else null(k)).cast(k).alias(n) for n, k in parts])


def _classed(found: Column) -> dict[str, Column]:
    return {"category": found["category"], "subcategory": found["subcategory"], "category_source": found["source"]}


def parks(df: DataFrame, zone: str) -> DataFrame:
    title = text.clean(F.col("title"))
    start = times.combine(times.parse_naive(F.col("startdate")), times.parse_naive(F.col("starttime")))
    end = times.combine(times.parse_naive(F.col("enddate")), times.parse_naive(F.col("endtime")))
    at = F.split("coordinates", ",")
    pair = (F.size(at) == 2) & F.get(at, F.lit(0)).try_cast("double").isNotNull() & F.get(at, F.lit(1)).try_cast("double").isNotNull()
    name = F.coalesce(F.nullif("location", F.lit("")), F.nullif("parknames", F.lit("")))
    found = F.coalesce(rules.from_parks(F.col("categories")), rules.from_title(title), rules.fixed("outdoors/park-programming", "default:parks"))
    df = df.withColumns({"_found": found, "_bad": rules.rejected_title(title)})  # once in the plan
    found = F.col("_found")
    reject = first_reject((F.col("_bad").isNotNull(), F.col("_bad")), (start.isNull(), F.lit("unparseable start time")), (name.isNull(), F.lit("no location named")))
    return _common(
        df, title=title, start=start, end=times.repaired_end(start, end), venue_name=text.clean(name), venue_kind=F.lit("park"),
        lat=F.when(pair, F.get(at, F.lit(0)).try_cast("double")), lon=F.when(pair, F.get(at, F.lit(1)).try_cast("double")), flags=rules.park_flags(F.col("categories")),
        url=text.https_link(F.col("link.url")), description=F.col("description"), image=text.host_image(F.col("image.url"), "nycgovparks.org"), reject=reject, **_classed(found),
    )


def permits(df: DataFrame, zone: str) -> DataFrame:
    title, kind = text.clean(F.col("event_name")), F.col("event_type")
    start, end = times.parse_naive(F.col("start_date_time")), times.parse_naive(F.col("end_date_time"))
    by_title = rules.from_title(title)
    special = F.when(F.lower(F.trim(kind)) == "special event", rules.renamed(by_title, "permit+title"))
    found = F.coalesce(special, rules.from_permit(kind), by_title)
    df = df.withColumns({"_found": found, "_bad": rules.rejected_title(title)})  # once in the plan
    found = F.col("_found")
    place = F.nullif(F.trim(F.substring_index(F.coalesce("event_location", F.lit("")), ":", 1)), F.lit(""))
    reject = first_reject(
        (F.col("_bad").isNotNull(), F.col("_bad")), (rules.rejected_permit(kind).isNotNull(), rules.rejected_permit(kind)),
        (start.isNull(), F.lit("unparseable start time")), (found.isNull(), F.concat(F.lit("unclassified event_type: "), F.coalesce(kind, F.lit("None")))),
    )
    return _common(df, title=title, start=start, end=times.repaired_end(start, end), venue_name=text.clean(F.coalesce(place, F.lit("Unknown location"))), venue_kind=F.lit("venue"), borough=F.col("event_borough"), reject=reject, **_classed(found))


def squarespace(df: DataFrame, zone: str) -> DataFrame:
    title = text.clean(F.col("title"))
    start, end = times.local_from_millis(F.col("startDate"), zone), times.local_from_millis(F.col("endDate"), zone)
    words = F.concat(F.coalesce("categories", F.array().cast("array<string>")), F.coalesce("tags", F.array().cast("array<string>")))
    found = F.coalesce(rules.title_over(words, "squarespace:tags"), rules.from_title(title))
    df = df.withColumns({"_found": found, "_bad": rules.rejected_title(title)})  # once in the plan
    found = F.col("_found")
    reject = first_reject((F.col("_bad").isNotNull(), F.col("_bad")), (start.isNull(), F.lit("unparseable start time")), (found.isNull(), F.lit("unclassified squarespace event")))
    return _common(
        df, title=title, start=start, end=times.dropped_end(start, end), venue_name=text.clean(F.coalesce(F.nullif("venue_name", F.lit("")), "venue_host")), venue_kind=F.lit("venue"), lat=F.col("location.mapLat"), lon=F.col("location.mapLng"),
        url=text.joined_url(F.col("origin"), F.col("fullUrl")), description=text.strip_tags(F.col("excerpt")), image=F.col("assetUrl"), reject=reject, **_classed(found),
    )


def ticketmaster(df: DataFrame, zone: str) -> DataFrame:
    """Rows of a title and day with over two slots collapse to the first, before other rejects."""
    from townsheet.operators.dedup import collapsed

    df = df.withColumn("_title", text.clean(F.col("name"))).withColumn("_bad", rules.rejected_title(F.col("_title")))
    df = df.withColumn("_day", F.col("dates.start.localDate"))
    kept = collapsed(df, ["_title", "_day"], ["row_pos"])
    title, at = F.col("_title"), F.get(F.col("_embedded.venues"), F.lit(0))
    s = F.col("dates.start")
    start = times.parse_naive(F.concat_ws(" ", s["localDate"], F.coalesce(F.nullif(s["localTime"], F.lit("")), F.lit("00:00:00"))))
    lat, lon = at["location"]["latitude"].try_cast("double"), at["location"]["longitude"].try_cast("double")
    status = F.lower(F.col("dates.status.code"))
    venue = text.clean(F.coalesce(F.nullif(at["name"], F.lit("")), F.lit("Unknown venue")))
    found = F.coalesce(rules.from_genres(F.col("classifications")), rules.from_title(title), rules.from_venue(venue))
    kept = kept.withColumn("_found", found)
    found = F.col("_found")
    price = text.least_price(F.transform("priceRanges", lambda p: p["min"]))
    unset = F.coalesce(s["dateTBA"], F.lit(False)) | F.coalesce(s["dateTBD"], F.lit(False)) | F.coalesce(s["noSpecificTime"], F.lit(False))
    reject = first_reject(
        (F.col("_bad").isNotNull(), F.col("_bad")), (F.col("collapsed"), F.lit("collapsed")), (unset, F.lit("date TBA/TBD")), (status.isin("cancelled", "canceled", "postponed"), F.concat(F.lit("status: "), status)),
        (start.isNull(), F.lit("unparseable start time")), (lat.isNull() | lon.isNull(), F.lit("venue has no coordinates")), (found.isNull(), F.lit("unclassified ticketmaster event")),
    )
    return _common(kept, title=title, start=start, venue_name=venue, venue_kind=F.lit("venue"), lat=lat, lon=lon, price_min=price, is_free=price == 0, url=F.col("url"), image=text.best_image(F.col("images")), needs_area=F.lit(True), reject=reject, **_classed(found))


def luma(df: DataFrame, zone: str) -> DataFrame:
    title = text.clean(F.col("summary"))
    start, end = times.local_from_iso(F.col("start"), zone), times.local_from_iso(F.col("end"), zone)
    found = F.coalesce(rules.from_title(title), rules.renamed(rules.from_title(F.col("calendar_name")), "luma:calendar-name"))
    df = df.withColumns({"_found": found, "_bad": rules.rejected_title(title)})  # once in the plan
    found = F.col("_found")
    link = F.nullif(F.regexp_extract(F.coalesce("description", F.lit("")), r"https://(?:luma\.com|lu\.ma)/[A-Za-z0-9_-]+", 0), F.lit(""))
    reject = first_reject(
        (F.col("_bad").isNotNull(), F.col("_bad")), (F.upper("status") == "CANCELLED", F.lit("status: cancelled")), (start.isNull(), F.lit("unparseable start time")),
        (F.col("lat").isNull() | F.col("lon").isNull(), F.lit("no coordinates, cannot place")), (found.isNull(), F.lit("unclassified luma event")),
    )
    name = F.coalesce(F.nullif("organizer", F.lit("")), F.nullif("calendar_name", F.lit("")), F.lit("Luma"))
    return _common(df, title=title, start=start, end=end, venue_name=text.clean(name), venue_kind=F.lit("organizer"), lat=F.col("lat"), lon=F.col("lon"), own_lat=F.col("lat"), own_lon=F.col("lon"), url=F.coalesce(link, F.when(F.col("location").startswith("http"), F.col("location"))), description=F.col("description"), needs_area=F.lit(True), reject=reject, **_classed(found))


def _status(c: Column) -> Column:
    return F.lower(F.element_at(F.split(c, "/"), -1))


def _marked_up(df: DataFrame, zone: str, title: Column, start: Column, end: Column, venue: Column, status: Column, missing: Column, source: str, **more: Column) -> DataFrame:
    """What both schema.org sources share: status, type, then title, then venue."""
    found = F.coalesce(rules.from_schema(F.col("type")), rules.from_schema_default(F.col("type")), rules.from_title(title), rules.from_venue(venue))
    df = df.withColumns({"_found": found, "_bad": rules.rejected_title(title)})  # once in the plan
    found = F.col("_found")
    reject = first_reject(
        (F.col("_bad").isNotNull(), F.col("_bad")), (_status(status).isin("eventcancelled", "eventpostponed"), F.concat(F.lit("status: "), _status(status))),
        (start.isNull(), F.lit("unparseable start time")), (missing, F.lit("no coordinates, cannot place")), (found.isNull(), F.lit(f"unclassified {source} event")),
    )
    return _common(df, title=title, start=start, end=end, venue_name=venue, venue_kind=F.lit("venue"), url=F.col("url"), image=F.col("image"), lat=F.col("lat"), lon=F.col("lon"), needs_area=F.lit(True), reject=reject, **_classed(found), **more)


def dice(df: DataFrame, zone: str) -> DataFrame:
    start, end = times.local_from_iso(F.col("startDate"), zone), times.local_from_iso(F.col("endDate"), zone)
    venue = F.coalesce(F.nullif(text.clean(F.col("venue_name")), F.lit("")), F.lit("DICE"))
    missing = F.col("lat").isNull() | F.col("lon").isNull()
    return _marked_up(df, zone, text.clean(F.col("name")), start, end, venue, F.col("eventStatus"), missing, "dice", description=text.first_line(F.col("description")))


def jsonld(df: DataFrame, zone: str) -> DataFrame:
    start, end = times.local_from_iso(F.col("start"), zone), times.local_from_iso(F.col("end"), zone)
    venue = F.coalesce(F.nullif(text.clean(F.col("venue_name")), F.lit("")), F.col("venue_host"))
    return _marked_up(df, zone, text.clean(F.col("title")), start, end, venue, F.col("status"), F.lit(False), "jsonld", description=F.col("description"), price_min=F.col("price_min"), is_free=F.col("is_free"), borough=F.col("borough"), place_name=F.when(F.col("lat").isNull(), F.col("address")))


def library(df: DataFrame, zone: str) -> DataFrame:
    """The offset that this source stamps on local times is dropped, not applied."""
    title = text.clean(F.col("title"))
    start, end = (times.parse_naive(F.replace(F.col(c), F.lit("+00:00"), F.lit(""))) for c in ("start", "end"))
    where = F.coalesce(F.nullif("location", F.lit("")), F.get("branches", F.lit(0)))
    kind = F.trim(F.coalesce("kind", F.lit("")))
    found = F.coalesce(rules.title_over(F.col("tags"), "bpl:tags"), rules.from_title(title), rules.fixed("learning/class", "default:bpl"))
    df = df.withColumns({"_found": found, "_bad": rules.rejected_title(title)})  # once in the plan
    found = F.col("_found")
    service = rules.rejected_library(title, F.col("tags"))
    reject = first_reject(
        (F.col("_bad").isNotNull(), F.col("_bad")), (~kind.isin("", "Program"), F.concat(F.lit("internal record: "), kind)), (service.isNotNull(), service),
        (F.coalesce("virtual", F.lit(False)) & ~F.coalesce("hybrid", F.lit(False)), F.lit("virtual only, has no place")), (start.isNull(), F.lit("unparseable start time")), (where.isNull(), F.lit("no branch named")),
    )
    flags = F.transform(F.filter(F.coalesce("audience", F.array().cast("array<string>")), lambda a: a.isNotNull() & (a != "")), text.event_slug)
    url = F.when(F.col("path") != "", F.concat(F.lit("https://www.bklynlibrary.org"), F.col("path")))
    return _common(df, title=title, start=start, end=end, venue_name=text.clean(F.substring_index(where, ",", 1)), venue_kind=F.lit("library"), borough=F.lit("Brooklyn"), place_name=F.col("address"), flags=flags, url=url, description=text.strip_tags(F.col("body")), reject=reject, **_classed(found))


def wordpress(df: DataFrame, zone: str) -> DataFrame:
    title = text.clean(F.col("title"))
    start, end = (F.coalesce(F.when(~F.col(c).rlike(r"T.*(Z|[+-]\d{2}:?\d{2})$"), times.parse_naive(F.col(c))), times.local_from_iso(F.col(c), zone)) for c in ("start", "end"))
    own = [F.col(c).try_cast("double") for c in ("venue_lat", "venue_lon")]
    both = own[0].isNotNull() & own[1].isNotNull()
    words = F.concat(F.coalesce("categories", F.array().cast("array<string>")), F.coalesce("tags", F.array().cast("array<string>")))
    venue = text.clean(F.coalesce(F.nullif("venue_name", F.lit("")), "venue_host"))

    def term(w: Column) -> Column:
        return F.coalesce(rules.from_term(w, "wordpress:term:"), rules.renamed(rules.from_title(w), "wordpress:terms"))

    found = F.coalesce(rules.first_of(F.transform(words, term)), rules.from_title(title), rules.from_venue(venue))
    df = df.withColumns({"_found": found, "_bad": rules.rejected_title(title)})  # once in the plan
    found = F.col("_found")
    status = F.lower(F.coalesce("status", F.lit("")))
    reject = first_reject(
        (F.col("_bad").isNotNull(), F.col("_bad")), (~status.isin("", "publish", "confirmed"), F.concat(F.lit("status: "), F.col("status"))), (start.isNull(), F.lit("unparseable start time")),
        (F.coalesce(venue, F.lit("")) == "", F.lit("no venue could be resolved")), (found.isNull(), F.lit("unclassified wordpress event")),
    )
    return _common(df, title=title, start=start, end=end, venue_name=venue, venue_kind=F.lit("venue"), lat=F.col("lat"), lon=F.col("lon"), own_lat=F.when(both, own[0]), own_lon=F.when(both, own[1]), borough=F.col("borough"), is_free=text.stated_free(F.col("cost")), url=F.col("url"), description=text.strip_tags(F.col("description")), needs_area=F.lit(True), reject=reject, **_classed(found))


TRANSFORMS = {"parks": parks, "permits": permits, "squarespace": squarespace, "ticketmaster": ticketmaster, "luma": luma, "dice": dice, "jsonld": jsonld, "library": library, "wordpress": wordpress}


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
