"""Saved web pages: links, markup events, capability signals, sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townsheet.functions.text import address, registrable_host, unescape_named
from townsheet.sources.signals import LD_JSON

HREF = r'(?i)href=["\']([^"\'#]+)["\']'


def links(pages: DataFrame, key: str, prefix: str = "/") -> DataFrame:
    """Distinct links of the page's own host under a prefix, in document order: key, pos, link."""
    page = pages.select(key, "url", F.posexplode_outer(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("at", "raw")).where("raw is not null")
    origin = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    href = unescape_named(F.col("raw"))
    full = F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(origin, href))
    own = page.withColumn("link", full).where((registrable_host(F.col("link")) == registrable_host(F.col("url"))) & F.coalesce(F.parse_url("link", F.lit("PATH")), F.lit("")).startswith(prefix))
    return own.groupBy(key, "link").agg(F.min("at").alias("pos"))


def segments(pages: DataFrame, key: str, eventish: str = "event|calendar|show|program|whats-on") -> DataFrame:
    """First path segments by distinct links, event-like ones flagged."""
    found = links(pages, key).withColumn("segment", F.regexp_extract(F.parse_url("link", F.lit("PATH")), "^/([^/]+)", 1)).where("segment <> ''")
    return found.groupBy("segment").agg(F.count_distinct("link").alias("n"), F.max(F.col("segment").rlike(f"(?i){eventish}")).alias("eventish"))


#: Levels of nesting that are walked; JSON as deep as that is not read at all by the parser.
DEPTH = 1000

WALK = f"""WITH RECURSIVE walk(k, path, v) MAX RECURSION LEVEL {DEPTH} AS (
  SELECT k, path, v FROM {{blocks}}
  UNION ALL
  SELECT w.k, concat(w.path, array(e.pos)), e.value FROM walk w, LATERAL variant_explode(w.v) e
  WHERE schema_of_variant(e.value) LIKE 'OBJECT%' OR schema_of_variant(e.value) LIKE 'ARRAY%'
) SELECT k, path, v FROM walk"""


def nested(blocks: DataFrame) -> DataFrame:
    """k, path and v of every object and array within blocks (k, path, v), themselves included.

    A recursive query: each step opens the containers of the step before, so there are as many steps as
    levels, whatever the number of pages. Its limit on rows, which is a session's setting, is lifted.
    """
    spark = blocks.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(WALK, blocks=blocks)


def markup_events(pages: DataFrame, key: str) -> DataFrame:
    """Every event of each page's markup, at any depth: objects with a type that ends in Event, and a startDate.

    Only pages with such markup are parsed, once each. Of events with one title, start and link, a page's
    first one stays. A block that is no JSON, or repeats a key within an object, gives nothing.
    """
    some = pages.where(F.col("html").contains("ld+json")).select(F.col(key).alias("k"), F.posexplode(F.regexp_extract_all("html", F.lit(LD_JSON), F.lit(1))).alias("at", "raw"))
    blocks = some.where(F.col("raw").contains("startDate")).select("k", F.array("at").alias("path"), F.try_parse_json("raw").alias("v")).where("v is not null")
    kinds = F.coalesce(F.try_variant_get("v", "$['@type']", "array<string>"), F.array(F.try_variant_get("v", "$['@type']", "string")))
    isone = F.try_variant_get("v", "$.startDate", "string").isNotNull() & F.exists(kinds, lambda t: F.coalesce(t.endswith("Event"), F.lit(False)))
    found = nested(blocks).where(isone).select(F.col("k").alias(key), "path", "v")
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    one = lambda path, kind="string": F.coalesce(get(f"$.location.{path}", kind), get(f"$.location[0].{path}", kind))
    types = F.coalesce(get("$['@type']", "array<string>"), F.array(get("$['@type']")))
    postal = [one(f"address.{c}") for c in ("streetAddress", "addressLocality", "addressRegion", "postalCode")]
    plain = one("address")  # an object comes back as its JSON
    named = found.select(
        key, "path", F.filter(types, lambda t: F.coalesce(t.rlike("Event$"), F.lit(False))).alias("types"), get("$.startDate").alias("start"), get("$.endDate").alias("end"), get("$.name").alias("title"), get("$.url").alias("url"), get("$.eventStatus").alias("status"), get("$.description").alias("description"),
        F.coalesce(one("name"), F.when(~get("$.location").startswith("{") & ~get("$.location").startswith("["), get("$.location"))).alias("venue"), F.coalesce(address(*postal), F.when(~plain.startswith("{"), F.nullif(plain, F.lit("")))).alias("address"), one("address.addressLocality").alias("locality"),
        one("geo.latitude", "double").alias("lat"), one("geo.longitude", "double").alias("lon"), F.coalesce(get("$.organizer.name"), get("$.organizer[0].name")).alias("organizer"),
        F.coalesce(get("$.image.url"), get("$.image[0].url"), get("$.image[0]"), get("$.image")).alias("image"), F.coalesce(get("$.offers.price", "double"), get("$.offers[0].price", "double")).alias("price"),
    )
    most = F.coalesce(F.get(F.filter("types", lambda t: t != "Event"), F.lit(0)), F.get("types", F.lit(0)))
    rows = named.withColumn("type", most).drop("types")
    same = [key, "title", "start", "url"]
    return rows.groupBy(*same).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in [*same, "path"]]), "path").alias("r")).select(*same, "r.*")


def sitemap(bodies: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, pos, loc, lastmod) of each url block; lastmod is null where the block has none."""
    block = bodies.select(key, F.posexplode_outer(F.regexp_extract_all(body, F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))).alias("pos", "b")).where("b is not null")
    one = lambda tag: F.nullif(F.trim(F.regexp_extract("b", rf"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    return block.select(key, "pos", unescape_named(one("loc")).alias("loc"), one("lastmod").alias("lastmod"))


def city_listing(url: Column, slugs: list[str]) -> Column:
    """The first city whose whole listing suffix the link has."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for s in slugs:
        out = out.when(F.regexp_replace(F.lower(url), "/+$", "").endswith(f"-{s}-tickets"), s)
    return out


def listing_and_detail(found: DataFrame, key: str, eventish: str) -> DataFrame:
    """The shallowest, shortest event-like link as listing, the shortest deeper one as detail."""
    path = F.regexp_replace(F.parse_url("link", F.lit("PATH")), "/+$", "")
    some = found.withColumn("depth", F.size(F.split(path, "/")) - 1).where(path.rlike(f"(?i){eventish}"))
    top = some.groupBy(key).agg(F.min(F.struct("depth", F.length("link").alias("len"), F.col("link").alias("listing"))).alias("top"))
    deep = some.join(top, key).where(F.col("depth") > F.col("top.depth")).groupBy(key).agg(F.min(F.struct(F.length("link").alias("len"), F.col("link").alias("detail"))).alias("d"))
    return top.join(deep, key, "left").select(key, "top.listing", "d.detail")


#: Hosts that are no site of a place's own. Fixed values.
SOCIAL = ("facebook.com", "instagram.com", "twitter.com", "x.com", "linktr.ee", "yelp.com", "youtube.com", "tiktok.com")


def website_candidates(places: DataFrame, order: str, website: str = "website") -> DataFrame:
    """host, url and the first place (by order) of each own website; a missing scheme is https."""
    raw = F.trim(F.col(website))
    url = F.when(raw.rlike("(?i)^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    rows = places.where(raw != "").select(F.col(order), url.alias("url")).withColumn("host", registrable_host(F.col("url"))).where(F.col("host").isNotNull() & ~F.col("host").isin(*SOCIAL))
    return rows.groupBy("host").agg(F.min_by("url", order).alias("url"), F.min(order).alias(order))


def blocked(status: Column, error: Column) -> Column:
    """Whether a site refused to be read, as opposed to having nothing to read."""
    return F.coalesce(status.isin(401, 403), F.lit(False)) | F.coalesce(F.lower(error).contains("robots"), F.lit(False))


def candidates(capabilities: DataFrame, signal: Column) -> DataFrame:
    """Readable sites that were not refused and show a signal."""
    return capabilities.where(F.col("readable") & ~F.col("blocked") & signal)


def redetected(fresh: DataFrame, before: DataFrame, key: str, network_only: list[str]) -> DataFrame:
    """Signals read again from saved pages, with those that only the network tells carried over."""
    return fresh.join(before.select(key, *network_only), key, "left")
