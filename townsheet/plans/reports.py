"""Reports over capability records, probes, sweeps and registries, as (metric, n, share) rows or rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metrics(rows: DataFrame, counts: dict[str, Column], of: Column) -> DataFrame:
    """One row a metric: how many rows it holds for, and their share of ``of`` in percent, one decimal."""
    sums = rows.agg(F.count_if(of).alias("_of"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("n")) for n in counts])
    share = F.bround(F.col("m.n") * 100.0 / F.greatest(F.col("_of"), F.lit(1)), 1)
    return sums.select("_of", F.explode(pairs).alias("m")).select("m.metric", "m.n", share.cast("double").alias("share"))


def reachability(sites: DataFrame) -> DataFrame:
    """sites: status, error, readable, blocked."""
    status, robots = F.col("status"), F.coalesce(F.col("error") == "robots-denied", F.lit(False))
    return metrics(sites, {
        "readable": F.col("readable") & ~F.col("blocked"), "blocked": F.col("blocked"), "dead": status.isNull() & ~robots, "other": status.isNotNull() & ~status.isin(200, 401, 403),
    }, F.lit(True))


def _some(c: str) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def capability_rates(sites: DataFrame) -> DataFrame:
    """The eleven rates among readable sites. sites: the columns of ``signals.site_signals``, post_types and
    node_types (arrays), tribe and squarespace_json (booleans), listing_url, readable, blocked."""
    reached = F.col("readable") & ~F.col("blocked")
    rates = {
        "jsonld_event": F.col("jsonld_event"), "ics": _some("ics"), "rss": _some("rss"), "wp": F.col("wp"), "post_types": _some("post_types"), "tribe": F.col("tribe"), "node_types": _some("node_types"), "squarespace_json": F.col("squarespace_json"),
        "any_jsonld": _some("jsonld_home") | _some("jsonld_detail"), "client_rendered": F.col("client_rendered"), "no_listing": F.col("listing_url").isNull(),
    }
    return metrics(sites, {n: reached & c for n, c in rates.items()}, reached)


def named_counts(sites: DataFrame, *columns: str) -> DataFrame:
    """How many readable sites name each value of array columns, commonest first."""
    rows = sites.where("readable and not blocked").select(F.explode(F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in columns]))).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")


def any_adapter(sites: DataFrame) -> DataFrame:
    """Sites that some general adapter can read, of all probed."""
    some = F.col("jsonld_event") | _some("ics") | F.col("tribe") | F.col("squarespace_json") | _some("platforms") | _some("post_types") | _some("node_types")
    return metrics(sites, {"any_adapter": F.col("readable") & ~F.col("blocked") & some}, F.lit(True))


def probe_report(probed: DataFrame) -> DataFrame:
    """probed: hit (the address that answered, or null), live. Rates of all probed."""
    hit = F.col("hit").isNotNull()
    return metrics(probed, {"hit": hit, "live": hit & F.col("live"), "stale": hit & ~F.col("live")}, F.lit(True))


def hit_shapes(probed: DataFrame) -> DataFrame:
    """Which guess found the calendar."""
    hit = F.col("hit")
    shape = F.when(hit.contains("/events/?ical"), "/events/?ical=1").when(hit.contains("post_type"), "?post_type=tribe_events").otherwise("listing?ical=1")
    return probed.where(hit.isNotNull()).groupBy(shape.alias("shape")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "shape")


def top_feeds(probed: DataFrame, limit: int = 20) -> DataFrame:
    """Live feeds by upcoming events."""
    return probed.where("hit is not null and live").orderBy(F.desc("future"), "name").limit(limit)


def sweep_report(sites: DataFrame) -> DataFrame:
    """sites: wp_types, drupal_types (arrays), open array<struct<total,dated>>: a type is registered, an endpoint answers, dates are in the payload."""
    feeds = F.exists("open", lambda o: o["dated"])
    grades = metrics(sites, {"registered": _some("wp_types") | _some("drupal_types"), "answering": _some("open"), "dated": feeds}, F.lit(True))
    total = F.aggregate(F.col("open"), F.lit(0).cast("long"), lambda n, o: n + F.coalesce(o["total"].try_cast("long"), F.lit(0)))
    rows = sites.agg(F.coalesce(F.sum(F.size("open")), F.lit(0)).alias("endpoints"), F.coalesce(F.sum(total), F.lit(0)).alias("rows"))
    more = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("n")) for c in ("endpoints", "rows")])).alias("m"))
    return grades.unionByName(more.select("m.metric", "m.n", F.lit(None).cast("double").alias("share")))


def collection_report(venues: DataFrame) -> DataFrame:
    """venues: collections array<struct<url,upcoming>>: with a collection, live, and events to be had."""
    n = F.aggregate(F.col("collections"), F.lit(0).cast("long"), lambda a, c: a + c["upcoming"])
    rates = metrics(venues, {"with_collection": _some("collections"), "live": F.coalesce(n, F.lit(0)) > 0}, F.lit(True))
    return rates.unionByName(venues.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).select(F.lit("upcoming").alias("metric"), "n", F.lit(None).cast("double").alias("share")))


def slug_report(events: DataFrame) -> DataFrame:
    """Ticket pages by city, and those without a lastmod, which are read again every run."""
    by = events.groupBy(F.coalesce("city_slug", F.lit("none")).alias("slug")).agg(F.count("*").alias("n"), F.count_if(F.col("lastmod").isNull()).alias("undated"))
    return by.orderBy(F.desc("n"), "slug")


def placed_report(asked: DataFrame, by: str) -> DataFrame:
    """asked: n rows that ride on each location, source that placed it (null: none). Outcomes weighted by rows."""
    total = asked.agg(F.greatest(F.sum("n"), F.lit(1)).alias("total"))
    out = asked.groupBy(F.coalesce(by, F.lit("unplaced")).alias("outcome")).agg(F.count("*").alias("locations"), F.sum("n").alias("n"))
    return out.crossJoin(F.broadcast(total)).select("outcome", "locations", "n", F.bround(F.col("n") * 100.0 / F.col("total"), 1).cast("double").alias("share"))


def ledger(loads: DataFrame, rows: DataFrame) -> DataFrame:
    """Source, ok, rows, error and fetched_at of a run. loads: source, error, fetched_at; rows: source."""
    n = rows.groupBy("source").agg(F.count("*").alias("n"))
    ok = F.col("error").isNull()
    return loads.join(n, "source", "left").select("source", ok.alias("ok"), F.when(ok, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n"), "error", F.when(ok, F.col("fetched_at")).alias("fetched_at"))
