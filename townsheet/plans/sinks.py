"""Tables and extracts that a run leaves behind: a published version of all, or single folders that a write replaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townsheet.operators.store import Store, Table, observed, part_of, saved
from townsheet.plans import events as listings


def publish(store: Store, built: DataFrame, **others: DataFrame) -> int:
    """A run as the store's next version: events by day, rejected by source, venues, meta and what else is given.

    The plan of ``built`` runs once, in the job that writes its rows parted by table; the counters of that
    pass (rows, kept, deduped, collapsed, incomplete, rejected, and fields that events state) are observed
    there and go into the manifest. All tables are then read off those files.
    """
    outcome, kept = F.col("outcome"), F.col("outcome") == "kept"
    stated = {"neighborhood": F.col("neighborhood").isNotNull(), "coordinates": F.col("lat").isNotNull(), "borough": F.col("borough").isNotNull(), "url": F.col("url").isNotNull(), "price": F.col("price_min").isNotNull(), "station": F.size("subway") > 0}
    counts = {n: F.count_if(outcome == n) for n in ("kept", "deduped", "collapsed", "dropped_incomplete")}
    counts |= {"rows": F.count(F.lit(1)), "rejected": F.count_if(part_of(outcome) == "rejected")} | {f"with_{n}": F.count_if(kept & c) for n, c in stated.items()}
    counted, seen = observed(built, **counts)
    rows = saved(counted, "built")
    counters = {k: int(v) for k, v in seen.get.items()}
    events = listings.listings(rows)
    n = F.lit(max(1, counters["kept"]))
    meta = events.sparkSession.createDataFrame([(k, v) for k, v in sorted(counters.items())], "name string, n long").withColumn("share", F.when(F.col("name").startswith("with_"), F.bround(F.col("n") * 100.0 / n, 1)))
    venues = events.groupBy("venue_id").agg(F.min_by(F.struct("venue_name", "venue_kind", "lat", "lon"), F.struct("start_utc", "title", "id")).alias("v"), F.count("*").alias("n")).select("venue_id", "v.*", "n")
    tables = {"events": Table(events, "date_local"), "rejected": Table(listings.rejects(rows), "source"), "outcomes": Table(listings.outcomes(rows)), "venues": Table(venues), "meta": Table(meta)}
    return store.publish(tables | {n: Table(f) for n, f in others.items()}, counters=counters)


def tables(path: str, **frames: DataFrame) -> None:
    """events (by day), venues, rejected (by source), subway, neighborhoods and meta, as many as are given."""
    parts = {"events": ["date_local"], "rejected": ["source"]}
    for name, frame in frames.items():
        frame.write.mode("overwrite").partitionBy(*parts.get(name, [])).parquet(f"{path}/{name}")


def places(rows: DataFrame, path: str) -> None:
    """Places sorted by kind and name over range partitions."""
    rows.repartitionByRange("kind", "name").sortWithinPartitions("kind", "name").write.mode("overwrite").parquet(path)


def review(unplaced: DataFrame, path: str) -> None:
    """Locations that nothing placed, those that most rows ride on first, as CSV with a header."""
    unplaced.orderBy(F.desc("n"), "location").write.mode("overwrite").option("header", True).csv(path)


def ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


#: Short keys of the places extract. Fixed values.
PLACE_KEYS = {
    "i": "id", "t": "name", "k": "kind", "kl": "kind_label", "h": "neighborhood", "hn": "neighborhood_name", "bo": "borough", "c": "category", "u": "website", "im": "image", "la": "lat", "lo": "lon", "oh": "opening_hours",
    "hm": "hours_mask", "nb": "notability", "lb": "listed_by", "wp": "wikipedia", "cr": "image_credit", "cp": "image_page",
}


def place_extract(rows: DataFrame, stations: DataFrame | None = None) -> DataFrame:
    """Places as JSON lines with short keys and the nearest station, with name and routes if stations (id, name, routes) are given.

    What is not stated is left out, but for notability, which is 0, and who lists it, which is the map.
    """
    known = listings.with_station(rows, F.col("subway"), stations)
    stated = {c: F.col(c) if c in known.columns else F.lit(None).cast("string") for c in PLACE_KEYS.values()}
    stated |= {"notability": F.coalesce(stated["notability"].cast("int"), F.lit(0)), "listed_by": F.coalesce(stated["listed_by"], F.lit("osm"))}
    return known.select(F.to_json(F.struct(*[stated[c].alias(k) for k, c in PLACE_KEYS.items()], "sw")).alias("value"))


def line_extract(order: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with their stops in order, and stations as name and routes. order: route, pos, station; stations: id, name, routes."""
    stops = F.transform(F.sort_array(F.collect_list(F.struct("pos", "station"))), lambda s: s["station"])
    lines = order.groupBy("route").agg(stops.alias("s")).select(F.to_json(F.struct(F.col("route").alias("r"), "s")).alias("value"))
    return lines, stations.select(F.to_json(F.struct(F.col("id").alias("i"), F.col("name").alias("n"), F.col("routes").alias("r"))).alias("value"))
