"""Stations and lines from schedules."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Route names folded into their parent. Fixed values.
FOLDED = {"FX": "F", "6X": "6", "7X": "7"}


#: Columns that are read of each file of a schedule. Fixed values.
FILES = {
    "stops": "stop_id string, parent_station string", "routes": "route_id string, route_short_name string, route_long_name string", "trips": "trip_id string, route_id string, direction_id string",
    "stop_times": "trip_id string, stop_id string, stop_sequence int",
}
SOUTH = "1"


def gtfs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The files of a schedule, each with the columns in FILES.

    Columns are found by the header, whatever their order and whatever else a file has; an optional one
    that a file lacks is null, and so are empty fields.
    """
    found = {}
    for name, columns in FILES.items():
        raw = spark.read.csv(f"{path}/{name}.txt", header=True)
        at = {c.strip("\ufeff \"").lower(): c for c in raw.columns}
        kinds = [c.split() for c in columns.split(", ")]
        found[name] = raw.select(*[(F.nullif(F.trim(f"`{at[c]}`"), F.lit("")) if c in at else F.lit(None)).cast(kind).alias(c) for c, kind in kinds])
    return found


def folded(route: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FOLDED.items() for x in kv]), route), route)


def schedule(feed: dict[str, DataFrame]) -> DataFrame:
    """Stop times as ``patterns`` takes them: platforms as their stations, routes folded; trips that are not listed go.

    Ids are unique in their files, as the format has it. A trip without a direction counts as northbound.
    """
    parents = feed["stops"].where("parent_station is not null").select("stop_id", "parent_station")
    trips = feed["trips"].select("trip_id", folded(F.col("route_id")).alias("route"), (F.coalesce("direction_id", F.lit("")) != SOUTH).alias("northbound"))
    rows = feed["stop_times"].join(trips, "trip_id").join(parents, "stop_id", "left")
    return rows.select("route", F.col("trip_id").alias("trip"), F.col("stop_sequence").alias("seq"), F.coalesce("parent_station", "stop_id").alias("stop"), "northbound")


def titles(feed: dict[str, DataFrame]) -> DataFrame:
    """route, bullet and line: short and long name of the first row of each folded route. A file of routes is small."""
    rows = feed["routes"].select(folded(F.col("route_id")).alias("route"), F.struct(F.col("route_short_name").alias("bullet"), F.col("route_long_name").alias("line")).alias("t"), F.monotonically_increasing_id().alias("at"))
    return rows.groupBy("route").agg(F.min_by("t", "at").alias("t")).select("route", "t.*")


def published(feed: dict[str, DataFrame], stations: DataFrame) -> DataFrame:
    """route, bullet, line, station, pos, name: a schedule's lines in riding order, by way of a register's stations.

    The schedule says the order, the register which lines serve a station (it names them by bullet). A
    route without a title goes by its id; a line that no station serves does not come back.
    """
    own = F.col("route")
    named = line_order(patterns(schedule(feed))).join(titles(feed), "route", "left").withColumns({"bullet": F.coalesce("bullet", own), "line": F.coalesce("line", own)})
    lines = named.groupBy("route").agg(F.first("bullet").alias("bullet"), F.first("line").alias("line"))
    return attach(named, stations, "bullet").join(lines, "route").select("route", "bullet", "line", "station", "pos", "name")


def stations(raw: DataFrame) -> DataFrame:
    """Rows with coordinates that parse: routes split, ada where 1 or 2."""
    return raw.select("id", "complex_id", "name", F.split(F.trim("routes"), r"\s+").alias("routes"), "borough", F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"), F.trim("ada").isin("1", "2").alias("ada")).where("lat is not null and lon is not null")


def merged(stations: DataFrame, order: str = "ord") -> DataFrame:
    """Stations of one complex as one: united routes and stops, smallest point, any access, first name."""
    key = F.coalesce(F.col("complex_id").cast("string"), F.col("id").cast("string"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    rows = stations.groupBy(key.alias("complex")).agg(F.min_by("id", order).alias("id"), F.min_by("name", order).alias("name"), union("routes").alias("routes"), F.array_sort(F.collect_set("id")).alias("stops"), F.min(F.struct("lat", "lon")).alias("at"), F.bool_or("ada").alias("ada"))
    return rows.select("complex", "id", "name", "routes", "stops", "at.lat", "at.lon", "ada")


def patterns(stop_times: DataFrame) -> DataFrame:
    """Distinct stopping patterns: route, stops. stop_times: route, trip, seq, stop, northbound.

    A trip's stops are few (one vehicle's run); northbound trips are read backwards.
    """
    trips = stop_times.groupBy(folded(F.col("route")).alias("route"), "trip").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "stop"))), lambda s: s["stop"]).alias("stops"), F.bool_or("northbound").alias("north"))
    return trips.select("route", F.when(F.col("north"), F.reverse("stops")).otherwise(F.col("stops")).alias("stops")).distinct()


def positions(patterns: DataFrame) -> DataFrame:
    """Mean relative position of each stop over its route's patterns."""
    at = patterns.select("route", F.size("stops").alias("n"), F.posexplode("stops").alias("pos", "stop"))
    return at.groupBy("route", "stop").agg(F.avg(F.col("pos") / F.greatest(F.lit(1), F.col("n") - 1)).alias("place"))


def edges(patterns: DataFrame) -> DataFrame:
    """Distinct (route, a, b): stop b follows a in some pattern."""
    keyed = patterns.withColumn("p", F.xxhash64("route", "stops")).select("route", "p", F.posexplode("stops").alias("pos", "a"))
    follow = keyed.withColumn("b", F.lead("a").over(Window.partitionBy("route", "p").orderBy("pos")))
    return follow.where("b is not null").select("route", "a", "b").distinct()


def running_order(place: dict[str, float], edges: list[tuple[str, str]]) -> tuple[list[str], int]:
    """Stops of a route, and how many edges run against it.

    An edge counts if its stop lies further on by mean position, so what counts has no cycle. Of the
    stops whose predecessors are all placed, one that follows the last placed stop goes first, so that
    a branch is ridden to its end; else the one that lies first.
    """
    rank = {s: i for i, s in enumerate(sorted(place, key=lambda s: (place[s], s)))}
    onward = [(a, b) for a, b in edges if rank[a] < rank[b]]
    waits, follows = Counter(b for _, b in onward), {}
    for a, b in onward:
        follows.setdefault(a, []).append(b)
    free, out = {s for s in place if not waits[s]}, []
    while free:
        near = free.intersection(follows.get(out[-1], ())) if out else ()
        stop = min(near or free, key=rank.__getitem__)
        free.remove(stop)
        out.append(stop)
        for b in follows.get(stop, ()):
            waits[b] -= 1
            if not waits[b]:
                free.add(b)
    return out, len(edges) - len(onward)


def line_order(patterns: DataFrame) -> DataFrame:
    """route, pos, stop, cut: one running order per route. A route's stops are few; edges come reduced."""
    nodes = positions(patterns).select("route", F.col("stop").alias("a"), F.lit(None).cast("string").alias("b"), F.round("place", 9).alias("place"))
    rows = nodes.unionByName(edges(patterns).withColumn("place", F.lit(None).cast("double")))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        stops, follow = pdf[pdf.b.isna()], pdf[pdf.b.notna()]
        found, cut = running_order(dict(zip(stops.a, stops.place)), list(zip(follow.a, follow.b)))
        return pd.DataFrame({"route": pdf.route.iloc[0], "pos": range(len(found)), "stop": found, "cut": cut})

    return rows.groupBy("route").applyInPandas(order, "route string, pos int, stop string, cut int")


def attach(order: DataFrame, stations: DataFrame, bullet: str = "route") -> DataFrame:
    """Line stops joined to stations that the line serves, as the register names it; a station stays once on a line."""
    served = stations.select(F.col("id").alias("station"), "name", "routes", F.explode("stops").alias("stop"))
    rows = order.join(served, "stop").where(F.array_contains("routes", F.col(bullet)))
    first = rows.groupBy("route", "station").agg(F.min("pos").alias("pos"), F.min_by("name", "pos").alias("name"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("route").orderBy("pos", "station")) - 1)


def orphans(stations: DataFrame, lines: DataFrame) -> DataFrame:
    return stations.join(lines.select(F.col("station").alias("id")).distinct(), "id", "left_anti")


def by_trunk(lines: DataFrame, order: list[str]) -> DataFrame:
    """Lines in a fixed order, others after, longer ones first."""
    n = lines.groupBy("route").agg(F.count("*").alias("stops"))
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("route"))
    return n.withColumn("place", F.when(place > 0, place).otherwise(len(order) + 1)).orderBy("place", F.desc("stops"), "route")


def area_card(events: DataFrame, located: DataFrame, stations: DataFrame) -> DataFrame:
    """Events, routes and stations by name of each area. located: id, area."""
    n = events.where("neighborhood is not null").groupBy(F.col("neighborhood").alias("area")).agg(F.count("*").alias("n"))
    s = located.join(stations, "id").groupBy("area").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("routes")))).alias("routes"), F.transform(F.sort_array(F.collect_list(F.struct("name", "id"))), lambda x: x["name"]).alias("stations"))
    return n.join(s, "area", "left")


def line_index(stations: DataFrame, lines: DataFrame, located: DataFrame) -> DataFrame:
    """Stations on any line, with the area they lie in. located: id, area."""
    return stations.join(lines.select(F.col("station").alias("id")).distinct(), "id", "left_semi").join(located, "id", "left")
