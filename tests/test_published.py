"""Schedules as they are published, configurations, and what a site is served from."""

import json

from pyspark.sql import functions as F

from townsheet.plans import events, lines, sinks
from townsheet.sources import feeds

SCHEDULE = {
    # a byte order mark, columns in another order, quoted commas, an optional column left out
    "stops": "﻿stop_name,stop_id,parent_station\nFirst,p1N,p1\nFirst,p1S,p1\n\"Second, east\",p2N,p2\nEnd,p3,\nAway,p4N,p4\n",
    "routes": "route_id,route_color,route_long_name,route_short_name\n6X,0,Express,6\n6,0,Local,6\nQ,1,,\n",
    "trips": "route_id,service_id,trip_id,direction_id\n6,w,north,0\n6X,w,south,1\nQ,w,q,1\nZ,w,z,1\n",
    "stop_times": "trip_id,arrival_time,stop_id,stop_sequence\nnorth,6:00,p2N,2\nnorth,6:00,p3,1\nnorth,6:00,p1N,10\nsouth,6:00,p1S,1\nsouth,6:00,p2N,2\nsouth,6:00,p3,3\nq,6:00,p3,1\nz,6:00,p4N,1\ngone,6:00,p1S,1\n",
}


def schedule(spark, folder, **other):
    for name, body in (SCHEDULE | other).items():
        (folder / f"{name}.txt").write_text(body, encoding="utf-8")
    return lines.gtfs(spark, str(folder))


def test_columns_are_found_by_the_header(spark, tmp_path):
    feed = schedule(spark, tmp_path, trips="trip_id,route_id\nnorth,6\n")
    assert [tuple(r) for r in feed["stops"].collect()] == [("p1N", "p1"), ("p1S", "p1"), ("p2N", "p2"), ("p3", None), ("p4N", "p4")]
    assert [tuple(r) for r in feed["trips"].collect()] == [("north", "6", None)]  # northbound
    assert lines.patterns(lines.schedule(feed)).first().stops == ["p1", "p2", "p3"]


def test_patterns_and_titles(spark, tmp_path):
    feed = schedule(spark, tmp_path)
    got = {(r.route, tuple(r.stops)) for r in lines.patterns(lines.schedule(feed)).collect()}
    assert got == {("6", ("p1", "p2", "p3")), ("Q", ("p3",)), ("Z", ("p4",))}  # the express folds in, an unlisted trip goes
    assert {tuple(r) for r in lines.titles(feed).collect()} == {("6", "6", "Express"), ("Q", None, None)}


def test_published_lines(spark, tmp_path):
    rows = [("s1", "First", ["6"], ["p1"]), ("s2", "Rest", ["6", "Q"], ["p2", "p3"]), ("s4", "Away", ["A"], ["p4"]), ("s5", None, None, None)]
    register = spark.createDataFrame(rows, "id string, name string, routes array<string>, stops array<string>")
    got = sorted(map(tuple, lines.published(schedule(spark, tmp_path), register).collect()))
    # a station of two stops stays once; a line without a title goes by its id; the register serves no Z
    assert got == [("6", "6", "Express", "s1", 0, "First"), ("6", "6", "Express", "s2", 1, "Rest"), ("Q", "Q", "Q", "s2", 0, "Rest")]
    none = schedule(spark, tmp_path, stop_times="trip_id,stop_id,stop_sequence\n")
    assert lines.published(none, register).count() == 0


def test_city_and_registries_by_key(spark, tmp_path):
    (tmp_path / "city=a").mkdir()
    (tmp_path / "city=b").mkdir()
    (tmp_path / "city=a" / "s.json").write_text(json.dumps({"sources": [{"id": "x", "enabled": True}, {"id": "y"}]}, indent=1))
    (tmp_path / "city=b" / "s.json").write_text(json.dumps({"sources": []}))
    assert [(r.city, r.id) for r in feeds.registry(spark, str(tmp_path), "city").collect()] == [("a", "x")]
    (tmp_path / "c.json").write_text(json.dumps({"slug": "a", "tz": "UTC", "bbox": [1, 2.5, 3], "boroughs": ["Q"], "geocoder": {"url": "u"}}))
    r = feeds.city(spark, str(tmp_path / "c.json")).first()
    assert (r.slug, r.tz, r.west, r.south, r.east, r.north, r.boroughs, r.name) == ("a", "UTC", 1.0, 2.5, 3.0, None, ["Q"], None)


def test_extracts_leave_out_what_is_not_stated(spark):
    stations = spark.createDataFrame([("s1", "One", ["A", "C"])], "id string, name string, routes array<string>")
    schema = "id string, name string, kind string, lat double, lon double, subway struct<meters:bigint,id:string>"
    rows = spark.createDataFrame([("p", "Park", "zoo", 1.0, 2.0, (70, "s1")), ("q", None, None, None, None, (80, "s2")), ("r", "R", "zoo", 1.0, 2.0, None)], schema)
    p, q, r = (json.loads(x.value) for x in sinks.place_extract(rows, stations).orderBy("value").collect())
    one = {"i": "p", "t": "Park", "k": "zoo", "la": 1.0, "lo": 2.0, "nb": 0, "lb": "osm", "sw": {"i": "s1", "n": "One", "r": ["A", "C"], "m": 70}}
    assert p == one and q == {"i": "q", "nb": 0, "lb": "osm", "sw": {"i": "s2", "m": 80}}  # a station that the register lacks
    assert r == {"i": "r", "t": "R", "k": "zoo", "la": 1.0, "lo": 2.0, "nb": 0, "lb": "osm"}
    assert {x.value for x in sinks.place_extract(rows).select(F.get_json_object("value", "$.sw").alias("value")).collect()} == {'{"i":"s1","m":70}', '{"i":"s2","m":80}', None}


def test_event_extract(spark):
    from townsheet.queries import built

    rows = events.listings(built(spark, "/root/testdata/sf0.001"))
    got = json.loads(events.extract(rows).orderBy("value").first().value)
    assert {"i", "t", "s", "d", "e", "b", "vn", "src"} <= set(got) and got["src"] == "pe" and got["s"].startswith(got["d"] + "T")
    assert events.extract(rows.limit(0)).count() == 0


def test_event_serving_names_stations_of_the_register_alone(spark):
    from townsheet.published_queries import event_serving

    rows = event_serving(spark, "/root/testdata/sf0.001")  # ten stations, ids asked up to 90
    known = {r.s_suppkey for r in spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").collect()}
    got = rows.select("sw_i", "sw_n", "sw_m").distinct().collect()
    assert {r.sw_i for r in got} - {None} <= known and all((r.sw_i is None) == (r.sw_n is None) for r in got)
    assert any(r.sw_i is None and r.sw_m is not None for r in got) and any(r.sw_i is not None for r in got)
