"""Feeds in their raw shapes, branch by branch."""

import json

import pytest
from pyspark.sql import functions as F

from townsheet.plans import events, lines
from townsheet.sources import feeds

ZONE = "America/New_York"


def run(spark, feed, rows):
    df = spark.createDataFrame([(feed, i, json.dumps(r)) for i, r in enumerate(rows)], "source_id string, row_pos int, j string")
    df = df.withColumn("r", F.from_json("j", feeds.SCHEMAS[feed])).select("source_id", "row_pos", "r.*")
    return sorted(feeds.TRANSFORMS[feed](df, ZONE).collect(), key=lambda r: r.row_pos)


def test_parks(spark):
    rows = [
        {"title": "Swim &amp; Jazz", "startdate": "2024-05-06T00:00:00.000", "starttime": "2020-01-01T22:00:00", "enddate": "2024-05-06", "endtime": "2020-01-01T01:00:00", "location": "Pier 1", "coordinates": "40.7,-73.9", "categories": "Sports|Swimming/Aquatics|Best for Kids", "link": {"url": "http://a/b"}, "image": {"url": "http://www.nycgovparks.org/p.jpg"}},
        {"title": "Yoga", "startdate": "2024-05-06", "coordinates": "x,y", "parknames": "Bay Park", "image": {"url": "http://other.org/p.jpg"}},
        {"title": "Closed today", "startdate": "2024-05-06", "location": "x"}, {"title": "Nice walk", "startdate": "soon", "location": "x"}, {"title": "Nice walk", "startdate": "2024-05-06"},
    ]
    a, b, c, d, e = run(spark, "parks", rows)
    assert (a.title, str(a.start), str(a.end), a.lat, a.category, a.subcategory, a.category_source, a.flags, a.url, a.image, a.reject) == ("Swim & Jazz", "2024-05-06 22:00:00", "2024-05-07 01:00:00", 40.7, "sports", "swimming", "parks:categories", ["kids"], "https://a/b", "https://www.nycgovparks.org/p.jpg", None)
    assert (b.lat, b.subcategory, b.category_source, b.image, b.venue_name, b.reject) == (None, "yoga", "title", None, "Bay Park", None)
    assert [x.reject for x in (c, d, e)] == ["closure or shutdown, not an event", "unparseable start time", "no location named"]


def test_permits(spark):
    base = {"start_date_time": "2024-05-06T10:00:00", "end_date_time": "2024-05-06T09:00:00", "event_location": "Park: lawn", "event_borough": "Queens"}
    kinds = [("Sport - Youth", "Game on"), ("Special Event", "Jazz in June"), ("Special Event", "Something"), ("Parade", "The Parade"), ("Parade", "Picnic")]
    got = run(spark, "permits", [base | {"event_type": k, "event_name": n} for k, n in kinds])
    assert [(r.subcategory, r.category_source, r.reject) for r in got] == [
        (None, None, "league field permit, not a public event"), ("jazz", "permit+title", None), (None, None, "unclassified event_type: Special Event"), ("parade", "permit:event_type", None), ("parade", "permit:event_type", "generic private permit, not a public event"),
    ]
    assert (got[1].venue_name, got[1].borough, str(got[1].end)) == ("Park", "Queens", "2024-05-07 09:00:00")


def test_ticketmaster(spark):
    at = {"venues": [{"name": "New Stage", "location": {"latitude": "40.7", "longitude": "-73.9"}}]}
    slot = lambda t, code="onsale", **more: {"name": "Long run", "dates": {"start": {"localDate": "2024-05-06", "localTime": t}, "status": {"code": code}}, "_embedded": at, "classifications": [{"segment": {"name": "Undefined"}, "genre": {"name": "Undefined"}}]} | more
    rows = [slot("10:00:00", "cancelled"), slot("11:00:00"), slot("12:00:00"), slot("13:00:00") | {"name": "Other", "priceRanges": [{"min": 0.0}, {"min": 5.0}]}, slot("14:00:00") | {"name": "Third", "dates": {"start": {"localDate": "2024-05-06", "dateTBA": True}}}, slot("15:00:00") | {"name": "Fourth", "_embedded": {"venues": []}}]
    got = run(spark, "ticketmaster", rows)
    assert [r.reject for r in got] == ["status: cancelled", "collapsed", "collapsed", None, "date TBA/TBD", "venue has no coordinates"]
    assert (got[3].category, got[3].category_source, got[3].price_min, got[3].is_free, got[3].needs_area) == ("performance", "venue-name", 0.0, True, True)


def test_other_feeds(spark):
    sq = run(spark, "squarespace", [{"title": "Night", "startDate": 1720000000000, "endDate": 1719999999999, "fullUrl": "/e", "origin": "https://v.org/", "excerpt": "<p>Hi &lt;b&gt;</p>", "tags": ["Workshop"], "location": {"mapLat": 40.7, "mapLng": -73.9}, "venue_host": "v.org"}, {"title": "Night", "startDate": 1720000000000}])
    assert (str(sq[0].start), sq[0].end, sq[0].url, sq[0].description, sq[0].category_source, sq[0].venue_name) == ("2024-07-03 05:46:40", None, "https://v.org/e", "Hi <b>", "squarespace:tags", "v.org") and sq[1].reject == "unclassified squarespace event"
    lu = run(spark, "luma", [{"summary": "Session 4", "calendar_name": "Film club", "start": "2024-07-01T23:30:00Z", "lat": 40.7, "lon": -73.9, "description": "see https://lu.ma/abc now"}, {"summary": "Session 4", "start": "2024-07-01T23:30:00Z"}, {"summary": "Jazz", "status": "cancelled", "start": "2024-07-01T23:30:00Z"}])
    assert (lu[0].category_source, lu[0].url, str(lu[0].start)) == ("luma:calendar-name", "https://lu.ma/abc", "2024-07-01 19:30:00") and [r.reject for r in lu[1:]] == ["no coordinates, cannot place", "status: cancelled"]
    di = run(spark, "dice", [{"name": "Show", "type": "MusicEvent", "startDate": "2024-07-01T19:30:00-04:00", "lat": 40.7, "lon": -73.9, "description": "\n One. \nTwo"}, {"name": "Show", "eventStatus": "https://schema.org/EventCancelled", "startDate": "2024-07-01"}])
    assert (di[0].category_source, di[0].description, str(di[0].start), di[0].venue_name) == ("schema-default:musicevent", "One.", "2024-07-01 19:30:00", "DICE") and di[1].reject == "status: eventcancelled"
    li = run(spark, "library", [{"title": "Story time", "start": "2024-07-01T10:00:00+00:00", "location": "DeKalb Library, room 2", "path": "/x", "audience": ["Young Kids"]}, {"title": "Hall", "kind": "Meeting Room"}, {"title": "Hello", "virtual": True, "hybrid": False}, {"title": "Hello", "tags": ["ESOL"]}, {"title": "Notary hour"}, {"title": "Hello", "start": "2024-07-01"}])
    assert (str(li[0].start), li[0].venue_name, li[0].flags, li[0].subcategory, li[0].url) == ("2024-07-01 10:00:00", "DeKalb Library", ["young-kids"], "storytelling", "https://www.bklynlibrary.org/x")
    assert [r.reject for r in li[1:]] == ["internal record: Meeting Room", "virtual only, has no place", "recurring language course", "standing service, not a programme", "no branch named"]
    wp = run(spark, "wordpress", [{"title": "Evening", "start": "2024-07-01 19:00:00", "categories": ["Music"], "cost": "Free", "venue_name": "Hall", "venue_lat": "40.7", "venue_lon": "-73.9", "lat": 1.0, "lon": 2.0}, {"title": "Evening", "start": "2024-07-01 19:00:00", "categories": ["Music Hall"], "venue_name": "Hall"}, {"title": "Evening", "status": "draft"}])
    assert (wp[0].category_source, wp[0].is_free, wp[0].own_lat, wp[0].lat) == ("wordpress:term:music", True, 40.7, 1.0) and [r.reject for r in wp[1:]] == ["unclassified wordpress event", "status: draft"]
    ld = run(spark, "jsonld", [{"title": "Laughs", "type": "ComedyEvent", "start": "2024-07-01T20:00", "address": "1 Main St", "price_min": 5.0, "is_free": False, "venue_name": "Club"}])
    assert (ld[0].category_source, ld[0].place_name, ld[0].price_min) == ("schema:comedyevent", "1 Main St", 5.0)


def test_snapshot_scan_and_registry(spark, tmp_path):
    (tmp_path / "permits.json").write_text(json.dumps({"source": {"id": "permits"}, "fetched_at": "2024-01-01", "rows": [{"event_name": "A"}, {"event_name": "B", "extra": 1}]}, indent=1))
    got = feeds.scan(spark, str(tmp_path / "permits.json"), "permits", feeds.SCHEMAS["permits"]).collect()
    assert [(r.source_id, r.row_pos, r.event_name) for r in got] == [("permits", 0, "A"), ("permits", 1, "B")]
    for name, schema in feeds.SCHEMAS.items():  # every schema reads
        assert feeds.scan(spark, str(tmp_path / "permits.json"), name, schema).count() == 2
    (tmp_path / "sources.json").write_text(json.dumps({"sources": [{"id": "a", "enabled": True, "min_expected": 3}, {"id": "b", "enabled": False}]}))
    assert [r.id for r in feeds.registry(spark, str(tmp_path / "sources.json")).collect()] == ["a"]


def test_save_and_extract(spark, tmp_path):
    from townsheet.queries import built

    rows = built(spark, "/root/testdata/sf0.001")
    events.save(rows, str(tmp_path))
    kept = spark.read.parquet(f"{tmp_path}/events")
    assert kept.count() == events.listings(rows).count() and kept.select("id").distinct().count() == kept.count()
    assert spark.read.parquet(f"{tmp_path}/rejected").count() == events.rejects(rows).count()
    assert sum(r.n for r in events.outcomes(rows).collect()) == rows.count()


def test_line_order_keeps_branches_and_counts_cycles(spark):
    stops = [("A", "ab", ["1", "2", "3", "4"]), ("A", "ac", ["1", "2", "5", "6"]), ("B", "x", ["p", "q", "r"]), ("B", "y", ["q", "p"])]
    got = lines.line_order(spark.createDataFrame([(r, s) for r, _, s in stops], "route string, stops array<string>")).collect()
    a = [r.stop for r in sorted(got, key=lambda r: r.pos) if r.route == "A"]
    assert a[:2] == ["1", "2"] and a.index("4") == a.index("3") + 1 and a.index("6") == a.index("5") + 1
    assert {r.cut for r in got if r.route == "A"} == {0} and {r.cut for r in got if r.route == "B"} == {1}


@pytest.mark.parametrize("x, y, inside", [(0.5, 0.5, True), (2.5, 0.5, True), (1.5, 1.5, False), (9, 9, False)])
def test_c_shape(spark, x, y, inside):
    from townsheet.operators import geo

    ring = [(0, 0), (3, 0), (3, 1), (1, 1), (1, 2), (3, 2), (3, 3), (0, 3)]
    df = spark.createDataFrame([(x * 1.0, y * 1.0, [{"x": float(a), "y": float(b)} for a, b in ring])], "x double, y double, r array<struct<x:double,y:double>>")
    r = df.select(geo.in_ring(F.col("x"), F.col("y"), F.col("r")).alias("i"), geo.interior(F.col("r")).alias("p")).first()
    assert r.i == inside
    q = spark.createDataFrame([(r.p.x, r.p.y, [{"x": float(a), "y": float(b)} for a, b in ring])], df.schema)
    assert q.select(geo.in_ring(F.col("x"), F.col("y"), F.col("r")).alias("i")).first().i
