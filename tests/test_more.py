"""Sinks, orders, images, contained names, hours and schedules on small hand-made rows."""

import json
import random

from pyspark.sql import functions as F

from townsheet.functions import hours
from townsheet.operators import dedup, resolve
from townsheet.plans import lines, places, sinks
from townsheet.sources import pages


def test_running_order_rides_branches_to_their_end():
    place = {"a": 0.0, "b": 0.2, "c": 0.4, "x": 0.41, "d": 0.6, "y": 0.61}
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("b", "x"), ("x", "y"), ("d", "a")]
    out, cut = lines.running_order(place, edges)
    assert (out, cut) == (["a", "b", "c", "d", "x", "y"], 1)
    assert lines.running_order({"q": 0.0}, []) == (["q"], 0)


def test_running_order_goes_with_every_edge_it_keeps():
    rnd = random.Random(4)
    for _ in range(50):
        stops = [str(i) for i in range(rnd.randint(1, 15))]
        place = {s: rnd.random() for s in stops}
        edges = list({(rnd.choice(stops), rnd.choice(stops)) for _ in range(25)})
        out, cut = lines.running_order(place, edges)
        assert sorted(out) == sorted(stops)
        kept = [(a, b) for a, b in edges if (place[a], a) < (place[b], b)]
        assert cut == len(edges) - len(kept) and all(out.index(a) < out.index(b) for a, b in kept)


IMAGES = [
    ("File:A b.jpg", "A b.jpg"), ("https://upload.wikimedia.org/wikipedia/commons/a/ab/X%20y+z.jpg", "X y+z.jpg"), ("http://upload.wikimedia.org/wikipedia/commons/thumb/a/ab/X.jpg/500px-X.jpg", "X.jpg"),
    ("https://en.wikipedia.org/wiki/File:Hall%2C_NY.jpg", "Hall,_NY.jpg"), ("https://upload.wikimedia.org/wikipedia/en/a/ab/X.jpg", None), ("https://drive.example/wikipedia/commons/a/ab/X.jpg", None), ("https://en.wikipedia.org/wiki/Hall", None), ("", None), (None, None),
]


def test_images(spark):
    rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(IMAGES)], "i int, v string").withColumn("tags", F.create_map(F.lit("image"), F.col("v")))
    assert {r.i: r.f for r in rows.select("i", places.image_ref(F.col("tags")).alias("f")).collect()} == {i: f for i, (_, f) in enumerate(IMAGES)}
    base = "https://upload.wikimedia.org/wikipedia/commons"
    want = {f"{base}/a/ab/X.jpg": f"{base}/thumb/a/ab/X.jpg/500px-X.jpg", f"{base}/thumb/a/ab/X.jpg/99px-X.jpg": f"{base}/thumb/a/ab/X.jpg/500px-X.jpg", f"{base}/a/ab/X.svg": f"{base}/a/ab/X.svg", "https://x/y.jpg": "https://x/y.jpg"}
    got = spark.createDataFrame([(u,) for u in want], "u string").select("u", places.thumb(F.col("u")).alias("t")).collect()
    assert {r.u: r.t for r in got} == want
    html = f'<img src="//x/a.jpg"><img class="b" src="{base}/a/ab/City_Logo.jpg"><img alt="" src="//upload.wikimedia.org/wikipedia/commons/thumb/c/cd/90px-Old_Hall.jpg/250px-Old_Hall.jpg">'
    assert spark.createDataFrame([(html,)], "h string").select(places.infobox_image(F.col("h")).alias("f")).first().f == "Old_Hall.jpg"


def test_contained_names_like_brute_force(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 4)))
    names = list({" ".join(word() for _ in range(rnd.randint(1, 4))) for _ in range(25)})
    asks = names[:8] + [n[1:] for n in names] + [f"x{n}y" for n in names] + [" ".join(word() for _ in range(2)) for _ in range(60)] + ["a b", "grand army", "rand army plaza"]
    names += ["grand army plaza", "a b"]
    table = spark.createDataFrame([(n, float(i), 0.0) for i, n in enumerate(names)], "name string, lat double, lon double")
    got = {r.key: r.lat for r in resolve.unique_contained(spark.createDataFrame(list(enumerate(asks)), "key long, name string"), table).collect()}
    want = {}
    for k, a in enumerate(asks):
        a = " ".join(a.split())
        hits = {i for i, n in enumerate(names) if " " in a and " " in n and (a in n or n in a)}
        if len({float(i) for i in hits}) == 1:
            want[k] = float(min(hits))
    assert got == want and len(want) > 3


def test_venue_state_like_a_running_frame(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice(["n", None, "m"]), "k", None, *([1.0 * i, 2.0] if rnd.random() < 0.3 else [None, None])) for i in range(60)]
    got = dedup.venue_state(spark.createDataFrame(rows, "ord int, slug string, name string, kind string, borough string, lat double, lon double"), "slug", ["ord"]).collect()
    first, at = {}, {}
    for r, row in zip(sorted(got, key=lambda r: r.ord), rows, strict=True):
        first.setdefault(row[1], row[2])
        if row[5] is not None:
            at.setdefault(row[1], row[5])
        assert (r.v_name, r.v_lat) == (first[row[1]], at.get(row[1]))


def test_markup_at_any_depth(spark):
    node = {"@type": "Event", "startDate": "2024-01-01", "name": "deep"}
    for _ in range(40):
        node = {"x": [node]}
    html = f'<script type="application/ld+json">{json.dumps(node)}</script><script type="application/ld+json">{{bad</script><script type="application/ld+json">{{"@type":["Thing","Event","DanceEvent"],"startDate":"2024","name":"flat","location":"Hall"}}</script>'
    got = pages.markup_events(spark.createDataFrame([(1, html), (2, None), (3, "ld+json")], "k int, html string"), "k").collect()
    assert sorted((r.title, r.type, r.venue) for r in got) == [("deep", "Event", None), ("flat", "DanceEvent", "Hall")]


def test_hours_outside_the_subset(spark):
    cases = {"Mo - Fr 10:00-12:00": None, "Mo-Fr 10:00 - 12:00": "1111100", "Mo-Fr 10:00-12:00 Sa": None, "MoTu 10:00-11:00": None, "Mo,We,, 10:00-11:00": "1010000", "off": None, "Mo-Su 10:00-11:00; PH,Su off": "1111110", "Mo 10:00": None, "Mo 10:00-11:00+": None, ";;": None}
    got = spark.createDataFrame([(c,) for c in cases], "s string").select("s", hours.week_mask(F.col("s")).alias("m")).collect()
    assert {r.s: r.m for r in got} == cases


def test_sinks_and_schedules(spark, tmp_path):
    events = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02")], "id string, date_local string")
    rejected = spark.createDataFrame([("s", "t", "r", None)], "source string, title string, reason string, url string")
    sinks.tables(f"{tmp_path}/out", events=events, rejected=rejected, meta=events.groupBy().count())
    assert spark.read.parquet(f"{tmp_path}/out/events").where("date_local = '2024-01-02'").first().id == "b" and spark.read.parquet(f"{tmp_path}/out/meta").first()["count"] == 2
    sinks.review(spark.createDataFrame([("x", 1, None), ("y", 3, "Q")], "location string, n long, borough string"), f"{tmp_path}/review")
    assert [r.location for r in spark.read.csv(f"{tmp_path}/review", header=True).collect()] == ["y", "x"]
    sinks.places(spark.createDataFrame([("museum", "B"), ("museum", "A"), ("arcade", "C")], "kind string, name string"), f"{tmp_path}/places")
    assert spark.read.parquet(f"{tmp_path}/places").count() == 3
    sinks.ledger(spark.createDataFrame([("s", True, 3)], "source string, ok boolean, n long"), f"{tmp_path}/ledger")
    assert spark.read.json(f"{tmp_path}/ledger").first().n == 3
    order = spark.createDataFrame([("A", 1, "q"), ("A", 0, "p")], "route string, pos int, station string")
    some, stations = sinks.line_extract(order, spark.createDataFrame([("p", "P St", ["A"])], "id string, name string, routes array<string>"))
    assert json.loads(some.first().value) == {"r": "A", "s": ["p", "q"]} and json.loads(stations.first().value) == {"i": "p", "n": "P St", "r": ["A"]}
    for name, body in {"stops": "stop_id,parent_station\ns1,p1\ns2,\n", "routes": "route_id,route_short_name,route_long_name\nr,6X,Six\n", "trips": "trip_id,route_id,direction_id\nt,r,0\n", "stop_times": "trip_id,stop_id,stop_sequence\nt,s2,2\nt,s1,1\n"}.items():
        (tmp_path / f"{name}.txt").write_text(body)
    g = lines.gtfs(spark, str(tmp_path))
    times = g["stop_times"].join(g["trips"], "trip_id").join(g["routes"], "route_id").join(g["stops"], "stop_id").select(F.col("route_short_name").alias("route"), F.col("trip_id").alias("trip"), F.col("stop_sequence").alias("seq"), F.coalesce("parent_station", "stop_id").alias("stop"), (F.col("direction_id") == "1").alias("northbound"))
    r = lines.patterns(times).first()
    assert (r.route, r.stops) == ("6", ["p1", "s2"])
