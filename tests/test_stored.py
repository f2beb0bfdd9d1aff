"""Published versions, ordered scans, nested markup, cells, text index, kept aggregates, bitmaps, pages."""

import json
import math
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import TABLES, compare
from pyspark.sql import functions as F

from townsheet.operators import bitmaps, dedup, deltas, geo, keyset, substrings
from townsheet.operators.store import Conflict, Store, Table
from townsheet.plans import sinks
from townsheet.queries import QUERIES, SQL
from townsheet.sources import feeds, pages


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- versions ----


def rows_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "day string, n int")


def read(store, name="t", version=None):
    return sorted(map(tuple, store.read(name, version).select("day", "n").collect()))


def test_a_run_that_stops_before_it_publishes_changes_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.manifest()["version"] == 0 and store.versions() == []
    store.publish({"t": Table(rows_of(spark, ("a", 1), ("b", 2)), "day")})
    said = store.write({"t": Table(rows_of(spark, ("a", 9)), "day")})  # and here it dies
    again = Store(spark, f"file://{tmp_path}/s")
    assert read(again) == [("a", 1), ("b", 2)] and again.versions() == [1]
    assert len(again.sweep()) == 1 and read(again) == [("a", 1), ("b", 2)]
    assert said["t"]["parts"].keys() == {"day=a"}


def test_versions_replace_parts_or_tables(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.publish({"t": Table(rows_of(spark, ("a", 1), ("b", 2)), "day"), "u": Table(rows_of(spark, ("x", 0)))}) == 1
    now, before = store.now_and_before("t")
    assert before.count() == 0 and before.columns == now.columns == ["n", "day"] or before.columns == now.columns
    assert store.publish({"t": Table(rows_of(spark, ("b", 3), ("b", 4), ("c", 5)), "day", replace=False)}) == 2
    now, before = store.now_and_before("t")
    assert sorted(map(tuple, now.select("day", "n").collect())) == [("a", 1), ("b", 3), ("b", 4), ("c", 5)]
    assert sorted(map(tuple, before.select("day", "n").collect())) == [("a", 1), ("b", 2)]
    assert read(store, "u") == [("x", 0)] and read(store, version=1) == [("a", 1), ("b", 2)]
    assert store.publish({"t": Table(rows_of(spark, ("z", 1)), "day")}) == 3 and read(store) == [("z", 1)]
    store.publish({"t": Table(rows_of(spark).where("false"), "day")})  # no part at all
    assert read(store) == []
    gone = store.sweep(keep=1)
    assert gone and store.versions() == [4] and read(store, "u") == [("x", 0)]
    with pytest.raises(KeyError):
        store.read("nothing")


def test_of_two_runs_on_one_version_the_later_one_is_refused(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.publish({"t": Table(rows_of(spark, ("a", 1)))})
    one, two = (store.write({"t": Table(rows_of(spark, ("a", n)))}) for n in (2, 3))
    assert store.commit(one, parent=1) == 2
    with pytest.raises(Conflict):
        store.commit(two, parent=1)
    assert read(store) == [("a", 2)]
    assert store.commit(two, parent=2) == 3 and read(store) == [("a", 3)]


def test_filters_on_the_parted_column_prune(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.publish({"t": Table(rows_of(spark, ("a", 1), ("b", 2)), "day")})
    store.publish({"t": Table(rows_of(spark, ("b", 3)), "day", replace=False)})
    found = store.read("t").where("day = 'b'")
    assert [r.n for r in found.collect()] == [3] and "PartitionFilters: [isnotnull(day" in plan_of(found)


def test_one_pass_writes_all_tables_and_counts(spark, tmp_path):
    """The built rows are computed once, whatever the number of tables."""
    seen = spark.sparkContext.accumulator(0)

    def touched(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    base = spark.range(100).mapInArrow(touched, "id long")
    i = F.col("id")
    kind = F.when(i % 10 == 0, "no permit").when(i % 10 == 1, "deduped").otherwise("kept")
    names = ["title", "description", "venue_name", "venue_kind", "neighborhood_name", "time_band", "tz", "category", "subcategory", "category_source", "image", "location_source", "url", "borough"]
    built = base.select(
        i.cast("string").alias("id"), *[F.lit("x").alias(n) for n in names], F.lit("2024-01-01 10:00:00").cast("timestamp_ntz").alias("start_utc"), F.lit("2024-01-01 10:00:00").cast("timestamp_ntz").alias("start_local"), F.lit(None).cast("timestamp_ntz").alias("end_local"),
        F.concat(F.lit("2024-01-0"), (i % 3 + 1).cast("string")).alias("date_local"), (i % 4).cast("string").alias("venue_id"), F.when(i % 2 == 0, "n").alias("neighborhood"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon"), F.array(F.struct(F.lit(5).cast("long").alias("meters"), F.lit("s").alias("id"))).alias("subway"),
        F.array().cast("array<string>").alias("flags"), F.lit(None).cast("double").alias("price_min"), F.lit(None).cast("boolean").alias("is_free"), F.lit("permits").alias("source"), i.alias("row_pos"), kind.alias("outcome"),
    )
    store = Store(spark, f"file://{tmp_path}/s")
    version = sinks.publish(store, built, neighborhoods=spark.range(3))
    assert seen.value == 100
    counters = store.manifest(version)["counters"]
    assert (counters["rows"], counters["kept"], counters["deduped"], counters["rejected"], counters["with_neighborhood"], counters["with_price"]) == (100, 80, 10, 10, 40, 0)
    assert store.read("events").count() == 80 and store.read("rejected").count() == 10 and store.read("venues").count() == 4 and store.read("neighborhoods").count() == 3
    assert {r.counter: r.n for r in store.read("outcomes").collect()} == {"kept:permits": 80, "deduped": 10, "rejected:no permit": 10}
    assert {r.name: r.share for r in store.read("meta").collect()}["with_neighborhood"] == 50.0


# ---- ordered scans, markup ----


@pytest.mark.parametrize("split", [37, 1000, 1 << 27])
def test_positions_do_not_depend_on_splits(spark, tmp_path, split):
    lines = [json.dumps({"id": i, "t": "é" * (i % 9)}) if i % 13 else "{oops %d" % i for i in range(300)]
    for source, some in (("b", lines), ("a", lines[:50]), ("other", lines[:5])):
        (tmp_path / source).mkdir()
        for part in range(3):
            (tmp_path / source / f"part-{part}.json").write_text("".join(f"{x}\n" + "  \n" * (i % 4 == 0) for i, x in enumerate(some[part::3])))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows, bad = feeds.scan_folder(spark, f"file://{tmp_path}", {"a": "id long", "b": "id long, t string"})
        assert sorted(rows) == ["a", "b"]
        order = [x for part in range(3) for x in range(300)[part::3]]
        got = {r.row_pos: r.id for r in rows["b"].collect()}
        assert got == {p: i for p, i in enumerate(order) if i % 13}
        assert {(r.source_id, r.row_pos, r.value) for r in bad.where("source_id = 'b'").collect()} == {("b", p, "{oops %d" % i) for p, i in enumerate(order) if i % 13 == 0}
        assert rows["a"].count() == 46 and rows["a"].columns == ["source_id", "row_pos", "id"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_markup_at_any_depth_without_python(spark):
    event = {"@type": ["Thing", "JazzEvent"], "name": "deep", "startDate": "2024", "location": {"name": "Hall"}}
    for i in range(40):
        event = [event, 1, None] if i % 2 else {"k": event, "startDate": None}
    many = {"@graph": [{"@type": "Event", "name": "one", "startDate": "1", "subEvent": [{"@type": "Event", "name": "two", "startDate": "2"}]}, {"@type": "Event", "name": "one", "startDate": "1", "description": "again"}, {"@type": "Eventful", "startDate": "3"}, {"@type": "Event", "startDate": None}]}
    page = lambda *blocks: "".join(f'<script type="application/ld+json">{b if isinstance(b, str) else json.dumps(b)}</script>' for b in blocks)
    rows = [(1, page(event)), (2, page("{startDate", many)), (3, None), (4, "ld+json"), (5, page({"a": "startDate"}))]
    found = pages.markup_events(spark.createDataFrame(rows, "k int, html string"), "k")
    got = sorted((r.k, r.title, r.start, r.type, r.venue, r.description) for r in found.collect())
    assert got == [(1, "deep", "2024", "JazzEvent", "Hall", None), (2, "one", "1", "Event", None, None), (2, "two", "2", "Event", None, None)]
    assert "Python" not in plan_of(found) and "Arrow" not in plan_of(found)
    assert pages.markup_events(spark.createDataFrame([], "k int, html string"), "k").count() == 0


# ---- cells ----


def test_cover_gives_the_same_areas_and_casts_few(spark):
    rnd = random.Random(3)

    def ring(x, y, r, n):
        import math

        return [{"x": x + r * rnd.uniform(0.5, 1) * math.cos(2 * math.pi * i / n), "y": y + r * rnd.uniform(0.5, 1) * math.sin(2 * math.pi * i / n)} for i in range(n)]

    areas = [(k, [{"outer": ring(rnd.uniform(-2, 2), rnd.uniform(-2, 2), rnd.uniform(0.3, 1.5), rnd.choice([3, 7, 40])), "holes": [ring(0, 0, 0.3, 5)] if k % 3 == 0 else []} for _ in range(1 + k % 2)]) for k in range(12)]
    areas.append((99, [{"outer": [], "holes": []}]))
    kind = "struct<x:double,y:double>"
    frame = spark.createDataFrame(areas, f"ord int, rings array<struct<outer:array<{kind}>,holes:array<array<{kind}>>>>")
    points = [(i, rnd.uniform(-3.5, 3.5), rnd.uniform(-3.5, 3.5)) for i in range(3000)] + [(5000, None, 1.0)]
    points += [(6000 + i, p["x"], p["y"]) for i, p in enumerate(areas[1][1][0]["outer"])]  # on corners
    table = spark.createDataFrame(points, "id int, lon double, lat double")
    want = {r.id: r.ord for r in geo.locate(table, frame, "id", cell=0.5).collect()}
    got = geo.locate_by_cover(table, frame, geo.cover(frame, 0.5, 4), "id", cell=0.5, levels=4).collect()
    assert {r.id: r.ord for r in got} == want and len(want) > 800
    assert sum(r.cast for r in got) < 0.25 * len(got)


def joined(df):
    """df's rows, and how many rows its joins made."""
    rows = df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in node.nodeName():
            n += node.metrics().apply("numOutputRows").value()
    return rows, n


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_a_point_meets_spots_and_not_their_stations(spark, limit):
    rnd = random.Random(7)
    spots = [(40.7 + rnd.random() / 30, -74.0 + rnd.random() / 30) for _ in range(6)]
    stations = [(i, *spots[i % 7]) if i % 7 < 6 else (i, None, -74.0) for i in range(700)] + [(13, *spots[2])]
    rnd.shuffle(stations)
    points = [(i, 40.69 + rnd.random() / 20, -74.01 + rnd.random() / 20) for i in range(200)] + [(200, None, None), (201, *spots[0])]
    found = geo.nearest(spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(stations, "id int, lat double, lon double"), "id", limit)
    rows, made = joined(found)
    want = {}
    for i, lat, lon in points:
        if lat is not None:
            far = sorted((math.sqrt(((lon - x) * geo.LAT_M * math.cos(math.radians(40.7))) ** 2 + ((lat - y) * geo.LAT_M) ** 2), k) for k, y, x in stations if y is not None)
            if near := [(round(m), k) for m, k in far[:limit] if m <= 1600]:
                want[i] = near
    assert {r.id: [tuple(s) for s in r.near] for r in rows} == want and 100 < len(want) < 202
    assert 0 < made <= len(points) * len(spots) * limit


# ---- text ----


def test_substring_search_reads_few_postings(spark, tmp_path):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(150)]
    texts = [(i, " ".join(rnd.choice(words) for _ in range(6))) for i in range(700)] + [(1000, None), (1001, ""), (1002, "AB"), (1003, "common " * 50 + "rarest"), (1004, texts_dup := "ab cd"), (1005, texts_dup)]
    path = f"file://{tmp_path}/i"
    substrings.build(spark.createDataFrame(texts, "id int, name string"), path)
    asks = ["rarest", "Rares", words[3], words[4][:2], words[5] + " " + words[6], "zzz", "a", "ab cd", "", texts[7][1][3:20]]
    for q in asks:
        want = sorted(i for i, t in texts if t is not None and q.lower() in t.lower())
        assert sorted(r.id for r in substrings.search(spark, path, q).collect()) == want, q
    got = {}
    for r in substrings.contained(spark.createDataFrame(list(enumerate(asks)), "key int, name string"), spark, path).collect():
        got.setdefault(r.key, []).append(r.id)
    for k, q in enumerate(asks):
        want = sorted(i for i, t in texts if t is not None and q and q.lower() in t.lower())
        assert sorted(got.get(k, [])) == want, q
    postings = spark.read.parquet(f"{path}/postings")
    held = {r.gram: r.n for r in postings.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    opened = substrings.rarest(spark, path, texts[7][1][3:20])
    assert sum(held[g] for g in opened) < 0.02 * sum(held.values()) and len(opened) == 3
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram" in plan_of(postings.where("gram = 'abc'"))
    assert sorted(r.ord for r in substrings.opened(postings, "gram").where("gram = 'abc'").collect()) == sorted(r.ord for r in spark.read.parquet(f"{path}/texts").where("contains(name, 'abc')").collect())


# ---- ids ----


def test_ids_as_if_in_turns(spark):
    rnd = random.Random(4)
    for trial in range(3):
        rows = [(i, rnd.choice(["a", "a-2", "a-2-2", "b", "a-n", "a-n-2"]), rnd.choice([None, None, "n", "m"])) for i in range(60)]
        rows = rows[:3] if trial == 2 else rows
        taken = []
        for _, b, area in sorted(rows):
            second, c = f"{b}-{area}" if area else b, b
            if c in taken:
                c = second if area else f"{b}-2"
                while c in taken:
                    c += "-2"
            taken.append(c)
        df = spark.createDataFrame(rows, "k int, b string, area string")
        got = dedup.distinct_ids(df, F.col("b"), F.when(F.col("area").isNotNull(), F.concat_ws("-", "b", "area")), ["k"]).collect()
        assert [r.id for r in sorted(got)] == taken
    three = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-2")], "k int, b string")
    got = dedup.distinct_ids(three, F.col("b"), F.lit(None).cast("string"), ["k"])
    assert [r.id for r in sorted(got.collect())] == ["a", "a-2", "a-2-2"]


def test_ids_of_long_lines_that_cross(spark):
    """Thousands of rows named a and as many named a-2 stand in one line; a second that is another's base; nulls."""
    rnd = random.Random(9)
    names = {"a": None, "a-2": None, "a-2-2": "a-2", "b": "b-n", "b-n": "b-n-n", "b-n-n": "b", "-2": "", "": None}
    rows = [(i, *rnd.choice(list(names.items()))) for i in range(4000)] + [(5000 + i, None, "x") for i in range(2)]
    taken, tried, want = set(), {}, {}
    for k, b, second in rows:
        c, s = b, b if second is None else second
        while c in taken:
            c, tried[s] = s + "-2" * tried.get(s, 0), tried.get(s, 0) + 1
        want[k] = c
        taken |= {c} - {None}
    df = spark.createDataFrame(rows, "k int, b string, second string").repartition(5, "second")
    got = dedup.distinct_ids(df, F.col("b"), F.col("second"), ["k"])
    assert got.columns == ["k", "b", "second", "id"]
    assert {r.k: r.id for r in got.collect()} == want and want[5000] is None
    ties = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a")], "k int, b string")
    assert sorted(r.id for r in dedup.distinct_ids(ties, F.col("b"), F.lit(None).cast("string"), ["k"]).collect()) == ["a", "a-2", "a-2-2", "b"]
    assert dedup.distinct_ids(ties.where("false"), F.col("b"), F.col("b"), ["k"]).count() == 0


# ---- kept aggregates ----


def test_kept_aggregates_follow_inserts_changes_and_evictions(spark):
    rnd = random.Random(6)
    schema, keys = "id int, g string, x long, v int", ["g"]
    frame = lambda rows: spark.createDataFrame([(i, *r) for i, r in rows.items()], schema)
    new = lambda: (rnd.choice(["a", "b", None]), rnd.choice([1, 5, None]), rnd.choice([3, 4, 9, None]))
    rows = {i: new() for i in range(40)}
    held = deltas.counted(frame(rows), keys, ["x"], "v")
    for step in range(3):
        before, rows = rows, {i: (new() if rnd.random() < 0.2 else r) for i, r in rows.items() if rnd.random() > 0.2} | {100 * (step + 1) + i: new() for i in range(5)}
        if step == 2:
            rows = {i: r for i, r in rows.items() if r[0] != "a"}  # a key goes
        change = deltas.changes(frame(before), frame(rows), "id")
        assert change.count() < len(before) + len(rows)
        held = deltas.applied(held, deltas.state(change, keys, ["x"], "v"), keys)
        held = deltas.State(*(spark.createDataFrame(t.collect(), t.schema) for t in (held.totals, held.values)))
        want = {}
        for g, x, v in rows.values():
            n, s, vs = want.get(g, (0, 0, []))
            want[g] = n + 1, s + (x or 0), vs + [v] * (v is not None)
        got = {r.g: (r.n, r.x, r.least, r.greatest, r.kinds) for r in deltas.read(held, keys).collect()}
        assert got == {g: (n, s, min(vs, default=None), max(vs, default=None), len(set(vs))) for g, (n, s, vs) in want.items()}
        assert deltas.broken(held).count() == 0
    twice = deltas.applied(held, deltas.state(frame({i: r for i, r in rows.items() if r[0] == "b"}).unionByName(frame(rows)).withColumn("sign", F.lit(-1).cast("long")), keys, ["x"], "v"), keys)
    assert deltas.broken(twice).count() == 1


def test_kept_totals_hold_doubles(spark, tmp_path):
    """Prices that differ in their last bit are two kinds, and none is cut to cents."""
    moved = [1000.07, 1000.09, 1000.11]  # as doubles, 1000.07 + 1000 is not 2000.07
    rows = [(7 * i + 2, "F", p) for i, p in enumerate(moved)] + [(7 * i + 4, "F", p + 1000) for i, p in enumerate(moved)]
    rows += [(7 * i + 6, "F", p) for i, p in enumerate([2000.07, 2000.09, 2000.11])] + [(7 * i + 3, "O", 0.004 * i + 0.0011) for i in range(9)]
    rows += [(102, "N", float("nan")), (104, "N", 1.0), (109, "H", 1e300), (111, None, None), (116, None, 2.5), (118, "E", None), (123, "P", 5.0), (124, "P", 7.25), (125, "P", 7.25)]
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    (tmp_path / "orders.parquet").unlink()
    pq.write_table(pa.table(dict(zip(("o_orderkey", "o_orderstatus", "o_totalprice"), map(list, zip(*rows, strict=True)), strict=True))), tmp_path / "orders.parquet")
    assert compare(spark, str(tmp_path), "kept_totals", QUERIES["kept_totals"], SQL["kept_totals"]) == ""
    assert {r.st: r.kinds for r in QUERIES["kept_totals"](spark, str(tmp_path)).collect()}["F"] == 6


# ---- bitmaps and pages ----


def test_bitmaps_count_like_filters(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice([i, i + 40000]) if i % 50 else i + 90000, rnd.choice("xyz"), rnd.choice(["p", None]), rnd.sample("klm", rnd.randint(0, 3)) if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "ord long, a string, b string, c array<string>").dropDuplicates(["ord"])
    rows = df.collect()
    index = bitmaps.build(df, ["a", "b", "c"])
    chosen = {"a": ["x", "y"], "c": ["k", "l"], "b": []}
    hit = lambda r, skip=None: (skip == "a" or r.a in "xy") and (skip == "c" or any(v in "kl" for v in r.c or []))
    assert bitmaps.count(index, chosen).first().n == sum(map(hit, rows)) > 0
    assert bitmaps.count(index, {}).first().n == len(rows) and bitmaps.count(index, {"a": ["none"]}).first().n == 0
    assert {r.value: r.n for r in bitmaps.options(index, "c", chosen).collect()} == {v: sum(hit(r, "c") and v in (r.c or []) for r in rows) for v in "klm"}
    assert {r.value: r.n for r in bitmaps.options(index, "b", chosen).collect()} == {"p": sum(hit(r) and r.b == "p" for r in rows)}
    assert {r.value: r.n for r in bitmaps.options(index, "a", {"b": ["none"]}).collect()} == {"x": 0, "y": 0, "z": 0}
    assert bitmaps.count(bitmaps.build(df.where("false"), ["a"]), {}).first().n == 0


def test_deep_pages_read_their_range_alone(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([1, 2, 2, 3]), rnd.choice("ab")) for i in range(1000)]
    path, order = f"file://{tmp_path}/p", ["d", "id"]
    keyset.build(spark.createDataFrame(rows, "id int, d int, c string"), order, path, size=30, chunk=4)
    want = sorted(rows, key=lambda r: (r[1], r[0]))
    for n in (0, 17, 33, 34):
        assert [r.id for r in keyset.page(spark, path, n, chunk=4).collect()] == [r[0] for r in want[30 * n : 30 * n + 30]]
    for at in (0, 29, 30, 517, 990, 999):
        i, d, _ = want[at]
        got = keyset.after(spark, path, order, (d, i), 12, F.col("c") == "a", chunk=4)
        assert [r.id for r in got.collect()] == [r[0] for r in want[at + 1 :] if r[2] == "a"][:12]
    assert [r.id for r in keyset.after(spark, path, order, (-5, 0), 3, chunk=4).collect()] == [r[0] for r in want[:3]]
    found = keyset.page(spark, path, 17, chunk=4)
    assert "PartitionFilters: [isnotnull(chunk" in plan_of(found) and "EqualTo(page,17)" in plan_of(found)
    bounds = spark.read.parquet(f"{path}/bounds").orderBy("page").collect()
    assert len(bounds) == 34 and all((b.first.d, b.first.id) == (want[b.start][1], want[b.start][0]) for b in bounds)
