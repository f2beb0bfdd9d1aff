"""Points, polygons and nearest stations as equi-joins on grid cells.

Areas: ``ord, slug, rings array<struct<outer:array<struct<x,y>>,holes:array<array<struct<x,y>>>>>``.
Both joins meet on the cells of a grid, so they shuffle or broadcast like any equi-join; ray casting
and distances run only on candidates of one cell. Points should be distinct before they come here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metres in a degree at the city's latitude, 40.7 degrees. Fixed values.
LAT_M = 111_320.0
NARROW = math.cos(math.radians(40.7))
LON_M = LAT_M * NARROW
REACH = 1600.0


def meters(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """In the steps of the SQL, so that stations as far as each other are told apart (or not) by the same last bits."""
    x, y = (lon1 - lon2) * LAT_M * NARROW, (lat1 - lat2) * LAT_M
    return F.sqrt(x * x + y * y)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a ray to the right crosses the ring an odd number of times; an empty ring holds nothing."""
    n = F.size(ring)
    before = F.concat(F.slice(ring, F.greatest(n, F.lit(1)), F.lit(1)), F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))))

    def crosses(a: Column, b: Column) -> Column:
        # the edge straddles the ray's height, and the point lies on the side of the edge where x is smaller
        side = (b["x"] - a["x"]) * (y - a["y"]) - (x - a["x"]) * (b["y"] - a["y"])
        return ((a["y"] > y) != (b["y"] > y)) & F.when(b["y"] > a["y"], side > 0).otherwise(side < 0)

    return F.aggregate(F.zip_with(ring, before, crosses), F.lit(False), lambda odd, c: odd != c)


def in_rings(x: Column, y: Column, rings: Column) -> Column:
    return F.exists(rings, lambda r: in_ring(x, y, r["outer"]) & ~F.exists(r["holes"], lambda h: in_ring(x, y, h)))


def bounds(rings: Column) -> dict[str, Column]:
    points = F.flatten(F.transform(rings, lambda r: r["outer"]))
    return {f"{c}{k}": f(F.transform(points, _axis(c))) for c in "xy" for k, f in ((0, F.array_min), (1, F.array_max))}


def _axis(name: str):
    return lambda p: p[name]


def covered(areas: DataFrame, cell: float) -> DataFrame:
    """Areas with their box, once for each grid cell that the box meets."""
    boxed = areas.select("*", *[c.alias(n) for n, c in bounds(F.col("rings")).items()])
    steps = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    return boxed.withColumn("cx", F.explode(steps("x0", "x1"))).withColumn("cy", F.explode(steps("y0", "y1")))


def locate(points: DataFrame, areas: DataFrame, key: str, x: str = "lon", y: str = "lat", cell: float = 0.02) -> DataFrame:
    """key and ord of the first area, in order, that holds each point; points in none are left out."""
    cells = points.select(key, F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).where("px is not null and py is not null")
    cells = cells.withColumn("cx", F.floor(F.col("px") / cell)).withColumn("cy", F.floor(F.col("py") / cell))
    near = cells.join(covered(areas.select("ord", "rings"), cell), ["cx", "cy"]).where("px between x0 and x1 and py between y0 and y1")
    return near.where(in_rings(F.col("px"), F.col("py"), F.col("rings"))).groupBy(key).agg(F.min("ord").alias("ord"))


def _edges(areas: DataFrame) -> DataFrame:
    """ord and the ends of every edge of every ring."""
    rings = F.flatten(F.transform("rings", lambda r: F.concat(F.array(r["outer"]), r["holes"])))
    ring = areas.select("ord", F.explode(rings).alias("ring")).where("size(ring) > 0")
    ends = F.zip_with("ring", F.concat(F.slice("ring", 2, F.greatest(F.size("ring"), F.lit(1))), F.slice("ring", 1, 1)), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return ring.select("ord", F.explode(ends).alias("e")).select("ord", "e.*")


def _touches(size: float) -> Column:
    """Whether the edge x1, y1, x2, y2 meets the closed cell cx, cy (a hair wider, so that rounding errs to yes)."""
    half = size / 2 * (1 + 1e-9)
    mx, my = (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ax, ay = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    box = (F.abs(ax - mx) <= half + F.abs(dx) / 2) & (F.abs(ay - my) <= half + F.abs(dy) / 2)
    return box & (F.abs(dx * (my - ay) - dy * (mx - ax)) <= half * (F.abs(dx) + F.abs(dy)))


def cover(areas: DataFrame, cell: float = 0.02, levels: int = 4) -> DataFrame:
    """A quadtree of each area: (ord, level, cx, cy, inside). Cells of a level are cell / 2^level wide.

    A cell that an edge meets is parted in four, down to the last level, and carries only the edges that
    meet it; a cell that none meets lies wholly in or out, which its middle tells, and is kept if it is in.
    So ``inside`` cells answer without ray casting, and the others, all of the last level, hold a border.
    """
    named = areas.select("ord", "rings")
    met = _edges(named)
    steps = lambda a, b: F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))
    met = met.withColumn("cx", F.explode(steps("x1", "x2"))).withColumn("cy", F.explode(steps("y1", "y2"))).where(_touches(cell))
    every = covered(named, cell).select("ord", "cx", "cy")
    kept = None
    quarters = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    part = lambda df: df.withColumn("_q", quarters).withColumn("cx", F.col("cx") * 2 + F.col("_q.i")).withColumn("cy", F.col("cy") * 2 + F.col("_q.j")).drop("_q")
    for level in range(levels + 1):
        size = cell / (1 << level)
        border = met.select("ord", "cx", "cy").distinct()
        plain = every.join(border, ["ord", "cx", "cy"], "left_anti").join(named, "ord")
        whole = plain.where(in_rings((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, F.col("rings")))
        here = whole.select("ord", F.lit(level).alias("level"), "cx", "cy", F.lit(True).alias("inside"))
        if level == levels:
            here = here.unionByName(border.select("ord", F.lit(level).alias("level"), "cx", "cy", F.lit(False).alias("inside")))
        kept = here if kept is None else kept.unionByName(here)
        met = part(met).where(_touches(size / 2))
        every = part(border)
    return kept


def locate_by_cover(points: DataFrame, areas: DataFrame, cells: DataFrame, key: str, x: str = "lon", y: str = "lat", cell: float = 0.02, levels: int = 4) -> DataFrame:
    """key, ord and cast of each point in an area: like :func:`locate`, over a stored cover of the areas.

    A point asks once at every level; only points in border cells are cast, and ``cast`` says so. Cells
    of many points are no harder than others: what meets a cell is reduced by point before it is sorted.
    """
    at = points.select(key, F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).where("px is not null and py is not null")
    asked = F.array(*[F.struct(F.lit(i).alias("level"), F.floor(F.col("px") / (cell / (1 << i))).alias("cx"), F.floor(F.col("py") / (cell / (1 << i))).alias("cy")) for i in range(levels + 1)])
    met = at.withColumn("_c", F.explode(asked)).select(key, "px", "py", "_c.*").join(cells, ["level", "cx", "cy"])
    sure = met.where("inside").select(key, "ord", F.lit(False).alias("cast"))
    unsure = met.where("not inside").join(areas.select("ord", "rings"), "ord").where(in_rings(F.col("px"), F.col("py"), F.col("rings"))).select(key, "ord", F.lit(True).alias("cast"))
    return sure.unionByName(unsure).groupBy(key).agg(F.min(F.struct("ord", "cast")).alias("m")).select(key, "m.ord", "m.cast")


def nearest(points: DataFrame, stations: DataFrame, key: str, limit: int = 2, reach: float = REACH) -> DataFrame:
    """key and near, an array of (meters, id) of the closest stations within reach, closest first.

    Stations go to the nine cells around them; a cell is as wide as the reach (and a hair, for rounding), so
    no pair is lost. Of the stations at one spot only the least ``limit`` ids can be among the closest, so the
    others stay behind, and a point meets the spots around it, however many stations these hold.
    """
    high, wide = reach / LAT_M * (1 + 1e-9), reach / LON_M * (1 + 1e-9)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spot = Window.partitionBy("slat", "slon").orderBy("sid")
    spread = stations.select(F.col("id").alias("sid"), F.col("lat").alias("slat"), F.col("lon").alias("slon")).where("slat is not null and slon is not null")
    spread = spread.withColumn("r", F.row_number().over(spot)).where(F.col("r") <= limit).drop("r")
    spread = spread.withColumn("dy", F.explode(around)).withColumn("dx", F.explode(around))
    spread = spread.select("sid", "slat", "slon", (F.floor(F.col("slat") / high) + F.col("dy")).alias("cy"), (F.floor(F.col("slon") / wide) + F.col("dx")).alias("cx"))
    at = points.where("lat is not null and lon is not null").select(key, "lat", "lon", F.floor(F.col("lat") / high).alias("cy"), F.floor(F.col("lon") / wide).alias("cx"))
    pairs = at.join(spread, ["cx", "cy"]).withColumn("m", meters(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))).where(F.col("m") <= reach)
    rank = Window.partitionBy(key).orderBy("m", "sid")
    best = pairs.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= limit)
    return best.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", F.rint("m").cast("long").alias("meters"), F.col("sid").alias("id")))), lambda s: F.struct(s["meters"].alias("meters"), s["id"].alias("id"))).alias("near"))


def interior(ring: Column) -> Column:
    """The vertex mean of a ring if it lies inside, else the middle of the widest span on its mid-height."""
    mean = lambda name: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[name]) / F.size(ring)
    mx, my = mean("x"), mean("y")
    ys = F.transform(ring, _axis("y"))
    level = (F.array_min(ys) + F.array_max(ys)) / 2
    n = F.size(ring)
    before = F.concat(F.slice(ring, n, F.lit(1)), F.slice(ring, F.lit(1), n - 1))
    hits = F.zip_with(ring, before, lambda a, b: F.when((a["y"] > level) != (b["y"] > level), (b["x"] - a["x"]) * (level - a["y"]) / (b["y"] - a["y"]) + a["x"]))
    xs = F.sort_array(F.filter(hits, lambda h: h.isNotNull()))
    spans = F.transform(F.sequence(F.lit(0), F.greatest((F.size(xs) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct((F.get(xs, i * 2 + 1) - F.get(xs, i * 2)).alias("w"), ((F.get(xs, i * 2 + 1) + F.get(xs, i * 2)) / 2).alias("x")))
    inside = in_ring(mx, my, ring)
    return F.struct(F.when(inside, mx).otherwise(F.array_max(spans)["x"]).alias("x"), F.when(inside, my).otherwise(level).alias("y"))
