"""Places by ordered strategies: coordinates, then register, then gazetteer; the first answer wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townsheet.functions.text import name_variants, norm


def register_of(parks: DataFrame) -> DataFrame:
    """name, lat, lon by normalised name; the first park (by ord) keeps a name."""
    rows = parks.select("ord", F.posexplode("names").alias("pos", "raw"), "lat", "lon").select(norm(F.col("raw")).alias("name"), "ord", "pos", "lat", "lon").where("name <> ''")
    return rows.groupBy("name").agg(F.min_by(F.struct("lat", "lon"), F.struct("ord", "pos")).alias("at")).select("name", "at.lat", "at.lon")


def gazetteer_of(cache: DataFrame) -> DataFrame:
    """name, lat, lon by normalised location; the last entry (by ord) keeps a name; null hits are no answer."""
    rows = cache.where("hit is not null").select(norm(F.col("location")).alias("name"), "ord", "hit.lat", "hit.lon")
    return rows.groupBy("name").agg(F.max_by(F.struct("lat", "lon"), "ord").alias("at")).select("name", "at.lat", "at.lon")


def resolve(places: DataFrame, register: DataFrame, gazetteer: DataFrame, key: str = "key", name: str = "name") -> DataFrame:
    """key, lat, lon, location_source of every row; unresolved rows keep nulls.

    Distinct names are looked up once each, however many rows ask; variants keep their order, and
    the register is asked for every variant before the gazetteer is.
    """
    asked = places.where("lat is null or lon is null").select(F.col(name).alias("raw")).where("raw is not null").distinct()
    variants = asked.select("raw", F.posexplode(name_variants(F.col("raw"))).alias("pos", "variant")).withColumn("name", norm(F.col("variant")))
    tables = [(0, "register", register), (1, "gazetteer", gazetteer)]
    hits = [variants.join(t.select("name", "lat", "lon"), "name").select("raw", F.struct(F.lit(i).alias("tier"), "pos").alias("o"), F.struct("lat", "lon", F.lit(s).alias("source")).alias("hit")) for i, s, t in tables]
    best = hits[0].unionByName(hits[1]).groupBy("raw").agg(F.min_by("hit", "o").alias("hit"))
    stated = F.when(F.col("p.lat").isNotNull() & F.col("p.lon").isNotNull(), F.struct(F.col("p.lat").cast("double").alias("lat"), F.col("p.lon").cast("double").alias("lon"), F.lit("coordinates").alias("source")))
    joined = places.alias("p").join(best, F.col(f"p.{name}") == best["raw"], "left").withColumn("at", F.coalesce(stated, "hit"))
    return joined.select(F.col(f"p.{key}").alias(key), "at.lat", "at.lon", F.col("at.source").alias("location_source"))


def first_match(asks: DataFrame, tries: list[Column], table: DataFrame, key: str = "key") -> DataFrame:
    """The value of the first try that is in the table, exact but for case; table: name, value."""
    tried = asks.select(key, F.posexplode(F.transform(F.array(*tries), lambda t: F.lower(F.trim(t)))).alias("pos", "name")).where("name <> ''")
    return tried.join(table.select(F.lower("name").alias("name"), "value"), "name").groupBy(key).agg(F.min_by("value", "pos").alias("value"))


#: Characters of a piece by which names are met.
PIECE = 6


def unique_contained(asks: DataFrame, names: DataFrame, key: str = "key") -> DataFrame:
    """The one point whose name contains the asked name or is contained in it, as text.

    Only names of several words take part, and an ask that meets several points has no answer. A name
    within another shares every piece of it, so the contained name is sent by its rarest piece of six
    characters (a name of fewer by itself cut at each length) and met by all pieces of the other.
    """
    a = asks.select(norm(F.col("name")).alias("a")).where(F.col("a").contains(" ")).distinct()
    b = names.select(norm(F.col("name")).alias("b"), "lat", "lon").where(F.col("b").contains(" ")).distinct()
    texts = a.select(F.col("a").alias("t")).union(b.select("b")).distinct()
    cut = lambda t, n: F.when(F.length(t) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substr(t, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))
    t = F.col("t")
    pieces = texts.select("t", F.explode(F.when(F.length(t) >= PIECE, cut(t, PIECE)).otherwise(F.array(t))).alias("p"))
    common = pieces.groupBy("p").agg(F.count("*").alias("n"))
    sent = pieces.join(common, "p").groupBy("t").agg(F.min(F.struct("n", "p")).alias("s")).select("t", "s.p")
    # a shorter name is a piece itself: the others are cut at its length too (3 is the least that two words have)
    short = [cut(t, n) for n in range(3, PIECE)]
    met = texts.select("t", F.explode(F.concat(cut(t, PIECE), *short, F.array(t))).alias("p")).distinct()
    pairs = sent.withColumnRenamed("t", "inner").join(met.withColumnRenamed("t", "outer"), "p").where(F.col("outer").contains(F.col("inner"))).select("inner", "outer").distinct()
    either = pairs.select(F.col("inner").alias("a"), F.col("outer").alias("b")).union(pairs.select("outer", "inner")).distinct()
    point = F.struct(F.round("lat", 6), F.round("lon", 6))
    hit = a.join(either, "a").join(b, "b").groupBy("a").agg(F.count_distinct(point).alias("n"), F.min(F.struct("lat", "lon")).alias("at")).where("n = 1")
    return asks.select(key, norm(F.col("name")).alias("a")).join(hit, "a").select(key, "at.lat", "at.lon")


def unplaced(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct locations before a colon that the cache was never asked: location, n, first borough."""
    asked = rows.withColumn("location", F.trim(F.substring_index("location", ":", 1))).where("location <> ''")
    wanted = asked.groupBy("location").agg(F.count("*").alias("n"), F.min_by("borough", F.when(F.col("borough").isNotNull(), F.col("ord"))).alias("borough"))
    return wanted.join(cache.select("location").distinct(), "location", "left_anti")
