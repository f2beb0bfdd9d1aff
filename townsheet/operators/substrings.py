"""Text search by substring over a stored inverted index of character trigrams.

``build(texts, path)`` writes two tables: ``postings`` (gram, block, n, first, gaps) with the ordinals of
the texts that hold a trigram, in blocks of ordinals, as a first one and gaps; and ``texts`` (ord, id, name).
Postings are sorted by gram, so that a search for one reads the row groups that hold it. A gram that is
in a third of all texts has many blocks, none of which is larger than ``BLOCK``.

``search`` takes the trigrams of the text asked for, reads how often each occurs, and opens only the
postings of the rarest few; what is left is verified against the texts. ``contained`` does so for a table
of asked texts at once. Asked texts under three characters scan the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of a gram, ordinals of a block, and grams of an asked text that are opened.
GRAM, BLOCK, OPENED = 3, 1 << 16, 3


def grams(text: Column, n: int = GRAM) -> Column:
    """Distinct n-grams of a text; none of a shorter one. Each offset cuts the text once from its start, so long texts take linear time."""
    cuts = [F.regexp_extract_all(F.substr(text, F.lit(i + 1)), F.lit(f"(?s).{{{n}}}"), F.lit(0)) for i in range(n)]
    return F.array_distinct(F.concat(*cuts))


def build(texts: DataFrame, path: str, id: str = "id", name: str = "name") -> None:
    """Index lower-cased names, one ordinal a distinct name (ids share it); null names are left out."""
    spark = texts.sparkSession
    rows = texts.select(F.col(id).alias("id"), F.lower(F.col(name)).alias("name")).where("name is not null")
    # ordinals are dense within a partition; blocks are made of their low bits
    rows.groupBy("name").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("ord", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/texts")
    named = spark.read.parquet(f"{path}/texts")
    one = named.select(F.explode(grams(F.col("name"))).alias("gram"), "ord")
    lists = one.groupBy("gram", F.floor(F.col("ord") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list("ord")).alias("o"))
    gaps = F.zip_with(F.slice("o", 2, F.greatest(F.size("o") - 1, F.lit(0))), F.slice("o", 1, F.greatest(F.size("o") - 1, F.lit(0))), lambda b, a: (b - a).cast("int"))
    packed = lists.select("gram", "block", F.size("o").alias("n"), F.get("o", F.lit(0)).alias("first"), gaps.alias("gaps"))
    packed.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(f"{path}/postings")


def opened(postings: DataFrame, *keys: str) -> DataFrame:
    """keys and ord of each posting: the first ordinal and the running sums of the gaps."""
    flat = postings.select(*keys, "block", "first", F.posexplode(F.concat(F.array(F.lit(0)), "gaps")).alias("at", "gap"))
    w = Window.partitionBy(*keys, "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return flat.select(*keys, (F.col("first") + F.sum("gap").over(w)).alias("ord"))


def frequencies(spark: SparkSession, path: str, asked: list[str]) -> dict[str, int]:
    """Texts that hold each of a few grams; reads two columns of their rows."""
    rows = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(asked)).groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(asked, 0) | {r.gram: r.n for r in rows}


def rarest(spark: SparkSession, path: str, text: str) -> list[str]:
    text = text.lower()
    asked = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
    held = frequencies(spark, path, asked)
    return sorted(asked, key=lambda g: (held[g], g))[:OPENED]


def search(spark: SparkSession, path: str, text: str) -> DataFrame:
    """id and name of the texts that contain the text, whatever its case; nothing asked is all."""
    named = spark.read.parquet(f"{path}/texts")
    text = text.lower()
    if len(text) >= GRAM:
        postings = spark.read.parquet(f"{path}/postings")
        lists = [opened(postings.where(F.col("gram") == g), "gram").select("ord") for g in rarest(spark, path, text)]
        named = named.join(reduce(lambda a, b: a.join(b, "ord", "left_semi"), lists), "ord", "left_semi")
    return named.where(F.col("name").contains(text)).select(F.explode("ids").alias("id"), "name")


def contained(asks: DataFrame, spark: SparkSession, path: str, key: str = "key", name: str = "name") -> DataFrame:
    """key, id and name for every asked text and indexed name that contains it. Asked texts are looked up once each."""
    asked = asks.select(F.lower(F.col(name)).alias("q")).where("q <> ''").distinct()
    postings, named = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/texts")
    wanted = asked.select("q", F.explode(grams(F.col("q"))).alias("gram"))
    held = postings.groupBy("gram").agg(F.sum("n").alias("held"))
    # a gram that no text holds answers for its text, so it ranks first
    ranked = wanted.join(held, "gram", "left").groupBy("q").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram"))).alias("g"))
    few = ranked.select("q", F.slice("g", 1, OPENED).alias("g")).select("q", F.size("g").alias("of"), F.explode("g").alias("g")).select("q", "of", "g.gram")
    met = few.join(opened(postings.join(few.select("gram").distinct(), "gram", "left_semi"), "gram"), "gram")
    found = met.groupBy("q", "ord").agg(F.count("*").alias("n"), F.first("of").alias("of")).where("n = of").join(named, "ord")
    short = asked.where(F.length("q") < GRAM).join(named, F.col("name").contains(F.col("q")))
    pairs = found.where(F.col("name").contains(F.col("q"))).select("q", "ids", "name").unionByName(short.select("q", "ids", "name"))
    return asks.select(F.col(key).alias("key"), F.lower(F.col(name)).alias("q")).join(pairs, "q").select("key", F.explode("ids").alias("id"), pairs["name"])
