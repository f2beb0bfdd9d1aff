"""Deep pages of a fixed order without sorting: a clustered table that knows its pages.

``build(rows, order, path, size)`` range-partitions rows by their order, sorts within partitions, and numbers
them: counts of partitions, taken from what was written, are summed up, so no task sees all rows. The table
is stored by ``chunk`` (so many pages a folder) with ``at`` (place in the order) and ``page``. ``bounds`` has a
row for each page: its first key and its rows. A page, or the rows after a key, reads the folders and row
groups of its range alone, and sorts one page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from townsheet.operators.store import saved

#: Pages in a folder.
CHUNK = 64


def build(rows: DataFrame, order: list[str], path: str, size: int = 250, chunk: int = CHUNK) -> None:
    """``order`` has to tell rows apart; nulls come first."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    table = saved(ranged.withColumn("_m", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_m", 33)
    totals = table.groupBy(part.alias("_p")).agg(F.count("*").alias("n"), F.min("_m").alias("_first"))  # a row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = totals.select("_p", (before - F.col("_first")).alias("_shift"))
    placed = table.withColumn("_p", part).join(F.broadcast(shifts), "_p").withColumn("at", F.col("_m") + F.col("_shift")).drop("_m", "_p", "_shift")
    paged = placed.withColumn("page", F.floor(F.col("at") / size)).withColumn("chunk", F.floor(F.col("page") / chunk))
    paged.repartitionByRange("at").sortWithinPartitions("at").write.mode("overwrite").partitionBy("chunk").parquet(f"{path}/rows")
    made = rows.sparkSession.read.parquet(f"{path}/rows")
    keys = F.min_by(F.struct(*order), "at").alias("first")
    made.groupBy("page").agg(keys, F.min("at").alias("start"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/bounds")


def page(spark: SparkSession, path: str, number: int, chunk: int = CHUNK) -> DataFrame:
    """Rows of a page, in order."""
    rows = spark.read.parquet(f"{path}/rows")
    return rows.where((F.col("chunk") == number // chunk) & (F.col("page") == number)).drop("chunk").orderBy("at")


def later(order: list[str], key: tuple) -> Column:
    """Whether a row comes after a key, as conditions on plain columns that a scan can skip by."""
    ties = [reduce(lambda a, b: a & b, [F.col(c) == k for c, k in zip(order[:i], key)], F.lit(True)) & (F.col(order[i]) > key[i]) for i in range(len(order))]
    return (F.col(order[0]) >= key[0]) & reduce(lambda a, b: a | b, ties)


def after(spark: SparkSession, path: str, order: list[str], key: tuple, limit: int, where: Column | None = None, chunk: int = CHUNK) -> DataFrame:
    """The next rows after a key that match; pages before the key's own are not read."""
    bounds = spark.read.parquet(f"{path}/bounds")
    held = bounds.where(~later([f"first.{c}" for c in order], key)).agg(F.max("page").alias("p")).first().p  # its page starts at or before it
    rows = spark.read.parquet(f"{path}/rows").where((F.col("chunk") >= (held or 0) // chunk) & (F.col("page") >= (held or 0)) & later(order, key))
    rows = rows if where is None else rows.where(where)
    return rows.drop("chunk").orderBy("at").limit(limit)
