"""Faceted counts from bitmaps of rows, one for each facet value.

``build(rows, facets)`` numbers rows densely enough to pack (``ord``, a long from 0) and keeps, for each facet
value and bucket of 32,768 rows, the bitmap of those that have it. A selection (values of one facet ORed,
facets ANDed) and the count of each option under the *other* facets' selections are then ORs and ANDs of
bitmaps, bucket by bucket; the rows themselves are not read again. Array columns have a bit for each value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build(rows: DataFrame, facets: list[str], ord: str = "ord") -> DataFrame:
    """facet, value, bucket, bits. Null values have no bitmap; the facet "" has a bit for every row."""
    kinds = dict(rows.dtypes)

    def values(facet: str) -> Column:
        held = F.col(facet) if kinds[facet].startswith("array") else F.array(F.col(facet).cast("string"))
        return F.transform(F.filter(F.coalesce(held, F.array()), lambda v: v.isNotNull()), lambda v: F.struct(F.lit(facet).alias("facet"), v.cast("string").alias("value")))

    every = F.array(F.struct(F.lit("").alias("facet"), F.lit("").alias("value")))
    one = rows.select((F.col(ord) + 1).alias("o"), F.explode(F.array_distinct(F.concat(every, *map(values, facets)))).alias("f")).select("o", "f.*")
    return one.groupBy("facet", "value", F.bitmap_bucket_number("o").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("o")).alias("bits"))


def _ored(index: DataFrame, facet: str, values: list[str]) -> DataFrame:
    return index.where((F.col("facet") == facet) & F.col("value").isin(values)).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def _anded(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """The AND of parts' bitmaps; a bucket that one of them lacks is empty."""
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy(*by).agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("parts")).where(F.col("parts") == len(parts)).drop("parts")


def selected(index: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """bucket and bits of the rows that have a chosen value of every facet; nothing chosen is all rows."""
    parts = [_ored(index, f, v) for f, v in chosen.items() if v] or [_ored(index, "", [""])]
    return _anded(parts, ["bucket"])


def count(index: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    return selected(index, chosen).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def options(index: DataFrame, facet: str, chosen: dict[str, list[str]]) -> DataFrame:
    """facet, value and n: rows that have the value and match what is chosen of the other facets; zeros are kept."""
    own = index.where(F.col("facet") == facet).select("value", "bucket", "bits")
    others = selected(index, {f: v for f, v in chosen.items() if f != facet})
    # each value's buckets meet the others' bitmap of that bucket
    met = own.join(others.select("bucket").distinct(), "bucket", "left_semi")
    theirs = met.select("value", "bucket").join(others, "bucket").select("value", "bucket", "bits")
    n = _anded([met.select("value", "bucket", "bits"), theirs], ["value", "bucket"]).groupBy("value").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    return own.select("value").distinct().join(n, "value", "left").select(F.lit(facet).alias("facet"), "value", F.coalesce("n", F.lit(0)).alias("n"))
