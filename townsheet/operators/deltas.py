"""Aggregates kept up to date by signed rows instead of being counted again.

A state is three tables by key: ``totals`` (n and sums), and ``values``, a multiset (value, n) of a column
whose least and greatest value are asked for, since a minimum cannot be lowered again when its row goes.
``changes`` compares two snapshots by their key and gives every row that came with sign 1 and every row
that went with sign -1; a changed row is both. ``applied`` adds them, and ``read`` is the answer. All are
sums, so runs can be applied in any order, and only keys that changed have to be written again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class State:
    totals: DataFrame
    values: DataFrame


def changes(before: DataFrame, now: DataFrame, id: str) -> DataFrame:
    """Rows of either snapshot that the other lacks or has otherwise, with sign. Unchanged rows cancel out here."""
    signed = now.withColumn("sign", F.lit(1)).unionByName(before.withColumn("sign", F.lit(-1)))
    # a row known by its id: one that is the same in both adds up to nothing
    same = [c for c in signed.columns if c != "sign"]
    return signed.groupBy(*same).agg(F.sum("sign").alias("sign")).where("sign <> 0")


def refreshed(plan: DataFrame, before: DataFrame, fetched: DataFrame, url: str) -> DataFrame:
    """The same from a refresh plan (url, action) and the rows that were fetched: reused links send nothing."""
    gone = before.join(plan.where("action <> 'reuse'").select(url), url, "left_semi").withColumn("sign", F.lit(-1).cast("long"))
    come = fetched.join(plan.where("action = 'refetch'").select(url), url, "left_semi").withColumn("sign", F.lit(1).cast("long"))
    return gone.unionByName(come)


def state(signed: DataFrame, keys: list[str], sums: list[str], value: str) -> State:
    """The state that signed rows make by themselves. Null sums count as 0, null values are not held."""
    totals = signed.groupBy(*keys).agg(F.sum("sign").alias("n"), *[F.sum(F.coalesce(F.col(c) * F.col("sign"), F.lit(0))).alias(c) for c in sums])
    values = signed.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.sum("sign").alias("n"))
    return State(totals, values.where("n <> 0"))


def counted(rows: DataFrame, keys: list[str], sums: list[str], value: str) -> State:
    return state(rows.withColumn("sign", F.lit(1).cast("long")), keys, sums, value)


def applied(old: State, delta: State, keys: list[str]) -> State:
    """old with delta; keys without rows and values without holders are gone."""
    sums = [c for c in old.totals.columns if c not in keys]
    totals = old.totals.unionByName(delta.totals).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).where("n <> 0")
    values = old.values.unionByName(delta.values).groupBy(*keys, "value").agg(F.sum("n").alias("n")).where("n <> 0")
    return State(totals, values)


def read(held: State, keys: list[str], total: str | None = None) -> DataFrame:
    """keys, n, sums, least, greatest and kinds (distinct values); under ``total``, if named, the sum of the values too.

    Values that are doubles are held as they are, so two that differ in their last bit are two kinds. Their
    sum is made of decimals to ten places, whatever the order of rows, unless one is beyond these (NaN,
    infinite, huge).
    """
    aggs = [F.min("value").alias("least"), F.max("value").alias("greatest"), F.count("*").alias("kinds")]
    if total:
        exact = F.col("value").try_cast("decimal(27,10)")  # times decimal(10,0) gives 38 digits: none is cut
        summed = F.when(F.count(exact) == F.count("*"), F.try_sum(exact * F.col("n").cast("decimal(10,0)")).cast("double"))
        aggs.append(F.coalesce(summed, F.sum(F.col("value").cast("double") * F.col("n"))).alias(total))
    ends = held.values.groupBy(*keys).agg(*aggs)
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    joined = held.totals.alias("t").join(ends.alias("e"), on, "left")
    return joined.select("t.*", "e.least", "e.greatest", F.coalesce("e.kinds", F.lit(0)).alias("kinds"), *[F.col(f"e.{total}")] * bool(total))


def broken(held: State) -> DataFrame:
    """Keys whose state no rows can have made: applied twice, or against the wrong version."""
    return held.totals.where("n < 0").select(*[c for c in held.totals.columns if c != "n"], "n")
