"""Comparing snapshots: what to refetch, what to keep, what to carry, what went missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def refresh(listed: DataFrame, cache: DataFrame) -> DataFrame:
    """url and action of each listed or cached link: reuse (same lastmod), refetch, or evict."""
    both = listed.select("url", F.col("lastmod").alias("now"), F.lit(True).alias("l")).join(cache.select("url", F.col("lastmod").alias("was"), F.lit(True).alias("c")), "url", "full_outer")
    same = F.col("c").isNotNull() & F.col("now").eqNullSafe(F.col("was"))
    return both.select("url", F.when(F.col("l").isNull(), "evict").when(same, "reuse").otherwise("refetch").alias("action"))


def stale(rows: DataFrame, as_of: str, future_days: int = 3, empty_days: int = 14) -> DataFrame:
    """rows with stale: a past event never is, a future one after 3 days, an empty page after 14."""
    now = F.lit(as_of).cast("timestamp_ntz")
    age = lambda d: F.col("fetched_at") < now - F.make_interval(days=F.lit(d))
    return rows.withColumn("stale", F.when(F.col("start").isNull(), age(empty_days)).when(F.col("start") < now, F.lit(False)).otherwise(age(future_days)))


def kept_rows(now: DataFrame, before: DataFrame, failed: DataFrame, host: str) -> DataFrame:
    """This run's rows, and last run's for hosts that were not read this time."""
    return now.unionByName(before.join(failed.select(host).distinct(), host, "left_semi").join(now.select(host).distinct(), host, "left_anti"))


def merged(old: DataFrame, new: DataFrame, key: str, measured: list[str], curated: list[str]) -> DataFrame:
    """New measurements over old ones; hand-set columns stay; rows missing now survive."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in measured], *[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in curated])


def lost(now: DataFrame, before: DataFrame, key: str, fall: float = 0.5) -> DataFrame:
    """Counts of both snapshots by key, with the verdict lost, empty, dropped, new or ok."""
    both = now.groupBy(key).agg(F.count("*").alias("now")).join(before.groupBy(key).agg(F.count("*").alias("before")), key, "full_outer")
    both = both.select(key, F.coalesce("now", F.lit(0)).alias("now"), F.coalesce("before", F.lit(0)).alias("before"))
    verdict = F.when(F.col("before") == 0, "new").when(F.col("now") == 0, "lost").when(F.col("now") < F.col("before") * fall, "dropped").otherwise("ok")
    return both.withColumn("verdict", verdict)


def carried(now: DataFrame, before: DataFrame, strikes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows and verdicts: a part that fell silent reuses its last rows once; the second time it fails."""
    quiet = before.select(key).distinct().join(now.select(key).distinct(), key, "left_anti").join(strikes.select(key, "strikes"), key, "left").withColumn("strikes", F.coalesce("strikes", F.lit(0)))
    verdicts = quiet.select(key, F.when(F.col("strikes") >= 1, "failed").otherwise("carried").alias("verdict"), (F.col("strikes") + 1).alias("strikes"))
    again = before.join(verdicts.where("verdict = 'carried'").select(key), key, "left_semi")
    return now.unionByName(again), verdicts


def vanished(before: DataFrame, now: DataFrame, column: str) -> DataFrame:
    return before.select(column).distinct().exceptAll(now.select(column).distinct())


def drifted(places: DataFrame, overrides: DataFrame) -> DataFrame:
    """Names overridden by id, with a warning where the place is no longer called what it was."""
    both = places.join(overrides.select("osm_id", F.col("name").alias("_new"), "was"), "osm_id", "left")
    warn = F.col("was").isNotNull() & ~F.col("name").eqNullSafe(F.col("was"))
    return both.withColumn("warning", warn).withColumn("name", F.coalesce("_new", "name")).drop("_new", "was")


def two_keys(asks: DataFrame, by_id: DataFrame, by_host: DataFrame) -> DataFrame:
    """The value found by numeric id, else by website host."""
    one = asks.join(by_id.select("osm_id", F.col("value").alias("_a")), "osm_id", "left").join(by_host.select("host", F.col("value").alias("_b")), "host", "left")
    return one.withColumn("value", F.coalesce("_a", "_b")).drop("_a", "_b")


def run_warnings(registry_before: DataFrame, registry_now: DataFrame, fetches: DataFrame, source: str, most_failed: float = 0.2) -> DataFrame:
    """(source, warning, n, of): registries with under half of last run's entries, and sources where over a fifth of fetches failed.

    fetches: source, ok. A source that was not there before, or fetched nothing, warns of nothing.
    """
    halved = lost(registry_now, registry_before, source).where((F.col("before") > 0) & (F.col("now") * 2 < F.col("before")))
    failed = fetches.groupBy(source).agg(F.count_if(~F.col("ok")).alias("n"), F.count("*").alias("of")).where(F.col("n") > F.col("of") * most_failed)
    return halved.select(source, F.lit("registry halved").alias("warning"), F.col("now").alias("n"), F.col("before").alias("of")).unionByName(failed.select(source, F.lit("fetches failed").alias("warning"), "n", "of"))
