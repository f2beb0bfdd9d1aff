"""Quality gates over listings: structure, freshness, regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townsheet.functions.rules import valid

REQUIRED = ("id", "title", "start_local", "date_local", "venue_id", "category", "subcategory", "source")


def structure(events: DataFrame) -> DataFrame:
    """(severity, rule, key) for each fault: first missing field, vocabulary, order of times, price; repeated ids."""
    missing = F.get(F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), c) for c in REQUIRED])), F.lit(0))
    pair = lambda cond, severity, rule: F.when(cond, F.struct(F.lit(severity).alias("severity"), rule.alias("rule") if not isinstance(rule, str) else F.lit(rule).alias("rule")))
    faults = F.array_compact(F.array(
        pair(missing.isNotNull(), "error", F.concat(F.lit("missing "), missing)), pair(~valid(F.col("category"), F.col("subcategory")), "error", "out of vocabulary"),
        pair(F.col("end_local") < F.col("start_local"), "warning", "ends before it starts"), pair(F.col("is_free") & (F.col("price_min") > 0), "error", "free with a price"),
    ))
    rows = events.select(F.col("id").alias("key"), F.explode(faults).alias("f")).select("f.severity", "f.rule", "key")
    twice = events.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("error").alias("severity"), F.lit("duplicate id").alias("rule"), F.col("id").alias("key"))
    return rows.unionByName(twice)


def freshness(registry: DataFrame, events: DataFrame, today: str) -> DataFrame:
    """One verdict per registered source; a silent source counts 0."""
    n = events.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("date_local") >= today).alias("ahead"))
    rows = registry.join(n, "id", "left").select("id", "min_expected", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ahead", F.lit(0)).alias("ahead"))
    verdict = F.when(F.col("n") == 0, "none").when(F.col("ahead") == 0, "none upcoming").when(F.col("n") < F.col("min_expected"), "below floor").when(F.col("ahead") * 4 < F.col("n") * 3, "mostly past").otherwise("ok")
    return rows.withColumn("verdict", verdict)


def next_week(events: DataFrame, today: str, hard: int = 25, soft: int = 100) -> DataFrame:
    last = F.date_format(F.date_add(F.lit(today).cast("date"), 6), "yyyy-MM-dd")
    n = events.agg(F.count_if(F.col("date_local").between(F.lit(today), last)).alias("n"))
    return n.withColumn("verdict", F.when(F.col("n") < hard, "error").when(F.col("n") < soft, "warning").otherwise("ok"))


def regressions(now: DataFrame, before: DataFrame, most: float = 10.0) -> DataFrame:
    """Categories that vanished, and a fall of placed events by more than ``most`` points."""
    gone = before.select("category").distinct().join(now.select("category").distinct(), "category", "left_anti").select(F.lit("category vanished").alias("rule"), F.col("category").alias("key"))
    share = lambda df, n: df.agg((F.count("neighborhood") * 100.0 / F.greatest(F.count("*"), F.lit(1))).alias(n))
    fall = share(now, "a").join(share(before, "b")).where(F.col("b") - F.col("a") > most).select(F.lit("coverage fell").alias("rule"), F.lit("neighborhood").alias("key"))
    return gone.unionByName(fall)
