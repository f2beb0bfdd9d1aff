"""Order-dependent operators. ``ord`` columns state the order; nothing depends on partitioning."""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from townsheet.operators.store import saved


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. A map-side minimum keeps a frequent key from filling one task."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def seen_rank(keys: list[str], order: list[str]) -> Column:
    """1 for the first row of a key; keeps the rows that are not first, for counting."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def collapsed(df: DataFrame, keys: list[str], order: list[str], most: int = 2) -> DataFrame:
    """df with ``collapsed``: true for all but the first row of a key that has over ``most`` rows."""
    w = Window.partitionBy(*keys)
    return df.withColumn("collapsed", (F.count("*").over(w) > most) & (F.row_number().over(w.orderBy(*order)) > 1))


def venue_state(df: DataFrame, slug: str, order: list[str]) -> DataFrame:
    """Adds v_name, v_kind, v_borough (first seen) and v_lat, v_lon: the location as of each row.

    The first row with coordinates sets the location for itself and all later rows; so a slug's state is
    one row, made by mergeable aggregates, and each row asks whether it comes before that location.
    """
    o = F.struct(*order)
    here = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), o)
    first = [F.min_by(c, o).alias(f"v_{c}") for c in ("name", "kind", "borough")]
    state = df.groupBy(F.col(slug).alias("_slug")).agg(*first, F.min(here).alias("_since"), F.min_by(F.struct("lat", "lon"), here).alias("_at"))
    known = F.coalesce(o >= F.col("_since"), F.lit(False))
    joined = df.join(state, F.col(slug).eqNullSafe(F.col("_slug")), "left")
    return joined.select(*df.columns, "v_name", "v_kind", "v_borough", F.when(known, F.col("_at.lat")).alias("v_lat"), F.when(known, F.col("_at.lon")).alias("v_lon"))


def venues(df: DataFrame, slug: str, order: list[str]) -> DataFrame:
    """One row per slug: first-seen fields, first coordinates, by mergeable aggregates only."""
    o = F.struct(*order)
    here = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), o)
    return df.groupBy(slug).agg(*[F.min_by(c, o).alias(c) for c in ("name", "kind", "borough")], F.min_by("lat", here).alias("lat"), F.min_by("lon", here).alias("lon"), F.count("*").alias("rows"))


def _dealer():
    """A pass over rows by stem and turn that adds slot and gone: the number of -2 that a row gets behind the stem, or that it goes on."""

    def run(batches):
        stem, free = None, array("q")  # free[i]: i if nobody has it, else a later one that may be free

        def first(i: int) -> int:
            while True:
                if i >= len(free):
                    free.extend(range(len(free), i + 1))
                step = free[i]
                if step == i:
                    free[i] = i + 1
                    return i
                if step < len(free):
                    free[i] = free[step]
                i = step

        for b in batches:
            slots, gone = [], []
            for s, came, base, second, stays in zip(*(b.column(c).to_pylist() for c in ("stem", "came", "base_at", "second_at", "stays")), strict=True):
                if s != stem:
                    stem, free = s, array("q")
                taken = not came and base < len(free) and free[base] != base
                gone.append(taken and not stays)
                slots.append(None if gone[-1] else first(second if came or taken else base))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(slots, pa.int64()), pa.array(gone, pa.bool_())], [*b.schema.names, "slot", "gone"])

    return run


#: Bytes of ids that a task of the last step of :func:`distinct_ids` makes. They grow with the number of rows of a name.
ID_BYTES = 128_000_000


def distinct_ids(df: DataFrame, base: Column, second: Column, order: list[str]) -> DataFrame:
    """Adds id: the first of base, second, second-2, second-2-2 and so on that no earlier row has.

    Rows take turns in ``order``, which should tell them apart (rows that it does not go by base and second).
    An id is a stem and a number of -2 behind it, so rows meet on stems, and a task deals out the numbers of
    a stem in one pass, whatever the length of its line. A row that finds its base taken and whose second
    has another stem goes on to that one. Who goes is told by the pass before, so there are as many passes,
    and two more, as stems hand rows on in a line ("a" to "a-area", and that to "a-area-area"): each settles at least the
    earliest row that was not yet, and once nobody's lot changes, all is as in turns. A row whose second is
    null goes on from its base, one whose base is null has no id.
    """
    ends = r"(?:-2)+\z"
    stem = lambda c: F.regexp_replace(c, ends, "")
    after = lambda c: ((F.length(c) - F.length(stem(c))) / 2).cast("long")
    rows = saved(df.withColumns({"_base": base, "_second": F.coalesce(second, base), "_row": F.monotonically_increasing_id()}), "rows")
    b, s = F.col("_base"), F.col("_second")
    turn = [f"turn{i}" for i in range(len(order))]
    state = rows.where("_base is not null").select(
        "_row", *[F.col(c).alias(t) for c, t in zip(order, turn, strict=True)], stem(b).alias("base_stem"), after(b).alias("base_at"), stem(s).alias("second_stem"), after(s).alias("second_at"),
        (stem(b) == stem(s)).alias("stays"), F.lit(False).alias("goes"),
    )
    while True:
        claims = state.select("*", F.col("base_stem").alias("stem"), F.lit(False).alias("came")).unionByName(state.where("goes").select("*", F.col("second_stem").alias("stem"), F.lit(True).alias("came")))
        dealt = claims.repartition("stem").sortWithinPartitions("stem", *turn, "base_at", "base_stem", "second_stem", "second_at", "_row", "came")
        kinds = T.StructType(claims.schema.fields + [T.StructField("slot", T.LongType()), T.StructField("gone", T.BooleanType())])
        now = saved(dealt.mapInArrow(_dealer(), kinds), "ids")
        state = now.where("not came").withColumn("goes", F.col("gone")).select(*state.columns)
        if now.where("not came and gone <> goes").isEmpty():
            break
    found = now.where("slot is not null").select("_row", "stem", "slot")
    much = found.agg(F.sum(F.octet_length("stem") + 2 * F.col("slot"))).first()[0] or 0
    # an id is put together where it is returned, in tasks by what it comes to
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), much // ID_BYTES + 1)
    joined = rows.repartition(n, "_row").join(found.repartition(n, "_row"), "_row", "left")
    return joined.select(*df.columns, F.concat("stem", F.repeat(F.lit("-2"), F.col("slot").cast("int"))).alias("id"))
