import pytest
from pyspark.sql import functions as F

from townsheet.functions import hours, text, times

HOURS = [
    ("24/7", "fffffff"), ("Tu-Su 10:00-17:00", "0333333"), ("Mo-Fr 09:00-17:00", "3333300"),
    ("Mo-Th 16:00-04:00; Fr 14:00-04:00; Sa-Su 12:00-04:00", "fffffff"), ("Th, Fr 19:00-24:00; Sa, Su 16:00-24:00", "000ccee"),
    ("09:00-12:00,13:00-18:00", "7777777"), ("Mo-Su 20:30-04:00", "ddddddd"), ("Mo-Fr 09:00-17:00; PH off", "3333300"),
    ("Su,PH 10:00-18:00", "0000007"), ("Mo-Su 12:00-4:00", "fffffff"), ("Nov-Mar 10:00-22:00", None), ("sunset-23:00", None),
    ("Mo-Fr 09:00-17:00; Jan 01 off", None), ("", None), (None, None), ("Fr 14:00-04:00", "0000e10"), ("Mo-Su 10:00-18:00; Tu off", "7077777"),
    ("Mo-Fr open", None), ("Fr-Mo 10:00-11:00", "1000111"), ("Mo 25:00-26:00", None), ('Mo 10:00-11:00 "by request"', "1000000"),
]


def test_week_masks(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(HOURS)], "i int, s string").withColumn("m", hours.week_mask(F.col("s")))
    assert {r.i: r.m for r in df.collect()} == {i: m for i, (_, m) in enumerate(HOURS)}
    r = spark.createDataFrame([("000ccee",), (None,)], "m string").select(hours.open_bands(F.col("m")).alias("b"), hours.is_open(F.col("m"), 3, ["late"]).alias("o"), hours.is_open(F.col("m"), 0).alias("shut")).collect()
    assert (r[0].b, r[0].o, r[0].shut) == (["afternoon", "evening", "late"], True, False) and (r[1].o, r[1].shut) == (None, None)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("f, x, y", [
    (text.clean, "Zumba Gold&#174; &amp; Lim&#243;n\u00a0", "Zumba Gold® & Limón"),
    (text.strip_tags, "<p class='a'>Hi &lt;b&gt;</p>", "Hi <b>"), (text.strip_tags, "<p></p>", None),
    (text.event_slug, "Jazz & Blues: Live! (Free)", "jazz-blues-live-free"), (text.event_slug, "é" * 90, "é" * 70),
    (text.place_slug, "St. Mark's — Church", "st-mark-s-church"), (text.area_slug, "Bay Ridge/Fort H. (x)", "bay-ridge-fort-h-x"),
    (text.norm, "Smith & Sons' Café!", "smith and sons café"), (text.norm, None, ""),
    (text.name_variants, "Langston Playground (St. Nick)", ["Langston Playground (St. Nick)", "Langston Playground", "St. Nick"]),
    (text.name_variants, "Bay Park and Orchard Beach", ["Bay Park and Orchard Beach", "Bay Park"]),
    (text.https_only, "//a.b/c", "https://a.b/c"), (text.https_only, "http://a.b/c", None),
    (lambda c: text.host_image(c, "parks.example"), "http://www.parks.example/i.jpg", "https://www.parks.example/i.jpg"),
    (text.first_line, "\n  \n first \nsecond", "first"), (text.stated_free, " Free! ", True), (text.stated_free, "$20", None),
    (text.street_query, "Mott Street between Prince and Spring", "Mott Street and Prince"),
    (text.street_query, "1197 Sutter Ave. at Crystal St., Brooklyn, NY, 11208", "1197 Sutter Ave., Brooklyn, NY, 11208"),
    (text.registrable_host, "https://www.Foo.org/x?y", "foo.org"),
])
def test_text(spark, f, x, y):
    assert one(spark, f, x) == y


@pytest.mark.parametrize("x, y", [("2024-05-06T07:08:09.123", "2024-05-06 07:08:09"), ("2024-05-06 07:08", "2024-05-06 07:08:00"), ("2024-05-06", "2024-05-06 00:00:00"), ("06/05/2024", None), ("2024-13-40", None), (None, None)])
def test_parse_naive(spark, x, y):
    got = one(spark, times.parse_naive, x)
    assert (str(got) if got else None) == y


@pytest.mark.parametrize("x, y", [("2024-07-01T23:30:00Z", "2024-07-01 19:30:00"), ("2024-01-01T02:00:00+00:00", "2023-12-31 21:00:00"), ("2024-07-01T19:30", "2024-07-01 19:30:00"), ("2024-07-01", "2024-07-01 00:00:00"), ("x", None)])
def test_local_from_iso(spark, x, y):
    got = one(spark, lambda c: times.local_from_iso(c, "America/New_York"), x)
    assert (str(got) if got else None) == y


def test_times(spark):
    r = spark.sql("select timestamp_ntz'2024-11-03 01:30:00' a, timestamp_ntz'2024-03-10 02:30:00' b, 1720000000000L ms, timestamp_ntz'2024-01-02 00:00:00' d, timestamp_ntz'1999-01-01 20:15:00' t").select(
        times.local_to_utc(F.col("a"), "America/New_York").cast("string").alias("fall"), times.local_from_millis(F.col("ms"), "America/New_York").cast("string").alias("ms"),
        times.combine(F.col("d"), F.col("t")).cast("string").alias("c"), times.repaired_end(F.col("a"), F.col("d")).cast("string").alias("e"), times.band(F.col("t")).alias("band"), times.walk_minutes(F.lit(121.0)).alias("w"), times.clock12(F.col("t")).alias("k"),
    ).first()
    assert (r.fall, r.ms, r.c, r.e, r.band, r.w, r.k) == ("2024-11-03 05:30:00", "2024-07-03 05:46:40", "2024-01-02 20:15:00", "2024-01-03 00:00:00", "evening", 2, "8:15 pm")
