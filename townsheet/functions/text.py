"""Text as columns: cleaning, slugs, names, links, prices. Null in, null out unless stated."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NBSP = "\u00a0"


@F.pandas_udf(T.StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """HTML entities decoded once; only strings with an ampersand travel to Python."""
    return F.coalesce(_unescaped(F.when(c.contains("&"), c)), c)


def unescape_named(c: Column) -> Column:
    """The five named entities and the no-break space, on built-in functions."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def clean(c: Column) -> Column:
    return F.trim(F.replace(unescape(c), F.lit(NBSP), F.lit(" ")))


def strip_tags(c: Column, decode=unescape) -> Column:
    """Tags become spaces before entities are decoded; nothing left is null."""
    text = F.trim(F.replace(decode(F.regexp_replace(c, "<[^>]+>", " ")), F.lit(NBSP), F.lit(" ")))
    return F.nullif(text, F.lit(""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _slug(c: Column, dashes: str, cap: int | None) -> Column:
    kept = F.regexp_replace(F.lower(c), f"[^\\p{{L}}\\p{{N}}{dashes}]", "")
    slug = F.regexp_replace(F.regexp_replace(kept, f"[{dashes}]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(slug, 1, cap), "-+$", "") if cap else slug


def event_slug(c: Column) -> Column:
    """Listed punctuation becomes a dash, other punctuation goes, 70 characters at most."""
    return _slug(c, " \\-_/&,'.:()", 70)


def area_slug(c: Column) -> Column:
    """A shorter list of dashes and no cap, for names of areas."""
    return _slug(c, " \\-_/&,", None)


def place_slug(c: Column) -> Column:
    """Every run of other characters becomes a dash, 70 characters at most."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(slug, 1, 70), "-+$", "")


def norm(c: Column) -> Column:
    """A name for matching: lower case, & as and, punctuation out. Null counts as empty."""
    spelled = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(spelled, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def name_variants(c: Column) -> Column:
    """Whole name, before brackets, within brackets, before the first 'and'; most specific first."""
    bracket = r"^(.*?)\s*\((.+)\)\s*$"
    parts = F.array(
        c,
        F.regexp_extract(c, bracket, 1),
        F.regexp_extract(c, bracket, 2),
        F.when(F.lower(c).contains(" and "), F.regexp_extract(c, r"(?i)^(.*?)\s+and\s+", 1)),
    )
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != ""))


def https_only(c: Column) -> Column:
    u = F.trim(c)
    u = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)
    return F.when(u.startswith("https://"), u)


def host_image(c: Column, host: str) -> Column:
    """An http image is upgraded for one tested host, and dropped for others."""
    pattern = "(?i)^http://(www\\.)?" + host.replace(".", "\\.") + "/"
    return https_only(F.when(c.rlike(pattern), F.regexp_replace(c, "(?i)^http://", "https://")).otherwise(c))


def https_link(c: Column) -> Column:
    return F.when(c.startswith("http://"), F.concat(F.lit("https://"), F.substring(c, 8, 1 << 30))).otherwise(c)


def joined_url(origin: Column, path: Column) -> Column:
    """A path on its origin; an absolute link stays; nothing is null."""
    rooted = F.concat(F.regexp_replace(F.coalesce(origin, F.lit("")), "/+$", ""), path)
    return F.nullif(F.when(path.startswith("/"), rooted).otherwise(path), F.lit(""))


def blurb(c: Column, cap: int = 400) -> Column:
    return F.nullif(F.substring(c, 1, cap), F.lit(""))


def first_line(c: Column) -> Column:
    """The first line that is not blank."""
    return F.get(F.filter(F.transform(F.split(c, r"\R"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))


def least_price(prices: Column) -> Column:
    """The smallest stated number of an array, or null."""
    return F.array_min(F.filter(F.transform(prices, lambda p: p.cast("double")), lambda p: p.isNotNull()))


def stated_free(cost: Column) -> Column:
    """True only where the source says free in so many words; otherwise unknown."""
    return F.when(F.lower(F.trim(cost)).isin("free", "free!", "$0", "0"), F.lit(True))


def street_query(c: Column) -> Column:
    """A block as its first corner; a trailing cross street dropped; else what looks like a street."""
    between = r"(?i)^(.+?)\s+between\s+(.+?)\s+and\s+(.+)$"
    at_cross = r"(?i)\s+(at|@|near)\s+[^,]+(,|$)"
    return (
        F.when(c.rlike(between), F.concat_ws(" and ", F.regexp_extract(c, between, 1), F.regexp_extract(c, between, 2)))
        .when(c.rlike(r"^\d") & c.rlike(at_cross), F.regexp_replace(c, at_cross, "$2"))
        .when(c.rlike(r"(?i)\b(street|st|avenue|ave|road|rd|boulevard|blvd|place|pl|drive|dr)\b"), c)
    )


def registrable_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.parse_url(url, F.lit("HOST"))), r"^www\.", "")


def address(*parts: Column) -> Column:
    """Stated parts with commas between, blanks skipped; nothing is null."""
    full = F.array_join(F.filter(F.array(*[F.trim(p) for p in parts]), lambda p: p.isNotNull() & (p != "")), ", ")
    return F.nullif(full, F.lit(""))


def best_image(images: Column) -> Column:
    """The widest real https rendition up to 1200, 16:9 first; the first of equals."""
    usable = F.filter(
        F.transform(images, lambda im, i: F.struct((im["ratio"].eqNullSafe("16_9")).alias("wide"), F.coalesce(im["width"], F.lit(0)).alias("w"), (-i).alias("first"), https_only(im["url"]).alias("u"), F.coalesce(im["fallback"], F.lit(False)).alias("stock"))),
        lambda x: x["u"].isNotNull() & ~x["stock"] & (x["w"] <= 1200),
    )
    return F.array_max(usable)["u"]
