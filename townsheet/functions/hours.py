"""Opening hours as a week mask: seven hex digits from Monday, bits morning 1 to late 8.

A rule is cut into tokens of the public opening-hours grammar (days, holidays, clocks, marks, words),
and each token into a letter that names its class; a rule is understood if its letters have the shape
days, then times or a word for shut. Rules are folded in order over an array of seven integers, all
with array functions. A rule of another shape makes the whole text unknown (null).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (bit, first hour, last hour exclusive) of morning, afternoon, evening, late. Fixed values.
BANDS = ((1, 0, 12), (2, 12, 17), (4, 17, 21), (8, 21, 24))
NAMES = ("morning", "afternoon", "evening", "late")
DAYS, HOLIDAYS, SHUT = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su"), ("PH", "SH"), ("off", "closed")
TOKEN = r"\s*-\s*|[A-Za-z]+|[0-9]+:[0-9]+|,|\S"
#: Letters: d day, h holiday, t clock, x shut, - and ~ dash (bare, spaced), comma. Days may not have a spaced dash.
SHAPE = r"^,*(?:[dh],*|d-d,*)*(?:x|t[-~]t(?:,t[-~]t)*),*$"


def _minutes(token: Column) -> Column:
    """Minutes of a clock from 0:00 to 24:59, else null."""
    hour, minute = F.substring_index(token, ":", 1), F.substring_index(token, ":", -1)
    fits = (F.length(hour) <= 2) & (F.length(minute) == 2) & token.contains(":")
    h, m = hour.try_cast("int"), minute.try_cast("int")
    return F.when(fits & (h <= 24) & (m <= 59), h * 60 + m)


def _letter(token: Column) -> Column:
    return (
        F.when(token.isin(",", "-"), token).when(F.trim(token) == "-", "~").when(token.isin(*DAYS), "d").when(token.isin(*HOLIDAYS), "h")
        .when(F.lower(token).isin(*SHUT), "x").when(_minutes(token).isNotNull(), "t").otherwise("?")
    )


def _spread(rule: Column, letter: str, dash: tuple[str, ...], of) -> Column:
    """of(first, last) for every token of a class, last being the one after its dash or the token itself."""
    n = F.size(rule["tokens"])
    at = lambda i: F.get(rule["letters"], i)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (at(i) == letter) & ~F.coalesce(at(i - 1).isin(*dash), F.lit(False)))
    end = lambda i: F.when(F.coalesce(at(i + 1).isin(*dash), F.lit(False)), i + 2).otherwise(i)
    return F.transform(starts, lambda i: of(F.get(rule["tokens"], i), F.get(rule["tokens"], end(i))))


def _days(first: Column, last: Column) -> Column:
    """Indexes from one day to another, around the week."""
    index = lambda d: F.array_position(F.array(*map(F.lit, DAYS)), d).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), F.pmod(index(last) - index(first), F.lit(7))), lambda k: F.pmod(index(first) + k, F.lit(7)))


def _bits(start: Column, end: Column) -> Column:
    """Band bits of a time range today and past midnight; an end at or before the start is tomorrow's."""
    until = F.when(end <= start, end + 1440).otherwise(end)
    bit = lambda cond, b: F.when(cond, F.lit(b)).otherwise(F.lit(0))
    today = sum((bit((start < b1 * 60) & (until > b0 * 60), b) for b, b0, b1 in BANDS), F.lit(0))
    after = sum((bit(until - 1440 > b0 * 60, b) for b, b0, _ in BANDS), F.lit(0))
    return F.struct(today.alias("today"), after.alias("after"))


def _rules(text: Column) -> Column:
    """An array of (days, shut, ok, today, after). Each step reads the fields of the one before, so
    that no expression is copied."""
    cut = F.transform(F.split(text, ";"), lambda t: F.struct(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)).alias("tokens")))
    named = F.transform(cut, lambda r: F.struct(r["tokens"].alias("tokens"), F.transform(r["tokens"], _letter).alias("letters")))
    shaped = F.transform(named, lambda r: F.struct(r["tokens"].alias("tokens"), r["letters"].alias("letters"), F.array_join(r["letters"], "").alias("shape")))
    # rules that say nothing, or speak of holidays alone, are passed over
    telling = F.filter(shaped, lambda r: (F.replace(r["shape"], F.lit(","), F.lit("")) != "") & ~(r["shape"].contains("h") & ~r["shape"].contains("d")))
    week = F.sequence(F.lit(0), F.lit(6))
    clocks = lambda a, b: F.struct(_minutes(a).alias("start"), _minutes(b).alias("end"))
    read = F.transform(telling, lambda r: F.struct(
        r["shape"].rlike(SHAPE).alias("ok"), r["shape"].contains("x").alias("shut"),
        F.when(r["shape"].contains("d"), F.flatten(_spread(r, "d", ("-",), _days))).otherwise(week).alias("days"), _spread(r, "t", ("-", "~"), clocks).alias("spans"),
    ))
    banded = F.transform(read, lambda r: F.struct(r["ok"].alias("ok"), r["shut"].alias("shut"), r["days"].alias("days"), F.transform(r["spans"], lambda s: _bits(s["start"], s["end"])).alias("spans")))
    bits = lambda r, name: F.aggregate(r["spans"], F.lit(0), lambda acc, s: acc.bitwiseOR(s[name]))
    return F.transform(banded, lambda r: F.struct(r["days"].alias("days"), r["shut"].alias("shut"), r["ok"].alias("ok"), bits(r, "today").alias("today"), bits(r, "after").alias("after")))


def _apply(week: Column, rule: Column) -> Column:
    def day(old: Column, d: Column) -> Column:
        mine = F.array_contains(rule["days"], d)
        spill = F.array_contains(rule["days"], F.pmod(d + 6, F.lit(7)))
        added = F.when(mine, rule["today"]).otherwise(0).bitwiseOR(F.when(spill, rule["after"]).otherwise(0))
        return F.when(rule["shut"], F.when(mine, F.lit(0)).otherwise(old)).otherwise(old.bitwiseOR(added))

    return F.transform(week, day)


def week_mask(spec: Column) -> Column:
    text = F.trim(F.regexp_replace(spec, '"[^"]*"', " "))
    folded = F.transform(F.array(_rules(text)), lambda rs: F.struct(F.forall(rs, lambda r: r["ok"]).alias("ok"), F.aggregate(rs, F.array_repeat(F.lit(0), 7), _apply).alias("week")))
    digits = lambda w: F.array_join(F.transform(w, lambda d: F.lower(F.hex(d.cast("long")))), "")
    masks = F.transform(folded, lambda f: F.when(f["ok"] & F.exists(f["week"], lambda d: d > 0), digits(f["week"])))
    return F.when(F.replace(text, F.lit(" ")).isin("24/7", "00:00-24:00"), "fffffff").when(spec.isNotNull(), F.get(masks, F.lit(0)))


def day_bits(mask: Column, weekday: Column) -> Column:
    """Bits of a day, 0 for Monday."""
    return F.conv(F.substr(mask, weekday + 1, F.lit(1)), 16, 10).cast("int")


def week_bits(mask: Column) -> Column:
    days = F.sequence(F.lit(0), F.lit(6))
    return F.when(mask.isNotNull(), F.aggregate(days, F.lit(0), lambda acc, d: acc.bitwiseOR(day_bits(mask, d))))


def open_bands(mask: Column) -> Column:
    """Names of the bands in which a place is open at some time of the week."""
    bits = week_bits(mask)
    return F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(b)) > 0, n) for (b, _, _), n in zip(BANDS, NAMES)]))


def is_open(mask: Column, weekday: int | None = None, bands: list[str] | None = None) -> Column:
    """True, false, or null where hours are unknown; nothing asked is true."""
    if weekday is None and not bands:
        return F.lit(True)
    bits = week_bits(mask) if weekday is None else day_bits(mask, F.lit(weekday))
    wanted = sum(b for (b, _, _), n in zip(BANDS, NAMES) if n in bands) if bands else 15
    return F.when(mask.isNotNull(), bits.bitwiseAND(F.lit(wanted)) > 0)
