"""Benchmark decontamination by templates, on DataFrame functions only.

Texts are read twice. In the typed reading, a run of tokens that begin with a digit becomes one ``#``, a
unit word after it ``$``, a run of capitalised words one ``@``, and the rest is lower case; in the
plain reading words are only lower-cased, so that copies in other case, and sentences that begin
with a name in one text alone, still agree. Windows of eight template tokens of every benchmark item
(with at least five literal tokens) are hashed and joined with the windows of every document.

An item without such a window gives all its windows; one of five to seven tokens is a window of its
own length; a shorter one is met only by documents that consist of it. Hits of an item and a document
count together if their diagonals (place in document minus place in item) lie within four of each
other, so that inserted or dropped words do not part them. If they cover six windows, or three tenths
of a shorter item's, they are a candidate (nine tenths of all in the plain reading, where no values
are compared): an item of 19 words or more is met with one word changed anywhere. The values at the item's placeholders are compared,
and the candidate stands if each of the item's values always meets one value in the document.
Verbatim copies pass by nature; a re-parameterised question passes with other values. ``matches``
gives (doc, item) rows, ``flag`` one row per document, ``clean`` drops the flagged ones.

Items with one template share its windows in the join; the candidates then meet every item of the
template, each with its own values. Items of one text are one item (smallest item_id). Defined results:
null and empty texts or items match nothing; a null doc_id is matched by its text; repeated rows get
repeated verdicts; empty tables give empty results; other columns do not matter, and ``clean``
returns exactly the columns of its input. Tables are broadcast only if the bytes of their files are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townsheet.llm.common import saved, sized, unused

WINDOW, LITERALS, LEAST, SHORTEST = 8, 5, 6, 5
#: Least share of an item's windows, where that is under LEAST of them.
SHARE = 0.3
#: Diagonals that count together: two of these overlapping strips.
STRIP = 8
#: Unit words, by kind: length, mass, volume, time, speed and data, money, share. Fixed values.
UNITS = (
    "mm cm m km inch inches ft feet foot yard yards mile miles mg g kg gram grams ton tons lb lbs oz pound pounds ml l liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh kb mb gb tb "
    "dollar dollars cent cents euro euros percent"
).split()
#: Joins the words of one name, and the digit groups of one number.
GLUE = "\u0001"


def base_text(text: Column) -> Column:
    """Letters and digits, runs of anything else as one space; points and commas stay within numbers."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?:[^\p{L}\p{M}\p{N}](?<!\p{N}[.,](?=\p{N})))+", " "))


def typed_base(base: Column) -> Column:
    """The base text with each run of names, and of numbers, as one token."""
    names = F.regexp_replace(base, r"\p{Lu}(?<![\p{L}\p{M}\p{N}]\p{Lu})([\p{L}\p{M}\p{N}]*) (?=\p{Lu})", "$0" + GLUE)
    numbers = F.regexp_replace(names, r"\p{N}(?<![\p{L}\p{M}\p{N}.,]\p{N})([\p{N}.,]*) (?=\p{N})", "$0" + GLUE)
    return F.replace(numbers, F.lit(" " + GLUE), F.lit(GLUE))


def template(base: Column) -> Column:
    """The typed reading of a typed base text."""
    named = F.regexp_replace(base, rf"\p{{Lu}}(?<![\p{{L}}\p{{M}}\p{{N}}{GLUE}]\p{{Lu}})[\p{{L}}\p{{M}}\p{{N}}{GLUE}]*", "@")
    numbered = F.regexp_replace(named, rf"\p{{N}}(?<![@\p{{L}}\p{{M}}\p{{N}}.,{GLUE}]\p{{N}})[\p{{N}}.,{GLUE}]*[\p{{L}}\p{{M}}]*", "#")
    return F.regexp_replace(F.lower(numbered), f"# (?:{'|'.join(UNITS)})(?= |$)", r"# \$")


def tokens(text: Column) -> Column:
    """The non-empty tokens of a base text or template."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def read(texts: DataFrame, *keep: str) -> DataFrame:
    """keep and, for the typed reading (0) and the plain one (1), template tokens t0, t1 and values v0, v1.

    Steps are projections of their own, so that no expression is copied into the ones that use it.
    """
    based = texts.select(*keep, base_text(F.col("text")).alias("base"))
    typed = based.select(*keep, "base", typed_base(F.col("base")).alias("typed"))
    named = typed.select(*keep, "base", "typed", template(F.col("typed")).alias("template"), F.lower("base").alias("low"))
    return named.select(*keep, tokens(F.col("template")).alias("t0"), tokens(F.col("typed")).alias("v0"), tokens(F.col("low")).alias("t1"), tokens(F.col("base")).alias("v1"))


def _joined(a: Column, b: Column, shift: int, *more: Column) -> Column:
    """Hashes of windows made of a window of a and the one of b that begins ``shift`` tokens later."""
    n = F.greatest(F.size(b) - shift, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(shift + 1), n), lambda x, y: F.xxhash64(x, y, *more))


def hashed(texts: DataFrame, keep: list[str], readings: dict[str, Column], lengths: list[int]) -> DataFrame:
    """keep, and for each reading (a column of tokens, and the number that tells it apart) and length k its ``t_k``.

    That is the array of hashes of all windows of k tokens. Tokens are hashed once, and windows are put
    together of windows of 1, 2 and 4, so that a window costs three short hashes and not eight tokens.
    Steps are projections of their own; a window's hash depends on its tokens and its reading alone.
    """
    step = texts.select(*keep, *readings, *[F.transform(t, lambda x: F.xxhash64(x)).alias(f"{t}_one") for t in readings])
    step = step.select("*", *[_joined(F.col(f"{t}_one"), F.col(f"{t}_one"), 1).alias(f"{t}_two") for t in readings])
    step = step.select("*", *[_joined(F.col(f"{t}_two"), F.col(f"{t}_two"), 2).alias(f"{t}_four") for t in readings])
    if 7 in lengths:
        step = step.select("*", *[_joined(F.col(f"{t}_four"), F.col(f"{t}_two"), 4).alias(f"{t}_six") for t in readings])
    ends = {5: ("four", "one", 4), 6: ("four", "two", 4), 7: ("six", "one", 6), 8: ("four", "four", 4)}
    made = [_joined(F.col(f"{t}_{ends[k][0]}"), F.col(f"{t}_{ends[k][1]}"), ends[k][2], r).alias(f"{t}_{k}") for t, r in readings.items() for k in lengths]
    return step.select(*keep, *readings, *made)


def _all_windows(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """key, pos, h and starts: all windows of both readings in one array, and where each reading and length begins in it.

    A text under SHORTEST tokens is one window, of length 0.
    """
    names = [(r, k) for r in (0, 1) for k in (0, *lengths)]
    rows = hashed(read(docs, "key"), ["key"], {"t0": F.lit(0), "t1": F.lit(1)}, lengths)
    none = F.array().cast("array<bigint>")
    whole = [F.when((F.size(t) > 0) & (F.size(t) < SHORTEST), F.array(F.xxhash64(t, F.lit(r)))).otherwise(none).alias(f"{t}_0") for r, t in enumerate(("t0", "t1"))]
    rows = rows.select("key", *whole, *[f"t{r}_{k}" for r, k in names if k])
    at, starts = F.lit(0), []
    for r, k in names:
        starts.append(at)
        at = at + F.size(f"t{r}_{k}")
    rows = rows.select("key", F.array(*starts).alias("starts"), F.concat(*[F.col(f"t{r}_{k}") for r, k in names]).alias("every"))
    # the outer form keeps the optimizer from copying the whole expression below into a filter
    return rows.select("key", "starts", F.posexplode_outer("every").alias("pos", "h"))


def items(benchmark: DataFrame) -> DataFrame:
    """One row per distinct text and reading: tid (of its template), item_id, values and template tokens."""
    distinct = benchmark.select("item_id", base_text(F.col("text")).alias("text")).where("text <> ''").groupBy("text").agg(F.min("item_id").alias("item_id"))
    both = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.col(f"t{r}").alias("t"), F.col(f"v{r}").alias("v")) for r in (0, 1)])).alias("s")
    return read(distinct, "item_id").select("item_id", both).select(F.xxhash64("s.r", "s.t").alias("tid"), "item_id", F.col("s.r").alias("r"), F.col("s.v").alias("raw"), F.col("s.t").alias("t"))


def _item_windows(of: DataFrame) -> DataFrame:
    """h (of tokens and reading), tid, ipos, width and needed windows of every template."""
    n = F.size("t")
    width = F.when(n >= WINDOW, WINDOW).otherwise(n)
    lengths = list(range(SHORTEST, WINDOW + 1))
    rows = hashed(of.dropDuplicates(["tid"]).select("tid", "r", "t", width.alias("width")), ["tid", "r", "width"], {"t": F.col("r")}, lengths)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("t") - F.col("width"))).alias("ipos"))
    window = F.slice("t", F.col("ipos") + 1, F.col("width"))
    literal = F.size(F.filter(window, lambda x: ~x.isin("@", "#", "$")))
    h = F.xxhash64("t", "r")
    for k in lengths:
        h = F.when(F.col("width") == k, F.get(f"t_{k}", F.col("ipos"))).otherwise(h)
    rows = rows.select("tid", "r", "width", "ipos", h.alias("h"), (literal >= LITERALS).alias("good"))
    counts = rows.groupBy("tid").agg(F.count("*").alias("n"), F.count_if("good").alias("n_good"))
    kept = rows.join(counts, "tid").where("good or n_good = 0")
    # an item without a telling window has to be met in all of them
    share = F.when(F.col("r") == 0, F.least(F.lit(LEAST), F.ceil(F.col("n_good") * SHARE))).otherwise(F.ceil(F.col("n_good") * 0.9))
    needed = F.when(F.col("n_good") == 0, F.col("n")).otherwise(share)
    return kept.select("h", "tid", "r", "ipos", "width", needed.cast("int").alias("needed"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit(""))).alias("key"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, tid, item_id, windows (those met) and changed (placeholders differ)."""
    of = saved(items(benchmark), "items")
    probe = saved(_item_windows(of), "item-windows")
    lengths = sorted({WINDOW, *(r.width for r in probe.select("width").distinct().collect() if r.width >= SHORTEST)})  # four at most
    keyed = _keyed(docs)
    hits = _all_windows(keyed, lengths).join(sized(probe), "h")
    # where a hit's reading and length begin among the windows of its text
    row = F.when(F.col("width") < SHORTEST, 0).otherwise(F.array_position(F.array(*map(F.lit, lengths)), F.col("width"))).cast("int")
    hits = hits.withColumn("dpos", F.col("pos") - F.get("starts", F.col("r") * (len(lengths) + 1) + row))
    # an item of under SHORTEST tokens is met by whole texts only, as only they have such a window
    strip = F.explode(F.array(F.floor((F.col("dpos") - F.col("ipos")) / STRIP) * 2, F.floor((F.col("dpos") - F.col("ipos") + STRIP // 2) / STRIP) * 2 + 1)).alias("strip")
    hits = hits.select("key", "tid", "needed", "width", "ipos", (F.col("dpos") - F.col("ipos")).alias("diagonal"), strip)
    # a strip's hits: at most a few times as many as its item has windows
    met = F.collect_set(F.struct("ipos", "diagonal"))
    lines = hits.groupBy("key", "tid", "strip", "needed", "width").agg(met.alias("met"), F.mode("diagonal", True).alias("mode"))
    # a window that occurs again nearby counts on the diagonal nearest to the commonest one
    away = F.transform("met", lambda m: F.struct(m["ipos"].alias("ipos"), F.abs(m["diagonal"] - F.col("mode")).alias("off"), m["diagonal"].alias("diagonal")))
    lines = lines.withColumn("met", F.sort_array(away)).withColumn("at", F.filter("met", lambda m, i: (i == 0) | (F.get("met", i - 1)["ipos"] != m["ipos"])))
    lines = saved(lines.withColumn("n", F.size("at")).where("n >= needed").select("key", "tid", "width", "at", "n"), "diagonals")
    texts = keyed.join(sized(saved(lines.select("key").distinct(), "hit-docs")), "key", "left_semi")
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.col(f"v{r}").alias("d")) for r in (0, 1)])).alias("s")
    raw = read(texts.dropDuplicates(["key"]), "key").select("key", values).select("key", "s.r", "s.d")
    both = lines.join(sized(of), "tid").join(raw, ["key", "r"])
    # (place in the item, place in the document) of every placeholder within a window that was met
    slots = F.flatten(F.transform("at", lambda a: F.transform(F.sequence(a["ipos"], a["ipos"] + F.col("width") - 1), lambda p: F.struct(p.alias("p"), (p + a["diagonal"]).alias("q")))))
    both = both.withColumn("slots", F.array_distinct(slots)).withColumn("slots", F.filter("slots", lambda s: F.get("t", s["p"]).isin("@", "#", "$") & (F.col("r") == 0)))
    pair = lambda s: F.struct(F.get("t", s["p"]).alias("k"), F.lower(F.get("raw", s["p"])).alias("i"), F.lower(F.get("d", s["q"])).alias("d"))
    both = both.withColumn("pairs", F.transform("slots", pair)).withColumn("pairs", F.array_distinct("pairs"))
    fits = both.where(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda s: F.struct(s["k"], s["i"])))))
    # the plain reading passes values as they are
    changed = F.exists("pairs", lambda s: s["i"] != s["d"])
    return fits.groupBy("key", "item_id").agg(F.min("tid").alias("tid"), F.max("n").alias("windows"), F.min(changed).alias("changed"))


def flag(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending, comma-joined), windows and changed by row of docs."""
    # a template's windows count once, however many of its items fit
    shared = matches(docs, benchmark).groupBy("key", "tid").agg(F.collect_set("item_id").alias("ids"), F.max("windows").alias("windows"), F.min("changed").alias("changed"))
    found = shared.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"), F.sum("windows").alias("windows"), F.min("changed").alias("changed"))
    found = found.select("key", F.size("ids").alias("n_items"), F.array_join("ids", ",").alias("item_ids"), "windows", "changed")
    found = saved(found, "flags")
    rows = _keyed(docs).select("doc_id", "key").join(sized(found), "key", "left")
    return rows.select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.lit("")).alias("item_ids"), F.coalesce("windows", F.lit(0)).cast("long").alias("windows"), F.coalesce("changed", F.lit(False)).alias("changed"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that match no item, with their columns."""
    (key,) = unused(docs, "key")
    mine = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit("")))
    found = saved(matches(docs, benchmark).select(F.col("key").alias(key)).distinct(), "flags")
    return docs.withColumn(key, mine).join(sized(found), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
