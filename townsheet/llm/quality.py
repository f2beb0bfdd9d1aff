"""Quality rules with robust multivariate outliers, on DataFrame functions only.

``statistics(docs)`` counts words, characters, symbols, repeated lines and repeated windows of every
whole text. ``judge(stats)`` fails texts by the base rules, then estimates for each (lang, source) a
minimum-covariance-determinant centre and scatter of transformed statistics and rejects rows whose
squared Mahalanobis distance passes a cut-off. The estimate of a group under ``least_rows`` rows is
shrunk towards its language's, and that of a small language towards the one of all rows, by the
group's share of ``least_rows``, so every row is judged by some estimate and none switches by size.

The vector is mean word length, log symbol share, repeated-line share and repeated-window share,
each shrunk towards a fixed prior by the text's words (a short text says little). The estimate is a
deterministic one: from medians and scaled absolute deviations, concentration steps keep the rows
with the smallest distances (three quarters of the group) and refit, which never raises the
determinant; the last scatter is scaled to the normal law.

Every group statistic is a count or sum by histogram bin, so a group with a third of all rows is
pre-aggregated where it lies; nothing is gathered by row. Ties fall into one bin and are kept together.

Defined results: a null or empty text has zero counts and fails; null lang or source is a group of
its own; distances are null only where no row at all passes the base rules; repeated rows get
repeated verdicts; an empty table gives an empty result. Extra columns pass through, but for ones named
like the results, which are replaced; ``keep`` returns exactly the columns of its input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townsheet.llm.common import SPACES, saved, sized, unused

WINDOW = 5
FEATURES = ("x1", "x2", "x3", "x4")
#: Words that the prior counts for, and the prior's mean word length.
PRIOR_WORDS, PRIOR_LENGTH = 60.0, 6.0
#: Share of a group in the subset; scale floors by feature; cut-off of the squared distance, well past
#: the 0.9999 point of chi-squared with four degrees (23.5) as texts are not normal; bins to a unit of
#: log1p, so that a group has some 4,000 bins at most, however far its outliers lie.
#: The base rules stop repeated windows at a share of 0.2, so only a floor under sqrt(0.2 / CUT) = 0.0707
#: lets them reject by themselves.
SHARE, FLOORS, CUT, BINS, STEPS, LEAST_ROWS = 0.75, (0.25, 0.25, 0.1, 0.0625), 40.0, 300, 3, 50


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words in place of text."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", *COUNTS)]
    text = F.coalesce(F.col("text"), F.lit(""))
    # the other columns travel in a struct, so that no name of theirs can clash
    split = docs.select(
        F.struct(*rest).alias("row"), F.filter(F.split(text, f"{SPACES}+"), lambda w: w != "").alias("w"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    hashed = split.select(
        "row", "n_symbols", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("w", lambda w: F.xxhash64(w)).alias("g"),
    )
    window = lambda i: F.xxhash64(*[F.get("g", i + k) for k in range(WINDOW)])
    none = F.array().cast("array<bigint>")
    windows = hashed.withColumn("h", F.when(F.size("g") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("g") - WINDOW), window)).otherwise(none)).drop("g")
    # texts without a repeated window are done; the others sort (window, place) pairs
    pairs = F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    paired = windows.withColumn("p", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(pairs))).drop("h")
    # a place repeats if the pair before or after it has its window
    shifted = paired.withColumn("next", F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))))
    same = F.zip_with("p", "next", lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    places = shifted.withColumn("at", F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))
    gaps = F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)
    repeats = F.coalesce(F.when(F.col("p").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words")
    return places.select("row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def features(stats: DataFrame) -> DataFrame:
    n, k = F.col("n_words").cast("double"), PRIOR_WORDS
    return (
        stats.withColumn("x1", (F.col("word_chars") + k * PRIOR_LENGTH) / (n + k))
        .withColumn("x2", F.log1p(F.col("n_symbols") * 1000.0 / (n + k)))
        .withColumn("x3", F.sqrt(F.col("n_dup_lines") * 10.0 / (n + k)))
        .withColumn("x4", F.sqrt(F.col("n_repeat_words") / (n + k)))
    )


def _bin(x: Column) -> Column:
    return F.floor(F.log1p(F.least(x, F.lit(1e6))) * BINS).cast("long")


def _middle(b: Column) -> Column:
    return F.expm1((b + 0.5) / BINS)


def _quantile(binned: DataFrame, group: list[str], share: float, name: str) -> DataFrame:
    """The bin that a share of each group's counts lies at or under; binned has group, bin and n."""
    up = Window.partitionBy(*group).orderBy("bin")
    run = binned.withColumn("run", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy(*group)))
    return run.where(F.col("run") >= F.col("all") * share).groupBy(*group).agg(F.min("bin").alias(name))


def _histogram(df: DataFrame, group: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.count("*").alias("n"))


def _with(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Rows with their group's saved parameters; the key is never null. Few groups are broadcast, many shuffled."""
    return rows.join(sized(params), "group", "left")


def _distance() -> Column:
    """Squared distance by the group's Cholesky factor l_ij and centre m_i (forward substitution)."""
    z: list[Column] = []
    for i in range(len(FEATURES)):
        left = F.col(FEATURES[i]) - F.col(f"m{i}")
        for j in range(i):
            left = left - F.col(f"l{i}{j}") * z[j]
        z.append(left / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, [x * x for x in z])


def _cholesky(params: DataFrame, floors: tuple = FLOORS) -> DataFrame:
    """l_ij from covariances c_ij, floored on the diagonal."""
    p = len(FEATURES)
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (F.lit(floors[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 * 0.01))) if i == j else rest / F.col(f"l{j}{j}"))
    return params


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Centre and Cholesky factor by group; rows: group and the features."""
    p = range(len(FEATURES))
    long = rows.select("group", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(x).alias("x")) for i, x in enumerate(FEATURES)])).alias("s")).select("group", "s.f", "s.x")
    middle = _quantile(_histogram(long.withColumn("bin", _bin(F.col("x"))), ["group", "f", "bin"]), ["group", "f"], 0.5, "mid")
    middle = saved(middle.withColumn("mid", _middle(F.col("mid"))), "mcd")
    away = long.join(sized(middle), ["group", "f"]).withColumn("bin", _bin(F.abs(F.col("x") - F.col("mid"))))
    spread = _quantile(_histogram(away, ["group", "f", "bin"]), ["group", "f"], 0.5, "mad").withColumn("mad", _middle(F.col("mad")) * 1.4826)
    both = middle.join(spread, ["group", "f"])
    pick = lambda f, c: F.max(F.when(F.col("f") == f, F.col(c)))
    start = both.groupBy("group").agg(*[pick(i, "mid").alias(f"m{i}") for i in p], *[F.pow(pick(i, "mad"), 2).alias(f"c{i}{i}") for i in p])
    for i in p:
        for j in range(i):
            start = start.withColumn(f"c{i}{j}", F.lit(0.0))
    params = saved(_cholesky(start), "mcd")
    for _ in range(steps):
        far = _with(rows, params).withColumn("bin", _bin(_distance()))
        limit = saved(_quantile(_histogram(far, ["group", "bin"]), ["group"], SHARE, "limit"), "mcd")
        inside = _with(far, limit).where(F.col("bin") <= F.col("limit"))
        sums = [F.count("*").alias("n"), *[F.sum(F.col(FEATURES[i]) - F.col(f"m{i}")).alias(f"s{i}") for i in p], *[F.first(f"m{i}").alias(f"o{i}") for i in p]]
        sums += [F.sum((F.col(FEATURES[i]) - F.col(f"m{i}")) * (F.col(FEATURES[j]) - F.col(f"m{j}"))).alias(f"q{i}{j}") for i in p for j in range(i + 1)]
        fitted = inside.groupBy("group").agg(*sums)
        fitted = fitted.select("group", *[(F.col(f"o{i}") + F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in p], *[(F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") / F.col("n")).alias(f"c{i}{j}") for i in p for j in range(i + 1)])
        params = saved(_cholesky(fitted), "mcd")
    # normal consistency: the median squared distance should be that of chi-squared with four degrees
    middle = _quantile(_histogram(_with(rows, params).withColumn("bin", _bin(_distance())), ["group", "bin"]), ["group"], 0.5, "mid")
    scaled = params.join(middle, "group").withColumn("scale", F.greatest(_middle(F.col("mid")) / 3.357, F.lit(1.0)))
    sizes = rows.groupBy("group").agg(F.count("*").alias("rows"))
    return scaled.join(sizes, "group").drop("mid")


def _shrunk(of: DataFrame, params: DataFrame, least_rows: int) -> DataFrame:
    """Centre and factor for every group of ``of`` (group, up, top), small ones mixed with the level above."""
    p = range(len(FEATURES))
    names = [*[f"m{i}" for i in p], *[f"c{i}{j}" for i in p for j in range(i + 1)]]
    scatter = lambda i, j: F.col("scale") * reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j + 1)])
    known = params.select("group", "rows", *[F.col(f"m{i}") for i in p], *[scatter(i, j).alias(f"c{i}{j}") for i in p for j in range(i + 1)])
    known = saved(known, "mcd")
    out = of
    for level in ("group", "up", "top"):
        out = out.join(sized(known.select(F.col("group").alias(level), *[F.col(c).alias(f"{level}_{c}") for c in ("rows", *names)]), known), level, "left")
    weight = lambda level: F.least(F.coalesce(F.col(f"{level}_rows"), F.lit(0)) / F.lit(float(least_rows)), F.lit(1.0))

    def mixed(c: str) -> Column:
        value = F.col(f"top_{c}")
        for level in ("up", "group"):
            value = weight(level) * F.coalesce(F.col(f"{level}_{c}"), F.lit(0.0)) + (1.0 - weight(level)) * value
        return value

    factors = _cholesky(out.select("group", *[mixed(c).alias(c) for c in names]), (0.0,) * len(FEATURES))
    return factors.select("group", *[f"m{i}" for i in p], *[f"l{i}{j}" for i in p for j in range(i + 1)])


def judge(docs: DataFrame, least_rows: int = LEAST_ROWS, cut: float = CUT) -> DataFrame:
    """Statistics of docs with base_failed, distance (null without an estimate) and kept."""
    made = (*COUNTS, "base_failed", "distance", "kept")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", *made)]
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in ("lang", "source"))
    keys = [F.xxhash64(lang, source).alias("group"), F.xxhash64(F.lit(1), lang).alias("up"), F.xxhash64(F.lit(2)).alias("top")]
    judged = features(statistics(docs.select(F.struct(*rest).alias("own"), "text", *keys))).withColumn("base_failed", base_failed())
    stats = saved(judged, "quality")
    levels = F.explode(F.array("group", "up", "top")).alias("group")
    params = estimates(stats.where(~F.col("base_failed")).select(levels, *FEATURES))
    of = saved(stats.select("group", "up", "top").distinct(), "mcd")
    params = saved(_shrunk(of, params, least_rows), "mcd")
    scored = _with(stats, params).withColumn("distance", _distance())
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cut)
    return scored.select("own.*", *COUNTS, "base_failed", "distance", kept.alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with their columns. A verdict rests on text, lang and source alone,
    so rows are matched by 128 bits of hash of those."""
    one, two = unused(docs, "one", "two")
    of = [x for c in ("text", "lang", "source") for x in (F.col(c), F.col(c).isNull())]
    marked = docs.withColumn(one, F.xxhash64(*of)).withColumn(two, F.xxhash64(F.lit(1), *of))
    asked = marked.select(F.col(one).alias("one"), F.col(two).alias("two"), "text", "lang", "source")
    good = judge(asked).where("kept").select(F.col("one").alias(one), F.col("two").alias(two)).distinct()
    return marked.join(good, [one, two], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
