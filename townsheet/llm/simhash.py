"""SimHash near-duplicates by meet-in-the-middle ball hashing.

``fingerprints(docs)``: lower-case A-Z, words, 3-word shingles with repeats (a shorter text is one
shingle, a text without words has fingerprint zero); bit i is set if over half the shingles' XXH64
(seed 42) have it.

``groups(prints)``: fingerprints within two bits are linked. Every distinct fingerprint emits all 65
variants within one bit, variants are shuffled, and fingerprints that meet at a variant lie within
two bits. At most 65 fingerprints can meet at one, each is linked to the one before it there, and
the distance is verified. Components follow by stars; ``component_id`` is the smallest doc_id.

Rows of one fingerprint are folded into one before variants are made, so large groups of copies cost
one ball, and the ball's size is fixed.

``keep_one(docs)`` is the stage for texts that are alike, not nearly equal: it links texts whose sets
of five-word shingles have a Jaccard similarity of ``ALIKE`` hundredths or more, and keeps one row of
each component. Texts so alike differ in about a tenth of the bits of a fingerprint, so theirs has 128
bits (of distinct word pairs, as an edited word changes two of those but five shingles) in four
parts, each part is a ball of its own, and whoever meets in one part is compared with those whose whole
sketch is nearest there (:func:`nearest`). Each text's nearest one is verified on their exact
shingle sets, so a group of n alike texts costs n pairs. Sketches leave links out, the more the closer
a pair is to the threshold; so all texts that are still in different components go through the exact
join of :mod:`townsheet.llm.jaccard` (prefixes of rarest shingles, without a cap), and components are
those of brute force. Texts whose prefix no other text shares can be linked to none, and make no ball.

Defined results: null and empty texts have fingerprint zero and are linked like others; a null doc_id
keeps its row and never names a component (nor is its row kept) unless the whole component has no
other; repeated rows repeat in ``groups`` and are one row in ``keep_one``; an empty table gives an
empty one. ``keep_one`` returns exactly the columns of its input, whatever their names.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townsheet.llm import jaccard
from townsheet.llm.common import forget, partitions, saved, small_batches, unused
from townsheet.llm.components import components

SHINGLE, PIECE = 3, 1 << 16
#: Words in a shingle and least similarity, in hundredths, of the stage; parts of its fingerprint, and leading bits of
#: a part that name the bucket where its variants meet; most bits in which candidates may differ.
WORDS, ALIKE, PARTS, LEAD, APART = 5, 80, 4, 10, 36


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        some = words[at : at + PIECE + width - 1]
        shingles = zip(*[some[i:] for i in range(width)]) if len(words) >= width else [words]
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(42)), "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255  # sums of 255 bits fit a byte
        total += bits[full:].sum(0, dtype=np.int64)
        if full:
            total += bits[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """docs with fp (the 64 bits as a signed long) in place of text."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("text", "fp")]

    def run(batches):
        for batch in batches:
            made = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(made)], names=[*rest, "fp"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), "fp long"])
    return docs.select(*[f"`{c}`" for c in rest], "text").mapInArrow(run, schema)


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints that hold every component together."""
    one = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    variants = prints.select("fp").distinct().select("fp", F.explode_outer(F.transform(one, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    met = variants.withColumn("before", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")))
    return met.where((F.col("before").isNotNull()) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("before"))) <= 2)).select(F.col("fp").alias("a"), F.col("before").alias("b"))


def groups(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    prints = saved(fingerprints(docs.select("doc_id", "text"), width), "prints")
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labels = components(links(prints))
    named = firsts.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    ids = named.join(least, "label").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def sketch(words: list[bytes]) -> tuple[int, int]:
    """128 bits, as two unsigned halves, of the distinct pairs of adjacent words."""
    pairs = list(set(zip(words, words[1:])) or {(w,) for w in words})
    total = np.zeros(128, np.int64)
    for at in range(0, len(pairs), PIECE):
        digests = b"".join(map(xxhash.xxh3_128_digest, map(b" ".join, pairs[at : at + PIECE])))
        total += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 16), axis=1).sum(0, dtype=np.int64)
    a, b = np.packbits(total * 2 > len(pairs)).view("<u8").tolist()
    return a, b


def _sketches(nodes: DataFrame) -> DataFrame:
    """nodes (long columns) with the halves a and b of a sketch in place of text."""
    rest = [c for c in nodes.columns if c != "text"]

    def run(batches):
        for batch in batches:
            made = np.array([sketch(words_of(t)) for t in batch.column("text").to_pylist()], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(made[:, 0]), pa.array(made[:, 1])], names=[*rest, "a", "b"])

    return nodes.select(*rest, "text").mapInArrow(run, ", ".join(f"{c} long" for c in (*rest, "a", "b")))


#: Orders of the bits in which those that meet are sorted, and neighbours that each is paired with in one.
ORDERS, NEAR = 8, 2


def _turned(a: Column, b: Column, by: int) -> tuple[Column, Column]:
    """The 128 bits of a and b, turned left by some bits."""
    if by >= 64:
        return _turned(b, a, by - 64)
    if by == 0:
        return a, b
    left = lambda high, low: F.shiftleft(high, by).bitwiseOR(F.shiftrightunsigned(low, 64 - by))
    return left(a, b), left(b, a)


def _neighbours(nodes: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """node and near, an array of (apart, node): those whose sketches differ in two bits at most of some part, and in APART in all; and the written table that it reads.

    A part's variants that keep its leading bits meet in one bucket, so they are made there; only the
    variants with another lead travel by themselves. Unlike texts meet as well, the more the larger the
    corpus (a part has 32 bits). So whoever meets is sorted by the whole sketch, in several orders of its
    bits, and paired with the next ones: two alike sketches are neighbours in an order whose first bits
    they share, and k strangers ask for log2(k) such bits only. Pairs beyond those are left to the exact join.
    """
    rest = 32 - LEAD
    part = F.element_at(F.array(*[F.shiftrightunsigned(c, s).bitwiseAND(F.lit(0xFFFFFFFF)) for c in ("a", "b") for s in (0, 32)]), F.col("k") + 1)
    one = lambda bits: F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in bits])
    parts = nodes.select("node", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("k")).select("node", "a", "b", "k", part.alias("v"))
    sent = parts.select("node", "a", "b", "k", "v", F.explode(one(range(rest, 32))).alias("flip"))
    sent = sent.select("node", "a", "b", (F.col("k") * (1 << LEAD) + F.shiftright(F.col("v").bitwiseXOR(F.col("flip")), rest)).alias("bucket"), F.col("v").bitwiseXOR(F.col("flip")).alias("v"), (F.col("flip") == 0).alias("home"))
    dealt = sent.repartition(n, "bucket")
    flips = F.when(F.col("home"), one(range(rest))).otherwise(F.array(F.lit(0).cast("long")))
    variants = dealt.select("node", "a", "b", "bucket", "v", F.explode(flips).alias("flip")).select("node", "a", "b", "bucket", F.col("v").bitwiseXOR(F.col("flip")).alias("v"))
    here = Window.partitionBy("bucket", "v")
    plain = here.orderBy("a", "b", "node")
    # most variants meet nobody; the orders below sort what is left, which is written so that their plan begins there
    alone = variants.withColumn("alone", F.lag("node").over(plain).isNull() & F.lead("node").over(plain).isNull())
    met = saved(alone.where("not alone").drop("alone"), "met")
    turns = [here.orderBy(*_turned(F.col("a"), F.col("b"), turn * 128 // ORDERS), "node") for turn in range(ORDERS)]
    me, steps = F.struct("node", "a", "b"), range(1, NEAR + 1)
    others = F.array(*[F.lead(me, step).over(w) for w in turns for step in steps]).alias("others")
    apart = lambda o: F.bit_count(F.col("a").bitwiseXOR(o["a"])) + F.bit_count(F.col("b").bitwiseXOR(o["b"]))
    near = F.transform(F.array_compact("others"), lambda o: F.struct(apart(o).alias("apart"), o["node"].alias("node")))
    found = met.select("node", "a", "b", others).select("node", F.array_distinct(F.filter(near, lambda o: (o["apart"] <= APART) & (o["node"] != F.col("node")))).alias("near"))
    return found, met


def candidates(nodes: DataFrame, n: int) -> DataFrame:
    """Pairs (low, high, apart) of all neighbours, some more than once."""
    pairs = _neighbours(nodes, n)[0].select("node", F.explode("near").alias("o"))
    return pairs.select(F.least("node", "o.node").alias("low"), F.greatest("node", "o.node").alias("high"), "o.apart")


def nearest(nodes: DataFrame, n: int) -> DataFrame:
    """Pairs (a, b), written, of each node b and the nearest of its neighbours: at most one a node."""
    found, met = _neighbours(nodes, n)
    best = found.select("node", F.array_min("near").alias("best")).where("best is not null").groupBy("node").agg(F.min("best").alias("best"))
    pairs = saved(best.select(F.col("best.node").alias("a"), F.col("node").alias("b")), "pairs")
    forget(met)
    return pairs


def keep_one(docs: DataFrame, width: int = WORDS, alike: int = ALIKE) -> DataFrame:
    """One row of each component of alike texts, the smallest doc_id first and a null one last."""
    spark = docs.sparkSession
    small_batches(spark)
    one, two = unused(docs, "one", "two")
    # a row is known by 128 bits of hash of all its columns (a hash of values passes over nulls, so they are hashed too)
    content = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    marked = docs.withColumn(one, F.xxhash64(*content)).withColumn(two, F.xxhash64(F.lit(1), *content))
    texts = marked.select("doc_id", "text", F.col(one).alias("one"), F.col(two).alias("two"))
    rows = saved(jaccard.sized_sets(texts, width, jaccard.HOT, ("doc_id", "one", "two")), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "one", "two")).alias("first")
    # texts of one set are one node, known by 128 bits, as are all without words; its number is given as it is written
    nodes = saved(rows.groupBy("hi", "lo").agg(first).select(F.monotonically_increasing_id().alias("node"), "hi", "lo", "first"), "nodes")
    sets = jaccard.sets_of(texts, rows, width, alike=alike).join(nodes.select("node", "hi", "lo"), ["hi", "lo"])
    sets = saved(sets.select("node", "n", "u", "tokens"), "sets")
    asked = sets.select("node").join(nodes, "node").select("node", "first.one", "first.two")
    sketches = saved(_sketches(texts.join(asked, ["one", "two"]).dropDuplicates(["node"]).select("node", "text")), "sketches")
    labels = saved(jaccard.linked(sets, alike, nearest(sketches, partitions(spark))), "labels")
    of = nodes.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("first").alias("first"))
    survivors = saved(of.select(F.col("first.one").alias(one), F.col("first.two").alias(two)), "survivors")
    forget(rows, nodes, sets, sketches, labels)
    kept = marked.join(survivors, [one, two], "left_semi").dropDuplicates([one, two])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
