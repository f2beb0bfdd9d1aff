"""Jaccard join of documents on their n-grams by rare-first prefix filtering.

``join(docs)``: lower-case A-Z, words, distinct 4-word shingles (fewer words are one shingle). Two
documents link if 100 x shared >= 85 x union. The result is one row per document with its set's size
and the smallest doc_id reachable by links.

1. **Fold.** Documents of one set (128 bits of its sorted hashes) are one node.
2. **Count.** Every shingle of every node travels once, packed as six bytes, to the bucket of its hash,
   which counts the nodes that hold it. Only shingles that two nodes hold go back to their nodes: the
   others can match nothing, and rank first as the rarest. A node's shingles are ordered by (count,
   hash), so the prefix of n - ceil(0.85 n) + 1 holds its rarest; a node whose prefix is all its own
   is linked to nothing and leaves here.
3. **Join** on prefix shingles. A pair must pass the *length* filter (100 m >= 85 n), the shorter
   *index* prefix of the smaller set, the *positional* filter (places left after the match) and the
   *suffix* filter: the shingles after the match are counted in 16 ranges of their hash, and the
   ranges' smaller counts bound what can still be shared.
4. **Verify** each pair once, by the two sets of shared shingles.

A group of n copies with edits has n^2 pairs, nearly all within one component. So each prefix shingle
first pairs its holders with the most typical of them (fewest shingles of its own), then, of those
that lie in other components, with another one; then all remaining pairs of holders in different
components are joined. A link between different components is never skipped, so components are exact.

Pairs that another method found may go first (``first`` of :func:`linked`): what they link needs no
further pair. They leave nothing out, as all three steps follow.

Shingles that fill over one in ``HOT`` of all places do not travel to buckets: whoever is so frequent
over all is so in some batch, so batches name them and their counts are summed (at most HOT names, sent
to every task). They rank last, by that count. Sets of many copies (``HOT`` likewise) are sent by one
row alone. Counts decide the order alone; any order that all nodes share gives the same links.

Defined results: null texts and texts without words have size 0 and link with nothing, each other
included; a null doc_id links like others and names a component only if all of its ids are null;
repeated rows repeat; an empty table gives an empty one; extra columns are ignored. Shingles are told
apart by their bucket and 48 bits of hash there; memory is a batch, or a bucket, whose number follows
the bytes of text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townsheet.llm.anchors import WORD_HASHES, rolling
from townsheet.llm.anchors import _planes as planes, _unplaned as unplaned
from townsheet.llm.common import forget, pieces, saved, sized, small_batches
from townsheet.llm.components import components

#: Words of a shingle, and hundredths of the union that linked sets share.
WORDS, ALIKE = 4, 85
#: Shingles over one in so many of all places are hot, as are sets of over one in so many rows.
HOT = 1 << 16
#: Bytes of text that a bucket is made for and least buckets, ranges of the suffix filter, pairs of one node in a task.
BUCKET_BYTES, LEAST_BUCKETS, RANGES, SPLIT = 24 << 20, 16, 16, 1000


def shingles(words: list[bytes], width: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(rolling(WORD_HASHES.of([words], len(words)), min(width, len(words))))


def _sets(batch: pa.RecordBatch, width: int):
    """(ordinal, set, its 128 bits as two numbers) of each row of a batch that has words."""
    for at, texts in pieces(batch.column("text")):
        for i, text in enumerate(texts.to_pylist(), at):
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            if words:
                found = shingles(words, width)
                bits = xxhash.xxh3_128_intdigest(found.tobytes())
                yield i, found, (bits >> 64, bits & (1 << 64) - 1)


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def sized_sets(docs: DataFrame, width: int, hot: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, hi, lo (null without words) and n of each row; often (hashes and counts) on a batch's first row."""

    def run(batches):
        for batch in batches:
            rows = len(batch)
            if not rows:
                continue
            hi, lo, n, some = [None] * rows, [None] * rows, [0] * rows, []
            for i, found, (a, b) in _sets(batch, width):
                hi[i], lo[i], n[i] = a - (a >> 63 << 64), b - (b >> 63 << 64), len(found)
                some.append(found)
            often = [None] * rows
            if some:
                every, counts = np.unique(np.concatenate(some), return_counts=True)
                many = counts >= max(2, -(-sum(map(len, some)) // hot))
                if many.any():
                    often[0] = every[many].tobytes() + counts[many].astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int64()), pa.array(often, pa.binary())], names=[*keys, "hi", "lo", "n", "often"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keys)
    return docs.select(*keys, "text").mapInArrow(run, f"{kinds}, hi long, lo long, n long, often binary")


def _frequent(rows: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the hot shingles: at most ``hot``."""

    def opened(batches):
        for batch in batches:
            for x in batch.column("often"):
                data = np.frombuffer(x.as_py(), "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(data[0]), pa.array(data[1])], names=["h", "c"])

    named = rows.where("often is not null").select("often").mapInArrow(opened, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    found = named.where(F.col("c") > total // hot).toPandas()  # at most total / (total / hot)
    h, c = found["h"].to_numpy(np.int64).view(np.uint64), found["c"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def _pack(hi, lo, n, counts, hashes) -> bytes:
    """Sets of one batch for one bucket; six bytes of each hash."""
    head = np.array([len(hi), len(hashes)], "<u4").tobytes()
    short = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return head + hi.astype("<u8").tobytes() + lo.astype("<u8").tobytes() + planes(n) + planes(counts) + short


def _unpack(data: bytes):
    d, m = np.frombuffer(data, "<u4", 2).tolist()
    hi, lo = np.frombuffer(data, "<u8", d, 8), np.frombuffer(data, "<u8", d, 8 + 8 * d)
    n, counts = unplaned(data, d, 8 + 16 * d), unplaned(data, d, 8 + 20 * d)
    wide = np.zeros((m, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8, 6 * m, 8 + 24 * d).reshape(m, 6)
    return hi, lo, n, counts, wide.view("<u8").ravel()


def _dealt(docs: DataFrame, width: int, buckets: int, hot: np.ndarray, firsts: dict) -> DataFrame:
    """Shingles packed for the bucket of their hash; hot ones for a bucket of their node (numbers from ``buckets`` on).

    ``firsts`` has, for sets of very many rows, the doc_id of the row that sends it.
    """
    shared = docs.sparkSession.sparkContext.broadcast((hot, firsts))

    def run(batches):
        hot, firsts = shared.value
        for batch in batches:
            ids, seen, found, keys = batch.column("doc_id"), set(), [], []
            for i, of, key in _sets(batch, width):
                if key not in seen and (key not in firsts or firsts[key] == ids[i].as_py()):
                    seen.add(key)
                    found.append(of)
                    keys.append(key)
            if not found:
                continue
            hi, lo = (np.array([k[j] for k in keys], np.uint64) for j in (0, 1))
            n = np.array([len(x) for x in found], np.uint32)
            own, h = np.repeat(np.arange(len(n)), n), np.concatenate(found)
            to = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            if len(hot):
                warm = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                to[warm] = buckets + (lo[own[warm]] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            rows = []
            for some in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                at, counts = np.unique(own[some], return_counts=True)
                bucket = int(to[some[0]])
                # a hot shingle is known by its rank, others by their bucket and 48 bits
                values = h[some] if bucket < buckets else np.searchsorted(hot, h[some]).astype(np.uint64)
                rows.append((bucket, _pack(hi[at], lo[at], n[at], counts, values)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "payload"])

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, payload binary")


def _shared(dealt: DataFrame, buckets: int, hot_counts: np.ndarray) -> DataFrame:
    """hi, lo, n and data (tokens, counts) for each bucket and node that holds shared shingles."""
    sent = dealt.sparkSession.sparkContext.broadcast(hot_counts)

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [_unpack(x.as_py()) for x in table.column("payload")]
        hi, lo, n, counts, h = (np.concatenate([p[i] for p in parts]) for i in range(5))
        node = np.unique(np.stack([hi, lo, n.astype(np.uint64)]), axis=1, return_inverse=True)
        hi, lo, n = node[0][0], node[0][1], node[0][2].astype(np.int64)
        own = np.repeat(node[1].ravel(), counts)
        order = np.lexsort((own, h))
        h, own = h[order], own[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])]  # copies of one set
        h, own = h[new], own[new]
        if bucket < buckets:
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            held = np.diff(np.r_[starts, len(h)])
            count = np.repeat(held, held)
            h, own, count = h[count > 1], own[count > 1], count[count > 1]
            tokens = h.astype(np.int64) | np.int64(bucket % (1 << 14)) << np.int64(48)
        else:
            count, tokens = (1 << 40) + sent.value[h.astype(np.int64)], -1 - h.astype(np.int64)
        order = np.argsort(own, kind="stable")
        own, tokens, count = own[order], tokens[order], count[order]
        cuts = np.flatnonzero(np.diff(own)) + 1
        first = np.r_[0, cuts] if len(own) else cuts
        data = [t.tobytes() + c.astype("<i8").tobytes() for t, c in zip(np.split(tokens, cuts), np.split(count, cuts))] if len(own) else []
        at = own[first]
        return pa.table({"hi": _signed(hi[at]), "lo": _signed(lo[at]), "n": pa.array(n[at], pa.int64()), "data": pa.array(data, pa.binary())})

    return dealt.groupBy("bucket").applyInArrow(run, "hi long, lo long, n long, data binary")


def prefix(n: int, alike: int = ALIKE) -> int:
    """Rarest shingles of which a linked set of any size must share one."""
    return n - -(-alike * n // 100) + 1


def _ranked(shared: DataFrame, alike: int = ALIKE) -> DataFrame:
    """Nodes that share a shingle of their prefix: tokens (shared ones, rarest first) and u (those of their own)."""

    def run(batches):
        for batch in batches:
            hi, lo, n, u, lists = [], [], [], [], []
            for a, b, size, parts in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "n", "parts"))):
                data = [np.frombuffer(p, "<i8").reshape(2, -1) for p in parts]
                tokens, counts = np.concatenate(data, axis=1)
                if prefix(size, alike) > size - len(tokens):
                    hi.append(a), lo.append(b), n.append(size), u.append(size - len(tokens))
                    lists.append(tokens[np.lexsort((tokens, counts))])
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (hi, lo, n, u)), pa.array(lists, pa.list_(pa.int64()))], names=["hi", "lo", "n", "u", "tokens"])

    return shared.groupBy("hi", "lo", "n").agg(F.collect_list("data").alias("parts")).mapInArrow(run, "hi long, lo long, n long, u long, tokens array<long>")


def _packed(nodes: DataFrame, alike: int = ALIKE) -> DataFrame:
    """node, n, u and entries: token, pos and after (shingles of the suffix by range) of each prefix shingle. A row a node."""

    def run(batches):
        for batch in batches:
            sizes, every, places, ranges_after = [0], [], [], []
            for n, u, stored in zip(batch.column("n").to_pylist(), batch.column("u").to_pylist(), batch.column("tokens")):
                tokens = stored.values.to_numpy()
                k = prefix(n, alike) - u
                ranges = (tokens.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60)).astype(np.int64)
                ones = np.zeros((k, RANGES), np.int32)
                ones[np.arange(k), ranges[:k]] = 1
                after = np.bincount(ranges, minlength=RANGES) - np.cumsum(ones, axis=0)
                sizes.append(sizes[-1] + k)
                every.append(tokens[:k]), places.append(np.arange(u, u + k)), ranges_after.append(after.ravel())
            if not every:
                continue
            lists = pa.ListArray.from_arrays(pa.array(np.arange(sizes[-1] + 1) * RANGES, pa.int32()), pa.array(np.concatenate(ranges_after), pa.int32()))
            rows = pa.StructArray.from_arrays([pa.array(np.concatenate(every)), pa.array(np.concatenate(places), pa.int64()), lists], names=["token", "pos", "after"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "n", "u")), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rows)], names=["node", "n", "u", "entries"])

    return nodes.select("node", "n", "u", "tokens").mapInArrow(run, "node long, n long, u long, entries array<struct<token: long, pos: long, after: array<int>>>")


def _opened(packed: DataFrame) -> DataFrame:
    """A row an entry, with all other columns of its node."""
    return packed.select(*[c for c in packed.columns if c != "entries"], F.inline("entries"))


def _entries(nodes: DataFrame, alike: int = ALIKE) -> DataFrame:
    """token, pos, after, node, n and u of each prefix shingle."""
    return _opened(_packed(nodes, alike))


def may_link(x, y, alike: int = ALIKE) -> Column:
    """Whether sets that meet at a prefix shingle may be linked; x and y name a side's columns, x the smaller set."""
    least = F.ceil(F.lit(alike) * (x("n") + y("n")) / (100 + alike))  # to share
    size = 100 * x("n") >= alike * y("n")
    index = x("pos") < x("n") - F.ceil(F.lit(2 * alike) * x("n") / (100 + alike)) + 1
    position = F.least(x("n") - x("pos"), y("n") - y("pos")) >= least
    left = F.aggregate(F.zip_with(x("after"), y("after"), lambda a, b: F.least(a, b)), F.lit(0), lambda s, c: s + c)
    return size & index & position & (1 + left >= least)


def _smaller(x, y) -> Column:
    return (x("n") < y("n")) | ((x("n") == y("n")) & (x("node") < y("node")))


def led(entries: DataFrame, order: Column, alike: int = ALIKE) -> DataFrame:
    """Pairs (a, b) of each prefix shingle's first holder, by ``order``, with its holders of other labels."""
    leads = entries.groupBy("token").agg(F.min(F.struct(order.alias("o"), "node", "n", "pos", "label", "after")).alias("lead"))
    both = entries.join(leads, "token").where("label <> lead.label")
    mine, lead = (lambda c: F.col(c)), (lambda c: F.col(f"lead.{c}"))
    meets = F.when(_smaller(mine, lead), may_link(mine, lead, alike)).otherwise(may_link(lead, mine, alike))
    return both.where(meets).select(lead("node").alias("a"), F.col("node").alias("b")).distinct()


def remaining(entries: DataFrame, alike: int = ALIKE) -> DataFrame:
    """Pairs (a, b) of all holders of a prefix shingle that have different labels."""
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    met = entries.alias("x").join(entries.alias("y"), (x("token") == y("token")) & (x("label") != y("label")) & _smaller(x, y) & may_link(x, y, alike))
    return met.select(x("node").alias("a"), y("node").alias("b")).distinct()


def verified(pairs: DataFrame, nodes: DataFrame, alike: int = ALIKE) -> DataFrame:
    """The linked ones of the pairs. A node of many pairs is sent to several tasks, by the other node."""
    loads = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPLIT).alias("parts"))
    spread = pairs.join(loads, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts"))
    left = loads.join(nodes, F.col("a") == F.col("node")).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("n").alias("n_a"), F.col("tokens").alias("of_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return spread.join(right, "b").join(left, ["a", "part"]).where(100 * shared >= alike * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def linked(nodes: DataFrame, alike: int = ALIKE, first: DataFrame | None = None) -> DataFrame:
    """node, label (smallest node of its component) of nodes with a link; pairs (a, b) in ``first``, a written table, are tested before all others."""
    entries = saved(_packed(nodes, alike), "entries")
    labels = None
    for step in ("first", "typical", "other", "rest"):
        if step == "first" and first is None:
            continue
        # labels meet nodes, not their shingles, which are many times as many
        now = entries.withColumn("label", F.col("node"))
        if labels is not None:
            now = entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        now = _opened(now)
        if step == "first":
            pairs = first
        elif step == "rest":
            pairs = saved(remaining(now, alike), "pairs")
        else:
            pairs = saved(led(now, F.col("u") / F.col("n") if step == "typical" else F.xxhash64("node").cast("double"), alike), "pairs")
        new = saved(verified(pairs, nodes, alike), "links")
        forget(pairs)
        if labels is not None:
            if new.isEmpty():
                continue
            # nodes with their labels stand for all links so far
            new = new.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        labels = components(new)
    forget(entries)
    return labels


def sets_of(docs: DataFrame, rows: DataFrame, width: int = WORDS, hot: int = HOT, alike: int = ALIKE) -> DataFrame:
    """hi, lo, n, u and tokens of the sets that can be linked; rows has doc_id, hi, lo, n and often of all of docs."""
    names, counts = _frequent(rows, hot)
    n_rows = rows.count()
    many = rows.where("n > 0").groupBy("hi", "lo").agg(F.count("*").alias("c"), F.min("doc_id").alias("first")).where(F.col("c") > max(1000, n_rows // hot))
    firsts = {(r.hi % (1 << 64), r.lo % (1 << 64)): r.first for r in many.collect() if r.first is not None}  # at most ``hot``
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, size // BUCKET_BYTES)
    return _ranked(_shared(_dealt(docs, width, buckets, names, firsts), buckets, counts), alike)


def join(docs: DataFrame, width: int = WORDS, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = saved(sized_sets(docs, width, hot), "sets")
    nodes = saved(sets_of(docs, rows, width, hot).withColumn("node", F.monotonically_increasing_id()), "nodes")
    labels = linked(nodes)
    of = nodes.join(labels, "node").select("hi", "lo", "label")
    held = rows.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).join(of, ["hi", "lo"], "left")
    least = held.where("label is not null").groupBy("label").agg(F.min("first").alias("least"))
    # a set of one row and without links needs no name
    named = held.where("label is not null or c > 1").join(least, "label", "left")
    named = saved(named.select("hi", "lo", F.when(F.col("label").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"), F.lit(True).alias("named")), "named")
    out = rows.join(sized(named), ["hi", "lo"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
