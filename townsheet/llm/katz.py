"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff, partitioned tables.

Tokens are lower-case words and an end; the end also opens each text. Every training word and every
pair of adjacent tokens is counted: there is no vocabulary cap. The model backs off recursively:

* bigram count, discounted, over its context's count; else
* backoff weight of the context times the token's unigram probability, where a word's count is
  discounted and all words that training never met share, as one token, the mass that this frees.

Weights are exact: seen and unseen successors of every context sum to one, and so do the words.

How it is laid out. The ``COMMON`` commonest words (whole bins of like counts) and the end are known
by a number and sent to all tasks with their counts and weights, as are the ``HOT`` commonest pairs
of them; both bounds only decide where a count is looked up, not what it is. All other words are
known by 64-bit XXH64. Counts of all other pairs lie in one table by bucket: pairs of common words by
pair; pairs with one rare word in that word's bucket, beside the word's own count or its weights as a
context; pairs of two rare words in both words' buckets. So a pair's probability, or its share by
context and its share by target, is found in one visit to a bucket. Scoring deals each batch's
tokens into the same buckets and adds up one array of partial sums for each batch and bucket;
nothing is emitted a token, frequent words and pairs are answered on the spot.

Defined results: null and empty texts are one end token; with nothing to train on the end and the
unseen words share evenly; null ids count as an empty text for the fold; repeated rows repeat; an
empty table gives an empty one; extra columns are ignored. Two of n words share a hash with
probability n^2 / 2^65. Memory is a batch of text, or a bucket: their number follows the words.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townsheet.llm.common import partitions, pieces, saved, small_batches

#: Words and pairs answered from what is sent to all tasks; number of the end (words follow).
COMMON, HOT, END = 65_534, 300_000, 1
KNEE = 5  # counts above it are not discounted
WORDS, KEEP, HELD = 200_000, 60_000, 400_000
#: Training words that a bucket is made for.
BUCKET_WORDS = 1_000_000
RARE = np.uint64(1 << 63)


class Words(dict):
    """Number of a common word, else the hash of the word (bit 63 set); bounded."""

    def __init__(self, classes: dict[int, int]):
        self.classes = classes

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word) | 1 << 63
        value = self[word] = self.classes.get(h, h)
        return value

    def of(self, lists: list[list[bytes]]) -> np.ndarray:
        if len(self) > WORDS:
            kept = list(islice(self.items(), KEEP))
            self.clear()
            self.update(kept)
        return np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), np.uint64, sum(map(len, lists)))


def word_lists(batch: pa.RecordBatch):
    """(start, word lists) of slices of a batch with some MB of text."""
    for at, texts in pieces(batch.column("text")):
        yield at, [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts.to_pylist()]


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after the other; unsigned ones in as few bytes as hold them."""
    out = []
    for a in arrays:
        if a.dtype.kind in "iu" and a.dtype.itemsize > 1 and (not len(a) or a.min() >= 0):
            top = int(a.max()) if len(a) else 0
            a = a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")
        out.append(a)
    head = struct.pack("<B", len(out)) + b"".join(struct.pack("<2sI", a.dtype.str[1:].encode(), len(a)) for a in out)
    return head + b"".join(a.tobytes() for a in out)


def _opened(data: bytes) -> list[np.ndarray]:
    out, at = [], 1 + 6 * data[0]
    for k in range(data[0]):
        kind, n = struct.unpack_from("<2sI", data, 1 + 6 * k)
        out.append(np.frombuffer(data, "<" + kind.decode(), n, at))
        at += out[-1].nbytes
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})


PACKED = "bucket int, payload binary"


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[starts], np.add.reduceat(n, starts)


def unigrams(train: DataFrame) -> DataFrame:
    """h, n of every training word; tasks add up what they meet before it is shuffled."""

    def run(batches):
        words, keys, counts, held = Words({}), [], [], 0

        def flush():
            k, n = _summed(keys, counts)
            return pa.RecordBatch.from_pydict({"h": pa.array(k.view(np.int64)), "n": pa.array(n)})

        for batch in batches:
            for _, lists in word_lists(batch):
                k, n = np.unique(words.of(lists), return_counts=True)
                keys.append(k)
                counts.append(n)
                held += len(k)
                if held > HELD:
                    k, n = _summed(keys, counts)
                    keys, counts, held = [k], [n], len(k)
                    if held > HELD // 2:
                        yield flush()
                        keys, counts, held = [], [], 0
        if held:
            yield flush()

    return train.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def discounts(of: dict[int, int]) -> np.ndarray:
    """Good-Turing discounts d_1 to d_KNEE from counts of counts; absolute ones where those fail."""
    n = [of.get(r, 0) for r in range(KNEE + 2)]
    out = np.ones(KNEE + 1)
    top = (KNEE + 1) * n[KNEE + 1] / n[1] if n[1] else 1.0
    for r in range(1, KNEE + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top < 1 else 0.0
        out[r] = d if 0.05 < d < 1 else (r - 0.5) / r
    return out


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= KNEE, d[np.minimum(counts, KNEE)], 1.0)


@dataclass
class Model:
    classes: dict[int, int]  # hash of a common word to its number
    counts: np.ndarray  # training count by number
    tokens: int
    types: int
    p1: np.ndarray  # unigram probability by number
    word_d: np.ndarray  # discounts of words
    word_total: float  # what discounted word counts are divided by
    unseen: float  # probability of all unseen words together
    pair_d: np.ndarray
    divisor: np.ndarray  # by context number; 0: never a context
    backoff: np.ndarray  # weight by context number
    hot: np.ndarray  # keys of the commonest pairs, ascending
    hot_n: np.ndarray
    buckets: int
    tables: DataFrame  # counts by bucket
    contexts: DataFrame  # weights of rare contexts by bucket

    def light(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not isinstance(v, DataFrame)}

    def word_p(self, c: np.ndarray) -> np.ndarray:
        return word_p(self.light(), c)


def word_p(m: dict, c: np.ndarray) -> np.ndarray:
    """Unigram probability of words by count."""
    return np.where(c > 0, discounted(np.maximum(c, 1), m["word_d"]) / m["word_total"], m["unseen"])


def bucket_of_pairs(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def bucket_of_words(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes.view(np.int64) % buckets).astype(np.int64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits for a pair with a rare word."""
    a, b = a.astype(np.uint64, copy=False), b.astype(np.uint64, copy=False)
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(33))


def tokens_of(values: np.ndarray, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and token of every token of texts, ends included, and each text's tokens."""
    sizes = np.array([len(x) + 1 for x in lists])
    now = np.full(int(sizes.sum()), END, np.uint64)
    inner = np.ones(len(now), bool)
    inner[np.cumsum(sizes) - 1] = False
    now[inner] = values
    return np.r_[np.uint64(END), now[:-1]], now, sizes


#: Kinds of pairs: both common; rare context; rare token; both rare, by context and by token.
KINDS = range(5)


def split_kinds(a: np.ndarray, b: np.ndarray, buckets: int):
    """(kind, places, bucket of each, arrays that name each pair) for the kinds in turn.

    Kinds 1 and 2 name the rare word by hash and the other by number, 3 and 4 both by hash.
    """
    ra, rb = a >= RARE, b >= RARE
    both, one, other, two = np.flatnonzero(~ra & ~rb), np.flatnonzero(ra & ~rb), np.flatnonzero(~ra & rb), np.flatnonzero(ra & rb)
    key = (a[both] << np.uint64(16) | b[both]).astype(np.uint32)
    yield 0, both, bucket_of_pairs(key, buckets), [key]
    yield 1, one, bucket_of_words(a[one], buckets), [a[one], b[one]]
    yield 2, other, bucket_of_words(b[other], buckets), [b[other], a[other]]
    yield 3, two, bucket_of_words(a[two], buckets), [a[two], b[two]]
    yield 4, two, bucket_of_words(b[two], buckets), [b[two], a[two]]


def _split(bucket: np.ndarray, *arrays: np.ndarray):
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for some in np.split(order, cuts) if len(order) else []:
        yield int(bucket[some[0]]), *(a[some] for a in arrays)


def _counted(names: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct pairs with their summed counts and keys, by ascending key."""
    key = names[0].astype(np.uint64) if len(names) == 1 else mixed(*names)
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.r_[len(key) > 0, key[order][1:] != key[order][:-1]])
    return [x[order[starts]] for x in names], np.add.reduceat(n[order], starts) if len(starts) else n[:0], key[order[starts]]


def _sections(pairs: list[list[np.ndarray]]) -> list[np.ndarray]:
    """names and counts of the five kinds, flat: one array of names for kind 0, two for the others."""
    return [x for k in KINDS for x in pairs[k]]


def _kinds(flat: list[np.ndarray]) -> list[list[np.ndarray]]:
    return [flat[:2], *(flat[2 + 3 * k : 5 + 3 * k] for k in range(4))]


def count_pairs(train: DataFrame, classes, buckets: int) -> DataFrame:
    """Counts of all pairs as rows (bucket, payload), summed over some million tokens each."""
    nothing = [np.empty(0, np.uint32), np.empty(0, np.int64)], *([np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)] for _ in range(4))

    def run(batches):
        words, held, size = Words(classes.value), [[] for _ in KINDS], 0

        def flush():
            by_bucket: dict[int, list] = {}
            for kind in KINDS:
                joined = [np.concatenate(x) for x in zip(*held[kind])]
                names, n, _ = _counted(joined[:-1], joined[-1])
                where = bucket_of_pairs(names[0], buckets) if kind == 0 else bucket_of_words(names[0], buckets)
                for b, *some in _split(where, *names, n):
                    by_bucket.setdefault(b, list(nothing))[kind] = some
            return _rows([(b, _packed(_sections(x))) for b, x in by_bucket.items()])

        for batch in batches:
            for _, lists in word_lists(batch):
                a, b, _ = tokens_of(words.of(lists), lists)
                for kind, places, _, names in split_kinds(a, b, buckets):
                    names, n, _ = _counted(names, np.ones(len(places), np.int64))
                    held[kind].append((*names, n))
                    size += len(n)
                if size > HELD:
                    yield flush()
                    held, size = [[] for _ in KINDS], 0
        if size:
            yield flush()

    return train.select("text").mapInArrow(run, PACKED)


def rare_words(words: DataFrame, classes, buckets: int) -> DataFrame:
    """Words that have no number, as packed rows (bucket, hashes and counts)."""

    def run(batches):
        for batch in batches:
            h, n, b = (batch.column(i).to_numpy() for i in range(3))
            some = np.fromiter((x not in classes.value for x in h.view(np.uint64).tolist()), bool, len(h))
            yield _rows([(bucket, _packed([hh.view(np.uint64), nn])) for bucket, hh, nn in _split(b[some].astype(np.int64), h[some], n[some])])

    keyed = words.select("h", "n", F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"))
    return keyed.repartition(buckets, "bucket").mapInArrow(run, PACKED)


def table(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """One row a bucket: names and counts of its pairs by kind, then hashes (ascending) and counts of its rare words."""

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        bucket = (left if len(left) else right).column("bucket")[0].as_py()
        parts = [_kinds(_opened(x.as_py())) for x in left.column("payload")]
        out = []
        for kind in KINDS:
            width = 1 if kind == 0 else 2
            joined = [np.concatenate([p[kind][i] for p in parts]) if parts else np.empty(0, np.uint64) for i in range(width + 1)]
            names, n, _ = _counted(joined[:-1], joined[-1].astype(np.int64))
            out += [*names, n]
        own = [_opened(x.as_py()) for x in right.column("payload")]
        h, n = (np.concatenate([o[i] for o in own]) if own else np.empty(0, np.uint64) for i in range(2))
        order = np.argsort(h)
        return pa.Table.from_batches([_rows([(bucket, _packed([*out, h[order], n[order]]))])])

    return pairs.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(merge, PACKED)


def commonest(words: DataFrame, most: int) -> list:
    """Up to ``most`` words, by whole count bins from the top: at most ``most`` rows reach the driver.

    A bin spans counts within a 64th of a power of two, so there are some thousand bins at most.
    """
    binned = words.withColumn("bin", F.floor(F.log("n") / F.log(F.lit(2.0)) * 64).cast("int"))
    sizes = sorted(((r.bin, r["count"]) for r in binned.groupBy("bin").count().collect()), reverse=True)
    total, least = 0, None
    for b, n in sizes:
        total += n
        if total > most:
            break
        least = b
    if least is None:
        return []
    return sorted(binned.where(F.col("bin") >= least).select("h", "n").collect(), key=lambda r: (-r.n, r.h))


def fit(train: DataFrame, common: int = COMMON, hot: int = HOT) -> Model:
    spark = train.sparkSession
    small_batches(spark)
    words = saved(unigrams(train), "unigrams")
    texts = train.count()
    n_words, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    buckets = max(partitions(spark), n_words // BUCKET_WORDS)
    of = {int(r.n): int(r["count"]) for r in words.where(F.col("n") <= KNEE + 1).groupBy("n").count().collect()}
    top = commonest(words, common)
    classes = {int(r.h) & (1 << 64) - 1: i + 2 for i, r in enumerate(top)}
    counts = np.zeros(len(top) + 2, np.int64)
    counts[2:] = [r.n for r in top]
    counts[END] = texts
    tokens, types = n_words + texts, types + (texts > 0)

    # words: discounted counts, and what is freed goes to unseen words; the end is no word and kept whole
    word_d = discounts(of)
    low = sum(n * r for r, n in of.items() if r <= KNEE)
    kept = sum(n * r * word_d[r] for r, n in of.items() if r <= KNEE) + (tokens - low)
    total = float(tokens) if tokens - kept > 1e-9 * max(tokens, 1) else tokens + 0.5
    p1 = discounted(counts, word_d) / total
    p1[END] = texts / total if tokens else 0.5
    unseen = 1.0 - kept / total if tokens else 0.5
    weigh = {"word_d": word_d, "word_total": total, "unseen": unseen}

    sent = spark.sparkContext.broadcast(classes)
    tables = saved(table(count_pairs(train, sent, buckets), rare_words(words, sent, buckets)), "bigrams")
    size = len(counts)

    def ranks(batches):
        """How many pairs occur so often: by count up to KNEE + 1, and by bin for pairs of common words."""
        out, bins = np.zeros(KNEE + 2, np.int64), np.zeros(64 * 64, np.int64)
        for batch in batches:
            for x in batch.column("payload"):
                pairs = _kinds(_opened(x.as_py())[:14])
                for kind in range(4):  # the fifth repeats the fourth
                    n = pairs[kind][-1].astype(np.int64)
                    out += np.bincount(n[n <= KNEE + 1], minlength=KNEE + 2)
                bins += np.bincount(_bins(pairs[0][-1].astype(np.int64)), minlength=len(bins))
        used = np.flatnonzero(bins)
        r, n = np.r_[np.arange(KNEE + 2), used + 1000], np.r_[out, bins[used]]
        yield pa.RecordBatch.from_pydict({"r": pa.array(r), "n": pa.array(n)})

    pair_of = {int(r.r): int(r.n) for r in tables.select("payload").mapInArrow(ranks, "r long, n long").groupBy("r").agg(F.sum("n").alias("n")).collect()}
    pair_d = discounts({r: n for r, n in pair_of.items() if r < 1000})
    least, met = 1 << 30, 0
    for r in sorted((r for r in pair_of if r >= 1000), reverse=True):
        met += pair_of[r]
        if met > hot:
            break
        least = r - 1000

    def hot_pairs(batches):
        for batch in batches:
            for x in batch.column("payload"):
                k, n = _opened(x.as_py())[:2]
                some = _bins(n.astype(np.int64)) >= least
                yield pa.RecordBatch.from_pydict({"k": pa.array(k[some].astype(np.int64)), "n": pa.array(n[some].astype(np.int64))})

    def common_contexts(batches):
        sums = np.zeros((3, size))
        for batch in batches:
            for x in batch.column("payload"):
                flat = _opened(x.as_py())
                pairs = _kinds(flat[:14])
                k, n = (x.astype(np.int64) for x in pairs[0])
                b, a, m = pairs[2]
                p = word_p(weigh, _found(flat[14], flat[15], b))
                for context, n, p in ((k >> 16, n, p1[k & 0xFFFF]), (a.astype(np.int64), m.astype(np.int64), p)):
                    for i, w in enumerate((n, discounted(n, pair_d), p)):
                        sums[i] += np.bincount(context, weights=w, minlength=size)
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_pydict({"context": pa.array(used), **{c: pa.array(sums[i][used]) for i, c in enumerate("cdp")}})

    def rare_contexts(batches):
        """Sums of rare contexts by their bucket; targets that are rare too add their share from theirs."""
        for batch in batches:
            for bucket, x in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
                flat = _opened(x.as_py())
                _, one, _, by_context, by_token = _kinds(flat[:14])
                a = np.concatenate([one[0], by_context[0]])
                n = np.concatenate([one[2], by_context[2]]).astype(np.int64)
                yield _rows([(bucket, _packed([a, n.astype(float), discounted(n, pair_d), np.r_[p1[one[1].astype(np.int64)], np.zeros(len(by_context[0]))]]))])
                b, a = by_token[:2]
                p, none = word_p(weigh, _found(flat[14], flat[15], b)), np.zeros(len(a))
                yield _rows([(to, _packed([aa, zero, zero, pp])) for to, aa, pp, zero in _split(bucket_of_words(a, buckets), a, p, none)])

    def weights(rows: pa.Table) -> pa.Table:
        """Hashes of a bucket's contexts, ascending, with divisor and backoff weight."""
        a, *sums = (np.concatenate(x) for x in zip(*(_opened(x.as_py()) for x in rows.column("payload"))))
        order = np.argsort(a, kind="stable")
        starts = np.flatnonzero(np.r_[len(a) > 0, a[order][1:] != a[order][:-1]])
        c, d, p = (np.add.reduceat(x[order], starts) if len(starts) else x[:0] for x in sums)
        pairs = np.array([context_weights(*x) for x in zip(c.tolist(), d.tolist(), (1.0 - p).tolist())]).reshape(-1, 2)
        return pa.Table.from_batches([_rows([(rows.column("bucket")[0].as_py(), _packed([a[order[starts]], pairs[:, 0].copy(), pairs[:, 1].copy()]))])])

    # both are bounded by COMMON and HOT
    found = tables.select("payload").mapInArrow(common_contexts, "context long, c double, d double, p double").groupBy("context").agg(*[F.sum(c).alias(c) for c in "cdp"]).collect()
    divisor, backoff = np.zeros(size), np.ones(size)
    for r in found:
        divisor[r.context], backoff[r.context] = context_weights(r.c, r.d, 1.0 - r.p)
    often = sorted((r.k, r.n) for r in tables.select("payload").mapInArrow(hot_pairs, "k long, n long").collect())
    hot_k, hot_n = np.array(often, np.int64).reshape(-1, 2).T
    contexts = saved(tables.mapInArrow(rare_contexts, PACKED).groupBy("bucket").applyInArrow(weights, PACKED), "contexts")
    return Model(classes, counts, tokens, types, p1, word_d, total, unseen, pair_d, divisor, backoff, hot_k.copy(), hot_n.copy(), buckets, tables, contexts)


def _bins(n: np.ndarray) -> np.ndarray:
    """Bins of like counts: 64 to a power of two."""
    return np.floor(np.log2(np.maximum(n, 1)) * 64).astype(np.int64)


def context_weights(c: float, d: float, free_p: float) -> tuple[float, float]:
    """What discounted counts are divided by, and the weight of unigrams not seen in the context."""
    if free_p < 1e-12:
        return d, 0.0  # every class was seen: nothing to back off to
    divisor = c if c - d > 1e-9 * c else c + 0.5  # a context without low counts frees half a count
    return divisor, (1.0 - d / divisor) / free_p


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model.light())
    buckets = model.buckets

    def base_of(m, c):
        return np.log10((c + 0.5) / (m["tokens"] + 0.5 * (m["types"] + 1)))

    def logs(m):
        with np.errstate(divide="ignore"):
            return {k: np.log10(m[k]) for k in ("p1", "backoff", "divisor", "pair_d")}

    def seen_part(log, c):
        return np.log10(np.maximum(c, 1)) + np.where(c <= KNEE, log["pair_d"][np.minimum(c, KNEE)], 0.0)

    def deal(batches):
        """Rows (batch, bucket, payload); bucket -1 - x holds a batch's ids and what is known at once."""
        m = sent.value
        words, log, common_base = Words(m["classes"]), logs(m), base_of(m, m["counts"])
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            all_ids = batch.column("doc_id")
            for at, lists in word_lists(batch):
                a, b, sizes = tokens_of(words.of(lists), lists)
                n = len(lists)
                doc = np.repeat(np.arange(n), sizes)
                common = b < RARE
                numbers = b[common].astype(np.int64)
                base = np.bincount(doc[common], common_base[numbers], n)
                known = np.bincount(doc[common], m["counts"][numbers] > 0, n)
                total = np.zeros(n)
                by_bucket: dict[int, list] = {}
                for kind, places, where, names in split_kinds(a, b, buckets):
                    if kind == 0:  # the commonest pairs are answered here
                        key = names[0].astype(np.int64)
                        c = _found(m["hot"], m["hot_n"], key)
                        hit = c > 0
                        total += np.bincount(doc[places[hit]], seen_part(log, c[hit]) - log["divisor"][key[hit] >> 16], n)
                        places, where, names = places[~hit], where[~hit], [names[0][~hit]]
                    for to, d, *some in _split(where, doc[places], *names):
                        by_bucket.setdefault(to, [[]] * 5)
                        used, times = np.unique(d, return_counts=True)
                        by_bucket[to][kind] = [np.diff(used, prepend=0), times, *some]
                ids = all_ids[at : at + n].to_pylist()
                head = [np.array([i or 0 for i in ids], "<i8"), np.array([i is None for i in ids], "<i8"), sizes.astype("<i8"), known.astype("<i8"), base, total]
                rows = [(-1 - (part * 1009 + number) % buckets, b"".join(x.tobytes() for x in head))]
                rows += [(to, struct.pack("<B", sum((len(x) > 0) << k for k, x in enumerate(found))) + _packed([x for f in found for x in f])) for to, found in by_bucket.items()]
                name = f"{part}-{number}"
                number += 1
                yield pa.RecordBatch.from_pydict({"batch": pa.array([name] * len(rows)), "bucket": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        """Partial scores of each batch from one bucket's tables, of the texts that have tokens there; known and base where rare ones are."""
        m = sent.value
        log = logs(m)
        stored = {k: [x.as_py() for x, kk in zip(right.column("payload"), right.column("kind").to_pylist()) if kk == k] for k in (0, 1)}
        empty = [np.empty(0, np.uint64)] * 16
        flat = _opened(stored[0][0]) if stored[0] else empty
        pairs, rare, rare_n = _kinds(flat[:14]), flat[14], flat[15]
        keys = [pairs[0][0].astype(np.uint64), *(mixed(p[0], p[1]) for p in pairs[1:])]  # ascending, as merged
        ctx, ctx_divisor, ctx_backoff = _opened(stored[1][0]) if stored[1] else empty[:3]
        ctx_log = np.log10(ctx_divisor.astype(float)), np.log10(ctx_backoff.astype(float))

        def context(h):
            """Logarithms of divisor and backoff weight; a word that is no context leaves all to unigrams."""
            at, there = _places(ctx, h)
            return (np.where(there, x[at] if len(ctx) else 0.0, 0.0) for x in ctx_log)

        out = []
        for name, bucket, payload in zip(left.column("batch").to_pylist(), left.column("bucket").to_pylist(), left.column("payload")):
            data = payload.as_py()
            if bucket < 0:
                out.append((name, True, data))
                continue
            kinds = data[0]
            arrays = iter(_opened(data[1:]))
            asked = {k: [next(arrays) for _ in range(3 if k == 0 else 4)] for k in KINDS if kinds >> k & 1}
            for x in asked.values():
                x[0] = np.cumsum(x[0], dtype=np.int64)  # texts are told by their distances
            texts = np.unique(np.concatenate([x[0] for x in asked.values()]))
            n = len(texts)
            known, base, total, rarely = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, bool)
            for kind, (used, counts, *names) in asked.items():
                doc = np.repeat(np.searchsorted(texts, used), counts.astype(np.int64))
                names = [x.astype(np.uint64) for x in names]
                c = _found(keys[kind], pairs[kind][-1], names[0] if kind == 0 else mixed(*names))
                seen, part = c > 0, seen_part(log, c)
                if kind in (2, 4):
                    count = _found(rare, rare_n, names[0])
                    rarely[doc] = True
                    known += np.bincount(doc, count > 0, n)
                    base += np.bincount(doc, base_of(m, count), n)
                    target = np.log10(word_p(m, count))
                if kind == 0:
                    before, now = (names[0] >> np.uint64(16)).astype(np.int64), (names[0] & np.uint64(0xFFFF)).astype(np.int64)
                    part = np.where(seen, part - log["divisor"][before], log["backoff"][before] + log["p1"][now])
                elif kind == 1:
                    divisor, backoff = context(names[0])
                    part = np.where(seen, part - divisor, backoff + log["p1"][names[1].astype(np.int64)])
                elif kind == 2:
                    before = names[1].astype(np.int64)
                    part = np.where(seen, part - log["divisor"][before], log["backoff"][before] + target)
                elif kind == 3:
                    divisor, backoff = context(names[0])
                    part = np.where(seen, part - divisor, backoff)
                else:
                    part = np.where(seen, 0.0, target)
                total += np.bincount(doc, part, n)
            out.append((name, False, _packed([np.diff(texts, prepend=0), total, np.packbits(rarely), known[rarely].astype(np.int64), base[rarely]])))
        return pa.table({"batch": pa.array([o[0] for o in out], pa.string()), "main": pa.array([o[1] for o in out], pa.bool_()), "sums": pa.array([o[2] for o in out], pa.binary())})

    def finish(rows: pa.Table) -> pa.Table:
        main = next(x.as_py() for x, k in zip(rows.column("sums"), rows.column("main").to_pylist()) if k)
        n = len(main) // 48
        ids, nulls, sizes, known = np.frombuffer(main, "<i8", 4 * n).reshape(4, n)
        base, total = np.frombuffer(main, "<f8", 2 * n, 32 * n).reshape(2, n)
        # added in one order whatever order the rows came in
        more = np.zeros((3, n))
        for x in sorted(x.as_py() for x, k in zip(rows.column("sums"), rows.column("main").to_pylist()) if not k):
            apart, part, bits, *sums = _opened(x)
            texts = np.cumsum(apart, dtype=np.int64)  # a text is there once
            rare = texts[np.unpackbits(bits, count=len(texts)).astype(bool)]
            more[0][rare] += sums[0]
            more[1][rare] += sums[1]
            more[2][texts] += part
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=nulls.astype(bool)), "n_tokens": pa.array(sizes), "n_known": pa.array(known + np.rint(more[0]).astype(np.int64)), "base_score": pa.array(base + more[1]), "score": pa.array(total + more[2])})

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(deal, "batch string, bucket int, payload binary")
    stored = model.tables.select("bucket", F.lit(0).alias("kind"), "payload").unionByName(model.contexts.select("bucket", F.lit(1).alias("kind"), "payload"))
    found = dealt.groupBy("bucket").cogroup(stored.groupBy("bucket")).applyInArrow(look_up, "batch string, main boolean, sums binary")
    return found.groupBy("batch").applyInArrow(finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is among ascending ones, and whether it is."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _found(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The count of each wanted key, 0 where there is none; keys ascend."""
    at, there = _places(keys, wanted)
    return np.where(there, counts[at].astype(np.int64), 0) if len(keys) else np.zeros(len(wanted), np.int64)
