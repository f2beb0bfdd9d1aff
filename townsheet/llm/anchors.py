"""Exact substring deduplication from fixed-block anchors.

A window of 13 words that starts in two documents holds, in each, one of that document's blocks of
7 words at places 0, 7, 14 and so on (13 = 2 x 7 - 1). The operator therefore

1. hashes every rolling window of 7 words of every document, dealt into buckets by hash; those at
   block places are the index, all of them are probes; hits are blocks that another document holds
   at any place. A document is found by its own blocks, so other windows need no answer;
2. extends each hit to the 13-word windows around it and deals those, with 80 hash bits, into
   buckets; a window is repeated if a document with a smaller id holds it. Overlapping repeated
   windows are the maximal repeats;
3. removes the words that repeated windows cover.

Hashes travel packed: a row holds all of one batch for one bucket. A block asks with its document
and place; any other window tells its hash alone, sorted, by differences. A short hash can only add
candidates, which step 2 then drops. Groups are summarised by minimum and maximum, never paired.

A task settles what its own texts show before anything is dealt. A block that two of its documents
hold is a hit: one window tells the bucket of it, and later ones are sent nowhere. A window that a
smaller id of the task holds is repeated: only those of the least id are asked about. So a passage in
a third of all documents costs a few entries a task, and not one a place. What a task settles
depends on which texts it reads together: a task that is run again has to read the same rows in the
same order, as it does from files; give a table and not the result of a shuffle.

Defined results: null texts and texts under 13 words lose nothing; a null doc_id counts as greater
than any id; rows with one id do not count against each other; an empty table gives an empty one.
Extra columns are ignored. Memory is a batch, or a bucket: the number of buckets follows the bytes of
text. Rows that share the least id of a passage (ids given many times, or null) are all asked about. Windows count as equal if 80 bits of two unrelated hashes are.
"""

from __future__ import annotations

import hashlib
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townsheet.llm.common import partitions, pieces, small_batches

WINDOW = 13
WORDS, KEEP = 300_000, 60_000
#: Bytes of text that a bucket is made for.
BUCKET_BYTES = 64 << 20
#: Settled hashes that a task keeps in mind.
MET = 1 << 18
LAST = (1 << 63) - 1
_BASE, _BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """64-bit hashes of words, filled as they come and bounded."""

    def __init__(self, hashed):
        self.hashed = hashed

    def __missing__(self, word: bytes) -> int:
        value = self[word] = self.hashed(word)
        return value

    def of(self, lists: list[list[bytes]], n: int) -> np.ndarray:
        if len(self) > WORDS:
            kept = list(islice(self.items(), KEEP))
            self.clear()
            self.update(kept)
        return np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), np.uint64, n)


#: Two functions of words that have nothing in common, for hashes and for their checks.
WORD_HASHES, CHECK_HASHES = _Words(xxhash.xxh64_intdigest), _Words(xxhash.xxh3_64_intdigest)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(w: np.ndarray, width: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Hashes of the windows that start at each word (fewer than w by width - 1)."""
    n = max(0, len(w) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * base + w[k : k + n]
        return mixed(out)


def _planes(a: np.ndarray) -> bytes:
    """Unsigned 32-bit integers by byte, lowest bytes first: zero bytes lie together and compress."""
    return a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(data: bytes, n: int, at: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


def pack(keys: np.ndarray, ids: np.ndarray, docs: np.ndarray, places: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> bytes:
    """Windows of one batch for one bucket: docs are ordinals into keys, ascending with places within."""
    used, counts = np.unique(docs, return_counts=True)
    first = np.r_[True, docs[1:] != docs[:-1]]
    gaps = np.where(first, places, places - np.r_[0, places[:-1]])
    head = np.array([len(used), len(docs), hashes.itemsize, len(checks)], "<u4").tobytes()
    return head + keys[used].astype("<i8").tobytes() + (ids[used].astype("<i8").tobytes() if len(checks) else b"") + _planes(counts) + _planes(gaps) + hashes.tobytes() + checks.tobytes()


def unpack(data: bytes, hashed: bool = True):
    n_docs, n, size, n_checks = np.frombuffer(data, "<u4", 4).tolist()
    size = size if hashed else 0
    at = 16
    keys = np.frombuffer(data, "<i8", n_docs, at)
    at += 8 * n_docs
    ids = np.frombuffer(data, "<i8", n_docs, at) if n_checks else np.zeros(n_docs, np.int64)
    at += 8 * n_docs if n_checks else 0
    counts = _unplaned(data, n_docs, at)
    at += 4 * n_docs
    gaps = _unplaned(data, n, at)
    at += 4 * n
    hashes = np.frombuffer(data, f"<u{size}" if hashed else "<u4", n if hashed else 0, at)
    checks = np.frombuffer(data, "<u2", n_checks, at + size * n)
    starts = np.cumsum(counts) - counts
    total = np.cumsum(gaps)
    places = total - np.repeat(total[starts] - gaps[starts], counts) if n else gaps
    return keys, ids, np.repeat(np.arange(n_docs), counts), places, hashes, checks


def _pieces(batch: pa.RecordBatch):
    """Slices of a batch with some MB of text, as (start, word lists)."""
    for at, texts in pieces(batch.column("text")):
        yield at, [words_of(t) for t in texts.to_pylist()]


def _deal(keys, ids, docs, places, hashes, checks, short: bool, buckets: int):
    """A row for each bucket that gets windows."""
    bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for some in np.split(order, cuts) if len(order) else []:
        h = hashes[some].astype("<u4") if short else hashes[some].astype("<u8")
        yield int((hashes[some[0]] >> np.uint64(32)) % np.uint64(buckets)), pack(keys, ids, docs[some], places[some], h, checks[some] if len(checks) else checks)


class _Met:
    """What a task has settled, by sorted hash, with a value and a check each.

    Beyond a bound it forgets what the last piece lacked, which only has windows sent again.
    """

    def __init__(self):
        self.hashes, self.values, self.checks = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash would stand, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def note(self, hashes: np.ndarray, values: np.ndarray, checks: np.ndarray) -> None:
        """Sorted hashes of the last piece, in place of what was held for them."""
        hashes, first = np.unique(hashes, return_index=True)
        values, checks = values[first], checks[first]
        if len(hashes) + len(self.hashes) <= MET:
            old = ~np.isin(self.hashes, hashes, assume_unique=True)
            hashes, values, checks = np.r_[hashes, self.hashes[old]], np.r_[values, self.values[old]], np.r_[checks, self.checks[old]]
            order = np.argsort(hashes)
            hashes, values, checks = hashes[order], values[order], checks[order]
        self.hashes, self.values, self.checks = hashes, values, checks


def settle_blocks(owner: np.ndarray, block: np.ndarray, h: np.ndarray, met: _Met) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of a piece ask their bucket, which are hits already, and the hashes that are told.

    Of a hash that one document holds, its blocks ask, or the hash is told if it has none; so a told
    hash is never that of a block of the same document. One that several hold is told once a task.
    """
    asked, hit = np.zeros(len(h), bool), np.zeros(len(h), bool)
    if not len(h):
        return asked, hit, h
    order = np.argsort(h)
    starts = np.flatnonzero(np.r_[True, np.diff(h[order]) != 0])
    sizes = np.diff(np.r_[starts, len(h)])
    hashes, owners, blocks = h[order][starts], owner[order], block[order]
    several = np.minimum.reduceat(owners, starts) != np.maximum.reduceat(owners, starts)
    indexed = np.maximum.reduceat(blocks.view(np.int8), starts) > 0
    _, known = met.find(hashes)
    several |= known
    hit[order] = np.repeat(several, sizes) & blocks
    asked[order] = np.repeat(~several, sizes) & blocks
    held = hashes[several]
    met.note(held, np.zeros(len(held), np.int64), np.zeros(len(held), np.uint64))
    return asked, hit, hashes[np.where(several, ~known, ~indexed)]


def settle_windows(owner: np.ndarray, h: np.ndarray, check: np.ndarray, met: _Met) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of a piece go to their bucket, and which a smaller id of the task holds already."""
    if not len(h):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((check, h))
    starts = np.flatnonzero(np.r_[True, (np.diff(h[order]) != 0) | (np.diff(check[order]) != 0)])
    sizes = np.diff(np.r_[starts, len(h)])
    hashes, checks, owners = h[order][starts], check[order][starts].astype(np.uint64), owner[order]
    least, greatest = np.minimum.reduceat(owners, starts), np.maximum.reduceat(owners, starts)
    at, known = met.find(hashes)
    if known.any():
        known &= met.checks[at] == checks
        least = np.where(known, np.minimum(least, met.values[at] if len(met.values) else least), least)
    gone = np.zeros(len(h), bool)
    gone[order] = owners > np.repeat(least, sizes)
    held = known | (least != greatest)
    met.note(hashes[held], least[held], checks[held])
    return ~gone, gone


#: What a packed row holds: windows that ask, hashes that are told, places that are settled.
ASKED, TOLD, SETTLED = range(3)
PACKED, SENT, PLACES = "bucket int, kind int, payload binary", "bucket int, payload binary", "key long, id long, places binary"


def _told(hashes: np.ndarray, buckets: int):
    """A row for each bucket that is told hashes: the lower halves in order, as differences."""
    both = (((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
    both.sort()
    cuts = np.flatnonzero(np.diff(both >> np.uint64(32))) + 1
    for some in np.split(both, cuts) if len(both) else []:
        low = (some & np.uint64(0xFFFFFFFF)).astype(np.int64)
        yield int(some[0] >> np.uint64(32)), _planes(np.diff(low, prepend=0))


def untold(data: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(data, len(data) // 4, 0)).astype("<u4")


def _packed_rows(asked, told, settled: pa.Table) -> pa.RecordBatch:
    """Windows and hashes by their buckets, and settled places by the buckets of their documents."""
    done = zip(*(settled.column(c).to_pylist() for c in ("bucket", "payload")))
    rows = [(b, kind, p) for kind, some in ((ASKED, asked), (TOLD, told), (SETTLED, done)) for b, p in some]
    bucket, kind, payload = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "kind": pa.array(kind, pa.int32()), "payload": pa.array(payload, pa.binary())})


def _block(window: int) -> int:
    return (window + 1) // 2


def probes(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    width = _block(window)

    def run(batches):
        met = _Met()
        for batch in batches:
            all_keys = batch.column("key").to_numpy()
            for at, lists in _pieces(batch):
                sizes = np.array([len(x) for x in lists])
                w = WORD_HASHES.of(lists, int(sizes.sum()))
                doc = np.repeat(np.arange(len(lists)), sizes)
                place = np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                h = rolling(w, width)
                fits = place[: len(h)] + width <= sizes[doc[: len(h)]]
                h, doc, place = h[fits], doc[: len(fits)][fits], place[: len(fits)][fits]
                keys = all_keys[at : at + len(lists)]
                ask, hit, told = settle_blocks(keys[doc], place % width == 0, h, met)
                asked = _deal(keys, keys, doc[ask], place[ask], h[ask], np.empty(0, "<u2"), True, buckets)
                yield _packed_rows(asked, _told(told, buckets), _sent_places(keys, keys, doc[hit], place[hit], buckets))

    return docs.select("key", "text").mapInArrow(run, PACKED)


def _opened(table: pa.Table):
    """All windows of a bucket: keys and ids by document, then document, place, hash, check by window."""
    parts = [unpack(x.as_py()) for x in table.column("payload")]
    shift = np.cumsum([0, *(len(p[0]) for p in parts)])
    return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] + s for p, s in zip(parts, shift)]), *(np.concatenate([p[i] for p in parts]) for i in (3, 4, 5)))


def _sent_places(keys, ids, docs, places, buckets: int) -> pa.Table:
    """Places of a bucket's documents, packed into a row for each bucket of documents."""
    target = np.mod(keys[docs], buckets)
    order = np.argsort(target, kind="stable")
    cuts = np.flatnonzero(np.diff(target[order])) + 1
    none = np.empty(0, "<u4")
    rows = [(int(target[some[0]]), pack(keys, keys, docs[some], places[some], none, none) + ids[np.unique(docs[some])].astype("<i8").tobytes()) for some in (np.split(order, cuts) if len(order) else [])]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})


def _gathered(sent: DataFrame) -> DataFrame:
    """A row for each document with its places."""

    def run(table: pa.Table) -> pa.Table:
        parts = []
        for x in table.column("payload"):
            data = x.as_py()
            keys, _, docs, places, _, _ = unpack(data, False)
            ids = np.frombuffer(data, "<i8", len(keys), len(data) - 8 * len(keys))
            parts.append((keys[docs], ids[docs], places))
        keys, ids, places = map(np.concatenate, zip(*parts))
        order = np.lexsort((places, ids, keys))
        keys, ids, places = keys[order], ids[order], places[order].astype("<u4")
        cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(ids) != 0)) + 1
        first = np.r_[0, cuts]
        return pa.table({"key": pa.array(keys[first], pa.int64()), "id": pa.array(ids[first], pa.int64()), "places": pa.array([p.tobytes() for p in np.split(places, cuts)], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, PLACES)


def _judged(packed: DataFrame, judge) -> DataFrame:
    """Places that a bucket's rows prove, beside those that were settled before."""

    def run(table: pa.Table) -> pa.Table:
        asked, told, done = (table.filter(pc.equal(table["kind"], kind)).select(["bucket", "payload"]) for kind in (ASKED, TOLD, SETTLED))
        return pa.concat_tables([done, judge(asked, told)]) if asked.num_rows else done

    return _gathered(packed.groupBy("bucket").applyInArrow(run, SENT))


def hits(packed: DataFrame, buckets: int) -> DataFrame:
    """Places of blocks that another document holds: told by it, or asked about by it as well."""

    def judge(asked: pa.Table, told: pa.Table) -> pa.Table:
        keys, _, docs, places, h, _ = _opened(asked)
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(h[order]) != 0])
        owner = keys[docs[order]]
        shared = np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)
        if told.num_rows:
            known = np.sort(np.concatenate([untold(x.as_py()) for x in told["payload"]]))
            own = h[order][starts]
            shared |= known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
        hit = np.zeros(len(h), bool)
        hit[order] = np.repeat(shared, np.diff(np.r_[starts, len(h)]))
        return _sent_places(keys, keys, docs[hit], places[hit], buckets)

    return _judged(packed, judge)


def _marked(n: int, stored: list[bytes], before: int, after: int) -> np.ndarray:
    """Which of n places lie within [place - before, place + after] of a stored place."""
    edges = np.zeros(n + 1, np.int64)
    p = np.concatenate([np.frombuffer(x, "<u4") for x in stored]).astype(np.int64) if stored else np.empty(0, np.int64)
    np.add.at(edges, np.clip(p - before, 0, n), 1)
    np.add.at(edges, np.clip(p + after + 1, 0, n), -1)
    return np.cumsum(edges[:n]) > 0


def extensions(docs: DataFrame, found: DataFrame, window: int, buckets: int) -> DataFrame:
    """The windows around each hit, packed."""
    width = _block(window)

    def run(batches):
        met = _Met()
        for batch in batches:
            all_keys, all_ids, stored = batch.column("key").to_numpy(), batch.column("id").to_numpy(), batch.column("places")
            for at, lists in _pieces(batch):
                sizes = np.array([len(x) for x in lists])
                first, n = np.cumsum(sizes) - sizes, int(sizes.sum())
                blocks = [np.frombuffer(stored[at + i].as_py(), "<u4") for i in range(len(lists))]
                of, block = np.repeat(np.arange(len(lists)), [len(b) for b in blocks]), np.concatenate(blocks).astype(np.int64)
                # windows that hold the block and end within the text
                low, high = np.maximum(block - (window - width), 0), np.minimum(block, sizes[of] - window)
                fits = low <= high
                base = first[of][fits]
                edges = np.bincount(base + low[fits], minlength=n + 1) - np.bincount(base + high[fits] + 1, minlength=n + 1)
                near = np.flatnonzero(np.cumsum(edges[:n]) > 0)
                if len(near):
                    doc = np.searchsorted(first + sizes, near, side="right")
                    place = near - first[doc]
                    hashes = rolling(WORD_HASHES.of(lists, n), window)[near]
                    checks = (rolling(CHECK_HASHES.of(lists, n), window, _BASE2)[near] >> np.uint64(48)).astype("<u2")
                    keys, ids = all_keys[at : at + len(lists)], all_ids[at : at + len(lists)]
                    sent, gone = settle_windows(ids[doc], hashes, checks, met)
                    asked = _deal(keys, ids, doc[sent], place[sent], hashes[sent], checks[sent], False, buckets)
                    yield _packed_rows(asked, (), _sent_places(keys, ids, doc[gone], place[gone], buckets))

    # doc_id comes along so that this join and the last one read the same shuffle; in one order, as a
    # task that is run again has to settle the same windows
    near = docs.join(found.select("key", "places"), "key").select("key", "id", "text", "places", "doc_id")
    return near.sortWithinPartitions("key").mapInArrow(run, PACKED)


def repeated(packed: DataFrame, buckets: int) -> DataFrame:
    """Places of windows that a document with a smaller id holds."""

    def judge(asked: pa.Table, _: pa.Table) -> pa.Table:
        keys, ids, docs, places, h, check = _opened(asked)
        order = np.lexsort((check, h))
        new = (np.diff(h[order]) != 0) | (np.diff(check[order]) != 0)
        starts = np.flatnonzero(np.r_[True, new])
        owner = ids[docs[order]]
        least = np.repeat(np.minimum.reduceat(owner, starts), np.diff(np.r_[starts, len(h)]))
        gone = np.zeros(len(h), bool)
        gone[order] = owner > least
        return _sent_places(keys, ids, docs[gone], places[gone], buckets)

    return _judged(packed, judge)


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed (word spans, ends exclusive) by row."""
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(partitions(spark), size // BUCKET_BYTES)
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("id"), "text", F.xxhash64(F.coalesce("doc_id", F.lit(LAST)), F.coalesce("text", F.lit(""))).alias("key"))
    dealt = rows.repartition(n, "key")  # one shuffle of the texts, used by both joins
    found = hits(probes(rows, window, n), n)
    gone = repeated(extensions(dealt, found, window, n), n).groupBy("key").agg(F.collect_list(F.struct("id", "places")).alias("places"))

    def run(batches):
        for batch in batches:
            stored, own, out = batch.column("places"), batch.column("id").to_pylist(), []
            for at, lists in _pieces(batch):
                for i, words in enumerate(lists):
                    places = [p["places"] for p in stored[at + i].as_py() or () if p["id"] == own[at + i]]
                    if not places:
                        out.append((len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), []))
                        continue
                    cover = _marked(len(words), places, 0, window - 1)
                    kept = [w for w, c in zip(words, cover.tolist()) if not c]
                    edges = np.flatnonzero(np.diff(np.r_[0, cover.astype(np.int8), 0])).reshape(-1, 2).tolist()
                    out.append((len(words), int(cover.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), edges))
            a, b, c, spans = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32())))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # by key alone, as the texts are dealt; rows whose keys collide differ in id
    joined = dealt.join(gone, "key", "left").select("doc_id", "id", "text", "places")
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, removed array<array<int>>")
