"""Token-id files compressed by Re-Pair grammars, one grammar a block.

``write(docs, path, tokenizer)`` sorts documents by id over range partitions, encodes every whole
text with the tokenizers library, appends an end id and writes blocks of whole documents as rows
(shard, block, n_docs, n_tokens, payload) of a Parquet table; a partition is a shard. ``read``
returns one row per document with its place in the stream of all ids.

Payload (little-endian): ``RPG2``; counts of documents, alphabet, rules and symbols, widths of a
symbol and of a length as uint32; ids of documents (int64) and which are null (uint8); ids in each
document (uint64); place of its first symbol (uint64); the alphabet (the block's distinct ids,
uint32); left and right symbol of each rule; its expansion length; the symbols. Symbols under the
alphabet's size are its entries, the others rules, which rest on earlier symbols. No rule crosses
documents, so any document, or any stretch of one (``decode_range``), is expanded by itself.

A round counts all adjacent pairs and replaces non-overlapping occurrences of those that occur
``LEAST`` times or more, commoner pairs first where they overlap. Rounds go on until no pair occurs so
often: there is no cap on rounds, on rules or on what a rule expands to. A rule stores two symbols
and a length, so one met fewer than four times costs as much as it saves; with ``least`` 2 rounds go
on until no pair occurs twice.

Defined results: null texts count as empty (only the end id); null ids come first; repeated rows and
ties of an id are ordered by their text's hash; an empty table has no blocks. Extra columns are
ignored. Memory is a block and the encoder's bounded cache; a document is never split.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from townsheet.llm.common import PIECE_BYTES, partitions, pieces, small_batches

BLOCK, END, LEAST = 300_000, 1, 4
#: Distinct chunks that an encoder remembers, how many of the oldest it keeps when full, chunks in a call.
CACHE, KEEP, JOINED = 1_200_000, 600_000, 2_000


class Encoder:
    """The tokenizers library over whole texts.

    It never merges across white space, so texts are cut there and the library encodes each distinct
    chunk once a worker (as pre-tokenized input, which tells the chunk of every id); the rest is
    lookup. Letters A-Z are lowered before, unless a text may hold a special token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.rows: dict[str, int] = {}
        self.ids, self.used = np.empty(1 << 16, "<u4"), 0
        self.starts, self.sizes = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def learn(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), JOINED):
            some = chunks[at : at + JOINED]
            found = self.library.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids, sizes = np.array(found.ids, "<u4"), np.bincount(np.array(found.word_ids, np.int64), minlength=len(some))
            self.ids = _room(self.ids, self.used + len(ids))
            self.ids[self.used : self.used + len(ids)] = ids
            first = len(self.rows)
            self.starts, self.sizes = _room(self.starts, first + len(some)), _room(self.sizes, first + len(some))
            self.starts[first : first + len(some)] = self.used + np.cumsum(sizes) - sizes
            self.sizes[first : first + len(some)] = sizes
            self.used += len(ids)
            self.rows.update(zip(some, range(first, first + len(some))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        if len(self.rows) > CACHE:
            self.rows = dict(islice(self.rows.items(), KEEP))
            self.used = int(self.starts[KEEP - 1] + self.sizes[KEEP - 1])
        texts = pc.fill_null(texts, "")
        cut = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        coded = cut.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        found = list(map(self.rows.get, chunks))
        new = [c for c, f in zip(chunks, found) if f is None]
        first = len(self.rows)
        self.learn(new)
        rows = np.array([-1 if f is None else f for f in found], np.int64)
        rows[rows < 0] = np.arange(first, first + len(new))
        rows = rows[coded.indices.to_numpy(zero_copy_only=False)]
        n = self.sizes[rows]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.starts[rows] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.r_[0, ends][cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return ids, np.diff(edges)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.r_[a, np.empty(max(n, 2 * len(a)) - len(a), a.dtype)]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def compress(ids: np.ndarray, last: np.ndarray, first: int, least: int = LEAST):
    """Symbols, their document ends, and rules: left, right and expansion length, from symbol ``first`` on.

    ids are under ``first``. On return no pair within a document occurs ``least`` times.
    """
    s, last = ids.astype(np.uint32), last.copy()
    left, right = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)]
    lengths = np.ones(first, np.int64)
    while len(s) > 1:
        narrow = len(lengths) <= 1 << 16  # two symbols in 32 bits, else in 64
        kind, half, bits = (np.uint32, np.uint32(16), 32) if narrow else (np.uint64, np.uint64(32), 64)
        s = s.astype(kind, copy=False)
        key = s[:-1] << half | s[1:]
        k = np.sort(key[~last[:-1]])
        starts = np.flatnonzero(np.r_[len(k) > 0, k[1:] != k[:-1]])
        counts = np.diff(starts, append=len(k))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        chosen = k[starts[often[np.argsort(-counts[often], kind="stable")]]]
        # a table of 2^20 slots ranks the pairs; the commoner keeps a shared slot, the other waits a round
        mixer, down = kind(2654435761 if narrow else 0x9E3779B97F4A7C15), kind(bits - 20)
        table = np.full(1 << 20, -1, np.int32)
        table[(chosen * mixer >> down)[::-1]] = np.arange(len(chosen), dtype=np.int32)[::-1]
        rank = table[key * mixer >> down]
        at = np.flatnonzero(rank >= 0)
        rank = rank[at]
        same = (chosen[rank] == key[at]) & ~last[at]
        at, rank = at[same], rank[same]
        turn = np.full(len(s) + 1, np.iinfo(np.int32).max, np.int32)
        turn[at + 1] = rank * 2 + (at & 1)  # in a run of one symbol, every other pair
        mine = turn[at + 1]
        won = (mine < turn[at]) & (mine < turn[at + 2])
        at, rank = at[won], rank[won]
        uses = np.bincount(rank, minlength=len(chosen))
        good = uses >= 2 if (uses >= 2).any() else uses >= 1
        keep = good[rank]
        at, rank = at[keep], rank[keep]
        number = len(lengths) - 1 + np.cumsum(good)
        s = s.astype(np.uint64) if number[-1] >= 1 << 16 and narrow else s
        s[at] = number[rank]
        last[at] = last[at + 1]
        stay = np.ones(len(s), bool)
        stay[at + 1] = False
        s, last = s[stay], last[stay]
        a, b = (chosen[good] >> half).astype(np.uint32), (chosen[good] & ((kind(1) << half) - kind(1))).astype(np.uint32)
        left.append(a)
        right.append(b)
        lengths = np.r_[lengths, lengths[a] + lengths[b]]
    return s, last, np.concatenate(left), np.concatenate(right), lengths[first:]


def pack(doc_ids: list[int | None], parts: list[np.ndarray], least: int = LEAST) -> bytes:
    """A block's payload; parts: each document's ids, its end id included."""
    ids = np.concatenate(parts)
    sizes = np.array([len(p) for p in parts], np.uint64)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(sizes).astype(np.int64) - 1] = True
    alphabet, dense = _alphabet(ids)
    s, ends, left, right, lengths = compress(dense, last, len(alphabet), least)
    width = "<u2" if len(alphabet) + len(left) <= 1 << 16 else "<u4"
    span = "<u2" if not len(lengths) or lengths.max() < 1 << 16 else "<u4"
    places = np.r_[0, np.flatnonzero(ends) + 1][:-1]
    head = struct.pack("<4s6I", b"RPG2", len(parts), len(alphabet), len(left), len(s), int(width[2]), int(span[2]))
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    known = np.array([d or 0 for d in doc_ids], "<i8")
    arrays = [known, nulls, sizes.astype("<u8"), places.astype("<u8"), alphabet.astype("<u4"), left.astype(width), right.astype(width), lengths.astype(span), s.astype(width)]
    return head + b"".join(a.tobytes() for a in arrays)


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and each id's place among them."""
    used = np.zeros(int(ids.max()) + 1, bool)
    used[ids] = True
    return np.flatnonzero(used), (np.cumsum(used) - 1)[ids]


class Block:
    """A payload, opened: rules expand to ids by lookup."""

    def __init__(self, payload: bytes):
        tag, docs, self.first, rules, symbols, size, span = struct.unpack_from("<4s6I", payload)
        if tag != b"RPG2":
            raise ValueError("not a grammar block")
        at, width = 28, f"<u{size}"

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        known, nulls = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if n else int(d) for d, n in zip(known, nulls)]
        self.sizes, self.places = take("<u8", docs).astype(np.int64), take("<u8", docs).astype(np.int64)
        alphabet = take("<u4", self.first).astype(np.int64)
        self.left, self.right = take(width, rules).astype(np.int64), take(width, rules).astype(np.int64)
        self.lengths, self.symbols = take(f"<u{span}", rules).astype(np.int64), take(width, symbols).astype(np.int64)
        # expansions of all ids and rules, one after the other, built rule level by rule level
        self.size = np.r_[np.ones(self.first, np.int64), self.lengths]
        self.start = np.r_[np.arange(self.first), self.first + np.r_[0, np.cumsum(self.lengths)[:-1]]] if rules else np.arange(self.first)
        self.flat = np.r_[alphabet, np.zeros(int(self.lengths.sum()), np.int64)]
        done = 0
        while done < rules:  # as many rules as rest on finished ones
            ready = (self.left[done:] < self.first + done) & (self.right[done:] < self.first + done)
            n = len(ready) if ready.all() else int(np.argmin(ready))
            pairs = np.stack([self.left[done : done + n], self.right[done : done + n]], 1).ravel()
            self.flat[self.start[self.first + done] :][: int(self.size[pairs].sum())] = self.expand(pairs)
            done += n

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.size[symbols]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[symbols] - (ends - n), n) + np.arange(total)]

    def all_ids(self) -> list[np.ndarray]:
        return np.split(self.expand(self.symbols).astype("<u4"), np.cumsum(self.sizes)[:-1])

    def decode_range(self, doc: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of a document, expanding only the symbols that hold them."""
        upto = self.places[doc + 1] if doc + 1 < len(self.places) else len(self.symbols)
        symbols = self.symbols[self.places[doc] : upto]
        ends = np.cumsum(self.size[symbols])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - before : stop - before].astype("<u4")


BLOCKS = "shard int, block int, n_docs long, n_tokens long, payload binary"


def blocks(docs: DataFrame, tokenizer: str, block: int = BLOCK, end: int = END, *, least: int = LEAST) -> DataFrame:
    """The blocks of all documents, in ascending doc_id order by (shard, block); no pair is left ``least`` times in one."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]):
        found = encoder(tokenizer)
        shard, number = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def row():
            nonlocal number, ids, parts, held
            out = {"shard": pa.array([shard], pa.int32()), "block": pa.array([number], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64())}
            out |= {"n_tokens": pa.array([held], pa.int64()), "payload": pa.array([pack(ids, parts, least)], pa.binary())}
            number, ids, parts, held = number + 1, [], [], 0
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, texts in pieces(batch.column(1), 2 * PIECE_BYTES):
                flat, sizes = found.encode(texts)
                ended = np.insert(flat, np.cumsum(sizes), end).astype("<u4")
                for d, part in zip(doc_ids[at:], np.split(ended, np.cumsum(sizes + 1)[:-1])):
                    if ids and held + len(part) > block:
                        yield row()
                    ids.append(d)
                    parts.append(part)
                    held += len(part)
        if ids:
            yield row()

    rows = docs.select("doc_id", "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return rows.mapInArrow(run, BLOCKS)


def write(docs: DataFrame, path: str, tokenizer: str, block: int = BLOCK, *, least: int = LEAST) -> None:
    blocks(docs, tokenizer, block, least=least).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    table = spark.read.schema(BLOCKS).parquet(path)

    def run(batches):
        for batch in batches:
            for shard, number, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                opened = Block(payload.as_py())
                sums = [zlib.crc32(x.tobytes()) for x in opened.all_ids()]
                n = len(sums)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard] * n, pa.int32()), "block": pa.array([number] * n, pa.int32()), "doc_id": pa.array(opened.doc_ids, pa.int64()), "local": pa.array(np.cumsum(opened.sizes) - opened.sizes), "n_tokens": pa.array(opened.sizes), "ids_crc32": pa.array(sums, pa.int64())})

    decoded = table.select("shard", "block", "payload").mapInArrow(run, "shard int, block int, doc_id long, local long, n_tokens long, ids_crc32 long")
    # one row a block, then one row a shard: prefix sums in two levels
    sizes = table.select("shard", "block", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = sizes.withColumn("within", before(Window.partitionBy("shard").orderBy("block"))).drop("n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
    ahead = shards.withColumn("ahead", before(Window.orderBy("shard"))).drop("n_tokens")
    offsets = within.join(ahead, "shard")
    return decoded.join(offsets, ["shard", "block"]).select("doc_id", (F.col("ahead") + F.col("within") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
