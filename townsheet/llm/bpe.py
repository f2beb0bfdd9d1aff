"""BPE encoding with a priority queue of merges over a doubly linked symbol list, and decoding.

``encode(docs, tokenizer)`` reads a public tokenizer file (NFC, white space, lower case; pieces by
pattern; byte symbols; merges with a word end) and returns one row per input row:

``n_tokens``, ``ids`` and ``tokens`` (ids in decimal and vocabulary strings, joined by one space).

A null or empty text gives no tokens and two empty strings. Repeated rows give repeated results.
Extra columns pass through, but for ones named like the results. Texts of any length are taken whole. Nothing is shuffled: each task
encodes its own rows, and memory is the batch plus two bounded caches.

Merging never crosses white space, so a worker encodes each distinct chunk once and looks the rest
up. A full cache keeps its oldest entries, which are the commonest chunks.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from heapq import heapify, heappop, heappush
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from townsheet.llm.common import small_batches

#: White space as the tokenizer's pattern language has it (a fixed value).
WHITE = "\t-\r \x85\xa0" + chr(0x1680) + chr(0x2000) + "-" + chr(0x200A) + "".join(map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Characters that str.split() also takes as white space, but the pattern does not.
NOT_WHITE = ("\x1c", "\x1d", "\x1e", "\x1f")

CHUNKS, PIECES, KEEP = 300_000, 150_000, 60_000


def byte_symbols() -> dict[int, str]:
    """The printable stand-in for each byte: itself if visible in Latin-1, else 256 and up."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Missing(dict):
    """A dict that fills itself; shrink() bounds it."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def shrink(self, most: int) -> None:
        if len(self) > most:
            kept = list(islice(self.items(), KEEP))
            self.clear()
            self.update(kept)


class Codec:
    """A tokenizer file's vocabulary and merges, with an encoder for texts and a decoder for ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.end = model["end_of_word_suffix"] or ""
        #: Vocabulary strings by decimal id.
        self.strings = {str(i): s for s, i in (self.vocab | self.special).items()}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        symbols = byte_symbols()
        self.inner = [self.vocab[symbols[b]] for b in range(256)]
        self.last = [self.vocab[symbols[b] + self.end] for b in range(256)]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces_of = regex.compile(pattern.replace("\\s", WHITE)).findall
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.white = regex.compile(f"[{WHITE}]+")
        self.pieces = _Missing(self.merge)
        self.chunks = _Missing(self.chunk)

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece: the lowest-ranked merge first, ties from the left."""
        data = piece.encode()
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        n, merges = len(ids), self.merges
        if n == 1:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(*found, i) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heapify(queue)
        while queue:
            rank, made, i = heappop(queue)
            j = after[i]
            if j < 0 or ids[i] < 0 or merges.get((ids[i], ids[j])) != (rank, made):
                continue  # stale: one of the two symbols has gone
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((made, ids[k])):
                    heappush(queue, (*found, i))
            h = before[i]
            if h >= 0 and (found := merges.get((ids[h], made))):
                heappush(queue, (*found, h))
        return [x for x in ids if x >= 0]

    def chunk(self, chunk: str) -> str:
        return " ".join(str(x) for p in self.pieces_of(chunk) for x in self.pieces[p])

    def encode(self, text: str | None) -> str:
        """The ids of a whole text in decimal, joined by one space."""
        if not text:
            return ""
        self.chunks.shrink(CHUNKS)
        self.pieces.shrink(PIECES)
        found: list[str] = []
        for part in self.special_at.split(text) if "<|" in text else (text,):
            if part in self.special:
                found.append(str(self.special[part]))
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            chunks = filter(None, self.white.split(part)) if any(c in part for c in NOT_WHITE) else part.split()
            found.extend(map(self.chunks.__getitem__, chunks))
        return " ".join(filter(None, found))

    def decode(self, ids: str) -> str:
        """The vocabulary strings of decimal ids; without a decoder in the file they stay spaced."""
        return " ".join(map(self.strings.__getitem__, ids.split()))


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def _rows(df: DataFrame, tokenizer: str, names: list[str], make) -> DataFrame:
    small_batches(df.sparkSession)
    rest = [c for c in df.columns if c != "text" and c not in names]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), *names_types(names)])

    def run(batches):
        found = codec(tokenizer)
        for batch in batches:
            results = [make(found, x) for x in batch.column("text").to_pylist()]
            columns = [batch.column(c) for c in rest] + [pa.array([r[i] for r in results], kind(n)) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, *names])

    return df.select(*[f"`{c}`" for c in rest], "text").mapInArrow(run, schema)


def kind(name: str) -> pa.DataType:
    return pa.int64() if name == "n_tokens" else pa.string()


def names_types(names: list[str]) -> list[str]:
    return [f"{n} {'long' if n == 'n_tokens' else 'string'}" for n in names]


def encode(df: DataFrame, tokenizer: str, tokens: str = "tokens") -> DataFrame:
    """Rows of df without text, with n_tokens, ids and tokens (see the module; under another name if given) in place of columns so named."""

    def make(found: Codec, text):
        ids = found.encode(text)
        return (ids.count(" ") + 1 if ids else 0), ids, found.decode(ids)

    return _rows(df, tokenizer, ["n_tokens", "ids", tokens], make)


def digests(df: DataFrame, tokenizer: str) -> DataFrame:
    """Encodes, decodes the ids again, and keeps SHA-256 of ids and of decoded text in place of both."""

    return _rows(df, tokenizer, ["n_tokens", "ids_sha256", "decoded_sha256"], digest)


def digest(found: Codec, text: str | None) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids and of what they decode to."""
    ids = found.encode(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (ids.count(" ") + 1 if ids else 0), sha(ids), sha(found.decode(ids))
