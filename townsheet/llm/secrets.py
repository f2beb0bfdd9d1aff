"""Secret scans by a trigram inverted index.

Each rule is a regular expression. A Boolean query over lower-case byte trigrams that every match must
satisfy is derived by walking the parsed expression (``trigram_query``). For each batch of
documents the operator builds postings (trigram to documents) for the trigrams that any query names,
evaluates the queries by intersecting and uniting postings, and runs a rule's expression only over
its candidates. Rules without a mandatory trigram scan every document.
The index lives as long as its batch, so it is built in one pass and nothing is shuffled or stored.

``scan(docs)`` returns the input's columns with ``spans``, an array of (kind, start, end) in code
points with an exclusive end, by start and then in the rules' order. ``redact(docs)`` replaces them.

A null or empty text has no spans. Ties (two rules at one place) keep both. Repeated rows repeat.
Nothing is shuffled or collected; postings live as long as their batch, and texts are read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from townsheet.llm.common import small_batches

#: A trigram, or ("and", query...) or ("or", query...); ALL holds for every document.
Query = str | tuple
ALL: Query = ("and",)
#: Strings in a set of alternatives, beyond which a part of an expression counts as unknown.
MOST = 24


def _all_of(*parts: Query) -> Query:
    flat = dict.fromkeys(q for p in parts for q in (p[1:] if isinstance(p, tuple) and p[0] == "and" else (p,)))
    return next(iter(flat)) if len(flat) == 1 else ("and", *flat)


def _any_of(parts: list[Query]) -> Query:
    flat = dict.fromkeys(parts)
    return ALL if ALL in flat else next(iter(flat)) if len(flat) == 1 else ("or", *flat)


def _grams(strings: frozenset[bytes]) -> Query:
    """What a text holds that contains one of the strings."""
    return _any_of([_all_of(*(s[i : i + 3].decode("latin-1") for i in range(len(s) - 2))) for s in sorted(strings)])


@dataclass(frozen=True)
class Part:
    """What is known of the text that a part of an expression matches, in lower case.

    exact: all strings it can be, or None; else how it begins and ends (two bytes at most, empty
    where unknown) and what it needs to hold.
    """

    exact: frozenset[bytes] | None = None
    begins: frozenset[bytes] = frozenset([b""])
    ends: frozenset[bytes] = frozenset([b""])
    needs: Query = ALL

    def open(self) -> Part:
        """The same without the list of all strings."""
        if self.exact is None:
            return self
        return Part(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), _grams(self.exact))

    def then(self, other: Part) -> Part:
        if self.exact is not None and other.exact is not None and len(self.exact) * len(other.exact) <= MOST:
            return Part(frozenset(a + b for a, b in product(self.exact, other.exact)))
        a, b = self.open(), other.open()
        seam = _grams(frozenset(x + y for x, y in product(a.ends, b.begins))) if len(a.ends) * len(b.begins) <= MOST else ALL
        # a short known side lets the other side's edge show through
        begins = frozenset((x + y)[:2] for x, y in product(self.exact, b.begins)) if self.exact is not None else a.begins
        ends = frozenset((x + y)[-2:] for x, y in product(a.ends, other.exact)) if other.exact is not None else b.ends
        return Part(None, _few(begins), _few(ends), _all_of(a.needs, b.needs, seam))


NOTHING, ANYTHING = Part(frozenset([b""])), Part()


def _few(strings: frozenset[bytes]) -> frozenset[bytes]:
    return strings if len(strings) <= MOST else frozenset([b""])


def _either(parts: list[Part]) -> Part:
    if all(p.exact is not None for p in parts) and len(both := frozenset().union(*(p.exact for p in parts))) <= MOST:
        return Part(both)
    open_ = [p.open() for p in parts]
    return Part(None, _few(frozenset().union(*(p.begins for p in open_))), _few(frozenset().union(*(p.ends for p in open_))), _any_of([p.needs for p in open_]))


def _char(code: int, flags: int) -> Part:
    """One literal; where case is ignored beyond ASCII, letters with other folds are unknown."""
    c = chr(code)
    wide = flags & re.IGNORECASE and not flags & re.ASCII
    if 0xD800 <= code < 0xE000 or (wide and (not c.isascii() or c in "iIkKsS")):
        return ANYTHING
    return Part(frozenset([c.encode().lower()]))


def _part(nodes, flags: int) -> Part:
    out = NOTHING
    for op, value in nodes:
        out = out.then(_node(op, value, flags))
    return out


def _node(op, value, flags: int) -> Part:
    if op is C.LITERAL:
        return _char(value, flags)
    if op is C.IN:
        if any(kind not in (C.LITERAL, C.RANGE) or kind is C.RANGE and x[1] - x[0] >= MOST for kind, x in value):
            return ANYTHING
        codes = [c for kind, x in value for c in ([x] if kind is C.LITERAL else range(x[0], x[1] + 1))]
        return _either([_char(c, flags) for c in codes])
    if op is C.SUBPATTERN:
        _, add, drop, inner = value
        return _part(inner, (flags | add) & ~drop)
    if op is C.ATOMIC_GROUP:
        return _part(value, flags)
    if op is C.BRANCH:
        return _either([_part(x, flags) for x in value[1]])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, inner = value
        one = _part(inner, flags)
        if (least, most) == (0, 1):
            return _either([NOTHING, one])
        out = NOTHING
        for _ in range(min(least, 3)):
            out = out.then(one)
        return out if least == most <= 3 else out.then(ANYTHING)
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return NOTHING  # no width: what they ask is left to verification
    return ANYTHING


def trigram_query(pattern: str) -> Query:
    """What every match of the expression makes a document hold."""
    parsed = _parser.parse(pattern)
    return _part(parsed, parsed.state.flags).open().needs


def trigrams_in(query: Query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(trigrams_in, query[1:]))


@dataclass(frozen=True)
class Rule:
    """A match counts if its group has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    def query(self) -> Query:
        return trigram_query(self.pattern)


#: The first three are the base rules, the rest are what the method adds. Fixed values, in listed order.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)


def compiled(rules) -> list:
    """A run of one character class that must be long is searched for at that length."""
    out = []
    for r in rules:
        simple = re.fullmatch(r"\[[^\]]+\]\+", r.pattern)
        out.append((re.compile(f"{r.pattern[:-1]}{{{r.least},}}") if simple and r.least else re.compile(r.pattern), bool(simple)))
    return out


def matches(rule: Rule, expression: re.Pattern, simple: bool, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches that are long enough."""
    return [m.span() for m in expression.finditer(text) if simple or m.end(rule.group) - m.start(rule.group) >= rule.least]


class Postings:
    """Documents of a batch by trigram, for the trigrams that some query names."""

    def __init__(self, queries: list[Query]):
        grams = sorted(set().union(*map(trigrams_in, queries)))
        self.codes = {g: int.from_bytes(g.encode("latin-1"), "big") for g in grams}
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[list(self.codes.values())] = True
        self.lower = np.arange(256, dtype=np.uint32)
        self.lower[65:91] += 32
        self.upper_end = 1 << 20

    def index(self, data: list[bytes]) -> dict[int, np.ndarray]:
        """Posting lists (sorted document ordinals) by trigram code."""
        lists: dict[int, list[np.ndarray]] = {}
        at, end = 0, len(data)
        while at < end:  # some MB of text at a time
            upto, size = at, 0
            while upto < end and (upto == at or size < self.upper_end):
                size += len(data[upto]) + 2
                upto += 1
            joined = np.frombuffer(b"\0\0".join(data[at:upto]) + b"\0\0", np.uint8)
            low = self.lower[joined]
            codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
            where = np.flatnonzero(self.wanted[codes])
            ends = np.cumsum([len(d) + 2 for d in data[at:upto]])
            pairs = np.unique(codes[where].astype(np.int64) << 32 | (np.searchsorted(ends, where, "right") + at))
            code, doc = pairs >> 32, pairs & 0xFFFFFFFF
            for c, some in zip(*_split(code, doc)):
                lists.setdefault(int(c), []).append(some)
            at = upto
        return {c: np.concatenate(x) for c, x in lists.items()}

    def candidates(self, query: Query, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
        """The documents that satisfy a query: postings, united and intersected."""
        if isinstance(query, str):
            return postings.get(self.codes[query], np.empty(0, np.int64))
        if query == ALL:
            return np.arange(n)
        lists = sorted((self.candidates(q, postings, n) for q in query[1:]), key=len)
        out = lists[0]
        for other in lists[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
        return out


def _split(keys: np.ndarray, values: np.ndarray):
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return keys[np.r_[0, cuts]] if len(keys) else keys, np.split(values, cuts) if len(keys) else []


def scan_batch(texts: list[str | None], rules=RULES, index: Postings | None = None, patterns=None) -> list[list[tuple[str, int, int]]]:
    """Spans of each text, by start and then in the rules' order."""
    queries = [r.query() for r in rules]
    index = index or Postings(queries)
    texts = [t or "" for t in texts]
    postings = index.index([t.encode("utf-8", "surrogatepass") for t in texts])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query, (expression, simple)) in enumerate(zip(rules, queries, patterns or compiled(rules))):
        for d in index.candidates(query, postings, len(texts)).tolist():
            found[d] += [(s, k, e) for s, e in matches(rule, expression, simple, texts[d])]
    return [[(rules[k].kind, s, e) for s, k, e in sorted(f)] for f in found]


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(df: DataFrame, rules=RULES) -> DataFrame:
    """The columns of df but for text, and spans. A column named spans is replaced."""
    small_batches(df.sparkSession)
    rest = [c for c in df.columns if c not in ("text", "spans")]

    def run(batches):
        index, patterns = Postings([r.query() for r in rules]), compiled(rules)
        for batch in batches:
            spans = scan_batch(batch.column("text").to_pylist(), rules, index, patterns)
            made = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], _SPANS)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), made], names=[*rest, "spans"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), f"spans {SPANS}"])
    return df.select(*[f"`{c}`" for c in rest], "text").mapInArrow(run, schema)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Overlapping spans merge; each merged stretch becomes the first one's kind in brackets."""
    out, at, until = [], 0, 0
    for kind, start, end in spans:
        if start >= until:
            out += [text[at:start] if start > at else "", f"[{kind.upper()}]"]
        until = max(until, end)
        at = until
    return "".join(out) + text[at:]


def redact(df: DataFrame, rules=RULES) -> DataFrame:
    """df with every span in text replaced by its kind; other columns unchanged, null texts stay null."""
    small_batches(df.sparkSession)
    names = df.columns

    def run(batches):
        index, patterns = Postings([r.query() for r in rules]), compiled(rules)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = scan_batch(texts, rules, index, patterns)
            made = pa.array([redacted(t, s) if s else t for t, s in zip(texts, spans)], pa.string())
            yield pa.RecordBatch.from_arrays([made if c == "text" else batch.column(c) for c in names], names=names)

    return df.mapInArrow(run, df.schema)
