"""Fill-in-the-middle transformation over a learned rank index of token boundaries.

Tokens are runs of A-Za-z or single other characters; n tokens have n + 1 boundaries, and the index
answers "at which character does boundary k lie".

``index(text)``: boundary offsets grow with their rank, so each segment is a line from its first
boundary that lies within ``ERROR`` characters of all boundaries up to the next segment (the cone of
slopes that still fit is narrowed until it is empty). Stored are the segments' first ranks, offsets and
slopes, and one signed byte a boundary: the residual of its prediction. ``Index.cut(k)`` finds the
segment by bisection, predicts, and adds the residual, which is exact. ``tables(docs)`` returns the
indexes, to be stored beside texts that are cut again and again.

``transform(docs)`` draws both cuts and the form from sha256 of ``1:`` and the decimal doc_id, looks the
cuts up in the index, and returns form, n, prefix_chars, middle_chars and output. ``rebuilt(form, output)``
gives the text back: it has none of the marks itself, else its form is plain.

Defined results: a null text is empty; empty texts are plain with n 0; a null doc_id is drawn like an
empty id; repeated rows repeat; an empty table gives an empty one; extra columns are ignored. Characters
are code points; a text's index is made in one piece, whatever its length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from townsheet.llm.common import pieces, small_batches

#: The marks of prefix, suffix and middle.
P, S, M = "<P>", "<S>", "<M>"
#: Most characters between a prediction and its boundary; residuals are signed bytes.
ERROR = 100
#: Boundaries that a segment is tried on at first.
STRIDE = 512


def boundaries(text: str) -> np.ndarray:
    """Character offsets of the n + 1 token boundaries."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return np.zeros(1, np.int64)
    letter = (codes | np.uint32(32)) - np.uint32(97) < 26
    return np.r_[0, np.flatnonzero(~(letter[1:] & letter[:-1])) + 1, len(codes)]


def segments(at: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray]:
    """First ranks and slopes of the lines: each is within ``error`` of its boundaries, rounding included."""
    starts, slopes, s, n = [], [], 0, len(at)
    while s < n:
        low, high, upto, stride, slope = -np.inf, np.inf, s + 1, STRIDE, 0.0
        while upto < n:
            k = np.arange(upto, min(n, upto + stride))
            rise, run = (at[k] - at[s]).astype(np.float64), (k - s).astype(np.float64)
            lows = np.maximum(low, np.maximum.accumulate((rise - error + 1) / run))
            highs = np.minimum(high, np.minimum.accumulate((rise + error - 1) / run))
            bad = np.flatnonzero(lows > highs)
            good = int(bad[0]) if len(bad) else len(k)
            if good:
                low, high = lows[good - 1], highs[good - 1]
                slope = (low + high) / 2
            upto += good
            if len(bad):
                break
            stride *= 2
        starts.append(s)
        slopes.append(slope)
        s = upto
    return np.array(starts, np.int64), np.array(slopes)


class Index:
    """Segments and residuals of one text's boundaries."""

    def __init__(self, first: np.ndarray, offset: np.ndarray, slope: np.ndarray, residual: np.ndarray):
        self.first, self.offset, self.slope, self.residual = first, offset, slope, residual

    @classmethod
    def of(cls, text: str, error: int = ERROR) -> Index:
        if not 0 < error < 127:
            raise ValueError("residuals are signed bytes")
        at = boundaries(text)
        first, slope = segments(at, error)
        made = cls(first, at[first], slope, np.zeros(len(at), np.int8))
        residual = at - made.predict(np.arange(len(at)))
        if np.abs(residual).max() > error:
            raise AssertionError("a line left its bound")
        made.residual = residual.astype(np.int8)
        return made

    def __len__(self) -> int:
        """Tokens."""
        return len(self.residual) - 1

    def predict(self, k: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.first, k, side="right") - 1
        return self.offset[s] + np.rint(self.slope[s] * (k - self.first[s])).astype(np.int64)

    def cut(self, k: int) -> int:
        """The offset of boundary k, exactly."""
        return int(self.predict(np.array([k]))[0]) + int(self.residual[k])


def draws(doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of a text."""
    index = Index.of(text)
    n = len(index)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or P in text or S in text or M in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((index.cut(h1 % (n + 1)), index.cut(h2 % (n + 1))))
    head, middle, tail = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"{S}{tail}{P}{head}{M}{middle}"
    return n, "psm", a, b - a, f"{P}{head}{S}{tail}{M}{middle}"


def rebuilt(form: str, output: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    first, second = (P, S) if form == "psm" else (S, P)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(M, 1)
    return one + middle + two if form == "psm" else two + middle + one


def _mapped(docs: DataFrame, row, fields: dict[str, pa.DataType], schema: str) -> DataFrame:
    """doc_id and what ``row`` makes of each id and text."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at, texts in pieces(batch.column("text")):
                ids = batch.column("doc_id").slice(at, len(texts))
                made = [row(i, t or "") for i, t in zip(ids.to_pylist(), texts.to_pylist())]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([m[j] for m in made], kind) for j, kind in enumerate(fields.values()))], names=["doc_id", *fields])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {schema}")


def transform(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row."""
    fields = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
    return _mapped(docs, transformed, fields, "n long, form string, prefix_chars long, middle_chars long, output string")


def tables(docs: DataFrame, error: int = ERROR) -> DataFrame:
    """The index of every row: first ranks, offsets and slopes of its segments, and residuals as bytes."""

    def row(_, text):
        x = Index.of(text, error)
        return x.first, x.offset, x.slope, x.residual.tobytes()

    fields = {"first": pa.list_(pa.int64()), "offset": pa.list_(pa.int64()), "slope": pa.list_(pa.float64()), "residual": pa.binary()}
    return _mapped(docs, row, fields, "first array<long>, offset array<long>, slope array<double>, residual binary")


def restore(made: DataFrame) -> DataFrame:
    """doc_id and text of transformed rows, from output and form alone."""
    small_batches(made.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [rebuilt(f, o) for f, o in zip(batch.column("form").to_pylist(), batch.column("output").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return made.select("doc_id", "form", "output").mapInArrow(run, f"doc_id {made.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame) -> DataFrame:
    """The transformation with checksums of output and rebuilt text in place of texts."""
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()

    def row(doc_id, text):
        n, form, head, middle, output = transformed(doc_id, text)
        return n, form, head, middle, sha(output), sha(rebuilt(form, output))

    fields = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output_sha256": pa.string(), "restored_sha256": pa.string()}
    return _mapped(docs, row, fields, "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
