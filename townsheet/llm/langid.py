"""Language identification by nearest centroid over normalised TF-IDF n-gram vectors.

``fit(docs)`` learns from rows with a text and a lang: document frequencies of hashed byte 1- to
3-grams over all of them, and ``centroids`` spherical k-means centroids per language from a bounded
sample of ``sample`` rows a language (those whose hashes are smallest). ``predict`` gives the
language of the centroid nearest by cosine, the score (that cosine, 0 to 1), and ``rejected``: the
text is farther from its centroid than all but a small share of the sample was.

Defined results: a text that is null or holds no letter is ``und`` with score 0; ties go to the
language first in order; repeated rows repeat; with nothing learned every text is ``und``. Extra
columns pass through. Vectors have a fixed width, so memory does not grow with texts; the model's
size is languages x centroids x width, checked against ``MOST_LANGUAGES`` before it is sent out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townsheet.llm.common import saved, sized, small_batches

#: Buckets for 1-grams and 2-grams (exact pairs folded) and for 3-grams.
WIDTH = 8192
SAMPLE, CENTROIDS, ROUNDS, MOST_LANGUAGES = 1500, 4, 8, 500
#: Letters in lower case, other ASCII as space, bytes over 127 as they are.
FOLD = np.array([c if 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], np.uint32)
#: Bytes of text that are hashed at a time.
PIECE = 1 << 18


def counts(text: str) -> np.ndarray:
    """Hashed 1- to 3-gram counts of a whole text."""
    data = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)
    out = np.zeros(WIDTH, np.int64)
    for at in range(0, max(1, len(data) - 2), PIECE):
        a = FOLD[data[at : at + PIECE + 2]]
        two = a[:-1] << 8 | a[1:]
        three = a[:-2] << 16 | a[1:-1] << 8 | a[2:]
        three = three[(a[:-2] != 32) | (a[1:-1] != 32)]
        last = len(two) if at + PIECE + 2 >= len(data) else PIECE
        hashed = np.concatenate([(two[:last] * np.uint32(2654435761)) >> 19, (three * np.uint32(2246822519)) >> 19])
        out += np.bincount(hashed, minlength=WIDTH)
    return out


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: (1 + log count) x idf."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for i, t in enumerate(texts):
        c = counts(t)
        k = np.flatnonzero(c)
        out[i, k] = (1 + np.log(c[k])) * idf[k]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means with farthest-first starts; fewer centroids for few rows."""
    picked = [0]
    near = x @ x[0]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picked[-1]])
    c = x[picked]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray
    least: np.ndarray  # cosine under which a centroid rejects


def _has_letter(text: str | None) -> bool:
    """Whether some character is a letter (Unicode category L)."""
    return any(map(str.isalpha, text or ""))


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model | None:
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")

    def frequencies(batches):
        df, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for t in batch.column("text").to_pylist():
                df += counts(t) > 0
                n += 1
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(WIDTH + 1), pa.int32()), "n": pa.array([*df.tolist(), n], pa.int64())})

    found = docs.select("text").mapInArrow(frequencies, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(WIDTH + 1)
    for r in found:
        df[r.k] = r.n
    if not df[-1]:
        return None
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1).astype(np.float32)

    # the sample: smallest hashes of each language, kept by a top-k a task before they meet
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text_hash")
    keyed = docs.select("lang", "doc_id", F.xxhash64("text").alias("text_hash")).withColumn("h", F.xxhash64("doc_id", "text_hash"))
    # a common language is thinned by hash to about four times the sample before its rows meet
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n"))
    part = F.shiftrightunsigned("h", 12) / float(1 << 52)
    keyed = keyed.join(sized(saved(sizes, "languages")), "lang").where(part * F.col("n") <= 4 * sample).drop("n").distinct()
    chosen = keyed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("doc_id", "lang", "text_hash").distinct()
    langs = sorted(r.lang for r in chosen.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; clean lang before fitting")
    # rows without an id are chosen by their text alone
    mark = lambda df: df.withColumn("id_hash", F.xxhash64("doc_id"))
    chosen = sized(saved(mark(chosen).drop("doc_id").distinct(), "sample"))
    texts = mark(docs).withColumn("text_hash", F.xxhash64("text")).join(chosen, ["id_hash", "lang", "text_hash"], "left_semi").dropDuplicates(["id_hash", "lang", "text_hash"])

    def clusters(key, pdf):
        pdf = pdf.drop_duplicates(["doc_id", "text"]).sort_values(["doc_id", "text"]).head(sample)
        x = vectors([t for t in pdf.text if _has_letter(t)], idf)
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "least": []})
        c = cluster(x, centroids)
        sims = x @ c.T
        own = sims.argmax(1)
        least = [float(np.quantile(sims[own == j, j], 0.005)) if (own == j).any() else 0.0 for j in range(len(c))]
        return pd.DataFrame({"lang": key[0], "centroid": [row.tobytes() for row in c], "least": least})

    rows = texts.groupBy("lang").applyInPandas(clusters, "lang string, centroid binary, least double").collect()
    rows.sort(key=lambda r: (r.lang, r.centroid))
    if not rows:
        return None
    langs = sorted({r.lang for r in rows})
    return Model(idf, langs, np.array([langs.index(r.lang) for r in rows]), np.stack([np.frombuffer(r.centroid, np.float32) for r in rows]), np.array([r.least for r in rows]))


def predict_batch(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    n = len(texts)
    langs, scores, rejected = ["und"] * n, np.zeros(n), np.ones(n, bool)
    real = [i for i, t in enumerate(texts) if _has_letter(t)] if model else []
    for at in range(0, len(real), 256):
        some = real[at : at + 256]
        sims = vectors([texts[i] for i in some], model.idf) @ model.centroids.T
        best = sims.argmax(1)
        for i, j, s in zip(some, best, sims[np.arange(len(some)), best]):
            langs[i], scores[i], rejected[i] = model.langs[model.owner[j]], min(max(float(s), 0.0), 1.0), s < model.least[j]
    return langs, scores, rejected


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of docs but for text, with lang_pred, score and rejected."""
    small_batches(docs.sparkSession)
    made = ("lang_pred", "score", "rejected")
    rest = [c for c in docs.columns if c not in ("text", *made)]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            langs, scores, rejected = predict_batch(held.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(langs), pa.array(scores), pa.array(rejected)], names=[*rest, *made])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), "lang_pred string, score double, rejected boolean"])
    return docs.select(*[f"`{c}`" for c in rest], "text").mapInArrow(run, schema)
