import math
import random
import unicodedata
import zlib
from collections import Counter

import pytest

from helpers import ODD_ROWS, SCHEMA, write

from townsheet.llm import langid, queries

STEMS = {"en": ["the", "of", "and", "with", "thing", "other", "when"], "de": ["der", "und", "nicht", "über", "schön", "auch"], "fr": ["les", "être", "où", "ça", "pour", "eaux"]}


def corpus(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(sorted(STEMS))
        rows.append((i, " ".join(rnd.choice(STEMS[lang]) + rnd.choice(["", rnd.choice(STEMS[lang])]) for _ in range(rnd.randint(8, 60))), lang, "s", 0))
    return rows


def test_held_out_accuracy_and_odd_rows(spark, tmp_path):
    odd = [r for r in ODD_ROWS if r[2] is None or r[0] in (2, 3, 4)] + [(9000, "123 --- 45", "en", "s", 0)]
    rows = [(r[0] + 10, *r[1:]) for r in corpus(300, 1)] + odd
    got = queries.op3_language_id(spark, write(spark, rows, tmp_path, extra=True)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows if r[0] is not None and 10 <= r[0] < 310}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "fr", "und") for r in got)
    for r in got:
        if r.doc_id in (2, 3, 4, 9000):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert queries.op3_language_id(spark, write(spark, [], tmp_path)).count() == 0


def test_far_texts_are_rejected(spark):
    model = langid.fit(spark.createDataFrame(corpus(300, 2), SCHEMA))
    langs, scores, rejected = langid.predict_batch(model, ["zxqj kvwx jjqz xkcd qqzz wvxk", "the other thing and when with the"])
    assert rejected[0] and not rejected[1] and langs[1] == "en" and scores[0] < scores[1]


def test_pieces_count_like_the_whole(monkeypatch):
    text = "Some Ünïcode text, with more words " * 30
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "PIECE", 50)
    assert (langid.counts(text) == whole).all()


def fold(byte):
    return byte if byte > 127 or 97 <= byte <= 122 else byte + 32 if 65 <= byte <= 90 else 32


def brute_counts(text):
    """Buckets of 2- and 3-grams by loops over bytes."""
    data, out = [fold(b) for b in f" {text} ".encode()], Counter()
    for i in range(len(data) - 1):
        out[(data[i] << 8 | data[i + 1]) * 2654435761 % 2**32 >> 19] += 1
    for i in range(len(data) - 2):
        if data[i] != 32 or data[i + 1] != 32:
            out[(data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2246822519 % 2**32 >> 19] += 1
    return out


def test_query_like_brute_force(spark, tmp_path):
    odd = [(5000, "½ ² 10", "en", "s", 0), (5001, "4 中", "en", "s", 0), (5002, None, "en", "s", 0), (None, "les pour", None, "s", 0), (None, "le eaux", "fr", "s", 0), (None, "le eaux", "fr", "s", 0)]
    rows = corpus(120, 7) + odd
    got = queries.op3_language_id(spark, write(spark, rows, tmp_path)).collect()
    train = [r for r in rows if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 3 != 1 and r[1] is not None and r[2] is not None]
    model = langid.fit(spark.createDataFrame(train, SCHEMA))
    df = Counter(k for r in train for k in brute_counts(r[1]))
    idf = [math.log((1 + len(train)) / (1 + df[k])) + 0.1 for k in range(langid.WIDTH)]
    assert model.idf == pytest.approx(idf, rel=1e-5)
    by_row = Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 4)) for r in got)
    want = Counter()
    for d, text, *_ in rows:
        held = zlib.crc32(b"" if d is None else str(d).encode()) % 3 == 1
        if not any(unicodedata.category(c).startswith("L") for c in text or ""):
            want[d, held, "und", 0.0] += 1
            continue
        v = {k: (1 + math.log(n)) * idf[k] for k, n in brute_counts(text).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(c[k]) for k, x in v.items()) / size for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        want[d, held, model.langs[model.owner[best]], round(cosines[best], 4)] += 1
    close = lambda x: sorted((str(d), h, p, round(s, 3)) for (d, h, p, s), n in x.items() for _ in range(n))
    assert sum(a != b for a, b in zip(close(by_row), close(want), strict=True)) <= 2  # a rounding edge


def test_many_copies_are_one_row_of_the_sample(spark):
    rows = corpus(60, 8) + [(None, "the other thing", "en", "s", 0)] * 200
    model = langid.fit(spark.createDataFrame(rows, SCHEMA), sample=50)
    assert sorted(model.langs) == ["de", "en", "fr"]
