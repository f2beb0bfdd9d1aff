import random
from collections import Counter

import numpy as np
from helpers import ODD_ROWS, SCHEMA, WORD, write

from townsheet.llm import quality, queries


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    at = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if at[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
TEXTS = ["a b c d e f a b c d e", "x " * 23, "one\ntwo\n one\none\n\n\n \n \n", "#$ %&| <>*é\xa0 中 ", "a b c d e f g h i j k l m n o p q r s t u v w x y z", "p q r s t 1 p q r s t 2 p q r s t", "q w e r t y u i o p " * 9]


def test_counts_like_brute_force(spark, tmp_path):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)] + ODD_ROWS
    got = queries.op6_quality_rules(spark, write(spark, rows, tmp_path, extra=True)).collect()
    want = Counter((r[0], *brute(r[1])) for r in rows)
    assert Counter((r.doc_id, *(r[c] for c in NAMES)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert queries.op6_quality_rules(spark, write(spark, [], tmp_path)).count() == 0


def test_random_counts(spark):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice(["a ", "b ", "c ", "\n", "a b\n", "# "]) for _ in range(rnd.randint(0, 60))), "en", "s", 0) for i in range(150)]
    got = quality.statistics(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: tuple(r[c] for c in NAMES) for r in got} == {r[0]: brute(r[1]) for r in rows}


def test_outliers_go_and_the_rest_stay(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    rows = [(i, " ".join(word() for _ in range(rnd.randint(60, 300))), "en", f"s{i % 2}", 0) for i in range(400)]
    rows += [(1000 + i, " ".join(word() + "#$%|" * 6 for _ in range(200)), "en", "s0", 0) for i in range(30)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(not got[i].kept for i in range(400)) == 0
    assert not any(got[1000 + i].kept for i in range(30))


def test_small_sources_are_judged(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    odd = lambda: " ".join(word() + "#$%|" * 6 for _ in range(200))
    rows = [(i, " ".join(word() for _ in range(rnd.randint(60, 300))), "en", f"s{i % 40}", 0) for i in range(200)]
    rows += [(1000, odd(), "en", "s3", 0), (1001, odd(), "en", "alone", 0), (1002, odd(), "xx", "alone", 0), (1003, odd(), None, None, 0)]
    block = [word() + "q" for _ in range(180)]
    rows.append((1004, " ".join([word() + "z" for _ in range(1640)] + block + ["between"] + block), "en", "s4", 0))  # 18 % of its words repeat
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(r.base_failed for r in got.values()) and all(r.distance is not None for r in got.values())
    assert all(got[i].kept for i in range(200)) and not any(got[i].kept for i in range(1000, 1005))


def test_estimate_like_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal([5, 1, 2, 3], [1, 0.5, 0.3, 0.4], (600, 4))
    x[:100] += [8, 5, 4, 4]
    x = np.abs(x)
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "group string, x1 double, x2 double, x3 double, x4 double")
    p = quality.estimates(rows).first()
    centre = np.array([p[f"m{i}"] for i in range(4)])
    # plain concentration steps on the same rows reach the same subset
    m, c = np.median(x, 0), np.diag((np.median(np.abs(x - np.median(x, 0)), 0) * 1.4826) ** 2)
    for _ in range(quality.STEPS):
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c + np.diag(np.square(quality.FLOORS))), x - m)
        inside = x[d <= np.quantile(d, quality.SHARE)]
        m, c = inside.mean(0), np.cov(inside.T, bias=True)
    assert np.abs(centre - m).max() < 0.05


def test_keep(spark):
    rows = [(i, f"some quite usual words of text number {i} that go on for a while here", "en", "s", 0) for i in range(20)]
    got = quality.keep(spark.createDataFrame(rows + ODD_ROWS + [(None, rows[0][1], None, None, None)], SCHEMA))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == list(range(20)) and got.where("doc_id is null").count() == 2


def test_keep_with_clashing_names(spark):
    rows = [(i, f"some quite usual words of text number {i} that go on for a while here", "en", "s", 0) for i in range(20)] + ODD_ROWS
    names = ("one", "TWO", "row", "own", "group", "up", "top", "w", "lines", "h", "kept", "n_words", "distance", "x1", "m0", "l00")
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"concat(doc_id, '{c}') as `{c}`" for c in names])
    got = quality.keep(docs)
    assert got.columns == docs.columns and got.count() == 21
    assert all(r.own == f"{r.doc_id}own" and r.kept == f"{r.doc_id}kept" for r in got.where("doc_id is not null").collect())
