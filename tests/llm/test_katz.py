import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import ODD_ROWS, SCHEMA, WORD, write

from townsheet.llm import katz, queries


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def gt(counts):
    """Discounts from the definition, with the operator's fallback."""
    n = Counter(counts)
    k, d = katz.KNEE, {}
    top = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top < 1 else 0
        d[r] = x if 0.05 < x < 1 else (r - 0.5) / r
    return lambda c: c * d.get(c, 1.0)


class Brute:
    """The same model by dictionaries and recursion."""

    def __init__(self, texts):
        lists = [words(t) for t in texts]
        self.c = Counter(w for x in lists for w in x)
        self.texts, self.tokens = len(lists), sum(self.c.values()) + len(lists)
        self.disc = gt(self.c.values())
        kept = sum(map(self.disc, self.c.values())) + self.texts
        self.total = self.tokens if self.tokens - kept > 1e-9 * self.tokens else self.tokens + 0.5
        self.unseen = 1 - kept / self.total
        self.pairs = Counter()
        for x in lists:
            y = ["</>", *x, "</>"]
            self.pairs.update(zip(y, y[1:]))
        self.pair_disc = gt(self.pairs.values())
        self.after = defaultdict(set)
        for a, b in self.pairs:
            self.after[a].add(b)

    def unigram(self, k):
        if k == "</>":
            return self.texts / self.total
        return self.disc(self.c[k]) / self.total if self.c[k] else self.unseen

    def bigram(self, a, k):
        seen = self.after.get(a)
        if not seen:
            return self.unigram(k)
        c, d = (sum(f(self.pairs[a, b]) for b in seen) for f in (lambda x: x, self.pair_disc))
        free = 1 - sum(map(self.unigram, seen))
        by = c if c - d > 1e-9 * c else c + 0.5
        return self.pair_disc(self.pairs[a, k]) / by if k in seen else (1 - d / by) / free * self.unigram(k)

    def score(self, text):
        tokens = ["</>", *words(text), "</>"]
        return sum(math.log10(self.bigram(a, b)) for a, b in zip(tokens, tokens[1:]))


def corpus(n, seed):
    rnd = random.Random(seed)
    common = ["the", "of", "A", "and", "to"]
    rows = []
    for i in range(n):
        w = [rnd.choice(common) if rnd.random() < 0.6 else f"w{int(rnd.expovariate(0.05))}" for _ in range(rnd.randint(0, 40))]
        rows.append((i, " ".join(w), "en", "s", 0))
    return rows


@pytest.mark.parametrize("common, hot, held", [(0, 0, 50), (12, 7, 1_000_000), (65534, 300_000, 1_000_000)])
def test_query_like_brute_force(spark, tmp_path, monkeypatch, common, hot, held):
    """What is answered on the spot and what from tables makes no difference."""
    monkeypatch.setattr(katz.fit, "__defaults__", (common, hot))
    monkeypatch.setattr(katz, "HELD", held)
    monkeypatch.setattr(katz, "BUCKET_WORDS", 300)
    rows = [(r[0] + 10, *r[1:]) for r in corpus(120, 3)] + ODD_ROWS
    got = queries.op7_katz_scores(spark, write(spark, rows, tmp_path, extra=True)).collect()
    train = [r[1] for r in rows if fold(r[0], 5) != 1]
    model = Brute(train)
    n, v = model.tokens, len(model.c) + 1
    want = []
    for d, t, *_ in rows:
        tokens = [*words(t), "</>"]
        counts = [model.texts if w == "</>" else model.c[w] for w in tokens]
        want.append((d, fold(d, 5) == 1, len(tokens), sum(c > 0 for c in counts), n, sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in counts), model.score(t)))
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-6), (g, w)


def test_probabilities_sum_to_one(spark):
    """Of every context, over all words, the end and whatever is unseen, as scored."""
    model = katz.fit(spark.createDataFrame(corpus(60, 9), SCHEMA), 12, 5)
    known = sorted({w for r in corpus(60, 9) for w in words(r[1])})
    texts = [f"{a} {b}" for a in known[:4] + known[-4:] for b in [*known, "neverseen"]]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*texts, *(known[:4] + known[-4:])])]
    got = {r.doc_id: r.score for r in katz.score(spark.createDataFrame(rows, SCHEMA), model).collect()}
    brute = Brute([r[1] for r in corpus(60, 9)])
    by_text = {r[1]: got[r[0]] for r in rows}
    for a in known[:4] + known[-4:]:
        start = math.log10(brute.bigram("</>", a))
        total = sum(10 ** (by_text[f"{a} {b}"] - start - math.log10(brute.bigram(b if b != "neverseen" else None, "</>"))) for b in [*known, "neverseen"])
        assert total + 10 ** (by_text[a] - start) == pytest.approx(1)


def test_texts_that_occur_twice_score_higher(spark, tmp_path):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(2, 7)))
    rows = [(i, " ".join(word() for _ in range(80)), "en", "s", 0) for i in range(200)]
    twice = [i for i in range(0, 200, 5) if fold(i, 5) != 1]
    rows += [(1000 + i, rows[i][1], "en", "s", 0) for i in twice if fold(1000 + i, 5) != 1]
    both = {r[0] - 1000 for r in rows if r[0] >= 1000}
    got = {r.doc_id: r.score / r.n_tokens for r in queries.op7_katz_scores(spark, write(spark, rows, tmp_path)).collect() if r.doc_id < 1000 and not r.held_out}
    assert min(got[i] for i in both) > max(v for i, v in got.items() if i not in both)


def test_held_out_likelihood_beats_the_base(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, " ".join(f"{w} x{w}y z{w}" for w in rnd.choices("abcdef", k=20)), "en", "s", 0) for i in range(200)]
    got = [r for r in queries.op7_katz_scores(spark, write(spark, rows, tmp_path)).collect() if r.held_out]
    assert got and all(r.score > r.base_score + 10 for r in got)


def test_nothing_to_learn_from(spark, tmp_path):
    assert queries.op7_katz_scores(spark, write(spark, [], tmp_path)).count() == 0
    held = next(i for i in range(99) if fold(i, 5) == 1)
    r = queries.op7_katz_scores(spark, write(spark, [(held, "a b", "x", "y", 0)], tmp_path)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isfinite(r.score) and math.isfinite(r.base_score)
