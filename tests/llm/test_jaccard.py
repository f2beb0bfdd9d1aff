import random
from collections import Counter

import pytest
from helpers import ODD_ROWS, WORD, write
from pyspark.sql import functions as F

from townsheet.llm import jaccard, queries


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sets_of(rows, width=4):
    for d, t, *_ in rows:
        w = WORD.findall(lower(t))
        yield d, (frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())


def brute(rows):
    """Every pair of rows; the smallest id of each component, a null one last."""
    sets = list(sets_of(rows))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return Counter((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
    return words


def made(seed, n=40):
    """Near copies of bases at all similarities round the threshold, a common passage, and short texts with ties."""
    rnd = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for b in range(6):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([8, 30, 60, 150]))]
        for _ in range(n // 4):
            rows.append(edited(rnd, base, rnd.choice([0, 0, 1, 1, 2, 3, 5])))
    for _ in range(n):
        own = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([0, 1, 2, 4, 10, 40]))]
        rows.append(own + common if rnd.random() < 0.6 else own)
    for k in range(n // 2):
        rows.append([f"s{i}" for i in range(rnd.randrange(12))])  # nested sets of every small size
    rnd.shuffle(rows)
    return [(i * 3 % 101, (" " if i % 2 else "\n\t").join(w).upper() if i % 5 == 0 else " ".join(w), "en", "s", 0) for i, w in enumerate(rows)]


@pytest.mark.parametrize("seed,hot", [(1, 1 << 16), (2, 40), (3, 1), (4, 1)])
def test_like_brute_force(spark, tmp_path, seed, hot):
    rows = made(seed) + ODD_ROWS
    docs = spark.read.parquet(write(spark, rows, tmp_path, extra=True) + "/documents.parquet")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs, hot=hot).collect())
    want = brute(rows)
    assert got == want
    assert len({r[2] for r in want}) < len(want) - 30


def test_query_and_empty(spark, tmp_path):
    rows = ODD_ROWS + [(9, "One two three", None, None, 0), (8, "one TWO\tthree", None, None, 0), (7, "one two three four", None, None, 0)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in queries.op11_ngram_jaccard_join(spark, write(spark, rows, tmp_path)).collect())
    assert got == brute(rows)
    assert queries.op11_ngram_jaccard_join(spark, write(spark, [], tmp_path)).count() == 0


def test_hub_of_copies_that_are_not_alike_themselves(spark, tmp_path):
    """Copies that link by the base alone; pairs examined stay far below all pairs."""
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rnd, base, 0 if i == 77 else 3)), "en", "s", 0) for i in range(150)]
    docs = spark.read.parquet(write(spark, rows, tmp_path) + "/documents.parquet")
    got = jaccard.join(docs, hot=1).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert {r.component_id for r in got} == {0}


def test_filters_keep_every_link(spark):
    """No filter drops a linked pair at its first common shingle, and each one drops some that are not linked."""
    rnd = random.Random(9)
    nodes = []
    for i in range(120):
        n = rnd.randrange(1, 60)
        nodes.append((i, n, 0, sorted(rnd.sample(range(64), n))))
    frame = spark.createDataFrame(nodes, "node long, n long, u long, tokens array<long>")
    entries = jaccard._entries(frame).withColumn("label", F.col("node"))
    got = {(r.a, r.b) for r in jaccard.remaining(entries).collect()}
    links = {tuple(sorted((a[0], b[0]))) for a in nodes for b in nodes if a[0] < b[0] and 100 * len(set(a[3]) & set(b[3])) >= 85 * len(set(a[3]) | set(b[3]))}
    assert links <= {tuple(sorted(p)) for p in got}
    assert links and len(got) < 120 * 119 / 4


def test_labels_meet_nodes_and_not_their_shingles(spark, monkeypatch):
    """What is joined with labels has a row a node, however many shingles its prefix has."""
    rnd = random.Random(10)
    nodes = [(i, 200, 0, [1000 * (i // 3) + j for j in sorted(rnd.sample(range(204), 200))]) for i in range(30)]
    frame = spark.createDataFrame(nodes, "node long, n long, u long, tokens array<long>")
    counts = []

    def counted(df, name, keep=False):
        out = jaccard_saved(df, name, keep)
        if name == "entries":
            counts.append(out.count())
        return out

    jaccard_saved = jaccard.saved
    monkeypatch.setattr(jaccard, "saved", counted)
    got = {r.node: r.label for r in jaccard.linked(frame).collect()}
    assert got == {i: i // 3 * 3 for i in range(30)}
    assert counts == [len(nodes)]


def test_pack_round_trip():
    import numpy as np

    rnd = np.random.default_rng(3)
    hi, lo, n = rnd.integers(0, 1 << 63, 5, np.uint64), rnd.integers(0, 1 << 63, 5, np.uint64), rnd.integers(1, 99999, 5).astype(np.uint32)
    counts, h = np.array([2, 0, 1, 3, 1]), rnd.integers(0, 1 << 48, 7, np.uint64)
    for a, b in zip(jaccard._unpack(jaccard._pack(hi, lo, n, counts, h)), (hi, lo, n, counts, h)):
        assert (a == b).all()
