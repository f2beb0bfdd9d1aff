import random

import pytest
import xxhash
from helpers import ODD_ROWS, SCHEMA, WORD, write

from townsheet.llm import jaccard as links_of_sets
from townsheet.llm import queries, simhash
from townsheet.llm.common import saved
from townsheet.llm.components import components


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_groups(rows):
    prints = [(d, brute_print(t)) for d, t in rows]
    fps = sorted({f for _, f in prints})
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[root(f)] = min(least.get(root(f), d), d)
    return sorted(((d, f"{f:016x}", least.get(root(f))) for d, f in prints), key=str)


def run(spark, path):
    return sorted([tuple(r) for r in queries.op4_simhash_near_dedup(spark, path).select("doc_id", "fingerprint", "component_id").collect()], key=str)


def test_like_brute_force(spark, tmp_path):
    rnd = random.Random(5)
    base = [[rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(400)] for _ in range(4)]
    rows = []
    for i in range(120):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(400)] = "Zz"
        rows.append((i, " ".join(w), "en", "s", 1))
    rows += [(200 + i, t, "x", "y", 0) for i, t in enumerate(["a", "a b", "A B", "é\xa0b c", None, "", "a b c d"])]
    path = write(spark, rows, tmp_path)
    got = run(spark, path)
    assert got == brute_groups([r[:2] for r in rows])
    assert len({g[2] for g in got}) < 100


def test_odd_rows_and_extra_columns(spark, tmp_path):
    assert run(spark, write(spark, ODD_ROWS, tmp_path, extra=True)) == brute_groups([r[:2] for r in ODD_ROWS])
    assert run(spark, write(spark, [], tmp_path)) == []


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 7)
    text = " ".join(str(i * i) for i in range(600))
    assert simhash.fingerprint(text) == brute_print(text)


def jaccard(x, y):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (x, y))
    return len(a & b) / len(a | b)


def low(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_keep(rows):
    """The row kept of each component of texts with a Jaccard similarity of 0.8 or more."""
    rows = list(dict.fromkeys(rows))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    words = [low(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(words[i], words[j]) >= 0.8:
                parent[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r)
    return groups.values()


def one_of_each(kept, rows):
    """Whether kept holds one row of each component, of the smallest id there is."""
    kept = [tuple(r) for r in kept]
    for group in brute_keep(rows):
        found = [r for r in kept if r in group]
        ids = [r[0] for r in group if r[0] is not None]
        assert len(found) == 1 and found[0][0] == (min(ids) if ids else None), (found, len(group))
    return len(kept) == len(brute_keep(rows))


def test_keep_one(spark):
    assert one_of_each(simhash.keep_one(spark.createDataFrame(ODD_ROWS, SCHEMA)).collect(), ODD_ROWS)
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one_like_brute_force_on_edited_copies(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 6)))
    base = [[word() for _ in range(rnd.randint(120, 400))] for _ in range(25)]
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate(base)]
    for i in range(150):  # up to one word in fifty is replaced, or a piece is cut off or put before
        w = list(base[i % 25])
        kind = i % 3
        for _ in range(len(w) // 50 if kind == 0 else 0):
            w[rnd.randrange(len(w))] = word()
        w = w[: -(len(w) // 12)] if kind == 1 else [word() for _ in range(len(w) // 15)] + w if kind == 2 else w
        rows.append((100 + i, " ".join(w).upper(), "en", "s", 1))
    rows += [(500 + i, " ".join(base[i][:60] + [word() for _ in range(200)]), "en", "s", 1) for i in range(10)]  # share a passage only
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    ids, want = {r.doc_id for r in kept}, len(brute_keep(rows))
    assert {*range(25), *range(500, 510)} <= ids and want == 35 and len(ids) <= want + 8  # over 0.94 of 150 copies go, most of them at 0.82 to 0.93


def test_keep_one_of_a_large_group_of_near_copies(spark):
    rnd = random.Random(13)
    base = [f"w{rnd.randint(0, 900)}" for _ in range(150)]
    rows = []
    for i in range(600):
        w = list(base)
        w[rnd.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(w), "en", "s", 1))
    assert [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()] == [0]


def test_keep_one_loses_no_link_near_the_threshold(spark):
    """Copies with scattered edits at just 0.8 are found, one by one, whether sketches meet or not."""
    rnd = random.Random(14)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 6)))
    rows = []
    for i in range(120):
        base = [word() for _ in range(rnd.randint(90, 160))]
        copy, tried = list(base), list(base)
        while jaccard(base, tried) >= 0.8:
            copy, tried = tried, list(tried)
            tried[rnd.randrange(len(tried))] = word()
        rows += [(i, " ".join(base), "en", "s", 1), (1000 + i, " ".join(copy), "en", "s", 1), (2000 + i, " ".join(tried), "en", "s", 1)]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert one_of_each(kept, rows)


def test_keep_one_tests_few_pairs_of_a_large_group(spark, monkeypatch):
    """A group of n near copies costs some n pairs, in every table that is written."""
    rnd = random.Random(15)
    base = [f"w{rnd.randint(0, 900)}" for _ in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rnd.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(w), "en", "s", 1))
    counts = []

    def counted(df, name, keep=False):
        out = saved(df, name, keep)
        if name == "pairs":
            counts.append(out.count())
        return out

    for module in (simhash, links_of_sets):
        monkeypatch.setattr(module, "saved", counted)
    assert [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()] == [0]
    assert sum(counts) <= 3 * len(rows), counts


def test_orders_of_neighbours_begin_at_a_written_table(spark):
    """The driver plans eight orders over a scan, not over the making of all variants."""
    frame = spark.createDataFrame([(i, i << 40, 7) for i in range(20)], "node long, a long, b long")
    found, met = simhash._neighbours(frame, 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Window [") == simhash.ORDERS
    assert met.count() >= 20 and {r.node for r in found.where("size(near) > 0").collect()}


def test_keep_one_of_every_component_without_usable_ids(spark):
    rnd = random.Random(9)
    text = lambda: " ".join(rnd.choice("abcdefghij") * rnd.randint(1, 4) for _ in range(60))
    same = text()
    rows = [(i if i % 3 else None, text(), "en", "s", 1) for i in range(30)] + [(7, text(), "en", "s", 1), (None, same, "en", None, 1), (None, same, None, "en", 1), (None, same, "en", None, 1), (99, same, "en", "s", 1)]
    names = ("one", "TWO", "node", "first", "_d", "_r", "label")
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"concat(n_chars, '{c}') as `{c}`" for c in names])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert one_of_each(kept.select(*SCHEMA.replace(",", "").split()[::2]).collect(), rows)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 90)] + [(1000, i) for i in range(2000, 2100)] + [(7, 7), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 91)) and all(got[i] == 1000 for i in [1000, *range(2000, 2100)]) and len(got) == 191
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _meetings(rnd, strangers, pairs=150, bits=13):
    """Pairs of sketches that share one part of four and differ in some bits of the others, among strangers of that part."""
    nodes, wanted = [], set()
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    for _ in range(pairs):
        k, whole = rnd.randrange(4), rnd.getrandbits(128)
        rest = [i for i in range(128) if i // 32 != k]
        near = whole
        for i in rnd.sample(rest, bits):
            near ^= 1 << i
        met = whole & (0xFFFFFFFF << 32 * k)
        others = [rnd.getrandbits(128) & ~(0xFFFFFFFF << 32 * k) | met for _ in range(strangers)]
        at = len(nodes)
        some = [whole, near, *others]
        order = list(range(len(some)))
        rnd.shuffle(order)
        nodes += [(at + o, signed(x & (1 << 64) - 1), signed(x >> 64)) for o, x in zip(order, some)]
        wanted.add((min(at + order[0], at + order[1]), max(at + order[0], at + order[1])))
    return nodes, wanted


@pytest.mark.parametrize("strangers,least", [(0, 1.0), (10, 0.97), (80, 0.93)])
def test_strangers_in_a_part_do_not_hide_pairs(spark, strangers, least):
    """Recall falls little as the corpus, and so the number of unlike texts that meet in a part, grows."""
    nodes, wanted = _meetings(random.Random(strangers), strangers)
    frame = spark.createDataFrame(nodes, "node long, a long, b long")
    found = {(r.low, r.high) for r in simhash.candidates(frame, 4).collect()}
    assert len(wanted & found) >= least * len(wanted)
    # of strangers, who differ in half the other 96 bits, few are candidates: one in a hundred is within APART by chance
    assert len(found - wanted) <= 0.015 * 150 * (strangers + 2) * (strangers + 1) / 2
