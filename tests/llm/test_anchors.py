import hashlib
import random

import numpy as np
from helpers import ODD_ROWS, WORD, write

from townsheet.llm import anchors, queries


def brute(rows, window=13):
    last = float("inf")
    lists = [(last if d is None else d, WORD.findall(t or "")) for d, t in rows]
    least = {}
    for d, w in lists:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, last), d)
    out = []
    for (d0, _), (d, w) in zip(rows, lists):
        gone = {j for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d0, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_like_brute_force(spark, tmp_path):
    rnd = random.Random(11)
    passages = [[rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(8, 40))] for _ in range(6)]
    rows = []
    for i in range(150):
        w = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, 8)
            at = rnd.randint(0, len(w))
            w[at:at] = p[a : a + rnd.randint(5, 30)]
        rows.append((i % 140, " ".join(w), "en", "s", 0))
    rows += ODD_ROWS
    got = queries.op10_fixed_block_anchors(spark, write(spark, rows, tmp_path, extra=True)).collect()
    want = brute([r[:2] for r in rows])
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == want
    assert sum(w[2] for w in want) > 500
    spans = [[tuple(map(int, x.split(":"))) for x in r.removed.split(",") if x] for r in got]
    assert all(sum(b - a for a, b in s) == r.n_removed for s, r in zip(spans, got))
    assert queries.op10_fixed_block_anchors(spark, write(spark, [], tmp_path)).count() == 0


def test_pack_round_trip():
    rnd = np.random.default_rng(1)
    docs = np.sort(rnd.integers(0, 9, 500))
    places = np.concatenate([np.sort(rnd.choice(90000, n, replace=False)) for n in np.unique(docs, return_counts=True)[1]])
    keys, ids, h, c = rnd.integers(-9, 9, 9), np.arange(9), rnd.integers(0, 1 << 60, 500).astype("<u8"), rnd.integers(0, 99, 500).astype("<u2")
    k, i, d, p, h2, c2 = anchors.unpack(anchors.pack(keys, ids, docs, places, h, c))
    assert (k[d] == keys[docs]).all() and (i[d] == ids[docs]).all() and (p == places).all() and (h2 == h).all() and (c2 == c).all()


def test_told_round_trip():
    hashes = np.random.default_rng(2).integers(0, 1 << 64, 5000, np.uint64)
    hashes[:2] = 0, (1 << 64) - 1
    got = {(b, x) for b, data in anchors._told(hashes, 7) for x in anchors.untold(data).tolist()}
    assert got == {((x >> 32) % 7, x & 0xFFFFFFFF) for x in hashes.tolist()}


def test_texts_are_shuffled_once(spark, tmp_path):
    passage = " ".join(map(str, range(40)))
    path = write(spark, ODD_ROWS + [(50 + i, f"{i} {passage} {i}", "en", "s", 0) for i in range(9)], tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = queries.op10_fixed_block_anchors(spark, path)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
        assert "ReusedExchange" in plan and plan.count("REPARTITION_BY_NUM") <= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _by_bucket(packed) -> list[int]:
    """Windows that each bucket is asked about or told of."""
    sizes: dict[int, int] = {}
    for r in packed.where(f"kind != {anchors.SETTLED}").collect():
        data = bytes(r.payload)
        sizes[r.bucket] = sizes.get(r.bucket, 0) + len(anchors.untold(data) if r.kind == anchors.TOLD else anchors.unpack(data)[2])
    return list(sizes.values())


def test_a_passage_in_a_third_of_all_texts(spark, tmp_path):
    # at the head of some texts, in the middle of others; over many batches of one task, and many tasks
    rnd = random.Random(3)
    hot = " ".join(f"p{k}" for k in range(22))
    rows = []
    for i in range(9000):
        own = [f"w{rnd.randint(0, 10**6)}" for _ in range(30)]
        if i % 3 == 0:
            at = 1 if i % 2 else rnd.randint(0, 30)
            own[at:at] = hot.split()
        rows.append((i, " ".join(own), "en", "s", 0))
    rnd.shuffle(rows)
    path = write(spark, rows, tmp_path)
    for parts in (1, 3):
        docs = spark.read.parquet(f"{path}/documents.parquet").coalesce(parts)
        got = anchors.dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=str) == brute([r[:2] for r in rows])
    buckets = 64
    keyed = docs.selectExpr("doc_id", "doc_id as id", "text", "xxhash64(doc_id, text) as key")
    asked = anchors.probes(keyed, 13, buckets)
    sizes = _by_bucket(asked)
    assert max(sizes) <= 2 * sum(sizes) / buckets
    found = anchors.hits(asked, buckets)
    sizes = _by_bucket(anchors.extensions(keyed, found, 13, buckets))
    # each task asks about the texts of its least ids alone, of 3,000 that hold these windows
    assert max(sizes) < 300


def test_what_a_task_forgets_is_sent_again(monkeypatch):
    monkeypatch.setattr(anchors, "MET", 4)
    met = anchors._Met()
    owner, h, block = np.repeat([1, 2], 6), np.tile(np.arange(6, dtype=np.uint64), 2), np.ones(12, bool)
    asked, hit, told = anchors.settle_blocks(owner, block, h, met)
    assert not asked.any() and hit.all() and told.tolist() == list(range(6))  # two owners each
    asked, hit, told = anchors.settle_blocks(owner[:6], block[:6], h[:6], met)
    assert not asked.any() and hit.all() and not len(told)
    anchors.settle_blocks(np.array([1, 2]), np.ones(2, bool), np.array([9, 9], np.uint64), met)
    asked, hit, told = anchors.settle_blocks(owner[:6], h[:6] < 3, h[:6], met)
    assert asked.tolist() == [True] * 3 + [False] * 3 and not hit.any() and told.tolist() == [3, 4, 5]
    met, check = anchors._Met(), np.zeros(12, np.uint64)
    sent, gone = anchors.settle_windows(owner, h, check, met)
    assert (gone == (owner == 2)).all() and (sent == ~gone).all()
    assert anchors.settle_windows(owner[:6], h[:6], check[:6], met)[0].all()
    assert anchors.settle_windows(owner[:6] + 1, h[:6], check[:6], met)[1].all()
    assert anchors.settle_windows(owner[:6] + 1, h[:6], check[:6] + np.uint64(1), met)[0].all()  # another window
