import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from helpers import ODD_ROWS, write
from pyspark.sql import functions as F

from townsheet.llm import queries, sharding


def test_query(spark, tmp_path):
    rows = [(i, f"text {i % 7}" * (i % 5), "en", "s", 0) for i in range(3000)] + ODD_ROWS
    got = queries.op8_hash_tree_sharding(spark, write(spark, rows, tmp_path, extra=True)).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and (r.grown_shard == r.shard or r.grown_shard == 40)
    assert set(slots) <= set(range(40)) and len(slots) == 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 20 < sum(r.grown_shard == 40 for r in got) < 160
    assert max(map(len, slots.values())) < 2 * len(rows) / 40
    assert queries.op8_hash_tree_sharding(spark, write(spark, [], tmp_path)).count() == 0


def placed(spark, tree, n=20000):
    return {r.id: r.s for r in spark.range(n).select("id", sharding.place(F.col("id"), tree).alias("s")).collect()}


def test_weights_and_confinement(spark):
    tree = {"r0": {"k0": {0: 1, 1: 3}, "k1": {2: 4}}, "r1": {"k0": {3: 2, 4: 6}}}
    before = placed(spark, tree)
    share = Counter(before.values())
    for shard, w in {0: 1, 1: 3, 2: 4, 3: 2, 4: 6}.items():
        assert abs(share[shard] / len(before) - w / 16) < 0.015
    tree["r0"]["k0"][1] = 5  # r0 and its rack k0 grow: rows leave others for them only
    after = placed(spark, tree)
    for k, s in before.items():
        if after[k] != s:
            assert after[k] in (0, 1, 2) if s in (3, 4) else after[k] in (0, 1)


def test_nothing_to_descend_to():
    with pytest.raises(ValueError):
        sharding.place(F.lit(1), {"r": {"k": {0: 0.0}}})


def brute_place(key, tree, path=""):
    """The descent by plain loops: the child with the smallest -ln(u) / weight, level by level."""
    if not isinstance(tree, dict):
        return int(path.rpartition("/")[2])
    best = None
    for child, node in tree.items():
        w = sharding.weight(node)
        if w <= 0:
            continue
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        bits = xxhash.xxh64_intdigest(f"{path}/{child}".encode(), seed) >> 12
        draw = -math.log((bits + 0.5) / 2**52) / w
        if best is None or draw < best[0]:
            best = draw, child, node
    return brute_place(key, best[2], f"{path}/{best[1]}")


def test_query_like_brute_force_descent(spark, tmp_path):
    rows = [(i * 7919 - 3000, "x", "en", "s", 0) for i in range(500)] + [(None, "x", None, None, None)]
    got = queries.op8_hash_tree_sharding(spark, write(spark, rows, tmp_path)).collect()
    tree, grown = sharding.base_tree(40), sharding.base_tree(40, extra=1)
    for r in got:
        assert (r.shard, r.grown_shard) == (brute_place(r.doc_id, tree), brute_place(r.doc_id, grown))
    uneven = {"r0": {"k0": {0: 1, 1: 3}, "k1": {2: 4}}, "r1": {"k0": {3: 2, 4: 0.0, 5: 6}}}
    assert all(s == brute_place(i, uneven) for i, s in placed(spark, uneven, 400).items())
