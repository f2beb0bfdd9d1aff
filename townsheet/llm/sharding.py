"""Sharding by a hierarchical weighted hash tree, on built-in functions.

A tree has regions, racks and shards with weights; a node weighs what its shards do. A row descends:
at each level every child draws -ln(u) / weight, with u hashed from the row's key and the child's
name, and the smallest draw wins. A child's draw depends on its own weight alone, so when weights
change, rows move only to or from subtrees whose weight changed.

``base_tree`` makes full regions; each shard beyond them opens a region of its own, so one more
shard draws rows into itself and moves no other row. ``assign`` adds size, text_crc32, shard and
slot (rank of the row within its shard, from 0 without gaps, by id, checksum and size).

Defined results: a null key hashes like a missing one (all null keys share a shard); a null text has
size 16 and the checksum of no bytes; repeated rows get one shard and different slots; an empty
table gives an empty one. Slots come from one range partitioning and prefix sums over partition
totals, so no shard's rows have to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townsheet.llm.common import partitions, saved

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]


def base_tree(full: int = 40, extra: int = 0, racks: int = 2, per_rack: int = 5) -> Tree:
    """``full`` shards in regions of racks x per_rack shards, then ``extra`` regions of one shard."""
    size = racks * per_rack
    tree: Tree = {}
    for shard in range(full):
        tree.setdefault(f"region{shard // size}", {}).setdefault(f"rack{shard % size // per_rack}", {})[shard] = 1.0
    for shard in range(full, full + extra):
        tree[f"extra{shard}"] = {"rack0": {shard: 1.0}}
    return tree


def weight(node) -> float:
    return sum(map(weight, node.values())) if isinstance(node, dict) else float(node)


def draw(key: Column, path: Column, w: Column) -> Column:
    """-ln(u) / w with u in (0, 1) from 52 bits of the hash of key and path."""
    bits = F.shiftrightunsigned(F.xxhash64(key, path), 12)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 52))) / w


def _levels(tree: Tree) -> list[list[list[tuple[str, float, int]]]]:
    """For each level the children (path, weight, place) of every node; places are rows of the next level, or shards."""
    levels, nodes = [], [("", tree)]
    while nodes:
        rows, below = [], []
        for path, node in nodes:
            some = {f"{path}/{c}": (c, sub) for c, sub in node.items() if weight(sub) > 0}
            if not some:
                raise ValueError(f"nothing at {path or 'the root'} has a weight")
            row = []
            for name, (c, sub) in some.items():
                row.append((name, weight(sub), len(below) if isinstance(sub, dict) else int(c)))
                if isinstance(sub, dict):
                    below.append((name, sub))
            rows.append(row)
        levels.append(rows)
        nodes = below
    return levels


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key: level by level, the child with the smallest draw among those of the node reached.

    A level's children are one constant table, and the node reached picks its row, so the expression
    has a term a level, whatever the number of shards.
    """
    at = F.lit(0)
    for rows in _levels(tree):
        table = F.array(*[F.array(*[F.struct(F.lit(p).alias("path"), F.lit(w).alias("w"), F.lit(i).alias("at")) for p, w, i in row]) for row in rows])
        at = F.array_min(F.transform(F.get(table, at), lambda c: F.struct(draw(key, c["path"], c["w"]).alias("d"), c["at"].alias("at"))))["at"]
    return at.cast("int")


def assign(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and, with a grown tree, the shard there."""
    key = F.col("doc_id")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        place(key, tree).alias("shard"), (place(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    order = ["shard", "doc_id", "text_crc32", "size"]
    sorted_rows = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    # row numbers within partitions are counted in the pass that writes, as a second pass could split elsewhere
    table = saved(sorted_rows.withColumn("at", F.monotonically_increasing_id()), "shards")
    part = F.shiftright("at", 33)
    totals = table.groupBy(part.alias("part"), "shard").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # a shard's partitions are few (total partitions / shards), each one row here
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("part", "shard", (before - F.col("first")).alias("shift"))
    out = table.withColumn("part", part).join(offsets, ["part", "shard"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).cast("long").alias("slot"), "grown_shard")

