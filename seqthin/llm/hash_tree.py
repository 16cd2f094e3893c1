"""Sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards carries weights on its leaves; an inner node
weighs what its leaves weigh.  A row descends from the root: at each node every
child draws ``-ln(u) / weight`` with ``u`` a hash of (row key, child path), and
the smallest draw wins, so a child is chosen with probability in proportion to
its weight.  A draw depends on nothing but the key, the path and the weight.
When a weight changes, only draws of that child and its ancestors change, and
rows move only into or out of the subtrees whose weights changed; a new subtree
under the root takes rows only into itself.

Everything is built-in expressions.  Defined cases: a null key hashes as null and
lands in one fixed shard; a null text has no bytes (size 1, checksum of nothing);
equal rows share a shard and get slots of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqthin.workspace import Workspace

Tree = dict  # name -> subtree, or name -> (shard number, weight)

LAW = "key"
ROWS_PER_BUCKET = 200_000


def weight(node) -> float:
    return float(node[1]) if isinstance(node, tuple) else sum(map(weight, node.values()))


def leaves(node) -> list[int]:
    return [node[0]] if isinstance(node, tuple) else [s for c in node.values() for s in leaves(c)]


def regular_tree(regions: int, racks: int, shards: int) -> Tree:
    """Equal weights: ``regions * racks * shards`` leaves, numbered in order."""
    number = iter(range(regions * racks * shards))
    return {
        f"region{g}": {
            f"rack{r}": {f"shard{s}": (next(number), 1.0) for s in range(shards)} for r in range(racks)
        }
        for g in range(regions)
    }


def grown(tree: Tree, shard: int, size: float = 1.0) -> Tree:
    """The tree with one more shard, in a region and rack of its own.

    No existing node changes its weight, so no row moves between old shards.
    """
    return {**tree, f"region-of-{shard}": {f"rack-of-{shard}": {f"shard-of-{shard}": (shard, size)}}}


def shard_of(key: list[Column], tree: Tree, path: str = "") -> Column:
    """The shard number a row with this key descends to."""
    if isinstance(tree, tuple):
        return F.lit(int(tree[0]))
    children = [(n, c) for n, c in tree.items() if weight(c) > 0]
    if len(children) == 1:
        return shard_of(key, children[0][1], f"{path}/{children[0][0]}")
    draws = []
    for i, (name, child) in enumerate(children):
        bits = F.shiftrightunsigned(F.xxhash64(*key, F.lit(f"{path}/{name}")), 11)
        u = (bits + F.lit(0.5)) * F.lit(math.ldexp(1.0, -53))
        draws.append(F.struct((-F.log(u) / F.lit(weight(child))).alias("draw"), F.lit(i).alias("child")))
    best = F.array_min(F.array(*draws))["child"]
    out = None
    for i, (name, child) in enumerate(children):
        below = shard_of(key, child, f"{path}/{name}")
        out = F.when(best == i, below) if out is None else out.when(best == i, below)
    return out


def hash_tree_shards(
    docs: DataFrame, tree: Tree, tree_after: Tree, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Place rows of (doc_id, text) in shards, number them there, and place them after growth.

    Slots come in two levels: shards are split into hash buckets, buckets are
    summed (one row each) and rows are numbered inside their bucket, so no task
    holds a shard.
    """
    ws = Workspace(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    key = [F.col("doc_id")]
    buckets = max(8, math.ceil(docs.count() / rows_per_bucket))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumns({
        "shard": shard_of(key, tree).cast("int"),
        "grown_shard": shard_of(key, tree_after).cast("int"),
        "bucket": F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int"),
    })
    rows = ws.table(rows, "placed")
    where = ["shard", "bucket"]
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        rows.groupBy(*where).agg(F.count("*").alias("n"))
        .select(*where, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    )
    inside = Window.partitionBy(*where).orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(first, where).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("first") + F.col("at")).cast("bigint").alias("slot"), "grown_shard",
    )
