import zlib
from collections import Counter

from pyspark.sql import functions as F

from seqthin.llm import hash_tree
from tests.llm import tables

TREE = hash_tree.regular_tree(2, 2, 2)


def test_rows(spark):
    docs, made = tables.odd_documents(spark)
    for frame, rows in ((tables.documents(spark), tables.rows()), (docs, made)):
        got = hash_tree.hash_tree_shards(frame, TREE, hash_tree.grown(TREE, 8), rows_per_bucket=5).collect()
        text = lambda r: (r[1] or "").encode()
        assert sorted(str((g.doc_id, g.size, g.text_crc32)) for g in got) == sorted(str((r[0], len(text(r)) + 1, zlib.crc32(text(r)))) for r in rows)
        slots = {}
        for g in got:
            slots.setdefault(g.shard, []).append(g.slot)
            assert g.grown_shard in (g.shard, 8) and g.law == "key"
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        by_id = {}
        for g in got:
            by_id.setdefault(g.doc_id, set()).add((g.shard, g.grown_shard))
        assert all(len(x) == 1 for x in by_id.values())
    assert hash_tree.hash_tree_shards(tables.empty(spark), TREE, TREE).count() == 0


def placed(spark, tree, n=8000):
    df = spark.range(n).select(hash_tree.shard_of([F.col("id")], tree).alias("s"))
    return [r.s for r in df.collect()]


def test_draws_follow_weights(spark):
    tree = {"a": {"r": {"x": (0, 1.0), "y": (1, 3.0)}}, "b": {"r": {"z": (2, 4.0), "none": (3, 0.0)}}}
    n = Counter(placed(spark, tree))
    assert 3 not in n
    for shard, share in ((0, 1 / 8), (1, 3 / 8), (2, 1 / 2)):
        assert abs(n[shard] / 8000 - share) < 0.03


def test_a_changed_weight_moves_rows_of_its_subtree_only(spark):
    before = {"a": {"r": {"x": (0, 1.0), "y": (1, 1.0)}, "q": {"v": (4, 1.0)}}, "b": {"r": {"z": (2, 1.0), "u": (3, 1.0)}}}
    after = {"a": {"r": {"x": (0, 2.0), "y": (1, 1.0)}, "q": {"v": (4, 1.0)}}, "b": before["b"]}
    moves = Counter((a, b) for a, b in zip(placed(spark, before), placed(spark, after)) if a != b)
    # Into region a, into its rack r, or onto x; never out of them, never inside b.
    assert moves and not any(a in (0, 1, 4) and b in (2, 3) for a, b in moves)
    assert not any({a, b} <= {2, 3} for a, b in moves) and (0, 1) not in moves and (0, 4) not in moves


def test_growth_takes_its_share(spark):
    old, new = placed(spark, TREE), placed(spark, hash_tree.grown(TREE, 8))
    moved = [b for a, b in zip(old, new) if a != b]
    assert set(moved) == {8} and abs(len(moved) / 8000 - 1 / 9) < 0.02
