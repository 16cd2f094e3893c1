"""Greedy selection against the sequential rule, with crowded keys and copies."""

import glob
import random

import pytest

from seqthin.operators.clusters import cluster_sizes, covered, nearest_kept
from seqthin.operators.novelty import keep_novel
from seqthin.operators.signatures import Scheme, novelty_scheme
from seqthin.functions.similarity import min_covering_slots, min_equal_slots
from seqthin.workspace import Workspace
from tests import sequential


def random_sketches(rng, count, m):
    """Families of sketches, one of them holding a third of all rows."""
    families = [[rng.randrange(8) for _ in range(m)] for _ in range(5)]
    out = []
    for i in range(count):
        base = families[0] if rng.random() < 0.35 else rng.choice(families)
        sk = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, m // 6, m // 3, m // 2])):
            sk[rng.randrange(m)] = rng.randrange(8)
        out.append((i, rng.choice([0, 0, 1]), sk))
    return out


CASES = [
    (64, 16, 0.15, 2), (32, 16, 0.15, 64), (64, 16, 0.5, 3), (8, 16, 0.3, 2),
    (40, 16, 0.125, 4), (16, 4, 0.0, 2), (128, 16, 0.15, 4), (256, 16, 0.15, 64),
]


@pytest.mark.parametrize("m,bands,threshold,key_limit", CASES)
def test_keeps_what_the_sequential_rule_keeps(spark, m, bands, threshold, key_limit):
    items = random_sketches(random.Random(m + key_limit), 90, m)
    df = spark.createDataFrame(items, "ord bigint, part int, sketch array<bigint>").repartition(3)
    kept = keep_novel(df, novelty_scheme(m, bands, threshold), ["part"], Workspace(spark), key_limit)
    assert sorted(r[0] for r in kept.collect()) == sequential.keep(items, m, bands, threshold)


@pytest.mark.parametrize("m,threshold", [(64, 0.4), (10, 0.3)])
def test_without_bands_every_pair_counts(spark, m, threshold):
    items = [(o, 0, s) for o, _, s in random_sketches(random.Random(5), 80, m)]
    df = spark.createDataFrame(items, "ord bigint, part int, sketch array<bigint>")
    scheme = Scheme.exhaustive(m, min_equal_slots(m, threshold))
    kept = keep_novel(df, scheme, [], Workspace(spark), 3)
    assert sorted(r[0] for r in kept.collect()) == sequential.keep(items, m, 16, threshold, banded=False)


@pytest.mark.parametrize("count", [200, 400])
def test_unlike_records_in_one_band_take_no_rounds(spark, count):
    """A band all records hold, and nothing else in common: no crowded key remains."""
    m = 256
    rng = random.Random(count)
    items = [(i, 0, [7] * 16 + [rng.randrange(10**9) for _ in range(m - 16)]) for i in range(count)]
    items.append((count, 0, items[3][2][:-5] + [1] * 5))
    ws = Workspace(spark)
    df = spark.createDataFrame(items, "ord bigint, part int, sketch array<bigint>")
    kept = keep_novel(df, novelty_scheme(m, 16, 0.15), ["part"], ws, 64)
    assert sorted(r[0] for r in kept.collect()) == list(range(count))
    assert not glob.glob(f"{ws.path}/*-waiting")


def test_earlier_batches_count(spark):
    m = 32
    items = [(o, 0, s) for o, _, s in random_sketches(random.Random(9), 100, m)]
    schema = "ord bigint, part int, sketch array<bigint>"
    scheme, ws = novelty_scheme(m, 16, 0.2), Workspace(spark)
    whole = sequential.keep(items, m, 16, 0.2)
    first = keep_novel(spark.createDataFrame(items[:40], schema), scheme, ["part"], ws, 4)
    old = spark.createDataFrame(items, schema).join(first, "ord", "left_semi")
    second = keep_novel(spark.createDataFrame(items[40:], schema), scheme, ["part"], ws, 4, old)
    assert sorted(r[0] for r in first.union(second).collect()) == whole


def test_nearest_and_cluster_sizes(spark):
    m = 32
    items = [(o, 0, s) for o, _, s in random_sketches(random.Random(3), 90, m)]
    scheme, ws = Scheme.exhaustive(m, min_equal_slots(m, 0.3)), Workspace(spark)
    df = spark.createDataFrame(items, "ord bigint, part int, sketch array<bigint>")
    kept = ws.table(keep_novel(df, scheme, [], ws, 4), "kept")
    near = nearest_kept(df.drop("part"), kept, scheme, [], ws, 4)
    order = sequential.keep(items, m, 16, 0.3, banded=False)
    sketches = {o: s for o, _, s in items}
    want = {}
    for o, _, s in items:
        if o not in order:
            scores = [(sum(a == b for a, b in zip(s, sketches[p])), -p) for p in order if p < o]
            want[o] = (-max(scores)[1], max(scores)[0])
    assert {r["ord"]: (r["rep"], r["equal"]) for r in near.collect()} == want
    sizes = {r["rep"]: r["members"] for r in cluster_sizes(kept, near).collect()}
    assert sum(sizes.values()) == len(items) and set(sizes) == set(order)


def test_coverage(spark):
    m, threshold = 32, 0.3
    items = random_sketches(random.Random(4), 100, m)
    df = spark.createDataFrame(items, "ord bigint, part int, sketch array<bigint>")
    a, b = df.where("ord % 3 = 0").select("ord"), df.where("ord % 3 < 2 and ord > 20").select("ord")
    got = sorted(r[0] for r in covered(a, b, df, m, threshold, Workspace(spark), 4).collect())
    sk = {o: s for o, _, s in items}
    close = lambda x, y: 1.0 - sum(p == q for p, q in zip(sk[x], sk[y])) / m < threshold
    bs = [o for o in sk if o % 3 < 2 and o > 20]
    assert got == [o for o in sk if o % 3 == 0 and any(close(o, y) for y in bs)]
    assert min_covering_slots(4, 0.5) == 3 and min_equal_slots(4, 0.5) == 3 and min_equal_slots(4, 0.0) == 5
