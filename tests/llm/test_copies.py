import hashlib
import re

import numpy as np
import pytest
import xxhash

from seqthin.llm import bwt_merge, simhash, winnow
from seqthin.workspace import Workspace
from tests.llm import tables
from tests.llm.test_scores import low, words


def fingerprint(text, k=4):
    w = words(low(text))
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def reachable(fps, radius=4):
    f = np.array(fps, np.uint64)
    group = np.arange(len(f))
    while True:
        new = np.array([group[np.bitwise_count(f ^ x) <= radius].min() for x in f])
        new = new[new]
        if (new == group).all():
            return group
        group = new


@pytest.mark.parametrize("part_rows", [3, 20_000])
def test_simhash_components(spark, part_rows):
    rows = tables.rows()
    fps = [fingerprint(r[1]) for r in rows]
    group = reachable(fps)
    least = {g: min(r[0] for r, x in zip(rows, group) if x == g) for g in set(group)}
    want = {(r[0], f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, group)}
    assert set(map(tuple, simhash.components(tables.documents(spark), part_rows=part_rows).collect())) == want
    kept = simhash.drop_near_copies(tables.documents(spark))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_links_of_close_fingerprints(spark):
    """A chain whose ends are far apart, and a crowd that all link."""
    rng = np.random.default_rng(3)
    seed = int(rng.integers(1 << 62))
    chain = [seed]
    for i in range(40):
        chain.append(chain[-1] ^ int(sum(1 << int(b) for b in rng.choice(63, 3, replace=False))))
    crowd = [0x5555 ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (300, 2))]
    fps = sorted({x & ((1 << 63) - 1) for x in chain + crowd})
    group = reachable(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    for part_rows in (50, 20_000):
        ws = Workspace(spark)
        got = {r.node: r.root for r in simhash.spread(simhash.links(df, ws, part_rows=part_rows), ws).collect()}
        assert [got.get(x, x) for x in fps] == [fps[g] for g in group]


def test_tiles_skip_nothing():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = base[rng.integers(0, 60, 3000)] ^ (np.uint64(1) << rng.integers(0, 63, 3000).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    a, b = simhash.tile_links(fps, None, 4)
    assert (np.bitwise_count(a ^ b) <= 4).all() and len(a) < len(fps)
    parent = {int(x): int(x) for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        parent[max(root(x), root(y))] = min(root(x), root(y))
    assert [root(int(x)) for x in fps] == [int(fps[g]) for g in reachable(fps)]


def test_simhash_odd_rows(spark):
    docs, rows = tables.odd_documents(spark)
    got = simhash.components(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(r[0]), f"{fingerprint(r[1]):016x}") for r in rows)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert sum(i is None for i, _ in left) == 3
    named = [x for x in left if x[0] is not None]
    assert len(named) == len(set(named)) and len({fingerprint(t) for _, t in named}) == len(named)
    assert simhash.components(tables.empty(spark)).count() == 0
    assert simhash.drop_near_copies(tables.empty(spark)).count() == 0


def brute_repeats(rows, n=50):
    out = {}
    seen, now, at = set(), set(), None
    for i, t in sorted((r[0], r[1] or "") for r in rows):
        if i != at:
            seen |= now
            now, at = set(), i
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - n + 1):
            if b[s : s + n] in seen:
                gone[s : s + n] = True
            now.add(b[s : s + n])
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out.setdefault(i, []).append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("gram", [16, 24, 50])
def test_repeats(spark, gram):
    want = brute_repeats(tables.rows())
    got = bwt_merge.repeats(tables.documents(spark).repartition(4), gram=gram).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: v[0][:4] for i, v in want.items()}
    assert sum(r.n_removed for r in got) > 1000


def test_repeats_odd_rows(spark):
    docs, rows = tables.odd_documents(spark)
    want = brute_repeats([r for r in rows if r[0] is not None])
    flat = sorted((i, *v[:4]) for i, vs in want.items() for v in vs)
    got = bwt_merge.repeats(docs).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == flat
    assert sorted(r.n_removed for r in got if r.doc_id is None) == [0, 0, 0]
    kept = bwt_merge.without_repeats(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    texts = sorted((r.doc_id, r.text or "") for r in kept.collect() if r.doc_id is not None)
    assert texts == sorted((i, v[4].decode("utf-8", "ignore")) for i, vs in want.items() for v in vs)
    assert bwt_merge.repeats(tables.empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_merged_transforms_are_intervals(seed):
    """Blocks after k rounds are the sets of equal k-byte strings, over any split into shards."""
    rng = np.random.default_rng(seed)
    width, k = 24, 7
    rows = rng.integers(1, 3 + seed, (40, width)).astype(np.uint8)
    rows[rng.integers(0, 40, 60), rng.integers(18, width, 60)] = 0
    rows[:, -1] = 0
    rows[:5, :4] = 0
    cuts = np.sort(rng.integers(0, 41, 3))
    shards = [bwt_merge.transform(s) for s in np.split(rows, cuts) if len(s)]
    block, row, place = bwt_merge.merge(shards, width, k)
    got = {}
    for b, r, p in zip(block, row, place):
        got.setdefault(b, set()).add((r, p))
    want = {}
    for r in range(40):
        for p in range(width - k + 1):
            s = rows[r, p : p + k]
            if (s > 0).all():
                want.setdefault(s.tobytes(), set()).add((r, p))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


BENCH = "item_id bigint, text string, rk bigint, words string"


def brute_hits(rows, items, window=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    runs = {}
    for i, t in items:
        w = cut(t)
        m = min(len(w), window)
        for s in range(len(w) - m + 1) if m else ():
            runs.setdefault(tuple(w[s : s + m]), set()).add(i)
    out = []
    for r in rows:
        w, hit, found = cut(r[1]), set(), set()
        for m in {len(x) for x in runs}:
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in runs:
                    hit |= set(range(s, s + m))
                    found |= runs[tuple(w[s : s + m])]
        names = ",".join(sorted(str(i) for i in found))
        out.append((str(r[0]), len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def bench(spark, rows, short=True):
    texts = [t for _, t, *_ in rows if t and len(t) > 300][:6]
    items = [(i, " ".join(t.split()[3 : 3 + n])) for i, (t, n) in enumerate(zip(texts, (13, 14, 40, 20, 30, 13)))]
    items += [(10, None), (11, "  ,"), (12, items[1][1].upper()), (2, "another text of the same item " * 3)]
    items += [(20, "same line"), (21, "ab"), (9, items[2][1])] if short else []
    return items, spark.createDataFrame([(*x, None, None) for x in items], BENCH)


@pytest.mark.parametrize("short", [True, False])
@pytest.mark.parametrize("odd", [True, False])
def test_contamination(spark, short, odd):
    docs, rows = tables.odd_documents(spark) if odd else (tables.documents(spark), tables.rows())
    items, benchmark = bench(spark, tables.rows(), short)
    want = brute_hits(rows, items)
    got = winnow.contamination(docs, benchmark).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:6]) for r in got) == want
    kept = winnow.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(x[0] for x in want if not x[5])


def test_contamination_of_nothing(spark):
    items, benchmark = bench(spark, tables.rows())
    assert winnow.contamination(tables.empty(spark), benchmark).count() == 0
    got = winnow.contamination(tables.documents(spark), tables.empty(spark, BENCH)).collect()
    assert len(got) == len(tables.rows()) and not any(r.n_hit or r.contaminated for r in got)


def test_no_python_on_the_native_paths(spark):
    from seqthin.llm import hash_tree

    _, benchmark = bench(spark, tables.rows())
    tree = hash_tree.regular_tree(2, 2, 2)
    for df in (winnow.contamination(tables.documents(spark), benchmark), hash_tree.hash_tree_shards(tables.documents(spark), tree, tree)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
