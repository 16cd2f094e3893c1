"""Codes against plain k-means in whole numbers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from seqthin.llm import codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, salt int, ints int"


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    x = np.array([r[1] for r in kept], object)
    q = x.shape[1] // parts
    books, picks = [], []
    for p in range(parts):
        mine = x[:, p * q : (p + 1) * q]
        book = [list(v) for v in mine[:entries]]

        def nearest():
            out = []
            for v in mine:
                d = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in book]
                out.append((d.index(min(d)), min(d)))
            return out

        for _ in range(rounds):
            chosen = nearest()
            for k in range(len(book)):
                own = [v for v, (c, _) in zip(mine, chosen) if c == k]
                if own:
                    book[k] = [sum(col) // len(own) for col in zip(*own)]
        books.append(book)
        picks.append(nearest())
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    error = [sum(picks[p][i][1] for p in range(parts)) for i in range(len(kept))]
    by_label = Counter()
    for (_, _, label), e in zip(kept, error):
        by_label[label] += e
    return sorted(
        ((i, "".join(f"{picks[p][j][0]:02x}" for p in range(parts)), error[j], by_label[label], digest) for j, (i, _, label) in enumerate(kept)),
        key=repr,
    )


def made(seed, n, dim=8, spread=1.0):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, spread) for _ in range(dim)] for _ in range(12)]
    rows = [(i, [m + rng.gauss(0, 0.1) for m in rng.choice(middles)], rng.choice([0, 1, None])) for i in range(n)]
    # Ties: many equal vectors, and vectors on a coarse grid.
    rows += [(n + i, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(dim)], 7) for i in range(n // 3)]
    rows += [(2 * n + i, list(rows[0][1]), 0) for i in range(n // 3)]
    rng.shuffle(rows)
    return rows


def got(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("n, entries, rounds, closest", [(60, 16, 4, 4), (200, 40, 5, 2), (30, 256, 4, 16), (90, 24, 6, 24)])
def test_same_as_plain_rounds(spark, n, entries, rounds, closest):
    rows = made(n, n)
    assert got(codes.compress(table(spark, rows), entries=entries, rounds=rounds, closest=closest)) == brute(rows, entries=entries, rounds=rounds)


def test_odd_rows(spark):
    rows = made(3, 30)
    rows += [(None, [0.25] * 8, None), (None, [0.25] * 8, 1), (rows[0][0], [0.1] * 8, 2), rows[1], rows[1]]
    rows += [(-9, None, 1), (-8, [None] * 8, 1), (-7, [float("nan")] * 8, 1), (-6, [float("inf")] + [0.0] * 7, 1), (-5, [], 1), (400, [0.5] * 4, 1)]
    rows += [(401, [300.5, -4000.25] + [0.0] * 6, 3)]
    assert got(codes.compress(table(spark, rows), entries=8)) == brute(rows, entries=8)
    assert codes.compress(table(spark, [])).collect() == []
    with pytest.raises(ValueError):
        codes.compress(table(spark, [(1, [1.0] * 6, 0)])).collect()
    with pytest.raises(Exception, match="too large"):
        codes.compress(table(spark, [(1, [1e20] * 8, 0)])).collect()


def test_lists_follow_moved_entries():
    """Whatever way entries go and lists grow or shrink, bounds hold and the nearest entry is found."""
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (500, 4))
    entries = rng.integers(-300, 300, (30, 4))
    near, low, own = codes.search_all(x, entries, 6)
    skipped = 0
    for step, b in enumerate([6, 6, 3, 9, 9, 30, 12, 4]):
        moved = entries + rng.integers(-9 - step, 10 + step, entries.shape)
        went = np.sqrt(((moved - entries) ** 2).sum(1))
        entries = moved
        near, low, own, looked, everything = codes.move(x, near, low, entries, went, b)
        skipped += ((looked == 0) & ~everything).sum()
        d = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (near[:, 0] == d.argmin(1)).all() and (own == d.min(1)).all() and near.shape == (500, b)
        true = np.sqrt(d)
        named = np.zeros((500, 31), bool)
        np.put_along_axis(named, np.where(near < 0, 30, near), True, axis=1)
        outside = np.where(named[:, :30], np.inf, true).min(1)
        assert (low[:, 0] <= outside + 1e-6).all()
        listed = near[:, 1:] >= 0
        held = np.take_along_axis(true, np.where(listed, near[:, 1:], 0), axis=1)
        assert (low[:, 1:][listed] <= held[listed] + 1e-6).all()
        assert (np.diff(low[:, 1:], axis=1)[np.isfinite(low[:, 2:])] >= 0).all()
    assert skipped > 300


def test_large_whole_numbers_are_exact():
    rng = np.random.default_rng(1)
    x, entries = rng.integers(-(1 << 27), 1 << 27, (20, 4)), rng.integers(-(1 << 27), 1 << 27, (5, 4))
    assert codes.distances(x, entries).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, e)) for e in entries] for v in x]
