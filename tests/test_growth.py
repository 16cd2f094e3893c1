"""Steps whose work must grow no faster than their input."""

import random
from collections import Counter

import numpy as np

from seqthin.config import ReduceConfig
from seqthin.operators import admission, clusters, signatures, superkmers
from seqthin.operators.signatures import Scheme
from seqthin.plans.reduce import Reducer
from seqthin.workspace import Workspace
from tests import sequential


def test_relatives_come_after_what_is_rejected(spark):
    """Earlier records gain nothing, so they stay out of the table the rounds run on."""
    rows = [(0, 1, [1, 2, 3, 4]), (0, 2, [1, 2, 3, 4]), (0, 3, [1, 2, 9, 9]), (0, 4, [7, 7, 8, 8])]
    profile = spark.createDataFrame(rows, "shard int, ord bigint, sketch array<bigint>")
    some = spark.createDataFrame([(0, 2)], "shard int, ord bigint")
    assert sorted(r["ord"] for r in admission._relatives(profile, some, 4).collect()) == [2, 3]


def test_right_side_is_replicated_for_met_keys_only(spark):
    left = spark.createDataFrame([(1, 5), (1, 21), (2, 6)], "key bigint, ord bigint")
    right = spark.createDataFrame([(1, 3), (2, 6), *[(k, k) for k in range(100, 1000)]], "key bigint, ord bigint")
    met = signatures.pairs_between(left, right)
    assert sorted((r["i"], r["j"]) for r in met.collect()) == [(3, 5), (3, 21)]
    assert "explode" not in met._jdf.queryExecution().optimizedPlan().toString().lower()


def test_kept_classes_look_for_no_neighbour(spark, monkeypatch):
    seen = []
    pairs = clusters.pairs_between

    def noted(left, right):
        seen.append({r["ord"] for r in left.select("ord").collect()})
        return pairs(left, right)

    monkeypatch.setattr(clusters, "pairs_between", noted)
    rows = [(1, [1, 2, 3, 4]), (2, [1, 2, 3, 9]), (3, [1, 2, 3, 4]), (4, [5, 6, 7, 8]), (5, [1, 2, 3, 9])]
    records = spark.createDataFrame(rows, "ord bigint, sketch array<bigint>")
    kept = spark.createDataFrame([(1,), (4,)], "ord bigint")
    near = clusters.nearest_kept(records, kept, Scheme.of(4, 4, 3), [], Workspace(spark))
    assert sorted(tuple(r) for r in near.collect()) == [(2, 1, 3), (3, 1, 4), (5, 1, 3)]
    assert seen == [{2}]
    seen.clear()
    a, b = (spark.createDataFrame([(o,) for o in some], "ord bigint") for some in ((1, 2), (1, 4)))
    close = clusters.covered(a, b, records.where("ord IN (1, 2, 4)"), 4, 0.5, Workspace(spark))
    assert sorted(r["ord"] for r in close.collect()) == [1, 2]
    assert seen == [{2}]


def test_ranked_minimizers_and_joint_sorts_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    bases = rng.integers(0, 4, 5000).astype(np.uint8)
    bases[rng.integers(0, 5000, 60)] = 4
    record = np.sort(rng.integers(0, 30, 5000))
    for k, m in ((15, 7), (15, 10), (5, 5), (32, 8)):
        plain = superkmers.run_starts(bases, record, k, m)
        ranked = superkmers.run_starts(bases, record, k, m, None, superkmers.minimizer_ranks(m))
        assert all(np.array_equal(x, y) for x, y in zip(plain, ranked))
    assert superkmers.minimizer_ranks(superkmers.LONGEST_RANKED + 1) is None
    kmer, ord_ = rng.integers(0, 1 << 30, 4000).astype(np.uint64) % np.uint64(500), rng.integers(0, 1 << 31, 4000) % 90
    joint = [superkmers._pairs(kmer, ord_)] + [superkmers._grouped(kmer, ord_, how) for how in (np.minimum, np.add)]
    monkeypatch.setattr(superkmers, "_narrow", lambda *a: False)
    plain = [superkmers._pairs(kmer, ord_)] + [superkmers._grouped(kmer, ord_, how) for how in (np.minimum, np.add)]
    assert all(np.array_equal(x, y) for a, b in zip(joint, plain) for x, y in zip(a, b))


def test_joint_sort_is_left_for_wide_numbers():
    kmer, ord_ = np.array([3, 3, 1], np.uint64), np.array([1 << 40, 5, -2])
    assert [x.tolist() for x in superkmers._pairs(kmer, ord_)] == [[1, 3, 3], [-2, 5, 1 << 40]]
    assert not superkmers._narrow(np.array([1 << 40], np.uint64), np.array([1]))


def test_sequences_are_cut_into_runs_once(spark, monkeypatch):
    """All passes of admission, and what asks for admitted k-mers after it, read the runs the first one wrote."""
    records = [(h, s) for _, h, s in sequential.strain_collection(6, 25)]
    rng = random.Random(9)
    foreign = "".join(rng.choice("ACGT") for _ in range(700))
    for i in range(4):
        records.append((f"near{i}|none|x", foreign[: 700 - 90 * i]))
        records += records[i * 7 : i * 7 + 5]
    records = [(i + 1, h, s) for i, (h, s) in enumerate(records)]
    cfg = ReduceConfig(min_len=200, max_n_frac=0.5, warmup=100, frequency="exact", outlier_sd=2.0)
    calls, sequences = [], superkmers._sequences
    monkeypatch.setattr(superkmers, "_sequences", lambda *a: calls.append(1) or sequences(*a))
    out = Reducer(spark, cfg).gated_admission(spark.createDataFrame(records, "ord bigint, header string, seq string"))
    done = out.admission
    rejected = {r["ord"] for r in done.rejects.collect()}
    assert rejected and done.rounds > 1
    held = Counter(w for o, _, s in records if o not in rejected for w in sequential.kmers(s, cfg.k))
    got = superkmers.frequencies_of(done.runs, cfg, done.rejects).collect()
    assert len(got) == len(held) and {r["kmer"]: r["df"] for r in got} == held
    assert [r["n"] for r in superkmers.distinct_counts_of(done.runs, cfg, done.rejects).collect()] == [len(held)]
    assert superkmers.distinct_counts_of(done.runs, cfg, out.profile.select("shard", "ord")).collect() == []
    assert len(calls) == 1
    out.release()


def test_runs_come_by_shard_target_and_record(spark):
    """Whether records lie in order or not."""
    rng = random.Random(2)
    rows = [(i // 9, i, "".join(rng.choice("ACGT") for _ in range(300))) for i in range(30)]
    cfg = ReduceConfig(k=9, shards=4, frequency="exact")
    for some in (rows, rng.sample(rows, len(rows))):
        df = spark.createDataFrame(some, "shard int, ord bigint, seq string").coalesce(1)
        for targets in (5, 30_000):
            for r in superkmers.runs_of(df, cfg, targets).collect():
                ords = np.frombuffer(r["ords"], np.int64)
                assert r["first"] == ords[0] and (np.diff(ords) >= 0).all() and (ords // 9 == r["shard"]).all()
