"""Runs of k-mers and array sketches against exploded k-mers."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqthin.config import ReduceConfig
from seqthin.functions import kernels
from seqthin.operators import kmers as K
from seqthin.operators import sketch, superkmers
from tests import sequential

SCHEMA = "shard int, ord bigint, seq string"


def sequences(seed, n=40, size=160):
    rng = random.Random(seed)
    base = "".join(rng.choice("ACGT") for _ in range(size))
    out = []
    for i in range(n):
        seq = "".join(c if rng.random() > 0.03 else rng.choice("ACGTN") for c in base[: rng.randrange(size)])
        flip = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
        out.append((i % 2, i + 1, flip if i % 3 == 0 else seq))
    out += [(0, 100, "A" * 90), (1, 101, "AC" * 60), (0, 102, ""), (1, 103, None), (1, 104, base + base), (0, 105, out[5][2])]
    rng.shuffle(out)
    return out


def held(rows, k, cap=None):
    return {(s, o): sequential.kmers(q or "", k, cap) for s, o, q in rows}


def check(spark, rows, k, cap, targets):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    cfg = ReduceConfig(k=k, kmer_cap=cap, shards=2, frequency="exact")
    words = held(rows, k, cap)
    first, df_of = {}, Counter()
    for (s, o), own in sorted(words.items()):
        for w in own:
            first.setdefault((s, w), o)
            df_of[s, w] += 1
    code = lambda x: x & 0xFFFFFFFFFFFFFFFF
    got = superkmers.first_holders_of_kmers(df, cfg, targets).collect()
    assert len(got) == len(first) and {(r.shard, code(r.cell)): r.ord for r in got} == first
    got = superkmers.first_holder_counts(df, cfg, targets).collect()
    assert {(r.shard, r.ord): r.n for r in got} == Counter((s, o) for (s, _), o in first.items())
    got = superkmers.frequencies(df, cfg, targets).collect()
    assert len(got) == len(df_of) and {(r.shard, code(r.kmer)): r.df for r in got} == df_of
    got = superkmers.distinct_counts(df, cfg, targets).collect()
    assert {r.shard: r.n for r in got} == Counter(s for s, _ in first)


@pytest.mark.parametrize("k, cap, targets", [(1, None, 3), (5, None, 8), (15, None, 64), (15, 20, 64), (31, None, 5000), (32, None, 2)])
def test_same_as_single_kmers(spark, k, cap, targets):
    check(spark, sequences(k), k, cap, targets)


def test_long_records_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(kernels, "BASES_PER_BLOCK", 50)
    monkeypatch.setattr(superkmers, "MERGE_SIZE", 100)
    check(spark, sequences(7), 9, None, 4)


def test_nothing_comes_from_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    cfg = ReduceConfig(frequency="exact")
    assert superkmers.first_holder_counts(df, cfg, 64).collect() == []
    assert superkmers.distinct_counts(df, cfg, 64).collect() == []


def test_runs_are_a_third_of_single_rows(spark):
    rng = random.Random(3)
    rows = [(0, i, "".join(rng.choice("ACGT") for _ in range(20_000))) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    cfg = ReduceConfig(k=15, frequency="exact")
    runs = superkmers.send_runs(df, cfg, 64)
    sent = runs.select(F.sum(F.octet_length("sizes") + F.octet_length("ords") + F.octet_length("bases") + 32)).first()[0]
    single = K.explode_kmers(df, cfg, ["shard", "ord"]).count()
    assert sent * 3 < single * 16


@pytest.mark.parametrize("slice_bits", [4, 16])
def test_array_sketches(spark, monkeypatch, slice_bits):
    monkeypatch.setattr(sketch, "SLICE_BITS", slice_bits)
    rows = sequences(11)
    cfg = ReduceConfig(k=11, shards=2, cms_log2_width=9)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    first, count, words = {}, Counter(), held(rows, 11)
    cells_of = lambda w: [(r << 9) | (sequential.mix(w, seed) & 511) for r, seed in enumerate(kernels.CMS_SEEDS)]
    for (s, o), own in sorted(words.items()):
        for w in own:
            for c in cells_of(w):
                first.setdefault((s, c), o)
                count[s, c] += 1
    assert {(r.shard, r.cell): r.ord for r in sketch.first_touches(df, cfg).collect()} == first
    assert {(r.shard, r.cell): r.n for r in sketch.counters(df, cfg).collect()} == count
    unseen = {(r.shard, r.ord): r.n_singleton for r in sketch.unseen_kmers(df, sketch.touch_slices(df, cfg), cfg).collect()}
    assert unseen == {(s, o): sum(any(first[s, c] == o for c in cells_of(w)) for w in own) for (s, o), own in words.items()}
    some = spark.createDataFrame([(s, w) for (s, _), own in words.items() for w in own[:5]] + [(7, 5)], "shard int, kmer bigint").distinct()
    for r in sketch.estimates(some, sketch.count_slices(df, cfg), cfg).collect():
        assert r.estimate == min(count[r.shard, c] for c in cells_of(r.kmer))
    # Rows grow with tasks and slices, not with k-mers.
    slices = -(-(4 << 9) // (1 << slice_bits))
    assert sketch._built(df, cfg, counts=False).count() <= 3 * 2 * slices * len(rows) and sketch.touch_slices(df, cfg).count() <= 2 * slices


def test_one_row_a_slice_and_task(spark):
    rows = [(0, o, q) for _, o, q in sequences(12, 200)]
    cfg = ReduceConfig(k=11, cms_log2_width=14)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert sketch._built(df, cfg, counts=True).count() == 1


def test_workers_need_no_copy_of_the_package(tmp_path):
    """The driver finds the package, Python workers don't."""
    import os
    import subprocess
    import sys

    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from seqthin.config import ReduceConfig
from seqthin.plans.reduce import Reducer
rows = [(i, f"h{{i}}", "ACGTTGCAACGGT" * (9 + i)) for i in range(12)]
for frequency in ("exact", "countmin"):
    cfg = ReduceConfig(k=7, min_len=1, warmup=2, frequency=frequency, cms_log2_width=8)
    Reducer(spark, cfg).admission_only(spark.createDataFrame(rows, "ord bigint, header string, seq string")).collect()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]


@pytest.mark.parametrize("merge", [1 << 21, 40])
def test_rare_kmers_from_runs(spark, monkeypatch, merge):
    """Rows of runs overlap in record numbers, and a target is counted in several goes."""
    monkeypatch.setattr(superkmers, "MERGE_SIZE", merge)
    monkeypatch.setattr(kernels, "BASES_PER_BLOCK", 400)
    rows = [(s, o, q * 4 if q and o % 9 == 0 else q) for s, o, q in sequences(3, 60)]
    cfg = ReduceConfig(k=7, shards=2, frequency="exact")
    verdicts = [(s, o, "REJECT" if o % 5 == 0 else "ADMIT", o // 11) for s, o, q in rows if q and sequential.kmers(q, 7)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    judged = spark.createDataFrame(verdicts, "shard int, ord bigint, decision string, cutoff bigint")
    got = superkmers.rare_kmers_of(superkmers.runs_of(df, cfg, 5), judged, cfg).collect()
    before, want, words = Counter(), {}, held(rows, 7)
    for s, o, decision, cutoff in sorted(verdicts):
        want[s, o] = sum(before[s, w] <= cutoff for w in words[s, o])
        before.update((s, w) for w in words[s, o] if decision == "ADMIT")
    assert {(r.shard, r.ord): r.n_rare for r in got} == want and len(got) == len(want)
    # Record numbers that repeat, and cutoffs that fall, are left to the caller.
    runs = superkmers.runs_of(df, cfg, 5)
    assert superkmers.rare_kmers_of(runs, judged.unionByName(judged.limit(1)), cfg) is None
    assert superkmers.rare_kmers_of(runs, judged.withColumn("cutoff", -F.col("ord")), cfg) is None


def test_rare_kmer_counts_sends_no_single_kmers(spark, tmp_path, monkeypatch):
    """The query reads admission's runs; only where record numbers repeat are k-mers rows."""
    from workload import queries

    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(400)), "en") for i in range(30)]
    for name, some in (("once", rows), ("twice", rows + rows[3:6])):
        spark.createDataFrame(some, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    single = lambda at: K.rare_kmers(queries.kmers(spark, at), queries.gated(spark, at).decisions())
    want = sorted((r.ord, r.n_rare) for r in single(f"{tmp_path}/once").collect())
    twice = sorted((r.ord, r.n_rare) for r in single(f"{tmp_path}/twice").collect())
    assert twice == sorted((r.ord, r.n_rare) for r in queries.rare_kmer_counts(spark, f"{tmp_path}/twice").collect())
    monkeypatch.setattr(K, "explode_kmers", None)
    got = queries.rare_kmer_counts(spark, f"{tmp_path}/once").collect()
    assert sorted((r.ord, r.n_rare) for r in got) == want and len(want) == 30
