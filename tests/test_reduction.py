"""Whole runs against record-by-record answers."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from seqthin.config import ReduceConfig
from seqthin.functions import kernels
from seqthin.plans.reduce import Reducer, decisions
from tests import sequential

SCHEMA = "ord bigint, header string, seq string"


def by_hand(records, cfg, shard_of):
    """(verdicts, kept within shards, kept overall) record by record."""
    salts = [int(s) for s in kernels.sketch_salts(cfg.sketch, cfg.salts)]
    verdicts, local, merged = {}, [], []
    for shard in sorted(set(shard_of.values())):
        mine = [r for r in records if shard_of[r[0]] == shard]
        verdicts.update(sequential.admit([(o, s) for o, _, s in mine], cfg))
        items = []
        for o, h, s in mine:
            if verdicts[o][0] == "ADMIT":
                month = h.split("|")[1] if cfg.by_month else ""
                items.append((o, month, sequential.sketch(sequential.kmers(s, cfg.k, cfg.kmer_cap), salts)))
        kept = set(sequential.keep(items, cfg.sketch, cfg.bands, cfg.threshold))
        local += sorted(kept)
        merged += [i for i in items if i[0] in kept]
    if len(set(shard_of.values())) == 1:
        return verdicts, local, local
    return verdicts, local, sequential.keep(merged, cfg.sketch, cfg.bands, cfg.threshold)


CASES = [
    dict(frequency="exact", outlier_sd=1.0, kmer_cap=50),
    dict(frequency="exact", outlier_sd=1.0, shards=3, k=7),
    dict(frequency="countmin", cms_log2_width=9, outlier_sd=1.0),
    dict(frequency="countmin", cms_log2_width=10, outlier_sd=1.5, shards=2, by_month=False),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_matches_record_by_record(spark, case):
    rows_per_chunk = 20 if case % 2 else 10_000
    cfg = ReduceConfig(**{
        **dict(k=5, min_len=20, max_n_frac=0.3, warmup=10, sketch=32, threshold=0.25), **CASES[case]
    })
    records = sequential.random_records(random.Random(case), 120)
    reducer = Reducer(spark, cfg, key_limit=4, rows_per_chunk=rows_per_chunk)
    out = reducer.run(spark.createDataFrame(records, SCHEMA).repartition(3))
    shard_of = {r["ord"]: r["shard"] for r in out.profile.select("ord", "shard").collect()}
    verdicts, local, overall = by_hand(records, cfg, shard_of)
    rows = out.decisions().collect()
    assert {r["ord"]: (r["decision"], r["n_singleton"]) for r in rows} == verdicts
    assert sum(r["decision"] == "REJECT" for r in rows) > 0
    assert sorted(r[0] for r in out.shard_kept.collect()) == sorted(local)
    assert sorted(r[0] for r in out.kept.collect()) == sorted(overall)
    tally = out.report().first()
    assert tally["seen"] == 120 and tally["promoted"] == len(overall)
    assert tally["admit"] == sum(v[0] == "ADMIT" for v in verdicts.values())


@pytest.mark.parametrize("frequency", ["countmin", "exact"])
def test_strain_collection(spark, frequency):
    """Foreign sequences late in a collection of strains are rejected; the checker tells which."""
    cfg = ReduceConfig(min_len=200, max_n_frac=0.5, warmup=150, frequency=frequency)
    records = sequential.strain_collection()
    out = Reducer(spark, cfg, key_limit=16).run(spark.createDataFrame(records, SCHEMA))
    verdicts, _, overall = by_hand(records, cfg, {r[0]: 0 for r in records})
    rows = out.decisions().collect()
    assert {r["ord"]: (r["decision"], r["n_singleton"]) for r in rows} == verdicts
    assert 0 < sum(v[0] == "REJECT" for v in verdicts.values()) <= 24
    assert sorted(r[0] for r in out.kept.collect()) == sorted(overall)


def test_limit_counts_per_shard(spark):
    records = spark.createDataFrame(sequential.strain_collection(4, 15), SCHEMA)
    cfg = ReduceConfig(min_len=200, warmup=200, limit=10, shards=3)
    seen = Reducer(spark, cfg).run(records).profile.groupBy("shard").count().collect()
    assert sorted(r["count"] for r in seen) == [10, 10, 10]


def test_one_reject_disputes_its_own_cells_only(spark):
    """Relatives of a rejected record stay out of the table the rounds run on."""
    records = sequential.strain_collection(8, 50)
    rng = random.Random(4)
    foreign = "".join(rng.choice("ACGT") for _ in range(160))
    spliced = records[-1][2][:320] + foreign
    records = [r for r in records if "/30|" not in r[1] and "/41|" not in r[1]]
    records = [(i + 1, h, s) for i, (_, h, s) in enumerate(records)] + [(len(records) + 1, "spliced|none|x", spliced)]
    cfg = ReduceConfig(min_len=200, max_n_frac=0.5, warmup=100, frequency="exact", outlier_sd=2.0)
    df = spark.createDataFrame(records, SCHEMA)
    reducer = Reducer(spark, cfg)
    out = reducer.gated_admission(df)
    verdicts = sequential.admit([(o, s) for o, _, s in records], cfg)
    assert {r["ord"]: (r["decision"], r["n_singleton"]) for r in out.decisions().collect()} == verdicts
    rejected = [o for o, v in verdicts.items() if v[0] == "REJECT"]
    assert rejected == [len(records)]
    covers = glob.glob(f"{reducer.ws.path}/*-cover")
    assert covers and all(spark.read.parquet(c).count() == 1 for c in covers)
    assert sum(spark.read.parquet(c).count() for c in glob.glob(f"{reducer.ws.path}/*-disputed")) <= 160
    out.release()
    assert not glob.glob(reducer.ws.path)


def test_rare_kmers_by_hand(spark):
    from seqthin.operators import kmers as K
    from seqthin.operators.gate import with_quality

    cfg = ReduceConfig(k=5, min_len=20, max_n_frac=0.3, warmup=10, outlier_sd=1.0, frequency="exact")
    records = sequential.random_records(random.Random(31), 80)
    reducer = Reducer(spark, cfg)
    df = spark.createDataFrame(records, SCHEMA).withColumn("shard", F.lit(0))
    cut = F.floor(F.col("ord") / 9).cast("bigint")
    verdicts = sequential.admit([(o, s) for o, _, s in records], cfg)
    judged = spark.createDataFrame([(0, o, v[0]) for o, v in verdicts.items()], "shard int, ord bigint, decision string")
    words = K.explode_kmers(with_quality(df, cfg), cfg, ["shard", "ord"])
    got = {r["ord"]: r["n_rare"] for r in K.rare_kmers(words, judged.withColumn("cutoff", cut), 7).collect()}
    held, want = {}, {}
    for o, _, s in records:
        if verdicts[o][0] in ("ADMIT", "REJECT"):
            mine = sequential.kmers(s, cfg.k)
            want[o] = sum(held.get(w, 0) <= o // 9 for w in mine)
            if verdicts[o][0] == "ADMIT":
                for w in mine:
                    held[w] = held.get(w, 0) + 1
    assert got == want


def test_a_chain_of_relatives_takes_few_passes(spark):
    """Near copies of a rejected record are rejected one after the other, without a pass over the sequences for each."""
    records = [(h, s) for _, h, s in sequential.strain_collection(6, 40)]
    rng = random.Random(9)
    foreign = [rng.choice("ACGT") for _ in range(700)]
    for i in range(8):
        near = list(foreign)
        for at in rng.sample(range(700), 3 * min(i, 1)):
            near[at] = rng.choice("ACGT")
        records.append((f"near{i}|none|x", "".join(near)))
        records += records[i * 7 : i * 7 + 5]
    records = [(i + 1, h, s) for i, (h, s) in enumerate(records)]
    cfg = ReduceConfig(min_len=200, max_n_frac=0.5, warmup=100, frequency="exact", outlier_sd=2.0)
    reducer = Reducer(spark, cfg)
    out = reducer.gated_admission(spark.createDataFrame(records, SCHEMA))
    verdicts = sequential.admit([(o, s) for o, _, s in records], cfg)
    assert {r["ord"]: (r["decision"], r["n_singleton"]) for r in out.decisions().collect()} == verdicts
    assert sum(verdicts[o][0] == "REJECT" for o, h, _ in records if h.startswith("near")) == 8
    assert len(glob.glob(f"{reducer.ws.path}/*-disputed")) <= 2
