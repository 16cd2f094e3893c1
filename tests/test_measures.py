"""Sampled divergences, distinct-count sketches, and what runs observe about themselves."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from seqthin.config import ReduceConfig
from seqthin.operators import distinct
from seqthin.plans.calibration import divergence, divergence_sketches, random_pairs, suggest
from seqthin.plans.reduce import Reducer
from seqthin.streaming.incremental import IncrementalReducer
from tests import sequential

CFG = ReduceConfig(k=11, sketch=16)


def test_the_median_of_sampled_pairs_is_that_of_all(spark):
    rng = random.Random(8)
    base = [[rng.randrange(3) for _ in range(16)] for _ in range(6)]
    rows = [(i, [x if rng.random() < 0.7 else rng.randrange(99) for x in rng.choice(base)]) for i in range(600)]
    held = np.array([r[1] for r in rows])
    equal = np.concatenate([(held[i + 1 :] == held[i]).sum(1) for i in range(len(held))])
    x = equal / 16
    with np.errstate(divide="ignore"):
        d = np.sort(np.where(equal == 0, 1.0, np.minimum(1, -np.log(2 * x / (1 + x)) / 11)))
    pairs = random_pairs(spark.createDataFrame(rows, "ord bigint, sketch array<bigint>"), 250)
    got = suggest(pairs, CFG).first()
    assert got.pairs == 250 and math.isclose(got.rank_bound, math.sqrt(math.log(200) / 500))
    below = lambda v: np.searchsorted(d, v, "left") / len(d)
    upto = lambda v: np.searchsorted(d, v, "right") / len(d)
    assert below(got.median_divergence - 1e-9) <= 0.5 + got.rank_bound and upto(got.median_divergence + 1e-9) >= 0.5 - got.rank_bound
    members = [i for r in pairs.collect() for i in (r.i, r.j)]
    assert len(set(members)) == 500
    # Sketches of parts, merged, answer for all.
    parts = divergence_sketches(pairs.withColumn("part", F.col("i") % 3), CFG, ["part"])
    merged = parts.agg(F.kll_merge_agg_double("sketch").alias("s")).select(F.kll_sketch_get_quantile_double("s", F.lit(0.5))).first()[0]
    own = np.sort([r[0] for r in pairs.select(divergence(CFG)).collect()])
    assert abs(np.searchsorted(own, merged, "left") / 250 - 0.5) < 0.1 or own[125] == merged


def test_pairs_of_few_records(spark):
    one = spark.createDataFrame([(1, [1] * 16)], "ord bigint, sketch array<bigint>")
    assert random_pairs(one).collect() == [] and suggest(random_pairs(one), CFG).first().pairs == 0


def sequences(seed, n):
    rng = random.Random(seed)
    return [(i + 1, f"h{i}|2021-0{i % 3 + 1}", "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 120)))) for i in range(n)]


def test_sketches_of_shards_unite(spark):
    rows = [(o % 4, o % 3, s) for o, _, s in sequences(5, 120)]
    df = spark.createDataFrame(rows, "shard int, mbucket int, seq string")
    parts = distinct.kmer_sketches(df, CFG, ["shard", "mbucket"])
    whole = distinct.kmer_sketches(df, CFG, ["mbucket"])
    exact = {m: len({w for _, o, s in rows if o == m for w in sequential.kmers(s, 11)}) for m in range(3)}
    got = {r.mbucket: r.estimate for r in distinct.estimated(distinct.united(parts, ["mbucket"])).collect()}
    assert got == {r.mbucket: r.estimate for r in distinct.estimated(whole).collect()}
    assert all(abs(got[m] - n) <= 0.02 * n for m, n in exact.items())
    total = distinct.estimated(distinct.united(parts, [])).first().estimate
    assert abs(total - len({w for *_, s in rows for w in sequential.kmers(s, 11)})) <= 0.02 * total


def test_a_run_counts_itself(spark):
    rows = sequences(2, 60)
    cfg = CFG.but(min_len=20, warmup=10, outlier_sd=1.0, frequency="exact", by_month=False)
    done = Reducer(spark, cfg).run(spark.createDataFrame(rows, "ord bigint, header string, seq string"))
    want = sequential.admit([(o, s) for o, _, s in rows], cfg)
    verdicts = [v for v, _ in want.values()]
    got = done.counters()
    assert {k: got[k] for k in ("seen", "lowqual", "skip", "reject", "admit")} == {
        "seen": 60, "lowqual": verdicts.count("LOWQUAL"), "skip": verdicts.count("SKIP"),
        "reject": verdicts.count("REJECT"), "admit": verdicts.count("ADMIT"),
    }
    assert got["bases"] == sum(len(s) for *_, s in rows) and verdicts.count("REJECT") > 0
    phases = done.timing().collect()
    assert [p.step for p in phases] == list(range(1, len(phases) + 1))
    assert next(p.rows for p in phases if p.phase == "profile") == 60 and all(p.seconds > 0 for p in phases)


def test_batches_report_their_verdicts(spark, tmp_path):
    rows = sequences(3, 30)
    cfg = CFG.but(min_len=20, warmup=5, frequency="exact")
    runner = IncrementalReducer(spark, cfg, str(tmp_path / "state"))
    for batch, some in enumerate((rows[:15], rows[15:])):
        runner.process(spark.createDataFrame(some, "ord bigint, header string, seq string"), batch)
    want = [v for v, _ in sequential.admit([(o, s) for o, _, s in rows], cfg).values()]
    for verdict in ("LOWQUAL", "SKIP", "REJECT", "ADMIT"):
        assert sum(p[verdict.lower()] for p in runner.progress) == want.count(verdict)
    assert [p["batch"] for p in runner.progress] == [0, 1]
    assert sum(p["promoted"] for p in runner.progress) == runner.table("kept").count()


def test_best_related_compares_crowded_bands_in_tiles(spark, monkeypatch):
    """Every record's best kept one, copies and a band that all records share included; no pair is a row."""
    from seqthin.plans import calibration
    from seqthin.sources.tables import spread

    monkeypatch.setattr(calibration, "TILE", 16)
    rng = random.Random(6)
    rows = [(i, [1, 1] + [rng.randrange(3) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(20)] + [(300, [7] * 8)]
    kept = [i for i, _ in rows if i < 120 and i % 3 == 0]
    want = {}
    held = dict(rows)
    for j, s in rows:
        found = [(sum(x == y for x, y in zip(s, held[i])), -i) for i in kept if i != j
                 and any(s[b : b + 2] == held[i][b : b + 2] for b in range(0, 8, 2))]
        if found:
            want[j] = (-max(found)[1], max(found)[0])
    cfg = ReduceConfig(k=11, sketch=8, bands=4)
    df = spread(spark.createDataFrame(rows, "ord bigint, sketch array<bigint>"), "ord")
    got = calibration.best_related(df, spark.createDataFrame([(i,) for i in kept], "ord bigint"), cfg)
    assert {r.j: (r.i, r.equal) for r in got.collect()} == want


def test_calibration_measures_every_related_record(spark):
    """More records than any sample: all are counted."""
    from seqthin.plans.calibration import best_related

    rows = [(i, [i // 2] * 16) for i in range(9000)]
    df = spark.createDataFrame(rows, "ord bigint, sketch array<bigint>")
    kept = df.where("ord % 2 = 0").select("ord")
    got = suggest(best_related(df, kept, CFG), CFG).first()
    assert got.pairs == 4500 and got.median_divergence == 0


def test_calibration_counts_all_pairs(spark, monkeypatch):
    """Unrelated records and copies included, whatever the blocks, and slots that most records share."""
    from seqthin.plans import calibration

    monkeypatch.setattr(calibration, "BLOCK", 40)
    monkeypatch.setattr(calibration, "PART", 16)
    rng = random.Random(12)
    for values in (400, 3):
        rows = [[rng.randrange(values) for _ in range(16)] for _ in range(150)]
        rows += [rows[i % 7] for i in range(30)]
        held = np.array(rows)
        equal = np.concatenate([(held[i + 1 :] == held[i]).sum(1) for i in range(len(held))])
        df = spark.createDataFrame([(r,) for r in rows], "sketch array<bigint>")
        pairs = calibration.pair_counts(df, CFG)
        assert {r.equal: r.n for r in pairs.collect()} == {int(e): int(n) for e, n in zip(*np.unique(equal, return_counts=True))}
        x = equal / 16
        with np.errstate(divide="ignore"):
            d = np.where(equal == 0, 1.0, np.minimum(1, -np.log(2 * x / (1 + x)) / 11))
        got = suggest(pairs, CFG).first()
        assert got.pairs == len(equal) and math.isclose(got.median_divergence, np.median(d)) and math.isclose(got.mean_divergence, d.mean())
    none = calibration.pair_counts(df.limit(1), CFG)
    assert suggest(none, CFG).first().pairs == 0
