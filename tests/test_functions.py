"""Scalar functions and kernels against known values and by-hand arithmetic."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqthin.functions import kernels, text
from seqthin.functions.calibrate import binomial_cutoff
from seqthin.operators.emit import four_places
from seqthin.operators.kmers import cell_numbers
from seqthin.config import ReduceConfig
from tests import sequential


def kmers(seq, k, cap=None):
    raw = np.frombuffer(seq.encode(), np.uint8)
    return kernels.distinct_kmers(raw, np.array([0, len(raw)]), k, cap)[1].tolist()


def test_kmer_vectors():
    assert kmers("ACGT", 5) == []
    assert kmers("ACGTA", 5) == [108]
    assert kmers("ACGTTGCA", 5) == kmers("TGCAACGT", 5)
    assert len(kmers("A" * 10, 3)) == 1
    assert kmers("ACGTNACGT", 5) == [] and len(kmers("ACGTNACGTA", 5)) == 1


@pytest.mark.parametrize("k", [1, 2, 3, 7, 15, 16, 31, 32])
def test_kmers_of_many_records(k):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGTACGTACGTN-u") for _ in range(rng.randint(0, 150))) for _ in range(40)]
    raw = np.frombuffer("".join(seqs).encode(), np.uint8)
    at = np.cumsum([0] + [len(s) for s in seqs])
    for cap in (None, 10):
        rec, words = kernels.distinct_kmers(raw, at, k, cap)
        for i, s in enumerate(seqs):
            assert words[rec == i].tolist() == sequential.kmers(s, k, cap)


@pytest.mark.parametrize("k", [1, 15, 32])
def test_long_records_in_pieces(k):
    rng = random.Random(k)
    seq = "".join(rng.choice("ACGTACGTACGTN") for _ in range(700)) * 2
    raw = np.frombuffer(seq.encode(), np.uint8)
    for piece in (1, 7, 100, 1399, 5000):
        assert kernels.distinct_kmers_in_pieces(raw, k, piece).tolist() == kmers(seq, k)


def test_hash_vectors():
    salts = kernels.sketch_salts(64)
    assert [hex(s) for s in salts[:2]] == ["0x3f2800d6569e01b5", "0x606f949a3cebd0b7"]
    assert hex(salts[63]) == "0x1dbc199b88d5cf6d"
    one = np.array([108], np.uint64)
    cells = kernels.count_min_cells(one, 22)[:, 0] & np.uint64((1 << 22) - 1)
    assert cells.tolist() == [3994948, 1247732, 2090471, 3411288]
    assert kernels.slot_hash(one, salts[0])[0] == 11880595226935061304
    rows = np.array([[1, 2, 3, 4] * 16], np.uint64)
    assert kernels.band_keys(np.array([-1]), rows, 16)[0, 0] == 13545398318699992404
    assert kernels.band_keys(np.array([24252]), rows, 16)[0, 3] == 12631702668556104311
    assert all(s % 2 for s in kernels.sketch_salts(8, "pcg64").tolist())


def test_minhash_by_hand():
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (40, 3, 90, 41)]
    raw, at = np.frombuffer("".join(seqs).encode(), np.uint8), np.cumsum([0] + [len(s) for s in seqs])
    rec, words = kernels.distinct_kmers(raw, at, 7)
    got = kernels.minhash(rec, words, 4, kernels.sketch_salts(5))
    salts = [int(s) for s in kernels.sketch_salts(5)]
    for i in (0, 2, 3):
        assert got[i].tolist() == sequential.sketch(sequential.kmers(seqs[i], 7), salts)
    assert got[1].tolist() == [kernels.EMPTY_SLOT] * 5


def test_headers(spark):
    want = {
        "v/x|2021-01-15|foo": 2021 * 12, "x|2020-12-31|y": 2020 * 12 + 11, "no-pipe-here": -1,
        "x|notadate|y": -1, "x|2021-13-01|y": -1, "x|2021-00-01|y": -1, "a|2021-1-01|2021-02-02": -1,
        "a|2021-05": 2021 * 12 + 4, "a||2021-05-01": -1,
    }
    df = spark.createDataFrame([(h,) for h in want], "h string")
    got = {r[0]: r[1] for r in df.select("h", text.month_bucket(F.col("h"))).collect()}
    assert got == want
    late = spark.createDataFrame([("é" * 200 + "|2021-05-01",)], "h string")
    key = late.select(text.header_key(F.col("h")).alias("k"), text.month_bucket(text.truncated_header(F.col("h"))).alias("m")).first()
    assert len(key["k"]) == 255 and key["m"] == -1


def test_n_fraction(spark):
    df = spark.createDataFrame([(s,) for s in ("ACGT", "NNNN", "ACNN", "", "ACGU-")], "s string")
    got = [r[0] for r in df.select(text.n_fraction(F.col("s"))).collect()]
    assert got == [0.0, 1.0, 0.5, 1.0, 1.0 - 3 / 5]


def test_kmer_letters_and_codes(spark):
    df = spark.createDataFrame([("GATTACAGATTACAA",), ("TTTTTTTTTTTTTTT",)], "w string")
    code = text.kmer_code(text.canonical(F.col("w")))
    rows = df.select(code.alias("c"), text.kmer_text(code, 15).alias("t"), text.canonical(F.col("w")).alias("w")).collect()
    assert all(r["t"] == r["w"] for r in rows) and rows[1]["c"] == 0


def test_cells_of_a_column(spark):
    got = spark.range(108, 109).select(cell_numbers(F.col("id"), ReduceConfig())).first()[0]
    assert [c & ((1 << 22) - 1) for c in got] == [3994948, 1247732, 2090471, 3411288]
    assert [c >> 22 for c in got] == [0, 1, 2, 3]


def test_binomial_cutoff(spark):
    def mass_below(n, count):
        """Exact probability of fewer than ``count`` events in ``n`` draws at 1 in 100."""
        return Fraction(sum(math.comb(n, x) * 99 ** (n - x) for x in range(count)), 100**n)

    draws = [-1, 0, 1, 2, 5, 50, 500, 3000, 80_000]
    df = spark.createDataFrame([(n,) for n in draws], "n bigint")
    got = dict(zip(draws, (r[0] for r in df.select(binomial_cutoff(F.col("n"), 0.01, 0.9)).collect())))
    assert got[-1] == got[0] == 0
    for n in draws[2:-1]:
        count = got[n]
        assert count == n or mass_below(n, count) >= Fraction(9, 10)
        assert count == 1 or mass_below(n, count - 1) < Fraction(9, 10)
    # Where no event at all is too unlikely for a double: about the 90th percentile of a normal.
    assert abs(got[80_000] - (800 + 1.2816 * math.sqrt(792))) < 3


def test_four_places_round_like_printf(spark):
    values = [0.03125, 717 / 800, 1 / 3, 0.00005, 0.99995, 1.0, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(four_places(F.col("x"))).collect()] == ["%.4f" % v for v in values]
