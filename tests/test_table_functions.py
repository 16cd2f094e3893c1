"""Table functions in SQL against record-by-record answers."""

import numpy as np
import pytest

from seqthin.config import ReduceConfig
from seqthin.functions import kernels, table_functions
from tests import sequential
from tests.test_superkmers import sequences

SLOTS = 6


def by_hand(words):
    """The smallest hash per slot, as BIGINT."""
    salts = kernels.sketch_salts(SLOTS)
    values = np.array(sorted(words), np.uint64)
    return [int(kernels.slot_hash(values.copy(), s).min().view(np.int64)) for s in salts]


@pytest.mark.parametrize("bases", [37, 1 << 20])
def test_kmers_and_sketches_in_sql(spark, bases):
    k, rows = 7, sequences(4)
    cfg = ReduceConfig(k=k, sketch=SLOTS)
    table_functions.register(spark, cfg, f"t{bases}_", bases)
    rows = [(i, q, "x") for i, (_, _, q) in enumerate(rows)]
    words = {i: sequential.kmers(q or "", k, None) for i, q, _ in rows}
    df = spark.createDataFrame(rows, "id bigint, seq string, kmer string").repartition(3)
    df.createOrReplaceTempView("some_records")
    got = spark.sql(f"SELECT id, kmer FROM t{bases}_kmers(TABLE(some_records))").collect()
    assert sorted(map(tuple, got)) == sorted((i, w) for i, ws in words.items() for w in set(ws))
    merged = table_functions.merged_sketch("sketch", SLOTS)
    of_rows = f"SELECT id, {merged} AS sketch FROM t{bases}_minhash_parts(TABLE(some_records)) GROUP BY id"
    assert {r.id: r.sketch for r in spark.sql(of_rows).collect()} == {i: by_hand(ws) for i, ws in words.items() if ws}
    # A group's sketch is that of its union, from parts or from finished sketches.
    union = by_hand(set().union(*words.values()))
    assert spark.sql(f"SELECT {merged} AS s FROM ({of_rows})").first().s == union
    assert spark.sql(f"SELECT {merged} AS s FROM t{bases}_minhash_parts(TABLE(some_records))").first().s == union


def test_nothing_to_read(spark):
    table_functions.register(spark, ReduceConfig(k=7, sketch=SLOTS), "none_")
    spark.createDataFrame([], "id bigint, seq string").createOrReplaceTempView("no_records")
    assert spark.sql("SELECT * FROM none_kmers(TABLE(no_records))").count() == 0
    assert spark.sql("SELECT * FROM none_minhash_parts(TABLE(no_records))").count() == 0
    spark.createDataFrame([(1, None), (None, "ACGTACGTA"), (2, "ACG")], "id bigint, seq string").createOrReplaceTempView("odd_records")
    got = spark.sql("SELECT id, count(*) AS n FROM none_kmers(TABLE(odd_records)) GROUP BY id").collect()
    assert [tuple(r) for r in got] == [(None, len(sequential.kmers("ACGTACGTA", 7, None)))]
