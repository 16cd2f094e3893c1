"""k-mers and MinHash sketches inside SQL.

:func:`register` gives a session two table functions over (id, seq)::

    SELECT id, kmer FROM kmers(TABLE(SELECT ord AS id, seq FROM records))
    SELECT id, <merged> FROM minhash_parts(TABLE(...)) GROUP BY id

``kmers`` has one row per id and distinct canonical k-mer of a row's sequence.
``minhash_parts`` has one partial sketch per stretch of a sequence, so no row, however
long, is worked off at once; :func:`merged_sketch` is the aggregate expression that
puts the parts of a group together.  It is one minimum per slot, which Spark combines
before its shuffle, and merges sketches of any origin: parts of a record, or the
records of a group (the sketch of their union).

A null sequence, and one without a k-mer, gives no row; a null id is kept; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from seqthin.config import ReduceConfig
from seqthin.functions import kernels

#: Turns the order of unsigned numbers into that of BIGINT.
SIGN = "CAST(-9223372036854775808 AS BIGINT)"


def stretches(at: np.ndarray, bases: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of stretches of about ``bases``; neighbours share k - 1 of them."""
    sizes = np.diff(at)
    n = np.maximum(1, -(-(sizes - k + 1) // bases))
    row = np.repeat(np.arange(len(sizes)), n)
    start = at[row] + bases * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    return row, start, np.minimum(start + bases + k - 1, at[row + 1])


def table_functions(cfg: ReduceConfig, bases: int = kernels.BASES_PER_BLOCK) -> tuple:
    """The table functions ``kmers`` and ``minhash_parts`` for the settings ``k``, ``sketch`` and ``salts``."""
    k, salts = cfg.k, kernels.sketch_salts(cfg.sketch, cfg.salts)

    def per_stretch(batch: pa.RecordBatch):
        """Rows and k-mers, a bounded number of bases at a time."""
        raw, at = kernels.text_buffer(batch.column("seq"))
        row, start, end = stretches(at, bases, k)
        for lo, hi in kernels.blocks(end - start, bases):
            taken = np.concatenate([raw[a:b] for a, b in zip(start[lo:hi].tolist(), end[lo:hi].tolist())])
            offsets = np.concatenate(([0], np.cumsum(end[lo:hi] - start[lo:hi])))
            yield row[lo:hi], *kernels.distinct_kmers(taken, offsets, k)

    class Kmers:
        def eval(self, batch: pa.RecordBatch):
            late, late_kmers = [], []
            ids = batch.column("id").cast(pa.int64())
            raw, at = kernels.text_buffer(batch.column("seq"))
            long = np.diff(at) > bases + k - 1
            for row, rec, kmer in per_stretch(batch):
                split = long[row[rec]]
                yield out(ids, row[rec[~split]], kmer[~split])
                late.append(row[rec[split]])
                late_kmers.append(kmer[split])
            # Stretches of one sequence may share k-mers.
            row, kmer = np.concatenate([np.zeros(0, np.int64), *late]), np.concatenate([np.zeros(0, np.uint64), *late_kmers])
            for r in np.unique(row):
                different = np.unique(kmer[row == r])
                yield out(ids, np.full(len(different), r), different)

    def out(ids: pa.Array, rows: np.ndarray, kmer: np.ndarray) -> pa.Table:
        return pa.table({"id": ids.take(pa.array(rows)), "kmer": pa.array(kmer.view(np.int64))})

    class MinHashParts:
        def eval(self, batch: pa.RecordBatch):
            ids = batch.column("id").cast(pa.int64())
            for row, rec, kmer in per_stretch(batch):
                some = np.unique(rec)
                parts = kernels.minhash(rec, kmer, len(row), salts)[some]
                sketch = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(some) + 1, dtype=np.int32) * len(salts)), pa.array(parts.reshape(-1).view(np.int64))
                )
                yield pa.table({"id": ids.take(pa.array(row[some])), "sketch": sketch})

    return (
        arrow_udtf(Kmers, returnType="id bigint, kmer bigint"),
        arrow_udtf(MinHashParts, returnType="id bigint, sketch array<bigint>"),
    )


def register(spark: SparkSession, cfg: ReduceConfig, prefix: str = "", bases: int = kernels.BASES_PER_BLOCK) -> None:
    """Make ``kmers`` and ``minhash_parts``, with a prefix to their names, known to a session's SQL."""
    for name, function in zip(("kmers", "minhash_parts"), table_functions(cfg, bases)):
        spark.udtf.register(prefix + name, function)


def merged_sketch(column: str, slots: int) -> str:
    """SQL aggregate: the sketch of the union of what a group's sketches stand for."""
    return "array(" + ", ".join(f"min({column}[{i}] ^ {SIGN}) ^ {SIGN}" for i in range(slots)) + ")"
