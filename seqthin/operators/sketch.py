"""Count-Min sketches as arrays: built in tasks, cut into slices, merged slice by slice.

A task keeps one array for the shard it reads.  When it ends (or turns to another shard)
it sends what it touched, one row for each slice of cells, so at most slices times tasks
rows are shuffled, whatever the number of k-mers.  Rows of a slice are merged one after
the other into one array of its cells.

``first_touches`` keeps the smallest record number of each cell, ``counters`` the number
of records' k-mers that fall into it.  Both end as small tables whose size the settings
bound.  Probing needs no join: the merged arrays travel to the tasks, if ``BROADCAST_MB``
allows for all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqthin.config import ReduceConfig
from seqthin.functions import kernels
from seqthin.operators.kmers import _kmer_blocks, _sequences

SLICE_BITS = 16
BROADCAST_MB = 256
EMPTY = np.iinfo(np.int64).max
SLICES = "shard int, slice int, cells binary, vals binary"


def cell_count(cfg: ReduceConfig) -> int:
    return len(kernels.CMS_SEEDS) << cfg.cms_log2_width


def travels(cfg: ReduceConfig) -> bool:
    """Do the arrays of all shards fit the broadcast bound?"""
    return cfg.shards * cell_count(cfg) * 8 <= BROADCAST_MB << 20


def _built(df: DataFrame, cfg: ReduceConfig, counts: bool) -> DataFrame:
    """Slices of every task's sketch."""
    k, cap, width = cfg.k, cfg.kmer_cap, cfg.cms_log2_width
    size, start = cell_count(cfg), 0 if counts else EMPTY

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, dense = None, None

        def flush() -> Iterator[pa.RecordBatch]:
            touched = np.flatnonzero(dense != start)
            cut = np.searchsorted(touched, np.arange(0, size + (1 << SLICE_BITS), 1 << SLICE_BITS))
            for s, (i, j) in enumerate(zip(cut, cut[1:])):
                if i < j:
                    cells = touched[i:j]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard], pa.int32()), pa.array([s], pa.int32()),
                        pa.array([(cells - (s << SLICE_BITS)).astype(np.uint16).tobytes()]), pa.array([dense[cells].tobytes()]),
                    ], names=["shard", "slice", "cells", "vals"])

        for batch in batches:
            shards, ords = batch.column("shard").to_numpy(), batch.column("ord").to_numpy()
            for lo, hi, rec, kmer in _kmer_blocks(batch, k, cap):
                for own in np.unique(shards[lo:hi][rec]):
                    if own != shard:
                        if shard is not None:
                            yield from flush()
                        shard, dense = int(own), np.full(size, start, np.int64)
                    mine = shards[lo:hi][rec] == own
                    who = ords[lo:hi][rec[mine]]
                    # Later records first, so that the earliest is what stays written.
                    order = None if counts else np.argsort(-who, kind="stable")
                    for cells in kernels.count_min_cells(kmer[mine], width):
                        cells = cells.astype(np.int64)
                        if counts:
                            cell, n = np.unique(cells, return_counts=True)
                            dense[cell] += n
                        else:
                            dense[cells[order]] = np.minimum(dense[cells], who)[order]
        if shard is not None:
            yield from flush()

    return _sequences(df, ["shard", "ord"]).mapInArrow(rows, SLICES)


def _merged(slices: DataFrame, counts: bool) -> DataFrame:
    """One row for each shard and slice."""
    start = 0 if counts else EMPTY

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, dense = None, None

        def give() -> pa.RecordBatch:
            cells = np.flatnonzero(dense != start)
            return pa.RecordBatch.from_arrays([
                pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()),
                pa.array([cells.astype(np.uint16).tobytes()]), pa.array([dense[cells].tobytes()]),
            ], names=["shard", "slice", "cells", "vals"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["shard"], row["slice"]) != key:
                    if key is not None:
                        yield give()
                    key, dense = (row["shard"], row["slice"]), np.full(1 << SLICE_BITS, start, np.int64)
                cells, vals = np.frombuffer(row["cells"], np.uint16), np.frombuffer(row["vals"], np.int64)
                dense[cells] = dense[cells] + vals if counts else np.minimum(dense[cells], vals)
        if key is not None:
            yield give()

    sent = slices.repartition("shard", "slice").sortWithinPartitions("shard", "slice")
    return sent.mapInArrow(rows, SLICES)


def _cells(slices: DataFrame, name: str) -> DataFrame:
    """(shard, cell, ``name``) of merged slices."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cells = np.frombuffer(row["cells"], np.uint16).astype(np.int64) + (row["slice"] << SLICE_BITS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cells), row["shard"], np.int32)), pa.array(cells), pa.array(np.frombuffer(row["vals"], np.int64))],
                    names=["shard", "cell", name],
                )

    return slices.mapInArrow(rows, f"shard int, cell bigint, {name} bigint")


def touch_slices(df: DataFrame, cfg: ReduceConfig) -> DataFrame:
    """Merged slices of the smallest ``ord`` per cell of (shard, ord, seq) records."""
    return _merged(_built(df, cfg, counts=False), counts=False)


def count_slices(df: DataFrame, cfg: ReduceConfig) -> DataFrame:
    """Merged slices of the Count-Min counters of (shard, ord, seq) records."""
    return _merged(_built(df, cfg, counts=True), counts=True)


def first_touches(df: DataFrame, cfg: ReduceConfig) -> DataFrame:
    """(shard, cell, ord): the first record to touch each cell."""
    return _cells(touch_slices(df, cfg), "ord")


def counters(df: DataFrame, cfg: ReduceConfig) -> DataFrame:
    """(shard, cell, n): non-zero Count-Min counters."""
    return _cells(count_slices(df, cfg), "n")


def arrays(slices: DataFrame, cfg: ReduceConfig, start: int) -> dict[int, np.ndarray]:
    """The sketch of each shard as one array, for tasks; their size is checked by :func:`travels`."""
    out: dict[int, np.ndarray] = {}
    for row in slices.toLocalIterator():
        dense = out.setdefault(row["shard"], np.full(cell_count(cfg), start, np.int64))
        dense[np.frombuffer(row["cells"], np.uint16).astype(np.int64) + (row["slice"] << SLICE_BITS)] = np.frombuffer(row["vals"], np.int64)
    return out


def unseen_kmers(df: DataFrame, slices: DataFrame, cfg: ReduceConfig) -> DataFrame:
    """(shard, ord, n_singleton): k-mers of each record with a cell no earlier record touched, by the merged first touches."""
    k, cap, width = cfg.k, cfg.kmer_cap, cfg.cms_log2_width
    sent = df.sparkSession.sparkContext.broadcast(arrays(slices, cfg, EMPTY))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = sent.value
        for batch in batches:
            shards, ords = batch.column("shard").to_numpy(), batch.column("ord").to_numpy()
            for lo, hi, rec, kmer in _kmer_blocks(batch, k, cap):
                hit = np.zeros(len(rec), bool)
                for own in np.unique(shards[lo:hi][rec]):
                    mine = np.flatnonzero(shards[lo:hi][rec] == own)
                    who = ords[lo:hi][rec[mine]]
                    for cells in kernels.count_min_cells(kmer[mine], width):
                        hit[mine] |= first[own][cells.astype(np.int64)] == who
                yield pa.RecordBatch.from_arrays(
                    [batch.column("shard").slice(lo, hi - lo), batch.column("ord").slice(lo, hi - lo), pa.array(np.bincount(rec[hit], minlength=hi - lo))],
                    names=["shard", "ord", "n_singleton"],
                )

    return _sequences(df, ["shard", "ord"]).mapInArrow(rows, "shard int, ord bigint, n_singleton bigint")


def estimates(kmers: DataFrame, slices: DataFrame, cfg: ReduceConfig) -> DataFrame:
    """``kmers`` (shard, kmer, …) with ``estimate``, the smallest of a k-mer's counters."""
    width = cfg.cms_log2_width
    sent = kmers.sparkSession.sparkContext.broadcast(arrays(slices, cfg, 0))

    @F.arrow_udf("bigint")
    def least(shard: pa.Array, kmer: pa.Array) -> pa.Array:
        held, own = sent.value, shard.to_numpy()
        cells = kernels.count_min_cells(kmer.to_numpy().view(np.uint64), width).astype(np.int64)
        out = np.zeros(len(own), np.int64)
        for s in np.unique(own):
            if s in held:
                out[own == s] = held[s][cells[:, own == s]].min(axis=0)
        return pa.array(out)

    return kmers.withColumn("estimate", least("shard", "kmer"))
