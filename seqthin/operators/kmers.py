"""k-mer relations: one pass over sequence batches, bounded output batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqthin.config import ReduceConfig
from seqthin.functions import kernels
from seqthin.sources.order import ROWS_PER_CHUNK, running_totals


def _kmer_blocks(batch: pa.RecordBatch, k: int, cap: int | None):
    """Slices of a batch with the distinct k-mers of their records."""
    raw, at = kernels.text_buffer(batch.column("seq"))
    for lo, hi in kernels.blocks(np.diff(at), kernels.BASES_PER_BLOCK):
        if at[hi] - at[lo] > kernels.BASES_PER_BLOCK and cap is None:
            kmer = kernels.distinct_kmers_in_pieces(raw[at[lo] : at[hi]], k, kernels.BASES_PER_BLOCK)
            rec = np.zeros(len(kmer), np.int64)
        else:
            rec, kmer = kernels.distinct_kmers(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], k, cap)
        yield lo, hi, rec, kmer


def _sequences(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and sequence; what fails the gate is blanked before it reaches Python.

    A filter would be pushed below the projections that build the sequence and
    repeat their work; a blank costs one empty row.
    """
    seq = F.when(F.col("complete"), F.col("seq")) if "complete" in df.columns else F.col("seq")
    return df.select(*keep, seq.alias("seq"))


def _among(values: np.ndarray, wanted: np.ndarray | None) -> np.ndarray | slice:
    """Which values are in a sorted array; all without one."""
    if wanted is None:
        return slice(None)
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    return wanted[at] == values if len(wanted) else np.zeros(len(values), bool)


def explode_kmers(df: DataFrame, cfg: ReduceConfig, keep: list[str], wanted: np.ndarray | None = None) -> DataFrame:
    """One row per record and distinct canonical k-mer: ``keep`` columns and ``kmer``.

    ``wanted``, sorted and of checked size, travels to the tasks; others never leave them.
    """
    k, cap = cfg.k, cfg.kmer_cap
    sent = df.sparkSession.sparkContext.broadcast(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, rec, kmer in _kmer_blocks(batch, k, cap):
                some = _among(kmer, sent.value)
                take = pa.array(rec[some] + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(take) for c in keep] + [pa.array(kmer[some].view(np.int64))],
                    names=[*keep, "kmer"],
                )

    kept = _sequences(df, keep)
    schema = T.StructType([kept.schema[c] for c in keep] + [T.StructField("kmer", T.LongType())])
    return kept.mapInArrow(rows, schema)


def explode_cells(df: DataFrame, cfg: ReduceConfig, keep: list[str], wanted: np.ndarray | None = None) -> DataFrame:
    """Counter cells each record touches.

    With exact frequencies the cell is the k-mer itself; with Count-Min it is
    one of four flat cell numbers per k-mer.
    """
    if cfg.frequency == "exact":
        return explode_kmers(df, cfg, keep, wanted).withColumnRenamed("kmer", "cell")
    k, cap, width = cfg.k, cfg.kmer_cap, cfg.cms_log2_width
    sent = df.sparkSession.sparkContext.broadcast(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, rec, kmer in _kmer_blocks(batch, k, cap):
                for cells in kernels.count_min_cells(kmer, width):
                    some = _among(cells, sent.value)
                    take = pa.array(rec[some] + lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(c).take(take) for c in keep] + [pa.array(cells[some].view(np.int64))], names=[*keep, "cell"]
                    )

    kept = _sequences(df, keep)
    schema = T.StructType([kept.schema[c] for c in keep] + [T.StructField("cell", T.LongType())])
    return kept.mapInArrow(rows, schema)


def profiles(quality: DataFrame, cfg: ReduceConfig) -> DataFrame:
    """Everything later steps need of a record but its sequence.

    Adds ``n_kmers`` and the MinHash ``sketch`` (null without k-mers).
    """
    keep = ["shard", "ord", "header", "mbucket", "len", "n_frac", "complete"]
    k, cap, m = cfg.k, cfg.kmer_cap, cfg.sketch
    salts = kernels.sketch_salts(m, cfg.salts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, rec, kmer in _kmer_blocks(batch, k, cap):
                n = hi - lo
                counts = np.bincount(rec, minlength=n)
                sketch = kernels.minhash(rec, kmer, n, salts)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * m),
                    pa.array(sketch.reshape(-1).view(np.int64)),
                    mask=pa.array(counts == 0),
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(lo, n) for c in keep] + [pa.array(counts), lists],
                    names=[*keep, "n_kmers", "sketch"],
                )

    source = _sequences(quality, keep)
    schema = T.StructType(
        [source.schema[c] for c in keep]
        + [
            T.StructField("n_kmers", T.LongType()),
            T.StructField("sketch", T.ArrayType(T.LongType())),
        ]
    )
    return source.mapInArrow(rows, schema)


def count_won_kmers(won: DataFrame, cfg: ReduceConfig) -> DataFrame:
    """k-mers of each record with at least one of their four cells in the record's ``cells``."""
    k, cap, width = cfg.k, cfg.kmer_cap, cfg.cms_log2_width
    cell_bits = np.uint64(width + 2)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell_lists = batch.column("cells")
            for lo, hi, rec, kmer in _kmer_blocks(batch, k, cap):
                lists = cell_lists.slice(lo, hi - lo)
                owner = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy(False))
                tag = lambda r, c: (r.astype(np.uint64) << cell_bits) | c
                mine = np.sort(tag(owner, lists.flatten().to_numpy(False).view(np.uint64)))
                hit = np.zeros(len(rec), bool)
                if len(mine):
                    for cells in kernels.count_min_cells(kmer, width):
                        probe = tag(rec, cells)
                        at = np.minimum(np.searchsorted(mine, probe), len(mine) - 1)
                        hit |= mine[at] == probe
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("shard").slice(lo, hi - lo),
                        batch.column("ord").slice(lo, hi - lo),
                        pa.array(np.bincount(rec[hit], minlength=hi - lo)),
                    ],
                    names=["shard", "ord", "n_singleton"],
                )

    kept = won.select("shard", "ord", "seq", "cells")
    schema = T.StructType(
        [kept.schema["shard"], kept.schema["ord"], T.StructField("n_singleton", T.LongType())]
    )
    return kept.mapInArrow(rows, schema)


def rare_kmers(
    kmers: DataFrame, verdicts: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """(shard, ord, n_rare): k-mers held by at most ``cutoff`` earlier admitted records.

    ``verdicts`` has (shard, ord, decision, cutoff).  Holders are counted in two
    levels, by ranges of ``ord`` and inside them, so that a k-mer all records hold
    is no task of its own.
    """
    judged = verdicts.where("decision IN ('ADMIT', 'REJECT')").select("shard", "ord", "decision", "cutoff")
    touch = kmers.join(judged, ["shard", "ord"]).withColumn(
        "chunk", F.floor(F.col("ord") / rows_per_chunk)
    )
    holds = F.when(F.col("decision") == "ADMIT", 1).otherwise(0).cast("bigint")
    counted = running_totals(touch, ["shard", "kmer"], "ord", {"before": holds})
    found = counted.where("before <= cutoff").groupBy("shard", "ord").agg(F.count("*").alias("n_rare"))
    return judged.select("shard", "ord").join(found, ["shard", "ord"], "left").fillna(0, ["n_rare"])


def mixed(value, seed: int):
    """Seeded 64-bit finaliser of a BIGINT bit pattern."""

    @F.arrow_udf("bigint")
    def mix(codes: pa.Array) -> pa.Array:
        return pa.array(kernels.mix64(codes.to_numpy(False).view(np.uint64), seed).view(np.int64))

    return mix(value)


def band_key_list(month, sketch, bands: int):
    """Band keys of a sketch, with its month folded in."""

    @F.arrow_udf("array<bigint>")
    def keys(months: pa.Array, sketches: pa.Array) -> pa.Array:
        n = len(sketches)
        slots = sketches.flatten().to_numpy(False).view(np.uint64).reshape(n, -1)
        out = kernels.band_keys(months.to_numpy(False), slots, bands)
        return pa.ListArray.from_arrays(
            pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(out.reshape(-1).view(np.int64))
        )

    return keys(month, sketch)


def cell_numbers(kmer, cfg: ReduceConfig):
    """The four flat Count-Min cell numbers of a k-mer code."""
    width = cfg.cms_log2_width

    @F.arrow_udf("array<bigint>")
    def cells(codes: pa.Array) -> pa.Array:
        flat = kernels.count_min_cells(codes.to_numpy(False).view(np.uint64), width)
        rows = len(kernels.CMS_SEEDS)
        return pa.ListArray.from_arrays(
            pa.array(np.arange(len(codes) + 1, dtype=np.int32) * rows),
            pa.array(np.ascontiguousarray(flat.T).reshape(-1).view(np.int64)),
        )

    return cells(kmer)
