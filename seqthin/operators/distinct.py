"""Distinct k-mers by mergeable sketches.

One sketch of a few kilobytes for each group (a shard, a month, a batch) is built on the
map side; sketches are kept as a table, and any union of groups is estimated from them
without going back to sequences.  A union equals the sketch of all its records at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqthin.config import ReduceConfig
from seqthin.operators.kmers import explode_kmers

#: Logarithm of a sketch's registers: a relative standard error of about 0.4 %.
LOG_REGISTERS = 16


def kmer_sketches(df: DataFrame, cfg: ReduceConfig, by: list[str], log_registers: int = LOG_REGISTERS) -> DataFrame:
    """(``by``, sketch) of the distinct k-mers of each group of records."""
    return explode_kmers(df, cfg, by).groupBy(*by).agg(F.hll_sketch_agg("kmer", F.lit(log_registers)).alias("sketch"))


def united(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, sketch) of coarser groups; no columns give one sketch of everything."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated(sketches: DataFrame) -> DataFrame:
    """The sketches' groups with ``estimate``."""
    return sketches.withColumn("estimate", F.hll_sketch_estimate("sketch")).drop("sketch")
