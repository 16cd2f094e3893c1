"""Completeness gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqthin.config import ReduceConfig
from seqthin.functions.text import month_bucket, n_fraction, seq_length

LOWQUAL, SKIP, REJECT, ADMIT = "LOWQUAL", "SKIP", "REJECT", "ADMIT"


def with_quality(records: DataFrame, cfg: ReduceConfig) -> DataFrame:
    """Add length, ambiguous fraction, month and the verdict of the gate."""
    if "shard" not in records.columns:
        records = records.withColumn("shard", F.lit(0))
    return records.select(
        "shard",
        "ord",
        "header",
        "seq",
        month_bucket(F.col("header")).alias("mbucket"),
        seq_length(F.col("seq")).alias("len"),
        n_fraction(F.col("seq")).alias("n_frac"),
    ).withColumn(
        "complete", (F.col("len") >= cfg.min_len) & (F.col("n_frac") <= cfg.max_n_frac)
    )
