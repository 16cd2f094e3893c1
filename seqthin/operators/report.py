"""Counters of a run as a one-row DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = ["seen", "lowqual", "skip", "reject", "promoted"]


def _partial(df: DataFrame, **counts) -> DataFrame:
    """One row holding the given counters and zero for the others."""
    return df.agg(*[counts.get(c, F.sum(F.lit(0))).cast("bigint").alias(c) for c in COUNTERS])


def report(profile: DataFrame, rejects: DataFrame, promoted: DataFrame) -> DataFrame:
    """Records per verdict, their shares and the overall reduction factor."""
    parts = [
        _partial(
            profile,
            seen=F.count("*"),
            lowqual=F.count_if(~F.col("complete")),
            skip=F.count_if(F.col("complete") & (F.col("n_kmers") == 0)),
        ),
        _partial(rejects, reject=F.count("*")),
        _partial(promoted, promoted=F.count("*")),
    ]
    sums = reduce(DataFrame.unionByName, parts).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]
    )
    sums = sums.withColumn(
        "admit", F.col("seen") - F.col("lowqual") - F.col("skip") - F.col("reject")
    )
    share = lambda part, whole: 100.0 * F.col(part) / F.greatest(F.col(whole), F.lit(1))
    return sums.select(
        "seen",
        "lowqual",
        "skip",
        "reject",
        "admit",
        "promoted",
        share("lowqual", "seen").alias("lowqual_pct"),
        share("reject", "seen").alias("reject_pct"),
        share("admit", "seen").alias("admit_pct"),
        share("promoted", "seen").alias("promoted_pct"),
        share("promoted", "admit").alias("promoted_of_admit_pct"),
        (F.col("seen") / F.greatest(F.col("promoted"), F.lit(1))).alias("reduction"),
    )
