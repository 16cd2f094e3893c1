"""Nearest kept records, cluster sizes and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqthin.functions.similarity import min_covering_slots
from seqthin.operators.novelty import first_of_equal
from seqthin.operators.signatures import (
    KEY_LIMIT,
    Scheme,
    compare,
    meeting_keys,
    pairs_between,
)
from seqthin.workspace import Workspace


def nearest_kept(
    records: DataFrame,
    kept: DataFrame,
    scheme: Scheme,
    partition: list[str],
    ws: Workspace,
    key_limit: int = KEY_LIMIT,
) -> DataFrame:
    """(ord, rep, equal): for each dropped record the most similar earlier kept one.

    Equal similarity goes to the earliest.  Copies share one sketch comparison:
    distinct sketches meet kept ones, and each copy then picks among those that
    precede it.
    """
    nodes = ws.table(first_of_equal(records.where("sketch IS NOT NULL"), partition), "sketches")
    toks, _, _ = meeting_keys(nodes, scheme, partition, ws, key_limit)
    # Copies of a kept record have it as their nearest, so its class looks for none.
    met = pairs_between(toks.join(kept, "ord", "left_anti"), toks.join(kept, "ord", "left_semi"))
    near = compare(met, nodes, scheme).select("i", F.col("j").alias("class"), "equal")
    itself = kept.select(
        F.col("ord").alias("i"), F.col("ord").alias("class"), F.lit(scheme.m).alias("equal")
    )
    near = ws.table(near.unionByName(itself), "near")
    keys = [*partition, "sketch"]
    member = records.join(kept, "ord", "left_anti").select("ord", *keys)
    member = member.join(nodes.withColumnRenamed("ord", "class"), keys).select("ord", "class")
    best = (
        member.join(near, "class")
        .where("i < ord")
        .groupBy("ord")
        .agg(F.max("equal").alias("equal"), F.max_by(-F.col("i"), F.struct("equal", -F.col("i"))).alias("rep"))
    )
    return best.select("ord", (-F.col("rep")).alias("rep"), "equal")


def cluster_sizes(kept: DataFrame, nearest: DataFrame) -> DataFrame:
    """(rep, members) for every kept record, itself included."""
    every = kept.select(F.col("ord").alias("rep")).unionByName(nearest.select("rep"))
    return every.groupBy("rep").agg(F.count("*").alias("members"))


def covered(
    a: DataFrame,
    b: DataFrame,
    sketches: DataFrame,
    m: int,
    threshold: float,
    ws: Workspace,
    key_limit: int = KEY_LIMIT,
) -> DataFrame:
    """(ord) of the records of ``a`` within ``threshold`` of some record of ``b``."""
    need = min_covering_slots(m, threshold)
    same = a.join(b, "ord", "left_semi")
    if need > m:
        return a.where("false")
    scheme = Scheme.exhaustive(m, need)
    union = ws.table(a.unionByName(b).distinct(), "union")
    nodes = ws.table(sketches.select("ord", "sketch").join(union, "ord", "left_semi"), "sketches")
    toks, _, _ = meeting_keys(nodes, scheme, [], ws, key_limit)
    # Records of both sets are covered by themselves.
    alone = a.join(b, "ord", "left_anti")
    met = pairs_between(toks.join(alone, "ord", "left_semi"), toks.join(b, "ord", "left_semi"))
    close = compare(met, nodes, scheme).select(F.col("j").alias("ord"))
    return same.unionByName(close).distinct()
