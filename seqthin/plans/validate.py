"""Does the kept set depend on the order of the records?"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqthin.config import ReduceConfig
from seqthin.operators.clusters import covered
from seqthin.operators.novelty import keep_novel
from seqthin.operators.signatures import KEY_LIMIT
from seqthin.plans.reduce import exact_scheme
from seqthin.workspace import Workspace

ORDER_STEP = 0x5DEECE66D
MEAN_COVERAGE, MAX_DRIFT = 0.98, 0.10


def shuffled(ord_: Column, order: int) -> Column:
    """A new order key; order 0 keeps the records' order.

    Xor and xor-shifts are one-to-one on 64 bits, so keys stay unique without
    numbering the records anew.
    """
    if order == 0:
        return ord_
    x = ord_.bitwiseXOR(F.lit(order * ORDER_STEP))
    for left, right in ((13, 7), (17, 11)):
        x = x.bitwiseXOR(F.shiftleft(x, left))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, right))
    return x


@dataclass
class OrderStudy:
    kept: list[DataFrame]  # (ord) per order
    counts: DataFrame  # one row: orders, low, high, mean_kept, drift
    coverage: DataFrame  # a, b, kept, covered, share
    verdict: DataFrame  # mean_coverage, min_coverage, drift, equivalent


def study_orders(
    sketches: DataFrame,
    cfg: ReduceConfig,
    ws: Workspace,
    orders: int = 4,
    key_limit: int = KEY_LIMIT,
) -> OrderStudy:
    """Keep novel records of (ord, sketch) in several orders and compare the kept sets."""
    scheme = exact_scheme(cfg)
    kept = []
    for o in range(orders):
        keyed = sketches.select(
            F.col("ord").alias("origin"), shuffled(F.col("ord"), o).alias("ord"), "sketch"
        )
        chosen = keep_novel(keyed.select("ord", "sketch"), scheme, [], ws, key_limit)
        back = keyed.join(chosen, "ord", "left_semi").select(F.col("origin").alias("ord"))
        kept.append(ws.table(back, f"order-{o}"))

    sizes = reduce(
        DataFrame.unionByName, [k.agg(F.count("*").alias("kept")) for k in kept]
    )
    counts = sizes.agg(
        F.count("*").alias("orders"),
        F.min("kept").alias("low"),
        F.max("kept").alias("high"),
        F.avg("kept").alias("mean_kept"),
    ).withColumn("drift", (F.col("high") - F.col("low")) / F.col("mean_kept"))

    cells = []
    for a in range(orders):
        for b in range(orders):
            if a != b:
                hit = covered(kept[a], kept[b], sketches, cfg.sketch, cfg.threshold, ws, key_limit)
                flagged = kept[a].join(hit.withColumn("hit", F.lit(True)), "ord", "left")
                cells.append(
                    flagged.agg(F.count("*").alias("kept"), F.count("hit").alias("covered")).select(
                        F.lit(a).alias("a"), F.lit(b).alias("b"), "kept", "covered"
                    )
                )
    coverage = ws.table(reduce(DataFrame.unionByName, cells), "coverage").withColumn(
        "share", F.col("covered") / F.greatest(F.lit(1), "kept")
    )
    means = coverage.agg(
        F.avg("share").alias("mean_coverage"), F.min("share").alias("min_coverage"), F.lit(1).alias("one")
    )
    verdict = means.join(counts.select("drift", F.lit(1).alias("one")), "one").select(
        "mean_coverage",
        "min_coverage",
        "drift",
        ((F.col("mean_coverage") > MEAN_COVERAGE) & (F.col("drift") < MAX_DRIFT)).alias("equivalent"),
    )
    return OrderStudy(kept, counts, coverage, verdict)
