"""Threshold and sketch size suggested by the data."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqthin.config import ReduceConfig
from seqthin.functions.calibrate import (
    divergence_boundary,
    divergence_floor,
    resolution_floor,
    sketch_bytes,
    threshold_for,
)
from seqthin.functions.similarity import equal_slots
from seqthin.operators.signatures import Scheme, tokens

PAIRS, PAIRS_SEED = 4096, 23
#: Records, and kept ones, that one comparison of a crowded band holds at most (by hash, so about).
TILE = 2048
#: Different sketches of a side that a task of :func:`pair_counts` holds (by hash, so about), and that it compares at once.
BLOCK, PART = 1 << 16, 1 << 12


def best_related(sketches: DataFrame, kept: DataFrame, cfg: ReduceConfig) -> DataFrame:
    """(j, i, equal): for every record the kept one most like it among those that share a band.

    The earliest of equally similar ones is taken; a record is not related to itself,
    and one that shares no band with a kept record has no row.  Copies share one comparison.
    Holders of a band are compared where they meet, in tiles of at most ``TILE`` records by
    ``TILE`` kept ones, and only the best of a tile leaves it: no pair is ever a row.
    """
    sketches = sketches.select("ord", "sketch").where("sketch IS NOT NULL")
    mine = sketches.join(kept.select("ord", F.lit(True).alias("kept")), "ord", "left")
    # Kept records stand for themselves; all others of equal sketch are one class.
    alone = F.when(F.col("kept"), F.col("ord"))
    classes = mine.groupBy("sketch", alone.alias("member")).agg(F.min("ord").alias("ord"))
    nodes = classes.select("ord", "sketch", F.col("member").isNotNull().alias("kept"))
    scheme = Scheme.of(cfg.sketch, cfg.bands, 0)
    toks = tokens(nodes, scheme, []).join(nodes.select("ord", "kept"), "ord")
    sizes = toks.groupBy("key").agg(F.count("*").alias("holders"), F.count_if("kept").alias("members"))
    # Others of the band meet here; alone under a key, or without kept ones, nobody does.
    sizes = sizes.where("holders > 1 AND members > 0")
    parts = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    drawn = lambda n: F.pmod(F.xxhash64("ord"), parts(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    met = toks.join(sizes, "key")
    asking = met.select("key", "ord", F.lit(False).alias("kept"), drawn("holders").alias("a"), every("members").alias("b"))
    asked = met.where("kept").select("key", "ord", "kept", every("holders").alias("a"), drawn("members").alias("b"))
    rows = asking.unionByName(asked).join(nodes.select("ord", "sketch"), "ord")
    rows = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "kept")
    found = rows.select("key", "a", "b", "kept", "ord", "sketch").mapInArrow(_best_of_tiles, "j bigint, i bigint, equal int")
    best = _best(found)
    # A class's best is that of all its records.
    named = classes.where("member IS NULL").select("sketch", F.col("ord").alias("class"))
    others = mine.where("kept IS NULL").join(named, "sketch").select("ord", "class")
    own = mine.where("kept").select("ord", F.col("ord").alias("class"))
    return _best(others.unionByName(own).join(best.withColumnRenamed("j", "class"), "class").select(
        F.col("ord").alias("j"), "i", "equal"
    )).select("j", "i", "equal")


def _best(found: DataFrame) -> DataFrame:
    return found.groupBy("j").agg(
        F.max_by("i", F.struct("equal", -F.col("i"))).alias("i"), F.max("equal").alias("equal")
    )


def _best_of_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best kept record of each record of a tile; rows come by tile, kept ones last."""

    out = []

    def compare(parts: list) -> None:
        kept, ord_ = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        held = np.concatenate([p[2] for p in parts])
        asking, asked = np.flatnonzero(~kept), np.flatnonzero(kept)
        asked = asked[np.argsort(ord_[asked], kind="stable")]
        if not len(asked) or not len(asking):
            return
        step = max(1, (1 << 18) // len(asked))
        for lo in range(0, len(asking), step):
            some = asking[lo : lo + step]
            equal = np.zeros((len(some), len(asked)), np.int32)
            for slot in range(held.shape[1]):
                equal += held[some, slot][:, None] == held[asked, slot][None, :]
            equal[ord_[some][:, None] == ord_[asked][None, :]] = -1
            # The first of the largest is the earliest kept one.
            at = equal.argmax(axis=1)
            most = equal[np.arange(len(some)), at]
            real = most >= 0
            out.append((ord_[some][real], ord_[asked[at]][real], most[real]))

    def given() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*out)]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["j", "i", "equal"])

    tile, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "a", "b")]
        kept, ord_ = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kept", "ord"))
        held = batch.column("sketch").flatten().to_numpy().reshape(batch.num_rows, -1)
        new = np.any([np.diff(c, prepend=c[0]) != 0 for c in names], axis=0)
        cut = np.append(0, np.flatnonzero(new))
        for lo, hi in zip(cut, np.append(cut[1:], batch.num_rows)):
            at = tuple(int(c[lo]) for c in names)
            if at != tile and parts:
                compare(parts)
                parts = []
                if len(out) > 1000:
                    yield given()
            tile = at
            if hi > lo:
                parts.append((kept[lo:hi], ord_[lo:hi], held[lo:hi]))
    if parts:
        compare(parts)
    if out:
        yield given()


def pair_counts(sketches: DataFrame, cfg: ReduceConfig) -> DataFrame:
    """(equal, n): how many pairs of different records agree in how many slots, over all pairs.

    Copies are compared once and weighed.  Sketches are dealt to blocks by hash, and a task
    has two blocks: what it holds is bounded, and no pair is ever a row.  Slots agree by
    sorted look-up, so pairs without an equal slot cost next to nothing; they are what is left.
    """
    sketches = sketches.select("sketch").where("sketch IS NOT NULL")
    records, cores = sketches.count(), sketches.sparkSession.sparkContext.defaultParallelism
    spread = math.ceil(math.sqrt(4 * cores))
    blocks = max(1, -(-records // BLOCK), min(-(-records // PART), spread))
    classes = sketches.groupBy("sketch").agg(F.count("*").alias("copies"))
    mine = classes.withColumn("block", F.pmod(F.xxhash64("sketch"), F.lit(blocks)).cast("int"))
    met = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    last = F.greatest("block", "other")
    tile = (last * (last + 1) / 2 + F.least("block", "other")).cast("int")
    rows = met.repartitionById(blocks * (blocks + 1) // 2, tile).select(
        (F.col("block") == F.col("other")).alias("alone"), (F.col("block") < F.col("other")).alias("first"), "copies", "sketch"
    )
    counts = rows.mapInArrow(_counted_tile(cfg.sketch), "equal int, n bigint")
    return counts.groupBy("equal").agg(F.sum("n").alias("n"))


def _counted_tile(m: int):
    """Counts the pairs of a partition, which has two blocks, or one with itself."""

    def parts(rows: list) -> list:
        if not rows:
            return []
        held, copies = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
        out = []
        for lo in range(0, len(held), PART):
            some = np.ascontiguousarray(held[lo : lo + PART].T)
            order = np.argsort(some, axis=1, kind="stable")
            out.append((order.astype(np.uint16), np.take_along_axis(some, order, 1), some, copies[lo : lo + PART]))
        return out

    def compared(a: tuple, b: tuple) -> np.ndarray:
        """Pairs of a record of ``a`` with one of ``b`` by equal slots, copies counted."""
        (order, there, own, left), (other, sought, against, right) = a, b
        size, width = len(left) * len(right), len(right)
        equal = np.zeros(size, np.min_scalar_type(m))
        lo, hi = (np.stack([np.searchsorted(t, s, side) for t, s in zip(there, sought)]) for side in ("left", "right"))
        hits, out = hi - lo, np.zeros(m + 1)
        if hits.sum() <= size:
            met = [np.zeros(0, np.int64)]
            for slot in range(m):
                some = np.flatnonzero(hits[slot])
                n = hits[slot, some]
                ends = np.cumsum(n)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo[slot, some] - (ends - n), n)
                # A pair is met once a slot at most.
                at = order[slot, at].astype(np.int64) * width + np.repeat(other[slot, some], n)
                equal[at] += 1
                met.append(at)
            at = np.concatenate(met)
            many = equal[at]
            weight = left[at // width] * right[at % width]
            # A pair with so many equal slots was met so many times.
            out += np.bincount(many, weight, m + 1) / np.maximum(1, np.arange(m + 1))
        else:
            equal, step = equal.reshape(len(left), width), max(1, (1 << 20) // width)
            for at in range(0, len(left), step):
                some = equal[at : at + step]
                for slot in range(m):
                    some += own[slot, at : at + step, None] == against[slot]
                out += np.bincount(some.reshape(-1), (left[at : at + step, None] * right).reshape(-1), m + 1)
        out = np.rint(out).astype(np.int64)
        out[0] = int(left.sum()) * int(right.sum()) - out[1:].sum()
        return out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, alone = ([], []), False
        for batch in batches:
            if not batch.num_rows:
                continue
            alone = batch.column("alone")[0].as_py()
            first = batch.column("first").to_numpy(zero_copy_only=False)
            held = batch.column("sketch").flatten().to_numpy().reshape(batch.num_rows, -1)
            copies = batch.column("copies").to_numpy()
            for side, which in zip(sides, (first, ~first)):
                side.append((held[which], copies[which]))
        one, two = (parts(side) for side in sides)
        out = np.zeros(m + 1, np.int64)
        for i, a in enumerate(two):
            for b in two[:i] if alone else one:
                out += compared(a, b)
            if alone:
                both, copies = compared(a, a), a[-1]
                both[m] -= (copies * copies).sum()
                out += both // 2
                out[m] += (copies * (copies - 1) // 2).sum()
        found = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(out[found])], names=["equal", "n"])

    return rows


def random_pairs(sketches: DataFrame, pairs: int = PAIRS, order: Column | None = None) -> DataFrame:
    """(i, j, equal) of ``pairs`` random pairs of different records, fewer if there are fewer records.

    The records that a hash puts first are taken, twice as many as pairs, and neighbours in
    that order are paired.  Every pair of records is equally likely, no record is in two
    pairs, and the work is one pass, whatever the number of records.
    """
    mixed = F.xxhash64(F.lit(PAIRS_SEED), "ord") if order is None else order
    few = sketches.select("ord", "sketch", mixed.alias("mixed")).orderBy("mixed", "ord").limit(2 * pairs)
    # At most twice `pairs` rows from here on.
    place = F.row_number().over(Window.orderBy("mixed", "ord")) - 1
    few = few.withColumn("pair", F.floor(place / 2))
    both = few.groupBy("pair").agg(
        F.count("*").alias("n"), F.min_by("ord", "mixed").alias("i"), F.max_by("ord", "mixed").alias("j"),
        F.min_by("sketch", "mixed").alias("a"), F.max_by("sketch", "mixed").alias("b"),
    )
    return both.where("n = 2").select("i", "j", equal_slots(F.col("a"), F.col("b")).alias("equal"))


def divergence(cfg: ReduceConfig) -> Column:
    """``-ln(2x / (1 + x)) / k`` of pairs that agree in a share x of their slots; 1 at most, and for none."""
    x = F.col("equal") / F.lit(float(cfg.sketch))
    return F.when(F.col("equal") == 0, 1.0).otherwise(F.least(F.lit(1.0), -F.log(2 * x / (1 + x)) / cfg.k))


def divergence_sketches(pairs: DataFrame, cfg: ReduceConfig, by: list[str]) -> DataFrame:
    """(``by``, sketch): quantile sketches of divergences, to be merged with ``kll_merge_agg_double``."""
    return pairs.groupBy(*by).agg(F.kll_sketch_agg_double(divergence(cfg)).alias("sketch"))


def rank_bound(pairs: Column, doubt: float = 0.01) -> Column:
    """How far the sample's median may be from the middle rank of all pairs, but for a chance of ``doubt``."""
    return F.sqrt(F.lit(math.log(2 / doubt)) / (2 * F.greatest(pairs, F.lit(1))))


def suggest(pairs: DataFrame, cfg: ReduceConfig) -> DataFrame:
    """Divergence of pairs and the settings that match its median; ``n``, if there is such a column, counts pairs of a row."""
    d = divergence(cfg)
    k, m = F.lit(cfg.k), F.lit(cfg.sketch)
    n = F.col("n") if "n" in pairs.columns else F.lit(1).cast("bigint")
    return pairs.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("pairs"), F.percentile(d, F.lit(0.5), n).alias("median_divergence"),
        (F.sum(d * n) / F.sum(n)).alias("mean_divergence"),
    ).select(
        "pairs",
        "median_divergence",
        "mean_divergence",
        rank_bound(F.col("pairs")).alias("rank_bound"),
        threshold_for(F.col("median_divergence"), k).alias("suggested_threshold"),
        divergence_boundary(F.lit(cfg.threshold), k).alias("boundary"),
        resolution_floor(m).alias("slot_resolution"),
        divergence_floor(m, k).alias("floor"),
        sketch_bytes(m).alias("bytes_per_record"),
        (resolution_floor(m) < F.col("median_divergence")).alias("resolves"),
    )
