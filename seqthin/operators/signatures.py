"""Join keys under which redundant records meet.

A sketch is cut into groups of slots and each group is hashed, with the
partition it belongs to, to one join key.  If two sketches may differ in at
most ``d`` slots to be redundant, they agree on at least ``groups - d`` whole
groups, so no redundant pair is missed and pairs that share fewer keys need no
comparison.

Keys that very many records hold are avoided by prefix filtering: when two
records share ``s`` of ``g`` keys, the ``g - s + 1`` rarest keys of each, in one
global order, already meet.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqthin.functions.similarity import equal_slots, min_equal_slots
from seqthin.workspace import Workspace

KEY_LIMIT = 64
SALTS = 16


@dataclass(frozen=True)
class Scheme:
    """How sketches of ``m`` slots are cut, and what redundancy implies."""

    m: int
    need: int  # agreeing slots that make a pair redundant
    groups: int
    width: int
    bands: int = 0  # redundant pairs also agree on one of so many bands (0: no such rule)

    @classmethod
    def of(cls, m: int, bands: int, need: int) -> "Scheme":
        if m // bands:
            return cls(m, need, bands, m // bands)
        # Fewer slots than bands: every pair of a partition is compared.
        return cls(m, need, m, 1) if need > 0 else cls(m, need, 1, 0)

    @classmethod
    def exhaustive(cls, m: int, need: int, groups: int = 16) -> "Scheme":
        """Enough groups that every pair agreeing in ``need`` slots shares a key."""
        differ = m - need
        if need < 1 or differ < min(groups, m):
            return cls.of(m, groups, need)
        groups = min(m, 2 * (differ + 1))
        return cls(m, need, groups, m // groups)

    @property
    def shared(self) -> int:
        """Keys a redundant pair surely shares (at least one is always required)."""
        return max(1, self.groups - (self.m - self.need))

    @property
    def prefix(self) -> int:
        return self.groups - self.shared + 1

    def keys(self, sketch: Column, partition: list[Column]) -> Column:
        return F.array(*[
            F.xxhash64(F.lit(g), *partition, *[sketch[g * self.width + i] for i in range(self.width)])
            for g in range(self.groups)
        ])


def novelty_scheme(m: int, bands: int, threshold: float) -> Scheme:
    """Records resemble each other if they share a band and enough slots.

    Where that implies a single shared band only, a band many unlike records hold
    could not be avoided.  There records meet under finer groups, of which they
    surely share several, and pairs are asked for a shared band at the end.
    """
    need = min_equal_slots(m, threshold)
    plain = Scheme.of(m, bands, need)
    fine = Scheme.exhaustive(m, need, bands)
    if m // bands and plain.shared == 1 and fine.shared > 1:
        return replace(fine, bands=bands)
    return plain


def tokens(sketches: DataFrame, scheme: Scheme, partition: list[str]) -> DataFrame:
    """(ord, key): one row per record and slot group."""
    keys = scheme.keys(F.col("sketch"), [F.col(p) for p in partition])
    return sketches.select("ord", F.explode(keys).alias("key"))


def crowded_keys(toks: DataFrame, limit: int) -> DataFrame:
    """Keys held by more than ``limit`` records."""
    return toks.groupBy("key").agg(F.count("*").alias("holders")).where(F.col("holders") > limit)


def rarest(toks: DataFrame, crowded: DataFrame, scheme: Scheme) -> DataFrame:
    """Prefix filter: each record's rarest keys, enough for every redundant pair to meet."""
    rank = F.row_number().over(
        Window.partitionBy("ord").orderBy(F.coalesce("holders", F.lit(0)), "key")
    )
    return (
        toks.join(crowded, "key", "left")
        .withColumn("rank", rank)
        .where(F.col("rank") <= scheme.prefix)
        .select("ord", "key")
    )


def meeting_keys(
    sketches: DataFrame, scheme: Scheme, partition: list[str], ws: Workspace, limit: int
) -> tuple[DataFrame, bool, bool]:
    """Tokens; whether they were prefix filtered; whether crowded keys remain."""
    toks = tokens(sketches, scheme, partition)
    crowded = crowded_keys(toks, limit)
    if crowded.isEmpty():
        return toks, False, False
    if scheme.prefix == scheme.groups:
        return ws.table(toks, "tokens"), False, True
    toks = ws.table(rarest(toks, crowded, scheme), "tokens")
    return toks, True, not crowded_keys(toks, limit).isEmpty()


def pairs_within(toks: DataFrame, min_shared: int = 1) -> DataFrame:
    """Candidate pairs (i, j), i before j, among records meeting under uncrowded keys."""
    a = toks.select("key", F.col("ord").alias("i"))
    b = toks.select("key", F.col("ord").alias("j"))
    met = a.join(b, "key").where("i < j")
    return met.groupBy("i", "j").agg(F.count("*").alias("shared")).where(
        F.col("shared") >= min_shared
    ).select("i", "j")


def pairs_between(left: DataFrame, right: DataFrame) -> DataFrame:
    """Candidate pairs (i from ``right``, j from ``left``) meeting under a key.

    ``left`` may hold most of its rows under one key, so its keys are salted
    and ``right`` is replicated over the salts that ``left`` has of a key; what
    ``right`` holds under other keys is sent once, not replicated.
    """
    a = left.select("key", F.col("ord").alias("j"), F.pmod(F.col("ord"), F.lit(SALTS)).cast("int").alias("salt"))
    b = right.select("key", F.col("ord").alias("i")).join(a.select("key", "salt").distinct(), "key")
    return a.join(b, ["key", "salt"]).where("i <> j").select("i", "j").distinct()


def shares_band(a: Column, b: Column, m: int, bands: int) -> Column:
    """Whether two sketches agree on all slots of some band."""
    width = m // bands
    numbers = F.sequence(F.lit(0), F.lit(bands - 1))
    return F.exists(numbers, lambda g: F.slice(a, g * width + 1, width) == F.slice(b, g * width + 1, width))


def compare(pairs: DataFrame, sketches: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs whose sketches are redundant under ``scheme``, with the number of agreeing slots."""
    a = sketches.select(F.col("ord").alias("i"), F.col("sketch").alias("sketch_i"))
    b = sketches.select(F.col("ord").alias("j"), F.col("sketch").alias("sketch_j"))
    scored = pairs.join(a, "i").join(b, "j")
    if scheme.bands:
        scored = scored.where(shares_band(F.col("sketch_i"), F.col("sketch_j"), scheme.m, scheme.bands))
    return scored.select(
        "i", "j", equal_slots(F.col("sketch_i"), F.col("sketch_j")).alias("equal")
    ).where(F.col("equal") >= scheme.need)
