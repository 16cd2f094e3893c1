"""Admission: reject records with outlying numbers of never-seen k-mers.

A record's *singletons* are its k-mers no earlier admitted record holds.  The
record is rejected when their number exceeds the running mean of the earlier
records of its shard by ``outlier_sd`` deviations.  Rejected records do not
count as holders, so each verdict depends on earlier ones.

That feedback is solved as a fixpoint.  For an assumed reject set R, the first
holder of every cell is a grouped minimum over records outside R, which gives
all singleton counts and a new reject set.  If R is right for the first n
records the new set is right for n + 1, so the iteration ends, at exactly the
answer of a record-by-record pass; it rarely takes more than a few rounds.

Only cells a rejected record touches before all others can change between rounds.
One more pass gathers who touches them: all records of the
*cover* (those rejected so far, and their copies, which are next in line once the
first one holds nothing), and of all others the first.  k-mers travel to it as runs,
which are cut from the sequences once and written,
and leave it as one row for each set of holders; Count-Min cells are combined on the
map side.  Rounds run on what is left.  A round that rejects records outside the cover
widens it, and then not by these alone: relatives of rejected records are next in line
one after the other, each of them a pass of its own otherwise, so all of them come in,
and so do records that are close to their limit.  Any assumed set leads to the same
end, so rounds begin with the copies and relatives rejected, which spares a round for
each of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqthin.config import ReduceConfig
from seqthin.functions.kernels import CMS_SEEDS
from seqthin.operators import sketch, superkmers
from seqthin.operators.kmers import count_won_kmers, explode_cells
from seqthin.sources.order import ROWS_PER_CHUNK, chunked, running_totals
from seqthin.workspace import Workspace

KEY = ["shard", "ord"]
BROADCAST_CELLS = 2_000_000
#: Share of its limit from which a record joins a cover that is widened.
CLOSE = 0.75


@dataclass
class History:
    """What earlier batches leave behind: touched cells and running sums per shard."""

    cells: DataFrame  # shard, cell
    sums: DataFrame  # shard, n, s, q
    first: DataFrame | None = None  # first holders of the batch's cells, if they are known already


@dataclass
class Admission:
    rejects: DataFrame  # shard, ord
    scored: DataFrame  # shard, ord, n_singleton, n_prior, mean, deviation, reject
    rounds: int
    runs: DataFrame | None = None  # runs of all k-mers of the records that pass the gate, if they were written


def outlier_test(
    counts: DataFrame, cfg: ReduceConfig, history: History | None = None
) -> DataFrame:
    """Judge (shard, ord, n_singleton, chunk) against the records before each one."""
    n = F.col("n_singleton")
    out = running_totals(
        counts,
        ["shard"],
        "ord",
        {"n_prior": F.lit(1).cast("bigint"), "s_prior": n, "q_prior": (n * n).cast("decimal(20,0)")},
    )
    if history is not None:
        out = out.join(history.sums, "shard", "left").withColumns({
            "n_prior": F.col("n_prior") + F.coalesce("n", F.lit(0)),
            "s_prior": F.col("s_prior") + F.coalesce("s", F.lit(0)),
            "q_prior": F.col("q_prior") + F.coalesce("q", F.lit(0)),
        })
    prior = F.nullif(F.col("n_prior"), F.lit(0)).cast("double")
    out = out.withColumn("mean", F.col("s_prior").cast("double") / prior)
    variance = F.col("q_prior").cast("double") / prior - F.col("mean") * F.col("mean")
    out = out.withColumn("deviation", F.sqrt(F.greatest(F.lit(0.0), variance)))
    # At least ``warmup`` scored records before this one implies as many records of any kind.
    limit = F.col("mean") + F.lit(float(cfg.outlier_sd)) * F.col("deviation") + 0.5
    return out.select(
        *KEY,
        "n_singleton",
        "n_prior",
        "s_prior",
        "q_prior",
        "mean",
        "deviation",
        F.coalesce((F.col("n_prior") >= cfg.warmup) & (n > limit), F.lit(False)).alias("reject"),
    )


def first_holders(
    passing: DataFrame, cfg: ReduceConfig, targets: int = superkmers.FEWEST_TARGETS
) -> DataFrame:
    """(shard, cell, ord): first record of each shard to touch each cell."""
    if cfg.frequency == "exact":
        return superkmers.first_holders_of_kmers(passing, cfg, targets)
    return sketch.first_touches(passing, cfg)


def singleton_counts(
    passing: DataFrame, cfg: ReduceConfig, targets: int = superkmers.FEWEST_TARGETS
) -> DataFrame:
    """(shard, ord, n_singleton) where every record counts as a holder; records without any may be missing."""
    if cfg.frequency == "exact":
        return superkmers.first_holder_counts(passing, cfg, targets).withColumnRenamed("n", "n_singleton")
    if sketch.travels(cfg):
        return sketch.unseen_kmers(passing, sketch.touch_slices(passing, cfg), cfg)
    return _count_singletons(sketch.first_touches(passing, cfg), passing, cfg)


def _first_by(touches: DataFrame, keys: list[str], cfg: ReduceConfig) -> DataFrame:
    """Lowest ord per shard and keys; one shard needs no column in the grouping key."""
    lowest = F.min("ord").alias("ord")
    if cfg.shards > 1:
        return touches.groupBy("shard", *keys).agg(lowest)
    return touches.groupBy(*keys).agg(lowest).select(F.lit(0).alias("shard"), *keys, "ord")


def _count_singletons(won: DataFrame, passing: DataFrame, cfg: ReduceConfig) -> DataFrame:
    """Singletons per record from the cells each record holds first."""
    if cfg.frequency == "exact":
        return won.groupBy(*KEY).agg(F.count("*").alias("n_singleton"))
    # A k-mer is unseen when any of its cells is; a record wins no more cells than it touches.
    lists = won.groupBy(*KEY).agg(F.collect_list("cell").alias("cells"))
    return count_won_kmers(passing.select(*KEY, "seq").join(lists, KEY), cfg)


def _copies(profile: DataFrame, some: DataFrame) -> DataFrame:
    """Records of the same shard whose sketch equals that of one of ``some``."""
    keyed = profile.where("sketch IS NOT NULL").select(
        *KEY, F.xxhash64("shard", "sketch").alias("a"), F.xxhash64(F.lit(1), "shard", "sketch").alias("b")
    )
    wanted = keyed.join(some, KEY, "left_semi").select("a", "b").distinct()
    return keyed.join(wanted, ["a", "b"], "left_semi").select(*KEY)


def _relatives(profile: DataFrame, some: DataFrame, m: int) -> DataFrame:
    """Records of the same shard that agree with those of ``some`` before them in an eighth of their pairs of slots.

    Earlier records gain nothing when a later one is rejected.
    """
    pairs = m // 2
    if not pairs:
        return _copies(profile, some)
    keys = [F.xxhash64(F.lit(g), "shard", F.col("sketch")[2 * g], F.col("sketch")[2 * g + 1]) for g in range(pairs)]
    toks = profile.where("sketch IS NOT NULL").select(*KEY, F.explode(F.array(*keys)).alias("key"))
    wanted = toks.join(some, KEY, "left_semi").groupBy("key").agg(F.min("ord").alias("since"))
    met = toks.join(wanted, "key").where("ord >= since").groupBy(*KEY).agg(F.count("*").alias("n"))
    return met.where(F.col("n") >= max(1, pairs // 8)).select(*KEY)


def _close(scored: DataFrame, cfg: ReduceConfig) -> DataFrame:
    """Records that are not far from being rejected."""
    limit = F.col("mean") + F.lit(float(cfg.outlier_sd)) * F.col("deviation") + 0.5
    return scored.where((F.col("n_prior") >= cfg.warmup) & (F.col("n_singleton") > CLOSE * limit)).select(*KEY)


def admit(
    quality: DataFrame,
    profile: DataFrame,
    cfg: ReduceConfig,
    ws: Workspace,
    history: History | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> Admission:
    """Run the admission fixpoint over the records that pass the gate."""
    passing = quality.select(*KEY, "seq", "complete")
    usable = profile.where("complete AND n_kmers > 0").select(*KEY, "n_kmers")
    size = usable.agg(F.count("*").alias("records"), F.coalesce(F.sum("n_kmers"), F.lit(0)).alias("kmers")).first()
    targets = superkmers.target_count(size["kmers"])
    first = runs = None
    if cfg.frequency == "exact":
        runs = superkmers.runs_of(passing, cfg, targets)
    if history is not None:
        # The batch's cells meet those of earlier batches, not the other way round.
        first = first_holders(passing, cfg, targets) if history.first is None else history.first
        first = ws.table(first.join(history.cells, ["shard", "cell"], "left_anti"), "first-holders")
        counts = _count_singletons(first, passing, cfg)
    elif cfg.frequency != "exact":
        slices = ws.table(sketch.touch_slices(passing, cfg), "first-touches")  # no larger than the sketch
        first = sketch._cells(slices, "ord")
        counts = sketch.unseen_kmers(passing, slices, cfg) if sketch.travels(cfg) else _count_singletons(first, passing, cfg)
    else:
        runs = ws.table(runs, "runs")
        counts = superkmers.first_holder_counts_of(runs, cfg).withColumnRenamed("n", "n_singleton")
    base = usable.join(counts, KEY, "left").select(
        *KEY, F.coalesce("n_singleton", F.lit(0)).cast("bigint").alias("n_singleton")
    )
    base = chunked(base, ws, KEY, rows_per_chunk, size["records"])
    scored = outlier_test(base, cfg, history)
    rejects = ws.table(scored.where("reject").select(*KEY), "rejects")
    if rejects.isEmpty():
        return Admission(rejects, scored, 1, runs if history is None else None)

    # Copies and relatives of a rejected record become singleton-rich once it holds nothing.
    near = rejects.unionByName(_copies(profile, rejects)).unionByName(_relatives(profile, rejects, cfg.sketch))
    rejects, rounds = ws.table(near.distinct(), "rejects"), 1
    cover = ws.table(rejects.unionByName(_close(scored, cfg)).distinct(), "cover")
    view = _view(first, runs, passing, base, usable, cover, cfg, ws, history)
    while True:
        rounds += 1
        scored = outlier_test(view.counts(rejects), cfg, history)
        latest = ws.table(scored.where("reject").select(*KEY), "rejects")
        change = (
            latest.withColumn("now", F.lit(True))
            .join(rejects.withColumn("was", F.lit(True)), KEY, "full_outer")
            .join(cover.withColumn("covered", F.lit(True)), KEY, "left")
            .agg(
                F.count_if(F.col("now").isNull() | F.col("was").isNull()).alias("moved"),
                F.count_if(F.col("now").isNotNull() & F.col("covered").isNull()).alias("escaped"),
            )
            .first()
        )
        if change["moved"] == 0:
            return Admission(rejects, scored, rounds, runs if history is None else None)
        rejects = latest
        if change["escaped"]:
            rejects = ws.table(latest.unionByName(_relatives(profile, latest, cfg.sketch)).distinct(), "rejects")
            wider = cover.unionByName(rejects).unionByName(_close(scored, cfg))
            cover = ws.table(wider.distinct(), "cover")
            view = _view(first, runs, passing, base, usable, cover, cfg, ws, history)


def _view(first, runs, passing, base, usable, cover, cfg, ws, history):
    if cfg.frequency == "exact":
        return _Contended(runs, base, cover, cfg, ws, history)
    return _Disputed(first, passing, base, usable, cover, cfg, ws, history)


def _undisputed_base(base: DataFrame, member: DataFrame) -> DataFrame:
    """All cells a cover record holds first are disputed; its count starts from zero."""
    return base.join(member, KEY, "left").select(
        *KEY, "chunk", F.when(F.col("member"), 0).otherwise(F.col("n_singleton")).alias("n_singleton")
    )


class _Contended:
    """k-mers a cover record holds before every record outside the cover, each with its holders in order."""

    def __init__(self, runs, base, cover, cfg, ws, history):
        member = cover.select(*KEY, F.lit(True).alias("member"))
        held = superkmers.contenders(runs, cover, cfg, merge=history is None)
        if history is not None:
            # What earlier batches hold is nobody's in this one.
            held = held.join(history.cells, ["shard", "cell"], "left_anti")
        self.held = ws.table(held, "disputed")
        self.base = _undisputed_base(base, member)

    def counts(self, rejects: DataFrame) -> DataFrame:
        """Singletons of every record if exactly ``rejects`` are rejected."""
        total = F.col("n_singleton") + F.coalesce("extra", F.lit(0))
        return self.base.join(superkmers.won_cells(self.held, rejects), KEY, "left").select(
            *KEY, "chunk", total.cast("bigint").alias("n_singleton")
        )


class _Disputed:
    """Count-Min cells a cover record touches before every record outside the cover.

    ``holders`` has, per such cell, the cover records that touch it and the
    first other one; later records can never hold the cell first.
    """

    def __init__(self, first, passing, base, usable, cover, cfg, ws, history):
        self.cfg, self.cover = cfg, cover
        member = cover.select(*KEY, F.lit(True).alias("member"))
        flagged = passing.join(member, KEY, "left").withColumn(
            "cover_ord", F.when(F.col("member"), F.col("ord"))
        )
        mine = explode_cells(passing.join(cover, KEY, "left_semi"), cfg, KEY).select("shard", "cell")
        if history is not None:
            # What earlier batches hold is nobody's in this one.
            mine = mine.join(history.cells, ["shard", "cell"], "left_anti")
        at_most = usable.join(cover, KEY, "left_semi").agg(F.sum("n_kmers")).first()[0] or 0
        small = at_most * len(CMS_SEEDS) <= BROADCAST_CELLS
        if small:
            # Cells outside the cover's are dropped where they are made.
            mine = ws.table(mine.distinct(), "cover-cells")
            wanted = np.unique(mine.select("cell").toArrow().column("cell").to_numpy().view(np.uint64))
            touches = explode_cells(flagged, cfg, [*KEY, "cover_ord"], wanted)
            if cfg.shards > 1 or history is not None:
                touches = touches.join(F.broadcast(mine), ["shard", "cell"], "left_semi")
        else:
            touches = explode_cells(flagged, cfg, [*KEY, "cover_ord"])
        # Records outside the cover are never rejected, so of them only the first matters.
        who = _first_by(touches, ["cell", "cover_ord"], cfg)
        if not small:
            who = who.join(mine.distinct(), ["shard", "cell"], "left_semi")
        who = ws.table(who, "holders")
        cells = ws.table(_disputed_cells(who), "disputed")
        before = who.where("cover_ord IS NOT NULL").join(cells, ["shard", "cell"])
        self.holders = (
            before.where("clear IS NULL OR ord < clear").select("shard", "cell", "ord")
            .unionByName(
                cells.where("clear IS NOT NULL")
                .select("shard", "cell", F.col("clear").alias("ord"))
            )
        )
        self.holders = ws.table(self.holders, "contenders")
        suspects = self.holders.select(*KEY).distinct()
        self.sequences = ws.table(passing.join(suspects, KEY, "left_semi"), "suspects")
        self.undisputed = ws.table(
            first.join(suspects, KEY, "left_semi").join(cover, KEY, "left_anti"), "undisputed"
        )
        self.base = _undisputed_base(base, member)

    def counts(self, rejects: DataFrame) -> DataFrame:
        """Singletons of every record if exactly ``rejects`` are rejected."""
        cell = ["shard", "cell"]
        first = (
            self.holders.join(rejects, KEY, "left_anti")
            .groupBy(*cell)
            .agg(F.min("ord").alias("ord"))
        )
        unseen = (
            self.holders.join(rejects, KEY, "left_semi")
            .join(first.select(*cell, F.col("ord").alias("first")), cell, "left")
            .where("first IS NULL OR first > ord")
            .select(*first.columns)
        )
        won = first.unionByName(unseen)
        own = self.undisputed.join(won.select(*KEY).distinct(), KEY, "left_semi")
        extra = _count_singletons(own.unionByName(won), self.sequences, self.cfg)
        extra = extra.withColumnRenamed("n_singleton", "extra")
        total = F.coalesce("extra", "n_singleton")
        return self.base.join(extra, KEY, "left").select(
            *KEY, "chunk", total.cast("bigint").alias("n_singleton")
        )


def _disputed_cells(who: DataFrame) -> DataFrame:
    """(shard, cell, clear): cells a cover record touches before ``clear``."""
    per_cell = who.groupBy("shard", "cell").agg(
        F.min(F.when(F.col("cover_ord").isNull(), F.col("ord"))).alias("clear"),
        F.min("cover_ord").alias("lowest"),
    )
    return per_cell.where("lowest IS NOT NULL AND (clear IS NULL OR lowest < clear)").select("shard", "cell", "clear")


def new_cells(
    passing: DataFrame, admission: Admission, cfg: ReduceConfig, history: History,
    targets: int = superkmers.FEWEST_TARGETS,
) -> DataFrame:
    """(shard, cell) touched by admitted records and by none before them."""
    kept = passing.join(admission.rejects, KEY, "left_anti")
    cells = first_holders(kept, cfg, targets).select("shard", "cell")
    return cells.join(history.cells, ["shard", "cell"], "left_anti")


def next_sums(admission: Admission, history: History) -> DataFrame:
    """Running sums per shard after this batch."""
    n = F.col("n_singleton")
    batch = admission.scored.select(
        "shard",
        F.lit(1).cast("bigint").alias("n"),
        n.alias("s"),
        (n * n).cast("decimal(38,0)").alias("q"),
    )
    return (
        history.sums.unionByName(batch)
        .groupBy("shard")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").cast("decimal(38,0)").alias("q"))
    )
