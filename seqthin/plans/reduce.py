"""Whole runs: the full reduction, admission alone, novelty alone."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seqthin.config import ReduceConfig
from seqthin.functions.calibrate import binomial_cutoff
from seqthin.functions.text import month_bucket, truncated_header
from seqthin.operators import clusters
from seqthin.operators.admission import KEY, Admission, admit
from seqthin.operators.emit import emitted, four_places
from seqthin.operators.gate import ADMIT, LOWQUAL, REJECT, SKIP, with_quality
from seqthin.operators.kmers import profiles
from seqthin.operators.novelty import keep_novel
from seqthin.operators.report import report
from seqthin.functions.similarity import min_equal_slots
from seqthin.operators.signatures import KEY_LIMIT, Scheme, novelty_scheme
from seqthin.sources.order import ROWS_PER_CHUNK, with_ordinal, with_shard
from seqthin.workspace import Workspace


def profile_counters() -> list[Column]:
    """What the profile's write observes."""
    return [
        F.count(F.lit(1)).alias("seen"),
        F.count_if(~F.col("complete")).alias("lowqual"),
        F.count_if(F.col("complete") & (F.col("n_kmers") == 0)).alias("skip"),
        F.sum("len").alias("bases"),
        F.sum("n_kmers").alias("kmers"),
    ]


def partition_columns(cfg: ReduceConfig, within_shard: bool = True) -> list[str]:
    return (["shard"] if within_shard else []) + (["mbucket"] if cfg.by_month else [])


@dataclass
class Reduction:
    """Results of a run; every field is a DataFrame over written tables."""

    cfg: ReduceConfig
    ws: Workspace
    records: DataFrame  # shard, ord, header, seq
    profile: DataFrame  # shard, ord, header, mbucket, len, n_frac, complete, n_kmers, sketch
    admission: Admission
    shard_kept: DataFrame | None  # ord
    kept: DataFrame | None  # ord
    seen: Observation | None = None

    @property
    def admitted(self) -> DataFrame:
        usable = self.profile.where("complete AND n_kmers > 0")
        return usable.join(self.admission.rejects, KEY, "left_anti")

    @property
    def promoted(self) -> DataFrame:
        return self.profile.join(self.kept, "ord", "left_semi").select(
            "shard", "ord", "header", "mbucket", "n_kmers", "sketch"
        )

    def report(self) -> DataFrame:
        return report(self.profile, self.admission.rejects, self.kept)

    def counters(self) -> dict[str, int]:
        """Records per verdict and bases, as the run observed them while it wrote its tables."""
        rows: dict[str, int] = {}
        for phase in self.ws.phases:
            rows[phase.name] = phase.rows  # of the last table of that name
        out = {c: int(self.seen.get[c] or 0) for c in ("seen", "lowqual", "skip", "bases", "kmers")}
        out["reject"] = rows.get("rejects", 0)
        out["admit"] = out["seen"] - out["lowqual"] - out["skip"] - out["reject"]
        return out

    def timing(self) -> DataFrame:
        """(step, phase, rows, seconds, rows_per_second) of every table the run has written so far."""
        rows = [(i, p.name, p.rows, p.seconds, p.rows / max(p.seconds, 1e-9)) for i, p in enumerate(self.ws.phases, 1)]
        return self.ws.spark.createDataFrame(rows, "step int, phase string, rows bigint, seconds double, rows_per_second double")

    def emitted(self, by: str = "ord") -> DataFrame:
        return emitted(self.records, self.promoted, by)

    def nearest(self) -> DataFrame:
        scheme = novelty_scheme(self.cfg.sketch, self.cfg.bands, self.cfg.threshold)
        partition = partition_columns(self.cfg, within_shard=self.cfg.shards > 1)
        wanted = self.admitted.select("ord", "sketch", *partition)
        return clusters.nearest_kept(wanted, self.kept, scheme, partition, self.ws)

    def decisions(self) -> DataFrame:
        """One row per record: the admission verdict and its evidence."""
        return decisions(self.profile, self.admission, self.cfg, self.ws)

    def release(self) -> None:
        """Delete the run's tables; nothing derived from it can be read afterwards."""
        self.ws.release()


def decisions(
    profile: DataFrame, admission: Admission, cfg: ReduceConfig, ws: Workspace
) -> DataFrame:
    rows = profile.drop("sketch").join(admission.scored, KEY, "left")
    verdict = (
        F.when(~F.col("complete"), LOWQUAL)
        .when(F.col("n_kmers") == 0, SKIP)
        .when(F.col("reject"), REJECT)
        .otherwise(ADMIT)
    )
    rows = with_ordinal(rows, ws, "ord", "n", ["shard"])
    return rows.select(
        "shard",
        "ord",
        "n",
        verdict.alias("decision"),
        "len",
        "n_frac",
        "n_kmers",
        "n_singleton",
        (F.col("n_singleton") / F.greatest(F.lit(1), "n_kmers")).alias("singleton_frac"),
        binomial_cutoff(F.greatest(F.lit(1), F.col("n") - 1), cfg.err_rate, cfg.cutoff_mass).alias("cutoff"),
        "header",
    )


def decision_lines(rows: DataFrame, with_ratio: bool = True) -> DataFrame:
    """Printable admission decisions; records without k-mers have none."""
    ratio = [four_places(F.col("singleton_frac")).alias("singleton_frac")] if with_ratio else []
    return rows.where(F.col("decision").isin(ADMIT, REJECT)).select(
        "decision",
        "len",
        four_places(F.col("n_frac")).alias("n_frac"),
        "n_kmers",
        "n_singleton",
        *ratio,
        "cutoff",
        "header",
    )


def novelty_lines(rows: DataFrame) -> DataFrame:
    """Printable novelty decisions of (decision, len, n_frac, novelty, header).

    ``novelty`` is one minus the similarity to the nearest kept record; it is empty
    for records that are kept or not compared.
    """
    return rows.select(
        "decision",
        "len",
        four_places(F.col("n_frac")).alias("n_frac"),
        four_places(F.col("novelty")).alias("novelty"),
        "header",
    )


class Reducer:
    """Runs reductions with one configuration."""

    def __init__(
        self,
        spark: SparkSession,
        cfg: ReduceConfig,
        key_limit: int = KEY_LIMIT,
        rows_per_chunk: int = ROWS_PER_CHUNK,
    ):
        self.spark, self.cfg = spark, cfg
        self.key_limit, self.rows_per_chunk = key_limit, rows_per_chunk
        self.ws = Workspace(spark, measured=True)

    def _placed(self, records: DataFrame) -> DataFrame:
        if "shard" in records.columns:
            if self.cfg.shards == 1:
                raise ValueError("records carry shards; set cfg.shards to their number")
            return records
        return with_shard(records, self.ws, self.cfg.shards, self.rows_per_chunk)

    def _limited(self, records: DataFrame) -> DataFrame:
        """At most ``limit`` records of each shard."""
        if not self.cfg.limit:
            return records
        if self.cfg.shards == 1:
            return records.where(F.col("ord") <= self.cfg.limit)
        numbered = with_ordinal(records, self.ws, "ord", "n", ["shard"], self.rows_per_chunk)
        return numbered.where(F.col("n") <= self.cfg.limit).drop("n")

    def run(self, records: DataFrame) -> Reduction:
        """Gate, admission, novelty within shards, then novelty across shards."""
        return self.with_novelty(self.gated_admission(records))

    def with_novelty(self, gated: Reduction) -> Reduction:
        """The result of :meth:`gated_admission`, taken to its end."""
        shard_kept, kept = self._novelty(gated.admitted)
        return replace(gated, shard_kept=shard_kept, kept=kept)

    def gated_admission(self, records: DataFrame) -> Reduction:
        """Gate and admission; the result has no kept records."""
        records = self._limited(self._placed(records))
        quality = with_quality(records, self.cfg)
        seen = Observation()
        profile = self.ws.table(profiles(quality, self.cfg).observe(seen, *profile_counters()), "profile")
        admission = admit(quality, profile, self.cfg, self.ws, None, self.rows_per_chunk)
        return Reduction(self.cfg, self.ws, records, profile, admission, None, None, seen)

    def admission_only(self, records: DataFrame) -> DataFrame:
        """Admission decisions for every record, without a completeness gate."""
        cfg = self.cfg.but(min_len=0, max_n_frac=1.0)
        quality = with_quality(self._limited(self._placed(records)), cfg)
        profile = self.ws.table(profiles(quality, cfg), "profile")
        admission = admit(quality, profile, cfg, self.ws, None, self.rows_per_chunk)
        return decisions(profile, admission, cfg, self.ws)

    def novelty_only(self, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(profile, kept within shards, kept overall): no gate, no admission, no months."""
        cfg = self.cfg.but(min_len=0, max_n_frac=1.0, by_month=False)
        quality = with_quality(self._limited(self._placed(records)), cfg)
        profile = self.ws.table(profiles(quality, cfg), "profile")
        runner = Reducer(self.spark, cfg, self.key_limit, self.rows_per_chunk)
        return (profile, *runner._novelty(profile.where("n_kmers > 0")))

    def exact_neighbours(self, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(profile, kept): gate and novelty against every kept record, without bands."""
        quality = with_quality(self._limited(self._placed(records)), self.cfg)
        profile = self.ws.table(profiles(quality, self.cfg), "profile")
        scheme = exact_scheme(self.cfg)
        wanted = profile.where("complete AND n_kmers > 0").select("ord", "sketch")
        return profile, keep_novel(wanted, scheme, [], self.ws, self.key_limit)

    def _novelty(self, admitted: DataFrame) -> tuple[DataFrame, DataFrame]:
        cfg = self.cfg
        scheme = novelty_scheme(cfg.sketch, cfg.bands, cfg.threshold)
        local = partition_columns(cfg)
        wanted = admitted.select("ord", "sketch", *local)
        shard_kept = keep_novel(wanted, scheme, local, self.ws, self.key_limit)
        if cfg.shards == 1:
            return shard_kept, shard_kept
        # Shards are contiguous in ord, so ord is also the order of the merge.
        merged = admitted.join(shard_kept, "ord", "left_semi").select(
            "ord", "sketch", month_bucket(truncated_header(F.col("header"))).alias("mbucket")
        )
        across = partition_columns(cfg, within_shard=False)
        merged = merged.select("ord", "sketch", *across)
        return shard_kept, keep_novel(merged, scheme, across, self.ws, self.key_limit)


def exact_scheme(cfg: ReduceConfig) -> Scheme:
    return Scheme.exhaustive(cfg.sketch, min_equal_slots(cfg.sketch, cfg.threshold), cfg.bands)
