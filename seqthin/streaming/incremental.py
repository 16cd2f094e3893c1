"""The reduction over a stream of records, micro-batch by micro-batch.

Batches continue from what earlier ones left: cells held by admitted records and kept
sketches in Spark's state store (:mod:`seqthin.streaming.memory`), of which a batch reads
what it touches, and the running sums of the batch before.  Any way of cutting the input
into batches gives the decisions of one run over all of it.  A batch writes its own
folders and reads those of the batch before it only, so its cost doesn't grow with the age
of the stream, and a batch that is run again after a failure replaces what it wrote.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqthin.config import ReduceConfig
from seqthin.operators import superkmers
from seqthin.operators.admission import KEY, History, admit, first_holders, new_cells, next_sums
from seqthin.operators.gate import ADMIT, LOWQUAL, REJECT, SKIP, with_quality
from seqthin.operators.kmers import profiles
from seqthin.operators.novelty import keep_novel
from seqthin.operators.signatures import KEY_LIMIT, novelty_scheme, tokens
from seqthin.plans.reduce import decisions, partition_columns
from seqthin.sources.fasta import parse_fasta
from seqthin.sources.order import ROWS_PER_CHUNK, with_ordinal
from seqthin.streaming.memory import ANSWER, CELL, KEPT, READ, BatchMemory
from seqthin.workspace import Workspace

#: Tables of the stream: cells are those the last batches added, the others grow with the results.
STATE = {
    "cells": "shard int, cell bigint, batch bigint",
    "sums": "shard int, n bigint, s bigint, q decimal(38,0), batch bigint",
    "seen": "records bigint, batch bigint",
    "kept": "shard int, ord bigint, header string, mbucket int, sketch array<bigint>, batch bigint",
    "decisions": "ord bigint, decision string, n_singleton bigint, header string, batch bigint",
}


class IncrementalReducer:
    """Feeds batches of (header, seq, order columns), or of FASTA texts, through the reduction."""

    def __init__(
        self,
        spark: SparkSession,
        cfg: ReduceConfig,
        state: str,
        order: tuple[str, ...] = ("ord",),
        key_limit: int = KEY_LIMIT,
        rows_per_chunk: int = ROWS_PER_CHUNK,
        memory: BatchMemory | None = None,
    ):
        if cfg.shards != 1:
            raise ValueError("a stream is one shard")
        self.spark, self.cfg, self.state, self.order = spark, cfg, state.rstrip("/"), order
        self.key_limit, self.rows_per_chunk = key_limit, rows_per_chunk
        self.memory = memory or BatchMemory(spark, f"{self.state}/memory")
        self.scheme = novelty_scheme(cfg.sketch, cfg.bands, cfg.threshold)
        self.part = partition_columns(cfg)
        #: What each batch came to, observed while it was written: batch, seconds, records per
        #: verdict and pages of state looked up.
        self.progress: list[dict] = []

    def table(self, name: str) -> DataFrame:
        """Rows of a kind, of all batches."""
        if not self._batches(name):
            return self.spark.createDataFrame([], STATE[name])
        return self.spark.read.schema(STATE[name]).parquet(f"{self.state}/{name}")

    def _path(self, folder: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.state}/{folder}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self, name: str) -> list[int]:
        path, fs = self._path(name)
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def _of(self, name: str, batch: int | None) -> DataFrame:
        """Rows of a kind that one batch wrote."""
        if batch is None:
            return self.spark.createDataFrame([], STATE[name]).drop("batch")
        schema = STATE[name].removesuffix(", batch bigint")
        return self.spark.read.schema(schema).parquet(f"{self.state}/{name}/batch={batch}")

    def _save(self, name: str, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.state}/{name}/batch={batch}")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Decide one batch and write its results and what the next one is told."""
        ws, cfg, start = Workspace(self.spark), self.cfg, time.time()
        # "seen" is written last, so a batch it names is whole.
        before = max((b for b in self._batches("seen") if b < batch_id), default=None)
        if "value" in batch.columns:
            texts = ws.table(batch.withColumn("row", F.monotonically_increasing_id()), "texts")
            batch = parse_fasta(texts)
        records = ws.table(batch.select(F.struct(*self.order).alias("place"), "header", "seq"), "batch")
        done = 0 if before is None else self._of("seen", before).first()["records"]
        records = with_ordinal(records, ws, "place", "ord", rows_per_chunk=self.rows_per_chunk)
        records = ws.table(
            records.select((F.col("ord") + done).alias("ord"), "header", "seq"), "records"
        )
        arrived = done + records.count()
        if cfg.limit:
            records = records.where(F.col("ord") <= cfg.limit)

        quality = with_quality(records, cfg)
        profile = ws.table(profiles(quality, cfg), "profile")
        passing = quality.select(*KEY, "seq", "complete")
        usable = profile.where("complete AND n_kmers > 0")
        kmers = usable.agg(F.coalesce(F.sum("n_kmers"), F.lit(0))).first()[0]
        targets = superkmers.target_count(kmers)
        first = ws.table(first_holders(passing, cfg, targets), "first")
        answers = self._remembered(first, usable, before, ws, batch_id)
        held = answers.where(F.col("kind") == CELL).select(F.lit(0).alias("shard"), F.col("item").alias("cell"))
        history = History(held.distinct(), self._of("sums", before), first)
        admission = admit(quality, profile, cfg, ws, history, self.rows_per_chunk)
        admitted = usable.join(admission.rejects, KEY, "left_anti")
        met = answers.where(F.col("kind") == KEPT).withColumn("shard", F.lit(0)).dropDuplicates(["ord"])
        kept = keep_novel(
            admitted.select("ord", "sketch", *self.part),
            self.scheme,
            self.part,
            ws,
            self.key_limit,
            met.select("ord", "sketch", *self.part),
        )
        kept = profile.join(kept, "ord", "left_semi")
        self._save("cells", new_cells(passing, admission, cfg, history, targets), batch_id)
        self._save("sums", next_sums(admission, history), batch_id)
        promoted, judged = Observation(), Observation()
        kept = kept.select("shard", "ord", "header", "mbucket", "sketch").observe(promoted, F.count(F.lit(1)).alias("promoted"))
        self._save("kept", kept, batch_id)
        verdicts = decisions(profile, admission, cfg, ws).select("ord", "decision", "n_singleton", "header")
        counts = [F.count_if(F.col("decision") == v).alias(v.lower()) for v in (LOWQUAL, SKIP, REJECT, ADMIT)]
        self._save("decisions", verdicts.observe(judged, *counts), batch_id)
        pages = answers.where(F.col("kind") == READ).agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
        self._save("seen", self.spark.range(1).select(F.lit(arrived).cast("bigint").alias("records")), batch_id)
        self.progress.append({"batch": batch_id, "seconds": time.time() - start, "pages": pages, **judged.get, **promoted.get})
        # The state holds what older batches told, and none of them runs again.
        for old in self._batches("cells"):
            if before is not None and old < before:
                path, fs = self._path(f"cells/batch={old}")
                fs.delete(path, True)
        ws.release()

    def _remembered(self, first: DataFrame, usable: DataFrame, before: int | None, ws: Workspace, batch_id: int) -> DataFrame:
        """What earlier batches know about this one's cells and band keys."""
        memory = self.memory
        if before is None:  # nobody has told anything yet
            return self.spark.createDataFrame([], ANSWER).drop("items")
        requests = memory.cells(self._of("cells", before), True).unionByName(
            memory.cells(first.select("cell"), False)
        )
        if self.scheme.need <= self.scheme.m:  # else nothing resembles anything
            kept = self._of("kept", before).where("sketch IS NOT NULL")
            told = tokens(kept, self.scheme, self.part).join(kept.select("ord", "mbucket", "sketch"), "ord")
            asked = tokens(usable, self.scheme, self.part).select("key")
            requests = requests.unionByName(memory.kept(told)).unionByName(memory.resembling(asked))
        return memory.answers(requests, f"{batch_id:08d}-{uuid.uuid4().hex}")

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """Run on a stream such as :func:`seqthin.sources.fasta.stream_fasta`."""
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
