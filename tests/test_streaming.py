"""Batches of a stream give the decisions of one run over everything."""

import random

from pyspark.sql import functions as F

from seqthin.config import ReduceConfig
from seqthin.operators.emit import write_fasta
from seqthin.plans.reduce import Reducer
from seqthin.sources.fasta import stream_fasta
from seqthin.streaming.incremental import IncrementalReducer
from tests import sequential

SCHEMA = "ord bigint, header string, seq string"


def test_batches_equal_one_run(spark, tmp_path):
    cfg = ReduceConfig(k=5, min_len=20, max_n_frac=0.3, warmup=10, outlier_sd=1.0, sketch=32, threshold=0.25, frequency="exact")
    records = sequential.random_records(random.Random(11), 90)
    whole = Reducer(spark, cfg).run(spark.createDataFrame(records, SCHEMA))
    runner = IncrementalReducer(spark, cfg, str(tmp_path / "state"), order=("ord",), key_limit=4)
    cuts = [0, 25, 70, 90]
    for batch, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        df = spark.createDataFrame(records[lo:hi], SCHEMA)
        runner.process(df, batch)
        if batch == 1:
            runner.process(df, batch)  # a batch run again replaces itself
    want = {(r["ord"], r["decision"], r["n_singleton"]) for r in whole.decisions().collect()}
    assert {(r["ord"], r["decision"], r["n_singleton"]) for r in runner.table("decisions").collect()} == want
    assert sorted(r["ord"] for r in runner.table("kept").collect()) == sorted(r["ord"] for r in whole.kept.collect())


def test_limit(spark, tmp_path):
    cfg = ReduceConfig(k=5, min_len=20, warmup=5, sketch=16, frequency="exact", limit=30)
    records = sequential.random_records(random.Random(13), 50)
    runner = IncrementalReducer(spark, cfg, str(tmp_path / "state"), order=("ord",))
    for batch, (lo, hi) in enumerate(((0, 20), (20, 50))):
        runner.process(spark.createDataFrame(records[lo:hi], SCHEMA), batch)
    assert sorted(r["ord"] for r in runner.table("decisions").collect()) == list(range(1, 31))


def test_stream_of_files(spark, tmp_path):
    cfg = ReduceConfig(k=5, min_len=20, warmup=10, outlier_sd=1.0, sketch=16, threshold=0.25, cms_log2_width=9)
    records = sequential.random_records(random.Random(12), 50)
    df = spark.createDataFrame(records, SCHEMA)
    write_fasta(df.repartitionByRange(2, "ord").sortWithinPartitions("ord"), str(tmp_path / "in"))
    runner = IncrementalReducer(spark, cfg, str(tmp_path / "state"))
    runner.start(stream_fasta(spark, str(tmp_path / "in")), str(tmp_path / "log"), available_now=True).awaitTermination()
    whole = Reducer(spark, cfg).run(df)
    assert sorted(r["header"] for r in runner.table("kept").collect()) == sorted(r["header"] for r in whole.promoted.collect())
