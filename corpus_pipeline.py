"""From documents to training sequences: each stage works on what the one before it kept.

The result of every stage is written to the shared folder and read again, so a lost
executor costs its own tasks and plans stay short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqthin.llm import bwt_merge, simhash, two_fit, winnow, word_cnn
from seqthin.llm.queries import tokenizer_path
from seqthin.workspace import Workspace


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on these documents' labels, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return word_cnn.drop_toxic(docs, word_cnn.fit_toxicity(docs, labels))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return simhash.drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that an earlier document has in a run of 50."""
    return bwt_merge.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage of weight."""
    return winnow.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return two_fit.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained and tokenizing stages have no SQL counterpart; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark)
    for name, stage in STAGES[:-1]:
        docs = ws.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
