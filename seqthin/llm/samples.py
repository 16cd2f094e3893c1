"""Labels of documents, and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(parts: int) -> Column:
    """crc32 of the doc_id as text, modulo ``parts``; a null id counts as empty text."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(parts))


def known_labels(labels: DataFrame, label: str, allowed: Column | None = None) -> DataFrame:
    """(doc_id, label), one row per id; null ids or labels and ids with contradicting labels are left out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)
    )
    known = known.where(allowed) if allowed is not None else known
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    return known.where("label = most").select("doc_id", "label")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, allowed: Column | None = None
) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` labelled documents of either class.

    Documents are taken by the hash of their id.  Rows with a null id or label, and
    ids with contradicting labels, are left out; of rows with equal id one counts.
    """
    known = known_labels(labels, label, allowed).withColumn("h", F.xxhash64("doc_id"))
    chosen = [known.where(F.col("label") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    # At most twice `per_class` rows of two numbers.
    few = F.broadcast(chosen[0].unionByName(chosen[1]).select("doc_id", "label"))
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").join(few, "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
