"""Sinks: FASTA and tab-separated decisions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqthin.functions.text import header_key


def emitted(records: DataFrame, promoted: DataFrame, by: str = "ord") -> DataFrame:
    """Records to write: the promoted ones, or all that share a promoted header.

    ``by="header"`` compares the first 255 bytes of headers, so copies of a
    promoted header come along whatever their own verdict.
    """
    if by == "ord":
        return records.join(promoted.select("ord"), "ord", "left_semi")
    if by != "header":
        raise ValueError("by must be 'ord' or 'header'")
    wanted = promoted.select(header_key(F.col("header")).alias("key")).distinct()
    return records.withColumn("key", header_key(F.col("header"))).join(wanted, "key", "left_semi").drop("key")


def fasta_text(header: Column, seq: Column) -> Column:
    """One record on two lines."""
    return F.concat(F.lit(">"), header, F.lit("\n"), F.upper(seq))


def write_fasta(records: DataFrame, path: str, by_shard: bool = False) -> None:
    """Write FASTA parts in the order of ``ord``, in a subfolder per shard if asked.

    Parts are ranges of ``ord``; read in the order of their names they give the
    records in order.
    """
    value = fasta_text(F.col("header"), F.col("seq")).alias("value")
    keys = ["shard", "ord"] if by_shard else ["ord"]
    ordered = records.select(*keys, value).repartitionByRange(*keys).sortWithinPartitions(*keys)
    if by_shard:
        ordered.drop("ord").write.partitionBy("shard").text(path)
    else:
        ordered.select("value").write.text(path)


def four_places(x: Column) -> Column:
    """A ratio with four decimals, rounded from its exact binary value.

    The JVM's formatters round some decimal ties, such as 0.00005, otherwise.
    """

    @F.arrow_udf("string")
    def printed(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.4f}" for v in values.to_pylist()], pa.string())

    return printed(x)


def write_tsv(rows: DataFrame, path: str) -> None:
    """Tab-separated text with a header line, fields as they are."""
    rows.write.option("sep", "\t").option("header", True).option("quote", "").csv(path)
