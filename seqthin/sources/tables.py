"""Sequences from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Usual characters that are no letters: the mapping that serves letters spares the slower pattern most matches.
OTHERS = "".join(c for c in map(chr, range(0x20, 0x180)) if c not in LETTERS + LETTERS.upper() + " ")


def from_table(df: DataFrame, order: Column, header: Column, seq: Column) -> DataFrame:
    """Any table as records; ``order`` is a unique BIGINT, ``seq`` uppercase."""
    return df.select(
        order.cast("bigint").alias("ord"), header.alias("header"), seq.alias("seq")
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Split an input of few partitions over all cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def letters_to_bases(text: Column) -> Column:
    """Map prose to the nucleotide alphabet.

    White space goes, letters become A, C, G, T by their alphabet position
    modulo four, and every other character becomes N.
    """
    bases = "".join("ACGT"[i % 4] for i in range(26))
    # Characters without a counterpart (the trailing white space) are deleted.
    mapped = F.translate(text, LETTERS + LETTERS.upper() + OTHERS + " \t\r\n", bases * 2 + "N" * len(OTHERS))
    return F.regexp_replace(mapped, "[^ACGT]", "N")


def document_sequences(documents: DataFrame) -> DataFrame:
    """Records derived from a ``documents`` table (doc_id, text, lang)."""
    month = F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0")
    date = F.when(F.col("doc_id") % 17 == 0, F.lit("undated")).otherwise(
        F.concat(F.lit("2021-"), month, F.lit("-15"))
    )
    header = F.concat_ws("|", F.concat(F.lit("doc"), F.col("doc_id").cast("string")), date, "lang")
    return from_table(documents, F.col("doc_id") + 1, header, letters_to_bases(F.col("text")))
