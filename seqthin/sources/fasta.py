"""FASTA files as a distributed, ordered source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqthin.functions.text import clean_header, clean_sequence


BROADCAST_BLOCKS = 500_000


def _texts(reader, path) -> DataFrame:
    """Text between record marks, with its file and split."""
    return reader.option("lineSep", "\n>").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def _head(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def _body(text: Column) -> Column:
    return F.when(F.locate("\n", text) > 0, F.expr("substring(text, locate('\n', text) + 1)")).otherwise("")


def read_fasta(
    spark: SparkSession, path: str | list[str], strip_blanks: bool = False, with_bytes: bool = False
) -> DataFrame:
    """Records of FASTA files as (ord, header, seq), ordered by file and position.

    Files split at any byte; the split holding a record's mark reads it whole.
    ``ord`` counts records from 1 across the files in path order.  Text before the
    first mark is dropped.  ``with_bytes`` adds the bytes each record takes in its
    file, mark and line ends included.
    """
    raw = _texts(spark.read, path).withColumn("row", F.monotonically_increasing_id())
    few = raw.rdd.getNumPartitions() + len(raw.inputFiles()) <= BROADCAST_BLOCKS
    return parse_fasta(raw, strip_blanks, with_bytes, few)


def parse_fasta(
    raw: DataFrame, strip_blanks: bool = False, with_bytes: bool = False, few_blocks: bool = False
) -> DataFrame:
    """Records of (value, file, block, row): texts between marks, ``row`` rising inside a block.

    A block's first ordinal is the number of records in earlier blocks, so only one
    row per block is gathered.
    """
    blocks = raw.groupBy("file", "block").agg(
        F.min("row").alias("first_row"),
        F.count("*").alias("rows"),
        F.min_by(F.substring("value", 1, 1) == ">", "row").alias("starts_with_mark"),
    )
    blocks = blocks.withColumn("preamble", (F.col("block") == 0) & ~F.col("starts_with_mark"))
    order = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "file",
        "block",
        "first_row",
        "preamble",
        F.coalesce(F.sum(F.col("rows") - F.col("preamble").cast("int")).over(order), F.lit(0)).alias("earlier"),
    )
    # Splits and files bound the number of blocks; few enough, they travel to the records.
    placed = raw.join(F.broadcast(blocks) if few_blocks else blocks, ["file", "block"])
    at_top = (F.col("block") == 0) & (F.col("row") == F.col("first_row"))
    text = F.when(at_top, F.expr("substring(value, 2)")).otherwise(F.col("value"))
    records = placed.where(~(at_top & F.col("preamble"))).select(
        (
            F.col("earlier") + F.col("row") - F.col("first_row") + 1 - F.col("preamble").cast("int")
        ).alias("ord"),
        text.alias("text"),
    )
    header = clean_header(_head(F.col("text")))
    return records.select(
        "ord",
        (F.regexp_replace(header, r"\s+$", "") if strip_blanks else header).alias("header"),
        clean_sequence(_body(F.col("text")), strip_blanks).alias("seq"),
        *([(F.octet_length("text") + 2).cast("bigint").alias("bytes")] if with_bytes else []),
    )


def stream_fasta(spark: SparkSession, folder: str) -> DataFrame:
    """New FASTA files of a folder as a stream of texts between marks (value, file, block).

    :class:`seqthin.streaming.incremental.IncrementalReducer` parses each batch as
    :func:`read_fasta` parses files.
    """
    return _texts(spark.readStream, folder)
