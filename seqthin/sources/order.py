"""Record order as a column: running totals, dense ordinals and shards.

Running totals over a whole data set are taken in two levels: rows are range
partitioned into chunks, chunk totals are summed in order, and each chunk
continues from its own offset.  No task sees more than one chunk.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqthin.workspace import Workspace

ROWS_PER_CHUNK = 250_000


def chunked(
    df: DataFrame,
    ws: Workspace,
    order: list[str],
    rows_per_chunk: int = ROWS_PER_CHUNK,
    rows: int | None = None,
) -> DataFrame:
    """``df`` as a written table with a ``chunk`` number that rises with ``order``.

    ``rows`` spares counting a costly ``df`` whose size is known.
    """
    chunks = max(1, math.ceil((df.count() if rows is None else rows) / rows_per_chunk))
    if chunks == 1:
        return ws.table(df.withColumn("chunk", F.lit(0)), "chunked")
    spread = df.repartitionByRange(chunks, *order)
    return ws.table(spread.withColumn("chunk", F.spark_partition_id()), "chunked")


def running_totals(
    df: DataFrame, part: list[str], order: str, values: dict[str, Column]
) -> DataFrame:
    """Add, per row, the sum of each value over all earlier rows of its part.

    ``df`` carries the ``chunk`` column of :func:`chunked`.
    """
    keys = [*part, "chunk"]
    sums = df.groupBy(*keys).agg(*[F.sum(v).alias(f"_{n}") for n, v in values.items()])
    before = (
        Window.partitionBy(*part).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per chunk.
    offsets = sums.select(
        *keys, *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in values]
    )
    inside = (
        Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        df.join(offsets, keys)
        .withColumns({
            n: F.col(f"_{n}") + F.coalesce(F.sum(v).over(inside), F.lit(0))
            for n, v in values.items()
        })
        .drop(*[f"_{n}" for n in values])
    )


def with_ordinal(
    df: DataFrame,
    ws: Workspace,
    key: str,
    name: str = "ord",
    part: list[str] | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Number rows 1, 2, … by ``key`` within each part.

    Ranking moves keys only; the numbers then join the rows by key.
    """
    part = part or []
    keys = chunked(df.select(*part, key), ws, [*part, key], rows_per_chunk)
    numbered = running_totals(keys, part, key, {name: F.lit(1).cast("bigint")})
    numbered = numbered.select(*part, key, (F.col(name) + 1).alias(name))
    return df.join(numbered, [*part, key])


def shard_map(
    records: DataFrame, ws: Workspace, shards: int, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """(ord, shard): contiguous shares of the FASTA file, by byte offset of the header.

    ``bytes``, if ``records`` has it, is what each record takes in its file; otherwise
    two lines are assumed.
    A record belongs to the shard its header starts in; the last shard takes
    what integer division leaves over.
    """
    two_lines = (F.octet_length("header") + F.octet_length("seq") + 3).cast("bigint")
    sized = records.select(
        "ord", (F.col("bytes") if "bytes" in records.columns else two_lines).alias("bytes")
    )
    sized = chunked(sized, ws, ["ord"], rows_per_chunk)
    share = max(1, (sized.agg(F.sum("bytes")).first()[0] or 0) // shards)
    placed = running_totals(sized, [], "ord", {"offset": F.col("bytes")})
    return placed.select(
        "ord", F.least(F.expr(f"offset div {share}"), F.lit(shards - 1)).cast("int").alias("shard")
    )


def with_shard(
    records: DataFrame, ws: Workspace, shards: int, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Add the shard of each record from the first ordinals of the shards (a bounded list)."""
    if shards == 1:
        return records.withColumn("shard", F.lit(0))
    starts = shard_map(records, ws, shards, rows_per_chunk).groupBy("shard").agg(F.min("ord"))
    later = sorted(starts.collect(), reverse=True)
    return records.withColumn(
        "shard", F.coalesce(*[F.when(F.col("ord") >= at, F.lit(s)) for s, at in later], F.lit(0))
    )
