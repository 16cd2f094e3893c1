"""Packing documents into sequences of bounded length by best-two-fit.

Documents are encoded, closed by an end id and, where longer than a sequence, cut
into full pieces behind a first, shorter one.  Only how many pieces there are of
each length decides how bins look, and there are no more lengths than ids in a
sequence; so the plan is made once, for the whole table, on that histogram:

- a bin takes the longest piece left, then again and again the longest that fits;
- while a gap remains, its smallest piece gives way to two unpacked ones that
  together fill the widened gap better;
- the bin is repeated as long as the counts last.

Every piece then finds its bin by its rank among pieces of its length.  Ranks come
in two levels (inside its input partition, and pieces in partitions before), so no
task gathers a length.

Defined cases: a null text is empty and packs as its end id alone; equal rows are
packed each; a null doc_id is kept; an empty table gives no pieces; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqthin.llm.batches import letting_go, small_batches, text_slices
from seqthin.llm.tokens import encoder, with_end
from seqthin.workspace import Workspace

END = 0
CAPACITY = 2048

PIECE_SCHEMA = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
)
PACKED_SCHEMA = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
    "sequence_id bigint, offset bigint"
)


def cut(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of ``n`` ids: document index, piece number, start, length."""
    pieces = -(-n // capacity)
    doc = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = (n - 1) % capacity + 1
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, first[doc], capacity)


def _fill(left: np.ndarray, capacity: int) -> list[int]:
    """Lengths of one bin; takes nothing out of ``left`` in the end."""
    left = left.copy()
    lengths = np.arange(len(left))
    bin_, gap = [], capacity
    while gap:
        fit = np.flatnonzero(left[: gap + 1])
        if not len(fit):
            break
        bin_.append(int(fit[-1]))
        left[fit[-1]] -= 1
        gap -= bin_[-1]
    while gap:
        smallest = bin_[-1] if len(bin_) == 1 else min(bin_)
        room = gap + smallest
        have = np.flatnonzero(left[: room + 1])
        if not len(have):
            break
        # For every first piece the longest second one that still fits.
        below = np.maximum.accumulate(np.where(left[: room + 1] > 0, lengths[: room + 1], 0))
        second = below[room - have]
        alone = (second == have) & (left[have] < 2)
        second = np.where(alone, below[np.maximum(have - 1, 0)], second)
        both = np.where(second > 0, have + second, 0)
        best = int(np.argmax(both))
        if both[best] <= smallest:
            break
        bin_.remove(smallest)
        left[smallest] += 1
        for x in (int(have[best]), int(second[best])):
            bin_.append(x)
            left[x] -= 1
        gap = capacity - sum(bin_)
    return bin_


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Bins for ``counts[length]`` pieces, as rows (length, first rank, per bin, first bin, offset).

    Pieces of ``length`` with ranks from ``first rank`` on go, ``per bin`` at a
    time, to the bins from ``first bin`` on, at ``offset`` and behind it.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    taken = np.zeros_like(left)
    rows, bins = [], 0
    while left.any():
        lengths, each = np.unique(_fill(left, capacity), return_counts=True)
        times = int((left[lengths] // each).min())
        offset = 0
        for length, k in zip(lengths[::-1].tolist(), each[::-1].tolist()):
            rows.append((length, int(taken[length]), k, bins, offset))
            taken[length] += k * times
            left[length] -= k * times
            offset += k * length
        bins += times
    return rows


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end: int) -> DataFrame:
    """All pieces with checksums, and their rank among equal lengths of their input partition."""
    fields = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()),
    ])

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows in text_slices(batch):
                ids, n = with_end(*enc.encode(rows.column("text")), end)
                doc, piece, start, length = cut(n, capacity)
                at = (np.cumsum(n) - n)[doc] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.searchsorted(ranked, ranked, side="left")
                nth += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start),
                    pa.array(length), pa.array(sums, pa.int64()), pa.array(np.full(len(doc), part, np.int32)),
                    pa.array(nth),
                ], schema=fields)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(letting_go(cut_all), PIECE_SCHEMA)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = Workspace(docs.sparkSession).table(pieces_of(docs, tokenizer, capacity, end), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    # At most `capacity` rows.
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    table = np.array(plan(histogram, capacity), np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )
    # The first row of each length, and how many ranks come before it in one common order.
    shift = np.cumsum(histogram) - histogram
    firsts = shift[table[:, 0]] + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column("length").to_numpy(zero_copy_only=False), np.int64)
            rank = np.asarray(batch.column("rank").to_numpy(zero_copy_only=False), np.int64)
            row = table[np.searchsorted(firsts, shift[length] + rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, PACKED_SCHEMA)
