"""Language-model scores by prediction by partial matching (PPM) over bytes.

Training documents (A-Z lower-cased) are counted once, as bytes with the ``ORDER``
bytes before them, every such string, however rare; shorter contexts are sums of longer
ones, so the counts form a trie.  In a context seen ``n`` times with ``q`` different bytes, a byte seen ``c``
times has probability ``c / (n + q)`` and the escape to the next shorter context
``q / (n + q)``; bytes of the longer context are left out of the shorter one's counts.
The trie no longer changes, so every string's log probability is worked out in advance,
by joins over the distinct strings, and a text costs one look-up a byte.  Texts begin
with marks and end with one that counts as a symbol.

What a context's followers leave to the shorter one needs no lists: they also follow
the shorter one, so their number and the sum of their counts there are enough.

Beside it stands a word unigram.  Counts of strings and words stay distributed: every
input part sends its different ones once, counts are summed, and what they are worth
returns to the part.

Defined cases: a null text is empty and scores its end alone; equal rows get equal
scores; without training documents every symbol is equally likely; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqthin.llm.batches import small_batches, text_slices
from seqthin.llm.bytescan import SPACES, U, joined, owner, runs, span_hashes, table_of
from seqthin.llm.samples import id_remainder
from seqthin.workspace import Workspace

ORDER = 4
MARK = 255  # no byte of UTF-8
ALPHA = 0.1
PART_BYTES = 16 << 20
SYMBOLS = 257  # bytes and the end


@dataclass
class Ppm:
    """The whole model in one process, for small corpora; ``string_scores`` is the distributed one."""

    symbol: np.ndarray  # byte -> number, the last one for bytes never seen
    row: np.ndarray  # code of ORDER numbers -> row of the table
    table: np.ndarray  # (rows, numbers): log10 probabilities

    def log10(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probability of each text; ``raw`` has lower-cased texts with one byte behind each."""
        raw = raw.copy()
        raw[ends] = MARK
        s = self.symbol[raw]
        mark, n = int(self.symbol[MARK]), self.table.shape[1]
        code = np.zeros(len(s), np.int64)
        for back in range(ORDER, 0, -1):
            before = np.full(len(s), mark, np.int64)
            before[back:] = s[:-back] if back else s
            # Contexts that reach over a text's start see marks.
            for j in range(back):
                at = starts + j
                before[at[at <= ends]] = mark
            code = code * n + before
        lp = self.table.reshape(-1)[self.row[code].astype(np.int64) * n + s]
        return np.add.reduceat(lp.astype(np.float64), starts) if len(starts) else np.zeros(0)


def build(grams: np.ndarray, counts: np.ndarray) -> Ppm:
    """Model of counted strings of ``ORDER`` context bytes and one symbol, packed in 64 bits."""
    parts = [(grams >> np.int64(8 * (ORDER - j))) & np.int64(255) for j in range(ORDER + 1)]
    seen = np.unique(np.concatenate([*parts, [MARK]])).astype(np.int64)
    symbol = np.full(256, len(seen), np.int64)
    symbol[seen] = np.arange(len(seen))
    n = len(seen) + 1
    parts = [symbol[p] for p in parts]
    code = np.zeros(len(grams), np.int64)
    for p in parts:
        code = code * n + p
    levels: list[tuple[np.ndarray, np.ndarray]] = []  # contexts, counts
    for order in range(ORDER, -1, -1):
        context, index = np.unique((code // n) % n**order, return_inverse=True)
        dense = np.zeros((max(1, len(context)), n))
        np.add.at(dense, (index, code % n), counts)
        levels.insert(0, (context if len(context) else np.zeros(1, np.int64), dense))
    tables, row = [], np.zeros(n**ORDER, np.int32)
    filled = 0
    everything = np.arange(n**ORDER) if ORDER else np.zeros(1, np.int64)
    for order, (context, dense) in enumerate(levels):
        p = np.zeros_like(dense)
        escape, used = np.ones(len(context)), np.zeros(dense.shape, bool)
        for shorter in range(order, -1, -1):
            known, below = levels[shorter]
            c = np.where(used, 0, below[np.searchsorted(known, context % n**shorter)])
            total, kinds = c.sum(axis=1), (c > 0).sum(axis=1)
            base = np.maximum(total + kinds, 1)
            p += np.where(c > 0, (escape / base)[:, None] * c, 0)
            escape = escape * np.where(total > 0, kinds / base, 1.0)
            used |= c > 0
        # What no context has: the remaining symbols, each as likely as any other.
        left = SYMBOLS - used[:, :-1].sum(axis=1)
        p = np.where(used, p, (escape / np.maximum(left, 1))[:, None])
        tables.append(np.log10(p))
        # Longer contexts overwrite the rows of shorter ones.
        suffix = everything % n**order
        at = np.minimum(np.searchsorted(context, suffix), len(context) - 1)
        mine = context[at] == suffix
        row[mine] = filled + at[mine]
        filled += len(context)
    return Ppm(symbol, row, np.concatenate(tables).astype(np.float32))


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, starts, ends = joined(column)
    raw = raw.copy()
    raw[(raw >= 65) & (raw <= 90)] += 32
    return raw, starts, ends


def word_tokens(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    lo, hi = runs(~table_of(SPACES)[raw])
    return span_hashes(raw, lo, hi), owner(starts, lo)


def grams_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Every symbol of the texts with the bytes before it, packed in 64 bits."""
    wide = (ends - starts) + 1 + ORDER
    at = np.cumsum(wide) - wide
    padded = np.full(int(wide.sum()), MARK, np.uint8)
    inner = np.zeros(len(padded) + 1, np.int64)
    inner[at + ORDER] += 1
    inner[at + wide - 1] -= 1
    inside = np.cumsum(inner[:-1]) > 0
    keep = np.ones(len(raw), bool)
    keep[ends] = False
    padded[inside] = raw[keep]
    out = np.zeros(max(0, len(padded) - ORDER), np.int64)
    for j in range(ORDER + 1):
        out = (out << np.int64(8)) | padded[j : j + len(out)]
    whole = np.ones(len(out), bool)
    # Strings that would reach into the next text.
    for j in range(ORDER):
        cross = at[1:] - 1 - j
        whole[cross[(cross >= 0) & (cross < len(out))]] = False
    return out[whole]


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(values):
        return values, np.zeros(0, np.int64)
    values = np.sort(values)
    edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True])))
    return values[edges[:-1]], np.diff(edges)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal values added."""
    values = np.concatenate([v for v, _ in parts])
    unique, index = np.unique(values, return_inverse=True)
    return unique, np.bincount(index, np.concatenate([c for _, c in parts]), len(unique)).astype(np.int64)


def with_parts(docs: DataFrame, ws: Workspace) -> tuple[DataFrame, int]:
    """(doc_id, held_out, text, part), and the number of training documents.

    Rows of a stretch of a file share a part.  A row's place in its file names the
    stretch, so every scan gives a row the same part, however it cuts the files.
    """
    docs_ = docs
    try:
        docs_.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        docs_ = ws.table(docs_.select("doc_id", "text"), "docs")
    held_out = id_remainder(10) == 0
    size = docs_.agg(
        F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~held_out).alias("train")
    ).first()
    rows_each = max(1, size["rows"] * PART_BYTES // max(1, size["bytes"] or 0))
    part = F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / F.lit(rows_each)))
    rows = docs_.select(F.col("doc_id").cast("bigint"), held_out.alias("held_out"), "text", part.alias("part"))
    return rows, size["train"]


def found(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of every wanted value among the sorted ones; an error if one is missing."""
    at = np.searchsorted(sorted_, wanted)
    if len(wanted) and not (len(sorted_) and (sorted_[np.minimum(at, len(sorted_) - 1)] == wanted).all()):
        raise RuntimeError("a part holds a word or string that it did not ask for: its rows changed between two scans")
    return at


def asked_for(values: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values and their training counts; those of held-out documents alone have none."""
    v, c = counted(values[train])
    other = np.setdiff1d(values[~train], v)
    return np.concatenate([v, other]), np.concatenate([c, np.zeros(len(other), np.int64)])


def count_all(rows: DataFrame) -> DataFrame:
    """(part, string, item, n): training counts of words and byte strings by part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list] = {}
        for batch in batches:
            for piece in text_slices(batch):
                raw, starts, ends = lowered(piece.column("text"))
                h, doc = word_tokens(raw, starts)
                g, of = grams_of(raw, starts, ends), np.repeat(np.arange(piece.num_rows), ends - starts + 1)
                part = piece.column("part").to_numpy()
                train = ~piece.column("held_out").to_numpy(zero_copy_only=False)
                for p in np.unique(part):
                    for string, values, row in ((False, h.view(np.int64), doc), (True, g, of)):
                        mine = part[row] == p
                        some = held.setdefault((int(p), string), [])
                        some.append(asked_for(values[mine], train[row[mine]]))
                        if len(some) >= 8:
                            some[:] = [summed(some)]
        for (p, string), some in held.items():
            v, c = summed(some)
            yield from batches_of(p, string, v, c)

    def batches_of(part, string, item, n, rows_each: int = 200_000):
        for lo in range(0, len(item), rows_each):
            some = slice(lo, lo + rows_each)
            size = len(item[some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, part)), pa.array(np.full(size, string)), pa.array(item[some]), pa.array(n[some])],
                names=["part", "string", "item", "n"],
            )

    return rows.mapInArrow(count, "part bigint, string boolean, item bigint, n bigint")


def ending(order: int) -> Column:
    """The last symbol of a string with ``order`` bytes before it."""
    return F.col("item").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))


def string_scores(strings: DataFrame, ws: Workspace) -> DataFrame:
    """(item, value): log10 probability of the last byte of every string (item, n)."""
    seen = {ORDER: strings.where("n > 0")}
    for k in range(ORDER - 1, -1, -1):
        seen[k] = ws.table(seen[k + 1].groupBy(ending(k).alias("item")).agg(F.sum("n").alias("n")), f"strings-{k}")

    def small(table: DataFrame, width: int) -> DataFrame:
        # At most 256 ** 2 rows.
        return F.broadcast(table) if width <= 2 else table

    # Of every context: occurrences, different followers, and what those count in the shorter context.
    contexts = {}
    for k in range(ORDER + 1):
        own = seen[k]
        if k:
            shorter = seen[k - 1].select(F.col("item").alias("end"), F.col("n").alias("below"))
            own = own.join(small(shorter, k), ending(k - 1) == F.col("end"))
        else:
            own = own.withColumn("below", F.lit(0).cast("bigint"))
        contexts[k] = own.groupBy(F.shiftright("item", 8).alias("context")).agg(
            F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("below").alias("taken")
        )
    contexts[ORDER] = ws.table(contexts[ORDER], "contexts")
    direct = seen[ORDER].join(contexts[ORDER], F.shiftright("item", 8) == F.col("context")).select(
        "item", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("value")
    )
    # Strings of held-out documents alone escape until a context has their last byte.
    none = F.lit(0).cast("bigint")
    rest = strings.where("n = 0").select(
        "item", F.lit(None).cast("double").alias("value"), F.lit(0.0).alias("escape"), none.alias("gone"), none.alias("gone_kinds")
    )
    for k in range(ORDER, -1, -1):
        rest = rest.join(small(contexts[k], k), F.shiftright(ending(k), 8) == F.col("context"), "left")
        if k < ORDER:
            here = seen[k].select(F.col("item").alias("end"), F.col("n").alias("own"))
            rest = rest.join(small(here, k + 1), ending(k) == F.col("end"), "left")
        else:
            rest = rest.withColumn("own", F.lit(None).cast("bigint"))
        left = F.coalesce("total", none) - F.col("gone")
        kinds = F.coalesce("kinds", none) - F.col("gone_kinds")
        rest = rest.select(
            "item",
            F.coalesce("value", F.col("escape") + F.log10(F.col("own") / (left + kinds))).alias("value"),
            F.when(left > 0, F.col("escape") + F.log10(kinds / (left + kinds))).otherwise(F.col("escape")).alias("escape"),
            F.coalesce("taken", none).alias("gone"), F.coalesce("kinds", none).alias("gone_kinds"),
        )
    # What no context has: the remaining symbols, each as likely as any other.
    rest = rest.select("item", F.coalesce("value", F.col("escape") - F.log10(F.lit(SYMBOLS) - F.col("gone_kinds"))).alias("value"))
    return direct.unionByName(rest)


def language_scores(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark)
    rows, ended = with_parts(docs, ws)
    asked = ws.table(count_all(rows), "counts")
    totals = ws.table(asked.groupBy("string", "item").agg(F.sum("n").alias("n")), "totals")
    words = totals.where("NOT string")
    sums = words.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n_all = (sums["n"] or 0) + ended
    kinds = (sums["v"] or 0) + (ended > 0)
    bottom = math.log10(n_all + ALPHA * (kinds + 1))
    end_score = math.log10(ended + ALPHA) - bottom

    def judge(held: pa.Table, known: pa.Table) -> pa.Table:
        string = known.column("string").to_numpy()
        item, value = known.column("item").to_numpy(), known.column("value").to_numpy()

        def of(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(item[kind])
            return item[kind][order], value[kind][order]

        word, n = of(~string)
        gram, lp = of(string)
        worth = np.log10(n + ALPHA) - bottom
        out = []
        for batch in held.combine_chunks().to_batches():
            for piece in text_slices(batch):
                raw, starts, ends = lowered(piece.column("text"))
                h, doc = word_tokens(raw, starts)
                at = found(word, h.view(np.int64))
                by_byte = lp[found(gram, grams_of(raw, starts, ends))]
                size = piece.num_rows
                out.append(pa.RecordBatch.from_arrays([
                    piece.column("doc_id"), piece.column("held_out"),
                    pa.array(np.bincount(doc, minlength=size) + 1),
                    pa.array(np.bincount(doc[n[at] > 0], minlength=size) + (ended > 0)),
                    pa.array(np.full(size, n_all, np.int64)),
                    pa.array(np.bincount(doc, worth[at], size) + end_score),
                    pa.array(np.add.reduceat(by_byte, starts)),
                ], names=NAMES))
        return pa.Table.from_batches(out)

    values = words.select("string", "item", F.col("n").cast("double").alias("value")).unionByName(
        string_scores(totals.where("string").select("item", "n"), ws).select(F.lit(True).alias("string"), "item", "value")
    )
    back = asked.select("part", "string", "item").join(values, ["string", "item"]).select("part", "string", "item", "value")
    return rows.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(judge, SCORE_SCHEMA)


NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
SCORE_SCHEMA = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)
