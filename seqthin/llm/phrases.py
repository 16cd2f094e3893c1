"""Phrase collocations by prefix-free parsing.

A text's words are cut into chunks wherever the hash of a window of words asks for it, so
equal stretches of text are cut alike wherever they stand.  Neighbouring chunks share that
window, which is one word shorter than the longest phrase: every phrase lies whole inside
some chunk, and one that starts in the shared window belongs to the later chunk alone.
The different chunks of a language are the dictionary, the number of times each was cut
its parse frequency.  Phrases are then counted inside different chunks only, each
occurrence weighing its chunk's frequency; the text is not read again.

Two passes over the dictionary keep rare phrases out of the shuffle.  The first sums 64-bit
hashes of all phrases but the longest; those that reach the least count enter a bit filter
of bounded size.  The second counts, by their words, the phrases whose parts all pass.  A
hash that is shared by chance, or a filter that is too full, only lets more phrases be
counted: what is kept is decided by the exact counts.

Defined cases: a null text is empty, a null language is ``und``; empty texts, texts without
words and languages without candidates give no rows; equal rows count each; an empty table
gives no rows; ids are not used and other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqthin.llm.batches import small_batches, text_slices
from seqthin.llm.bytescan import STEP, POWER, U, mix, owner, runs, span_hashes, table_of
from seqthin.workspace import Workspace

MAX_WORDS, MIN_COUNT, CONTAINED_PERCENT, TOP = 3, 10, 50, 2000
#: One window in so many, by its hash, ends a chunk.
CHUNK_WORDS = 32
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
UNKNOWN = "und"
#: Bits of the filter for each frequent phrase, and at most.
BITS_EACH, LOG_BITS_LEAST, LOG_BITS_MOST = 16, 12, 27
SLICE = 8 << 20
ROWS_OUT = 100_000
CHUNKS = "lang string, final boolean, chunk string"
COUNTED = "lang string, words int, phrase string, n bigint"


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column, A-Z lowered and a line end behind every row; starts of the rows."""
    ended = pc.binary_join_element_wise(pc.fill_null(column.cast(pa.binary()), b""), b"", b"\n")
    _, offsets, data = ended.buffers()
    starts = np.frombuffer(offsets, np.int32)[: len(ended) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[: starts[-1]].copy()
    raw[(raw >= 65) & (raw <= 90)] += 32
    return raw, starts[:-1]


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of breaks before each."""
    breaks = table_of(BREAKS)[raw]
    lo, hi = runs(~(breaks | table_of(BLANKS)[raw]))
    return lo, hi, np.cumsum(breaks, dtype=np.int32)[lo]


def _together(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` hashes from each place on."""
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, n, U)
    for j in range(n):
        out = mix(out * U(STEP) + hashes[j : j + size] * U(POWER))
    return out


def chunks_of(raw: np.ndarray, starts: np.ndarray, window: int, every: int):
    """(row, final, start, end) of every chunk, in order; ``final`` ones share no window with a next one."""
    lo, hi, _ = words_of(raw)
    if not len(lo):
        nothing = np.zeros(0, np.int64)
        return nothing, np.zeros(0, bool), nothing, nothing
    row = owner(starts, lo)
    begins = np.ones(len(row), bool)
    begins[1:] = row[1:] != row[:-1]
    last = np.flatnonzero(np.append(begins[1:], True))
    asked = _together(span_hashes(raw, lo, hi), window) % U(every) == 0
    asked &= row[: len(asked)] == row[len(row) - len(asked) :]
    begins[: len(asked)] |= asked
    first = np.flatnonzero(begins)
    follows = np.append(row[first[1:]] == row[first[:-1]], False)
    ends = last[np.searchsorted(last, first)]
    ends[follows] = first[1:][follows[:-1]] + window - 1
    return row[first], ~follows, lo[first], hi[ends]


def dictionary(docs: DataFrame, max_words: int = MAX_WORDS, every: int = CHUNK_WORDS) -> DataFrame:
    """(lang, final, chunk, n): every different chunk of a language with its parse frequency."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, SLICE):
                raw, starts = flat(rows.column("text"))
                row, final, a, b = chunks_of(raw, starts, max_words - 1, every)
                held = raw.tobytes()
                chunk = pa.array([held[i:j] for i, j in zip(a.tolist(), b.tolist())], pa.binary()).cast(pa.string())
                lang = rows.column("lang").take(pa.array(row))
                whole = pa.RecordBatch.from_arrays([lang, pa.array(final), chunk], names=["lang", "final", "chunk"])
                yield from (whole.slice(i, ROWS_OUT) for i in range(0, whole.num_rows, ROWS_OUT))

    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")
    return rows.mapInArrow(parse, CHUNKS).groupBy("lang", "final", "chunk").agg(F.count("*").alias("n"))


class Counted:
    """Words of some chunks, and which stretches of them count."""

    def __init__(self, rows: pa.RecordBatch, window: int):
        self.raw, starts = flat(rows.column("chunk"))
        self.lo, self.hi, self.piece = words_of(self.raw)
        row = owner(starts, self.lo)
        held = rows.column("lang").dictionary_encode()
        self.langs, of_row = held.dictionary, held.indices.to_numpy(zero_copy_only=False)
        self.lang = of_row[row]
        self.weight = rows.column("n").to_numpy()[row]
        # Phrases that start in the shared window are counted in the next chunk.
        behind = np.searchsorted(row, row, side="right") - np.arange(len(row))
        final = rows.column("final").to_numpy(zero_copy_only=False)[row]
        self.counts = final | (behind > window)

    def whole(self, n: int) -> np.ndarray:
        """Does the phrase of ``n`` words from a place on count, whole and within a piece?"""
        size = max(0, len(self.lo) - n + 1)
        return self.counts[:size] & (self.piece[:size] == self.piece[n - 1 : n - 1 + size])

    def hashes(self) -> np.ndarray:
        names = [int.from_bytes(hashlib.blake2b((x or "").encode(), digest_size=8).digest(), "little") for x in self.langs.to_pylist()]
        return mix(span_hashes(self.raw, self.lo, self.hi) + np.array(names, U)[self.lang]) if len(self.lo) else np.zeros(0, U)

    def words(self) -> pa.Array:
        """The words, as strings."""
        sizes = self.hi - self.lo
        inside = np.zeros(len(self.raw) + 1, np.int8)
        inside[self.lo] += 1
        inside[self.hi] -= 1
        data = self.raw[np.cumsum(inside[:-1]).astype(bool)]
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data))


def gathered(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``SLICE`` bytes of the column ``name``."""
    held, size = [], 0

    def together() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(name).nbytes
        if size >= SLICE:
            for rows in text_slices(together(), SLICE, name):
                yield rows
            held, size = [], 0
    if held:
        yield from text_slices(together(), SLICE, name)


def _summed(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, the sum of the weights of each, and a place of each."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(weight[order], first) if len(keys) else np.zeros(0, np.int64)
    return ordered[first], sums, order[first]


def part_hashes(chunks: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(h, n): hashes of all phrases shorter than ``max_words``, with their summed weights."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered(batches, "chunk"):
            c = Counted(rows, max_words - 1)
            one = c.hashes()
            for n in range(1, max_words):
                at = np.flatnonzero(c.whole(n))
                keys, sums, _ = _summed(_together(one, n)[at], c.weight[at])
                out = pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], names=["h", "n"])
                yield from (out.slice(i, ROWS_OUT) for i in range(0, len(keys), ROWS_OUT))

    return chunks.mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def bit_filter(hashes: DataFrame, count: int, log_most: int = LOG_BITS_MOST) -> np.ndarray:
    """Words of 64 bits, two bits set for every hash; at most ``2 ** log_most`` bits, of which the driver gets whole words."""
    log_bits = min(log_most, max(LOG_BITS_LEAST, (BITS_EACH * max(1, count) - 1).bit_length()))
    mask = (1 << log_bits) - 1
    places = F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))
    bit = hashes.select(F.explode(places).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("bits")
    ).toArrow()
    out = np.zeros(1 << (log_bits - 6), U)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(U)
    return out


def passing(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask = U(len(bits) * 64 - 1)

    def one(place: np.ndarray) -> np.ndarray:
        return (bits[place >> U(6)] >> (place & U(63))) & U(1) == 1

    return one(h & mask) & one((h >> U(32)) & mask)


def phrase_counts(chunks: DataFrame, bits: np.ndarray, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, words, phrase, n) of the phrases whose parts pass; zero words: all words of a language."""
    sent = chunks.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for rows in gathered(batches, "chunk"):
            c = Counted(rows, max_words - 1)
            strings, one, lang = c.words(), c.hashes(), pa.array(c.lang)
            ids = strings.dictionary_encode()
            key, kinds = c.lang.astype(np.int64) * max(1, len(ids.dictionary)) + ids.indices.to_numpy(zero_copy_only=False), 1
            at = np.flatnonzero(c.counts)
            langs, sums, _ = _summed(c.lang[at], c.weight[at])
            yield pa.RecordBatch.from_arrays([
                c.langs.take(pa.array(langs)), pa.array(np.zeros(len(langs), np.int32)), pa.array([""] * len(langs), pa.string()), pa.array(sums),
            ], names=["lang", "words", "phrase", "n"])
            passes = None
            for n in range(1, max_words + 1):
                if n == 1:
                    word = key = np.unique(key, return_inverse=True)[1]
                    kinds = int(key.max()) + 1 if len(key) else 1
                else:
                    key = np.unique(key[: len(key) - 1] * kinds + word[n - 1 :], return_inverse=True)[1] if len(key) > 1 else key[:0]
                fits = c.whole(n)
                if n < max_words:
                    own = passing(bits, _together(one, n))
                    good = own if passes is None else own & passes[: len(own)] & passes[1 : 1 + len(own)]
                else:
                    good = passes[: len(fits)] & passes[1 : 1 + len(fits)] if passes is not None else np.ones(len(fits), bool)
                passes = good
                at = np.flatnonzero(fits & good)
                _, sums, where = _summed(key[at], c.weight[at])
                where = at[where]
                for i in range(0, len(where), ROWS_OUT):
                    some = where[i : i + ROWS_OUT]
                    parts = [strings.take(pa.array(some + j)) for j in range(n)]
                    yield pa.RecordBatch.from_arrays([
                        c.langs.take(lang.take(pa.array(some))), pa.array(np.full(len(some), n, np.int32)),
                        pc.binary_join_element_wise(*parts, " "), pa.array(sums[i : i + ROWS_OUT]),
                    ], names=["lang", "words", "phrase", "n"])

    return chunks.mapInArrow(count, COUNTED).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def ranked(counts: DataFrame, top: int = TOP, contained_percent: int = CONTAINED_PERCENT) -> DataFrame:
    """The best ``top`` phrases of each language, from whole counts of frequent phrases and of all words."""
    spark = counts.sparkSession
    known = counts.select("lang", "phrase", F.col("n").alias("f"))
    split = F.split("phrase", " ")
    phrases = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), split.alias("w"))

    def part(start, length):
        return F.array_join(F.slice("w", start, length), " ")

    cuts = phrases.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # Whole numbers of up to 38 digits; a * a <= l * r, so the quotient is at most a million.
    exact = "CAST({0} AS DECIMAL(18, 0)) * CAST({1} AS DECIMAL(18, 0))"
    score = F.expr(f"CAST(({exact.format('a', 'a')}) * 1000000 AS DECIMAL(38, 0)) div ({exact.format('l', 'r')})")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low")
    ).select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    sub = phrases.where("words > 2").select("lang", "a", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("k"))
    sub = sub.select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("k") + 1)).alias("s"))
    longer = sub.groupBy("lang", part(F.col("s"), F.col("k")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < contained_percent * F.col("a"))
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within shares of a language, so that no task ranks a whole one.
    shares = F.pmod(F.xxhash64("phrase"), F.lit(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    best = kept.withColumn("share", shares)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", "n", "score")


def collocations(
    docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP,
    contained_percent: int = CONTAINED_PERCENT, every: int = CHUNK_WORDS, log_bits_most: int = LOG_BITS_MOST,
) -> DataFrame:
    """Per language: lang, rank, phrase, a, l, r, n, score of its best phrases of 2 to ``max_words`` words."""
    if max_words < 2:
        raise ValueError("phrases have two words at least")
    ws = Workspace(docs.sparkSession)
    chunks = ws.table(dictionary(docs, max_words, every), "dictionary")
    frequent = ws.table(part_hashes(chunks, max_words).where(F.col("n") >= min_count).select("h"), "frequent")
    bits = bit_filter(frequent, frequent.count(), log_bits_most)
    counts = ws.table(phrase_counts(chunks, bits, max_words).where((F.col("n") >= min_count) | (F.col("words") == 0)), "counts")
    return ranked(counts, top, contained_percent)
