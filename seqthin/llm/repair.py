"""Token-id files compressed by a Re-Pair grammar.

Documents are encoded in ascending doc_id order and cut into blocks of about a
million ids.  Within a block, rounds replace frequent pairs of neighbouring ids by
new ids (nonterminals): each round gives rules to the most frequent pair and to all
that occur at least a sixteenth as often; overlapping occurrences are
taken from the left.  Rounds end when no pair is frequent, or when new ids would no
longer fit two bytes.  Pairs never cross the end of a document.

A file row (Parquet, written through Spark, so lost tasks are simply redone) holds
one block: its rules, the length each rule expands to, the remaining ids, and the
doc_id and number of ids of every document.  The lengths place any document's ids
without expanding what stands before it (``read_range``).

Defined cases: a null text is empty, so only its end id is stored; null doc_ids
come first; equal doc_ids each keep their own ids, in order of their texts; an
empty table gives an empty file; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqthin.llm.batches import ranges, small_batches, text_slices
from seqthin.llm.tokens import encoder, with_end
from seqthin.workspace import Workspace

END = 2
VOCABULARY = 50_257
BLOCK_IDS = 1 << 20
ID_LIMIT = 1 << 16
MIN_PAIRS = 8
#: Rules that stand for more ids are opened step by step, not from a table.
TABLE_WIDTH = 64
#: A round takes the pairs down to this part of the most frequent one's occurrences.
LEVEL = 16
#: Pairs are looked for in a table of so many bits first.
TABLE_BITS = 20
#: Places of infrequent pairs are dropped once the places kept are so many times the frequent ones.
PRUNED_AT = 2

BLOCK_SCHEMA = (
    "part int, block int, n_ids bigint, doc_ids array<bigint>, n_tokens array<int>, "
    "rules binary, rule_lengths binary, sequence binary"
)
DOC_SCHEMA = "part int, block int, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint"


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in ascending order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def found(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the ascending ones, and where."""
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[at] == keys, at


class Block:
    """Ids of a block as a chain, so that a replaced pair leaves a hole and moves nothing."""

    def __init__(self, ids: np.ndarray, closing: np.ndarray):
        n = len(ids)
        # The last place stands for the outside, behind which nothing follows.
        self.ids = np.append(ids, np.uint32(0)).astype(np.uint32)
        self.after = np.append(np.arange(1, n + 1), n).astype(np.int32)
        self.before = np.concatenate(([n], np.arange(n))).astype(np.int32)
        self.opens = np.append(~closing, False)  # pairs never cross the end of a document
        self.stands = np.append(np.ones(n, bool), False)

    def pairs(self, at: np.ndarray) -> np.ndarray:
        return (self.ids[at] << np.uint32(16)) | self.ids[self.after[at]]

    def replace(self, at: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Put new ids for the pairs at ascending places; the pairs that vanish, those that appear, and where."""
        second = self.after[at]
        around = self.touched(at, second)
        gone = self.pairs(around)
        after = self.after[second]
        self.ids[at], self.opens[at], self.after[at] = new, self.opens[second], after
        self.before[after] = at
        self.stands[second] = self.opens[second] = False
        around = self.touched(at, at[:0])
        return gone, self.pairs(around), around

    def touched(self, at: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Places of pairs that hold a given place, each once."""
        before = self.before[at]
        follows = np.append(False, before[1:] == (second if len(second) else at)[:-1])
        places = np.concatenate((at, second, before[~follows]))
        return places[self.opens[places]]


def chosen_pairs(pairs: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The pairs of the highest level, ascending; of too many the most frequent ones, ties go to smaller ids."""
    some = np.flatnonzero(counts * LEVEL >= counts.max())
    if len(some) > most:
        some = some[np.lexsort((pairs[some], -counts[some]))][:most]
    return np.sort(pairs[some])


class Among:
    """Tells which pairs may be among some, by one bit of a hash table."""

    def __init__(self):
        self.table = np.zeros(1 << TABLE_BITS, bool)

    def __call__(self, pairs: np.ndarray, some: np.ndarray) -> np.ndarray:
        slot = lambda p: (p * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)
        mine = slot(some)
        self.table[mine] = True
        out = self.table[slot(pairs)]
        self.table[mine] = False
        return out


def pair_rules(ids: np.ndarray, closing: np.ndarray, base: int, limit: int, least: int):
    """Grammar of a block: rules (n, 2), and what remains of the ids.

    ``closing`` marks the last id of every document.  Pairs are counted once; later
    rounds change the counts by the pairs that vanish and appear around replaced places.
    A pair of old ids never gains occurrences, so infrequent ones are forgotten.
    """
    rules, n_rules, among = [np.zeros((0, 2), np.uint32)], 0, Among()
    block = Block(ids, closing)
    block.opens &= block.after < len(ids)
    at = np.flatnonzero(block.opens)
    here = block.pairs(at)
    pairs, counts = tally(here)
    while n_rules < limit - base:
        frequent = counts >= least
        pairs, counts = pairs[frequent], counts[frequent]
        if not len(pairs):
            break
        if len(at) > PRUNED_AT * counts.sum():
            some = among(here, pairs)
            at, here = at[some], here[some]
        best = chosen_pairs(pairs, counts, limit - base - n_rules)
        some = np.flatnonzero(among(here, best))
        hit, rule = found(here[some], best)
        hits, rule = at[some[hit]], rule[hit]
        # Of neighbouring hits every second one, counted from the left of their run.
        run = np.append(True, block.after[hits[:-1]] != hits[1:])
        since = np.arange(len(hits)) - np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))
        taken = since % 2 == 0
        hits, rule = hits[taken], rule[taken]
        # Rules whose every occurrence was overlapped get no number.
        used = np.bincount(rule, minlength=len(best)) > 0
        rules.append(np.stack([best[used] >> np.uint32(16), best[used] & np.uint32(0xFFFF)], axis=1))
        gone, come, places = block.replace(hits, (base + n_rules + np.cumsum(used) - 1).astype(np.uint32)[rule])
        n_rules += int(used.sum())
        gone, n_gone = tally(gone)
        known, where = found(gone, pairs)
        counts[where[known]] -= n_gone[known]
        come, n_come = tally(come)
        # What appears holds a new id, so it was not counted before.
        pairs, counts = np.concatenate((pairs, come)), np.concatenate((counts, n_come))
        order = np.argsort(pairs)
        pairs, counts = pairs[order], counts[order]
        live = np.zeros(len(ids) + 1, bool)
        live[at] = live[places] = True
        at = np.flatnonzero(live & block.opens)
        here = block.pairs(at)
    return np.concatenate(rules), block.ids[block.stands]


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for; a rule uses earlier rules only."""
    out = np.ones(base + len(rules), np.int64)
    done = 0
    while done < len(rules):
        # All rules up to the first that uses a rule of this stretch.
        late = np.flatnonzero((rules[done:] >= base + done).any(axis=1))
        upto = done + (int(late[0]) if len(late) else len(rules) - done)
        out[base + done : base + upto] = out[rules[done:upto]].sum(axis=1)
        done = upto
    return out[base:]


def opened(ids: np.ndarray, inner: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids with the marked ones replaced by both sides of their rules."""
    sizes = 1 + inner
    first = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint32)
    pairs = rules[ids[inner] - base]
    out[first[~inner]] = ids[~inner]
    out[first[inner]], out[first[inner] + 1] = pairs[:, 0], pairs[:, 1]
    return out


def expand(sequence: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids a sequence stands for.

    Rules that stand for many ids are opened level by level; the others are looked up
    in a table of their ids, which holds ``TABLE_WIDTH`` ids a rule at most.
    """
    ids = sequence.astype(np.uint32)
    widths = np.concatenate((np.ones(base, np.int64), lengths))
    while (long := widths[ids] > TABLE_WIDTH).any():
        ids = opened(ids, long, rules, base)
    short = np.flatnonzero(lengths <= TABLE_WIDTH)
    table = (base + short).astype(np.uint32)
    while (inner := table >= base).any():
        table = opened(table, inner, rules, base)
    first = np.arange(base + len(rules))
    first[base + short] = base + np.cumsum(lengths[short]) - lengths[short]
    return np.concatenate((np.arange(base, dtype=np.uint32), table))[ranges(first[ids], widths[ids])]


def read_range(sequence, rules, lengths, base: int, start: int, n: int) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of a block, expanding only what covers them."""
    wide = np.where(sequence >= base, np.concatenate((lengths, [1]))[np.where(sequence >= base, sequence.astype(np.int64) - base, -1)], 1)
    ends = np.cumsum(wide)
    lo, hi = np.searchsorted(ends, [start, start + n - 1], side="right") if n else (0, -1)
    skipped = start - (ends[lo] - wide[lo]) if n else 0
    return expand(sequence[lo : hi + 1], rules, lengths, base)[skipped : skipped + n]


def block_row(part: int, block: int, docs: list, ids: np.ndarray, sizes: np.ndarray, base: int, limit: int, least: int) -> dict:
    closing = np.zeros(len(ids), bool)
    closing[np.cumsum(sizes) - 1] = True
    rules, rest = pair_rules(ids, closing, base, limit, least)
    return {
        "part": part, "block": block, "n_ids": len(ids), "doc_ids": docs, "n_tokens": sizes.tolist(),
        "rules": rules.astype("<u2").tobytes(),
        "rule_lengths": expansion_lengths(rules, base).astype("<u4").tobytes(),
        "sequence": rest.astype("<u2").tobytes(),
    }


def write_repair(
    docs: DataFrame, path: str, tokenizer: str, end: int = END, base: int = VOCABULARY,
    block_ids: int = BLOCK_IDS, limit: int = ID_LIMIT, least: int = MIN_PAIRS,
) -> None:
    """Encode whole texts of (doc_id, text) and write their blocks to ``path``.

    ``base``: first id the tokenizer never uses; ``limit``: ids stay below it (two bytes).
    """
    fields = pa.schema([
        ("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())),
        ("rules", pa.binary()), ("rule_lengths", pa.binary()), ("sequence", pa.binary()),
    ])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, docs_held = TaskContext.get().partitionId(), 0, [], []
        enc = encoder(tokenizer)

        def flush():
            nonlocal block, held, docs_held
            ids = np.concatenate([h[0] for h in held])
            sizes = np.concatenate([h[1] for h in held])
            row = block_row(part, block, docs_held, ids, sizes, base, limit, least)
            block, held, docs_held = block + 1, [], []
            return pa.RecordBatch.from_pylist([row], schema=fields)

        for batch in batches:
            for piece in text_slices(batch):
                ids, n = with_end(*enc.encode(piece.column("text")), end)
                names = piece.column("doc_id").to_pylist()
                at = lo = 0
                while lo < len(n):
                    room = block_ids - sum(len(h[0]) for h in held)
                    ends = np.cumsum(n[lo:])
                    take = int(np.searchsorted(ends, room, side="right"))
                    if take == 0 and held:
                        yield flush()
                        continue
                    take = max(1, take)
                    width = int(ends[take - 1])
                    held.append((ids[at : at + width], n[lo : lo + take]))
                    docs_held += names[lo : lo + take]
                    at, lo = at + width, lo + take
        if held:
            yield flush()

    small_batches(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange("doc_id")
    ordered.sortWithinPartitions("doc_id", "text").mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(path)


def read_repair(spark: SparkSession, path: str, base: int = VOCABULARY) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    fields = pa.schema([
        ("part", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("inner", pa.int64()),
        ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
    ])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rules = np.frombuffer(row["rules"], "<u2").astype(np.uint32).reshape(-1, 2)
                lengths = np.frombuffer(row["rule_lengths"], "<u4").astype(np.int64)
                ids = expand(np.frombuffer(row["sequence"], "<u2"), rules, lengths, base).astype("<u4", copy=False)
                n = np.array(row["n_tokens"], np.int64)
                ends = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * len(n), pa.int32()), pa.array([row["block"]] * len(n), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(ends - n), pa.array(n), pa.array(sums, pa.int64()),
                ], schema=fields)

    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_ids").over(parts), F.lit(0))
    # One row per part of the file.
    part_first = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before.alias("part_first"))
    first = blocks.select("part", "block", "n_ids").join(part_first, "part").select(
        "part", "block", (F.col("part_first") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("first")
    )
    read = blocks.select("part", "block", "doc_ids", "n_tokens", "rules", "rule_lengths", "sequence").mapInArrow(documents, DOC_SCHEMA)
    return read.join(first, ["part", "block"]).select(
        "doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"
    )


def repair_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents to the shared folder and read them back."""
    spark = docs.sparkSession
    path = f"{Workspace(spark).path}/repair"
    write_repair(docs, path, tokenizer)
    return read_repair(spark, path)
