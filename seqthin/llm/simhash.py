"""Near-duplicates by SimHash fingerprints, compared exactly, tile by tile.

Fingerprints sum the bits of the XXH64 hashes of a text's word shingles.  Equal
fingerprints collapse first.  Two that differ in at most ``radius`` bits agree in
``BLOCKS - radius`` of ``BLOCKS`` stretches of bits at least, so every choice of that
many stretches is a join key.  Rows with equal keys meet in order of their population
counts and are cut into tiles; tiles are compared by exclusive-or and bit counts, and
a pair of tiles is skipped when their population counts lie further apart than the
radius.  A key with many rows is dealt to several tasks by pairs of its parts.  No
list of pairs is kept: each task returns links that join what it found linked, at
most one for each row, and groups spread along links until nothing changes.

Defined cases: a null or wordless text has fingerprint zero and links like any other;
equal rows get equal answers; a null doc_id belongs to its group but never names it
unless all do; an empty table gives no rows; other columns are ignored by
``components`` and kept by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqthin.llm.batches import letting_go, small_batches, text_slices
from seqthin.workspace import Workspace

WORDS, RADIUS, BLOCKS, SEED = 4, 4, 6, 42
PART_ROWS = 20_000
TILE = 1024


def fingerprints(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """64-bit fingerprints of whole texts: a bit is set where over half the shingles have it."""
    hashed, counts, digest = [], [], xxhash.xxh64_intdigest
    for t in texts:
        w = t.lower().split()
        if len(w) <= words:
            shingles = [b" ".join(w)] if w else []
            hashed += [digest(s, SEED) for s in shingles]
            counts.append(len(shingles))
            continue
        line = b" ".join(w)
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(w) - words + 1].tolist()
        hashed += [digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]
        counts.append(len(starts))
    counts = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    h = np.array(hashed, "<u8")
    first = (np.cumsum(counts) - counts)[some]
    ones = np.zeros((len(some), 64), np.int64)
    # Bit planes one at a time keep memory at a few bytes a shingle.
    for bit in range(64):
        ones[:, bit] = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), first)
    majority = 2 * ones > counts[some][:, None]
    out[some] = (majority.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprint_rows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, tid, fp): a hash of the text, and the fingerprint as a BIGINT bit pattern."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch):
                texts = [t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("tid"), pa.array(fingerprints(texts, words).view(np.int64))],
                    names=["doc_id", "tid", "fp"],
                )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("tid"), "text")
    return rows.mapInArrow(letting_go(make), "doc_id bigint, tid bigint, fp bigint")


def stretches(blocks: int) -> list[int]:
    """Masks that divide 64 bits."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def key_masks(blocks: int, radius: int) -> list[int]:
    masks = [sum(c) for c in combinations(stretches(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def tile_links(fps: np.ndarray, other: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all fingerprints within the radius: inside one part, or across two.

    Rows already joined by an earlier link give no further one.
    """
    everything = fps if other is None else np.concatenate([fps, other])
    order = np.argsort(np.bitwise_count(everything), kind="stable")
    x, group = everything[order], np.arange(len(order))
    side = order >= len(fps)
    pops = np.bitwise_count(x).astype(np.int64)
    left, right = [], []
    for a in range(0, len(x), TILE):
        for b in range(a, len(x), TILE):
            if pops[b] - pops[min(a + TILE, len(x)) - 1] > radius:
                break
            near = np.bitwise_count(x[a : a + TILE, None] ^ x[None, b : b + TILE]) <= radius
            if other is not None:
                near &= side[a : a + TILE, None] != side[None, b : b + TILE]
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            ahead = (i < j) & (group[i] != group[j])
            i, j = i[ahead], j[ahead]
            while len(i):
                # Every group takes one link to the smallest group it touches, then groups merge.
                p, q = group[i], group[j]
                low, high = np.minimum(p, q), np.maximum(p, q)
                by = np.lexsort((low, high))
                first = by[np.concatenate(([True], high[by][1:] != high[by][:-1]))]
                left.append(x[i[first]])
                right.append(x[j[first]])
                to = np.arange(len(group))
                to[high[first]] = low[first]
                while (to[to] != to).any():
                    to = to[to]
                group = to[group]
                open_ = group[i] != group[j]
                i, j = i[open_], j[open_]
    none = np.zeros(0, x.dtype)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def short_links(key: np.ndarray, fps: np.ndarray, longest: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All links inside short runs of equal keys, by comparing rows 1, 2, … apart."""
    left, right = [], []
    for d in range(1, longest):
        near = (key[d:] == key[:-d]) & (np.bitwise_count(fps[d:] ^ fps[:-d]) <= radius)
        left.append(fps[:-d][near])
        right.append(fps[d:][near])
    none = np.zeros(0, fps.dtype)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


SHORT = 32


def links(distinct: DataFrame, ws: Workspace, radius: int = RADIUS, blocks: int = BLOCKS, part_rows: int = PART_ROWS) -> DataFrame:
    """(a, b): fingerprints of ``distinct`` joined by links within the radius."""
    masks = key_masks(blocks, radius)
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("key"))
        for i, m in enumerate(masks)
    ])).alias("k")).select("fp", "k.choice", "k.key")
    # Keys of one row link nothing; a key of many rows gets parts, and every pair of parts a task.
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = ws.table(sizes.withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int")), "keys")
    met = keyed.join(sizes, ["choice", "key"])
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = met.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select(
        "choice", "key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "fp"
    )
    task = ["choice", "key", "p", "q"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def columns(batch):
            return [batch.column(c).to_numpy(zero_copy_only=False) for c in (*task, "part", "fp")]

        def done(rows: list[np.ndarray]):
            """Links of whole runs of equal task keys."""
            choice, key, p, q, part, fp = rows
            fp = fp.view(np.uint64)
            fresh = np.ones(len(fp), bool)
            fresh[1:] = False
            for c in (choice, key, p, q):
                fresh[1:] |= c[1:] != c[:-1]
            start = np.flatnonzero(fresh)
            size = np.diff(np.append(start, len(fp)))
            run = np.repeat(np.arange(len(start)), size)
            # Parts compared with themselves, in short runs.
            small = (size <= SHORT)[run] & (p == q)
            out = [short_links(run[small], fp[small], SHORT, radius)]
            for at, n in zip(start[(size > SHORT) | (p[start] != q[start])], size[(size > SHORT) | (p[start] != q[start])]):
                f, own = fp[at : at + n], part[at : at + n] == p[at]
                out.append(tile_links(f[own], None if own.all() and p[at] == q[at] else f[~own], radius))
            a, b = (np.concatenate(c) for c in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = columns(batch)
            held.append(rows)
            same = np.ones(len(rows[0]), bool)
            for c in rows[:4]:
                same &= c == c[-1]
            # The last run may go on in the next batch.
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if last == 0 and (len(held) == 1 or all(h[i][-1] == rows[i][-1] for h in held[-2:-1] for i in range(4))):
                continue
            whole = [np.concatenate([*(h[i] for h in held[:-1]), rows[i][:last]]) for i in range(6)]
            held = [[c[last:] for c in rows]]
            if len(whole[0]):
                yield done(whole)
        if held:
            whole = [np.concatenate([h[i] for h in held]) for i in range(6)]
            if len(whole[0]):
                yield done(whole)

    sorted_ = met.repartition(*task).sortWithinPartitions(*task)
    return ws.table(sorted_.mapInArrow(letting_go(compare), "a bigint, b bigint").distinct(), "links")


def spread(links_: DataFrame, ws: Workspace) -> DataFrame:
    """(node, root): the smallest node reachable along links, for every linked node.

    Rounds of two steps: neighbours hang on the smallest of a node's neighbourhood,
    first the larger ones, then the smaller ones; links shrink to stars.  A hub's
    neighbours are rows, and only their minimum is grouped.
    """
    edges = ws.table(links_.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = ws.table(large.where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v")
        hung = least.select("u", F.col("least").alias("v"))
        edges = ws.table(small.unionByName(hung).distinct(), "small-star")
        # A star forest: nobody is both above and below, and nobody has two parents.
        state = edges.agg(
            F.count("*").alias("n"), F.countDistinct("u").alias("children"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")
        ).first()
        if before == (state["n"], state["sum"]):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (state["n"], state["sum"])


def _grouped(docs: DataFrame, ws: Workspace, words: int, radius: int, blocks: int, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, tid, fp) and, for every fingerprint, the smallest one it reaches (fp, root, least)."""
    rows = ws.table(fingerprint_rows(docs, words), "fingerprints")
    distinct = ws.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = spread(links(distinct.select("fp"), ws, radius, blocks, part_rows), ws)
    return rows, distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )


def components(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, blocks: int = BLOCKS, part_rows: int = PART_ROWS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows, named = _grouped(docs, Workspace(docs.sparkSession), words, radius, blocks, part_rows)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, blocks: int = BLOCKS, part_rows: int = PART_ROWS) -> DataFrame:
    """Of each component the row with the smallest doc_id, all columns kept.

    Rows with a null doc_id always stay; of rows equal in doc_id and text one stays.
    """
    ws = Workspace(docs.sparkSession)
    known = docs.where("doc_id IS NOT NULL")
    rows, named = _grouped(known, ws, words, radius, blocks, part_rows)
    member = ws.table(rows.join(named.select("fp", "root"), "fp").select("doc_id", "tid", "root"), "members")
    stays = member.groupBy("root").agg(F.min(F.struct("doc_id", "tid")).alias("stays"))
    gone = member.join(stays, "root").where("stays <> struct(doc_id, tid)").select("doc_id", "tid")
    # A written table: the optimizer sees its size and broadcasts it only where it is small.
    gone = ws.table(gone.distinct(), "gone").select(F.col("doc_id").alias("_gone"), F.col("tid").alias("_gone_text"))
    same = (docs["doc_id"] == gone["_gone"]) & (F.xxhash64(docs["text"]) == gone["_gone_text"])
    kept = docs.join(gone, same, "left_anti")
    repeats = member.groupBy("doc_id", "tid").agg(F.count("*").alias("n")).where("n > 1")
    if repeats.isEmpty():
        return kept
    first = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    return first.unionByName(kept.where("doc_id IS NULL"))
