"""Vector codes: product quantization trained by k-means with adaptive distance bounds.

Vectors become whole numbers and are cut into consecutive parts, each with a codebook of
its own.  A round assigns every part to its nearest entry and moves the entries.  What a
vector knows of the distances is kept as a table between rounds: for every part the ``b``
closest entries, assigned one first, an ordered lower bound for each of the others and one
outer bound for all entries not named.  When entries move, a bound falls by the way its
entry went, the outer bound by the longest way.  A part whose distance to its entry is
clearly below all its bounds keeps it unseen; entries whose bound it doesn't clear are
measured in whole numbers, and only a part that doesn't clear the outer bound meets all
entries again.  ``b`` grows while many parts meet all entries, and shrinks while few
bounds of the list are looked at.

Bounds are floating point and only tell what may be skipped, with a margin; all
assignments, ties included, follow from exact whole-number distances.  Sums per entry are
combined in tasks; the driver holds the codebooks, whose size the corpus doesn't change.

Defined cases: rows whose vector is null, or has null, NaN or infinite components, are
dropped; so are empty vectors and those of another length than the kept vector of the
smallest id (which must divide into the parts).  Rows with a null id are coded and come
last in the choice of first entries; equal ids are ordered by their components.  Fewer
vectors than entries make smaller codebooks.  Components beyond what 64-bit sums of
squares hold are an error.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqthin.workspace import Workspace

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries kept for a part: at first, at least, and at most as a share of all.
CLOSEST, CLOSEST_LEAST, CLOSEST_SHARE = 16, 4, 4
#: ``CLOSEST`` doubles where more parts meet all entries, halves where fewer look past half their list.
OFTEN, SELDOM = 1 / 8, 1 / 64
MARGIN = 1e-9
ROWS_AT_ONCE = 4096
LABEL_SALTS = 32


def _list(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def whole_vectors(table: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, ints): vectors of finite components as whole numbers ``floor(scale * x)``."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = column.flatten()
            known = values.is_valid().to_numpy(zero_copy_only=False)
            values = pc.fill_null(values.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            good = known & np.isfinite(values)
            ends = np.cumsum(sizes)
            upto = np.concatenate(([0], np.cumsum(~good)))
            keep = (upto[ends] == upto[ends - sizes]) & (sizes > 0)
            x = np.floor(values[np.repeat(keep, sizes)] * scale)
            width = int(sizes[keep].max(initial=1))
            if (np.abs(x) > np.sqrt(2.0**62 / width) / 2).any():
                raise ValueError("components too large for 64-bit sums of squares")
            offsets = np.concatenate(([0], np.cumsum(sizes[keep]))).astype(np.int32)
            kept = batch.filter(pa.array(keep))
            ints = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), ints], names=["vec_id", "label", "ints"])

    rows = table.select(F.col("vec_id").cast("bigint"), "label", F.col(vector).alias("vector"))
    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(convert, f"vec_id bigint, label {kind}, ints array<bigint>")


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact."""
    top = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if 4.0 * x.shape[1] * float(top) ** 2 < 2.0**53:
        # Every term and sum is a whole number that a double holds.
        a, c = x.astype(float), entries.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - entries[None, :, j]) ** 2
    return out


def search_all(x: np.ndarray, entries: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``b`` closest entries (nearest first, ties to the lower index), bounds (outer first), and the nearest's distance."""
    d = distances(x, entries)
    k = len(entries)
    nearest = d.argmin(axis=1)
    rows = np.arange(len(x))
    if b < k:
        close = np.sort(np.argpartition(d, b, axis=1)[:, : b + 1], axis=1)
    else:
        close = np.broadcast_to(np.arange(k), d.shape)
    held = np.take_along_axis(d, close, axis=1)
    order = np.argsort(held, axis=1, kind="stable")
    close, held = np.take_along_axis(close, order, axis=1), np.take_along_axis(held, order, axis=1)
    near, low = np.full((len(x), b), -1, np.int32), np.full((len(x), b), np.inf)
    size = min(b, k)
    near[:, :size] = close[:, :size]
    # Where more entries than fit are equally near, the first of them is still the nearest.
    near[:, 0] = nearest
    low[:, 1:size] = np.sqrt(held[:, 1:size])
    low[:, 0] = np.sqrt(held[:, b]) if b < k else np.inf
    return near, low, d[rows, nearest]


def move(x: np.ndarray, near: np.ndarray, low: np.ndarray, entries: np.ndarray, went: np.ndarray, b: int):
    """New lists of length ``b`` after entries moved; distances, bounds looked at, and which rows met all entries."""
    n, width = near.shape
    gap = x - entries[near[:, 0]]
    own = (gap * gap).sum(axis=1)
    u = np.sqrt(own)
    far = went.max(initial=0.0)
    # A place without an entry has no bound.
    low = np.concatenate([low[:, :1] - far, low[:, 1:] - np.where(near[:, 1:] >= 0, went[near[:, 1:]], 0.0)], axis=1)
    reach = u + MARGIN * (1 + u + far)
    everything = low[:, 0] <= reach
    unsure = (low[:, 1:] <= reach[:, None]) & ~everything[:, None]
    looked = unsure.sum(axis=1)
    near = near.copy()
    row, at = np.nonzero(unsure)
    at += 1
    if len(row):
        gap = x[row] - entries[near[row, at]]
        d = (gap * gap).sum(axis=1)
        low[row, at] = np.sqrt(d)
        order = np.lexsort((near[row, at], d, row))
        row, at, d = row[order], at[order], d[order]
        first = np.append(True, row[1:] != row[:-1])
        row, at, d = row[first], at[first], d[first]
        better = (d < own[row]) | ((d == own[row]) & (near[row, at] < near[row, 0]))
        row, at, d = row[better], at[better], d[better]
        low[row, at] = u[row]
        near[row, at], near[row, 0] = near[row, 0], near[row, at]
        own[row] = d
    order = np.argsort(low[:, 1:], axis=1, kind="stable") + 1
    near[:, 1:], low[:, 1:] = np.take_along_axis(near, order, axis=1), np.take_along_axis(low, order, axis=1)
    if b < width:
        low[:, 0] = np.minimum(low[:, 0], low[:, b])
        near, low = near[:, :b], low[:, :b]
    elif b > width:
        near = np.concatenate([near, np.full((n, b - width), -1, np.int32)], axis=1)
        low = np.concatenate([low, np.full((n, b - width), np.inf)], axis=1)
    if everything.any():
        near[everything], low[everything], own[everything] = search_all(x[everything], entries, b)
    return near, low, own, looked, everything


def _assigned(rows: DataFrame, books: np.ndarray, before: np.ndarray | None, width: int, b: int) -> DataFrame:
    """One assignment: from vectors alone, or from the state that ``before``'s codebooks left."""
    parts, k, q = books.shape
    went = None if before is None else np.sqrt(((books - before) ** 2).sum(axis=2))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(lo, ROWS_AT_ONCE)
                n = batch.num_rows
                x = _matrix(batch.column("ints"), parts * q)
                near, low = np.empty((n, parts, b), np.int32), np.empty((n, parts, b))
                error, looked, everything = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int32)
                if went is not None:
                    old_near = _matrix(batch.column("near"), parts * width).reshape(n, parts, width)
                    old_low = _matrix(batch.column("low"), parts * width).reshape(n, parts, width)
                for p in range(parts):
                    mine = x[:, p * q : (p + 1) * q]
                    if went is None:
                        near[:, p], low[:, p], d = search_all(mine, books[p], b)
                        everything += 1
                    else:
                        near[:, p], low[:, p], d, some, all_of = move(mine, old_near[:, p], old_low[:, p], books[p], went[p], b)
                        looked = np.maximum(looked, some.astype(np.int32))
                        everything += all_of.astype(np.int32)
                    error += d
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id"), batch.column("label"), batch.column("ints"), _list(near.reshape(n, -1)),
                    _list(low.reshape(n, -1)), pa.array(error), pa.array(looked), pa.array(everything),
                ], names=["vec_id", "label", "ints", "near", "low", "error", "looked", "searched"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(assign, (
        f"vec_id bigint, label {kind}, ints array<bigint>, near array<int>, low array<double>, "
        "error bigint, looked int, searched int"
    ))


def _moved(state: DataFrame, books: np.ndarray, b: int) -> np.ndarray:
    """Codebooks of the means of what is assigned; entries without any stay."""
    parts, k, q = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((parts * k, q), np.int64), np.zeros(parts * k, np.int64)
        for batch in batches:
            x = _matrix(batch.column("ints"), parts * q).reshape(-1, q)
            code = _matrix(batch.column("near"), parts * b)[:, ::b]
            slot = (code + np.arange(parts) * k).reshape(-1)
            order = np.argsort(slot, kind="stable")
            first = np.flatnonzero(np.diff(slot[order], prepend=-1))
            if len(first):
                sums[slot[order[first]]] += np.add.reduceat(x[order], first, axis=0)
            count += np.bincount(slot, minlength=parts * k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), _list(sums[some])], names=["slot", "n", "sums"])

    # One row for each entry: the codebooks' size.
    totals = state.select("ints", "near").mapInArrow(add, "slot bigint, n bigint, sums array<bigint>").groupBy("slot").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(q)]
    ).toArrow()
    out = books.reshape(parts * k, q).copy()
    slot, n = totals.column("slot").to_numpy(), totals.column("n").to_numpy()
    for j in range(q):
        out[slot, j] = totals.column(f"s{j}").to_numpy() // n
    return out.reshape(books.shape)


def _length(b: int, k: int, rows: int, parts: int, searched: int, deep: int) -> int:
    """Length of the next round's lists."""
    if searched > OFTEN * rows * parts:
        return max(b, min(2 * b, k // CLOSEST_SHARE))
    return max(min(b, CLOSEST_LEAST), b // 2) if deep < SELDOM * rows else b


def train(vectors: DataFrame, ws: Workspace, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, closest: int = CLOSEST):
    """Codebooks (parts, entries, components) after ``rounds``, and the table of final assignments with lists of length ``b``."""
    held = ws.table(vectors, "vectors")
    order = [F.asc_nulls_last("vec_id"), F.asc("ints")]
    first = held.orderBy(*order).select(F.size("ints").alias("n")).first()
    if first is None:
        return np.zeros((parts, 0, 0), np.int64), None, 0
    if first["n"] % parts:
        raise ValueError(f"vectors of {first['n']} components have no {parts} equal parts")
    held = held.where(F.size("ints") == first["n"])
    start = held.orderBy(*order).limit(entries).select("ints").toArrow().column("ints").combine_chunks()
    books = _matrix(start, first["n"]).reshape(len(start), parts, -1).transpose(1, 0, 2).astype(np.int64)
    k = books.shape[1]
    b = min(closest, k)
    state = ws.table(_assigned(held, books, None, 0, b), "state-0")
    for r in range(1, rounds + 1):
        before, books = books, _moved(state, books, b)
        seen = state.agg(
            F.count("*").alias("rows"), F.sum("searched").alias("searched"), F.count_if(F.col("looked") > b // 2).alias("deep")
        ).first()
        width, b = b, b if r == 1 else _length(b, k, seen["rows"], parts, seen["searched"], seen["deep"])
        state = ws.table(_assigned(state, books, before, width, b), f"state-{r}")
        ws.drop(f"state-{r - 1}")
    return books, state, b


def compress(
    table: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    scale: int = SCALE, closest: int = CLOSEST,
) -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("an index is two hexadecimal digits")
    ws = Workspace(table.sparkSession)
    vectors = whole_vectors(table, vector, scale)
    books, state, b = train(vectors, ws, parts, entries, rounds, closest)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    if state is None:
        none = vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")).where("false")
    else:
        index = [F.lpad(F.lower(F.hex(F.col("near")[p * b])), 2, "0") for p in range(parts)]
        none = state.select("vec_id", "label", F.concat(*index).alias("code"), "error")
    # Every label's sum is there once for each salt, so rows of a common label meet it in many tasks.
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(LABEL_SALTS))
    sums = none.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(LABEL_SALTS)])))
    rows, sums = none.withColumn("salt", salt).alias("r"), sums.alias("s")
    joined = rows.join(sums, (F.col("r.salt") == F.col("s.salt")) & F.col("r.label").eqNullSafe(F.col("s.label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
