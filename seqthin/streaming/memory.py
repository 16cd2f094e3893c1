"""What earlier batches left behind, in Spark's state store.

Each batch sends one set of requests: the cells and kept records that the batch before
it added (told), and the cells and band keys it needs to know about (asked).  A stateful
query reads them, adds what is told, answers what is asked and ends.  It looks up only
the pages that the requests name, so a batch costs what it touches, however old the
stream is.

Cells travel packed, both ways, and so do the band keys asked for: a row has those of a page
that one task sends or asks for, eight bytes each, so the rows that Python sees grow with pages
and tasks.

State is keyed by a bucket of the hash of a cell or band key.  In a bucket, cells lie in
pages by further bits of the hash.  Kept records lie, once a band key, in numbered pages of
bounded size, filled as they come, for each of the same stretches of the hash; the numbers
of the pages that hold a band key are kept beside, so keys that nobody told of are found
missing together, and only pages that hold one asked for are read.  Band keys are salted by
record number.  Everything told is a set, so requests that
are sent again after a failure change nothing.  Nothing expires.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

REQUEST = "kind string, told boolean, bucket int, page int, item bigint, ord bigint, mbucket int, sketch array<bigint>, items binary"
ANSWER = "kind string, item bigint, ord bigint, mbucket int, sketch array<bigint>, pages bigint, items binary"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CELL, KEPT, READ = "cell", "kept", "read"
SALTS = 4
PAGE = 256
#: Cells or band keys a task gathers before it packs them.
PACKED = 1 << 21
#: Kept records that a bucket gathers before it answers.
GIVEN = 1 << 13


class Memory(StatefulProcessor):
    """Sets of cells, and kept records by band key, of one bucket."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState("cells", "page int", "held binary")
        self.names = handle.getMapState("names", "page int", "item binary, number binary")
        self.kept = handle.getMapState("kept", "page int, number int", "item binary, ord binary, mbucket binary, sketch binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        requests = pd.concat(list(rows), ignore_index=True)
        yield from (self._cells if key[0] == CELL else self._kept)(requests)

    def close(self) -> None:
        pass

    def _cells(self, requests: pd.DataFrame) -> Iterator[pd.DataFrame]:
        pages = 0
        for page, part in requests.groupby("page"):
            found = self.cells.getValue((int(page),))
            held = np.frombuffer(bytes(found[0]), np.int64) if found else np.empty(0, np.int64)
            sent, asked = (
                np.concatenate([np.empty(0, np.int64), *[np.frombuffer(bytes(b), np.int64) for b in part.loc[part["told"] == told, "items"]]])
                for told in (True, False)
            )
            now = np.union1d(held, sent)
            if len(now) > len(held):
                self.cells.updateValue((int(page),), (now.tobytes(),))
            known = asked[np.isin(asked, now)]
            if len(known):
                yield _answers(CELL, items=[known.tobytes()])
            pages += 1
        yield _answers(READ, pages=np.array([pages]))

    def _kept(self, requests: pd.DataFrame) -> Iterator[pd.DataFrame]:
        looked, found, waiting = 0, [], 0
        for page, part in requests.groupby("page"):
            page, told = int(page), part["told"].to_numpy(bool)
            named = self.names.getValue((page,))
            item = np.frombuffer(bytes(named[0]), np.int64) if named else np.empty(0, np.int64)
            where = np.frombuffer(bytes(named[1]), np.int32) if named else np.empty(0, np.int32)
            asked = np.unique(np.concatenate([np.empty(0, np.int64), *[np.frombuffer(bytes(b), np.int64) for b in part.loc[~told, "items"]]]))
            sent, last, tail = _sent(part[told]), int(where.max(initial=-1)), None
            # Only pages that hold a name asked for or told of are read, and the last one, which may have room.
            needed = set(where[np.isin(item, np.concatenate([asked, sent[0]]))].tolist()) | ({last} if len(sent[0]) and last >= 0 else set())
            looked += 1 + len(needed)
            for n in sorted(needed):
                held = _unpacked(self.kept.getValue((page, n)))
                sent = _unlike(sent, held)
                tail = held if n == last else None
                some = np.isin(held[0], asked)
                found.append(tuple(a[some] for a in held))
                waiting += int(some.sum())
                if waiting >= GIVEN:
                    yield _records(found)
                    found, waiting = [], 0
            if not len(sent[0]):
                continue
            some = np.isin(sent[0], asked)
            found += [tuple(a[some] for a in sent)] if some.any() else []
            waiting += int(some.sum())
            if tail is not None and len(tail[0]) < PAGE:
                sent, first = tuple(np.concatenate(both) for both in zip(tail, sent)), last
            else:
                first = last + 1
            item, where = [item[where < first]], [where[where < first]]
            for n, lo in enumerate(range(0, len(sent[0]), PAGE), first):
                some = tuple(a[lo : lo + PAGE] for a in sent)
                self.kept.updateValue((page, n), tuple(a.tobytes() for a in some))
                item.append(np.unique(some[0]))
                where.append(np.full(len(item[-1]), n, np.int32))
            self.names.updateValue((page,), (np.concatenate(item).tobytes(), np.concatenate(where).tobytes()))
        if waiting:
            yield _records(found)
        yield _answers(READ, pages=np.array([looked]))


def _sent(told: pd.DataFrame) -> tuple:
    """(item, ord, mbucket, sketch) of what is told, each record once a name."""
    told = told.drop_duplicates(["item", "ord"])
    sketches = np.stack(told["sketch"].to_list()).astype(np.int64) if len(told) else np.empty((0, 0), np.int64)
    return told["item"].to_numpy(np.int64), told["ord"].to_numpy(np.int64), told["mbucket"].to_numpy(np.int32), sketches


def _unlike(sent: tuple, held: tuple) -> tuple:
    """What is told without the records that a page has under the same names."""
    if not len(sent[0]):
        return sent
    known = {*zip(held[0].tolist(), held[1].tolist())}
    new = np.array([pair not in known for pair in zip(sent[0].tolist(), sent[1].tolist())])
    return tuple(a[new] for a in sent)


def _records(found: list) -> pd.DataFrame:
    found = [f for f in found if len(f[0])]
    item, ords, months, sketches = (np.concatenate(x) for x in zip(*found))
    return _answers(KEPT, item=item, ord=ords, mbucket=months, sketch=list(sketches))


def _unpacked(value: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, ord, mbucket, sketch) of a page."""
    items = np.frombuffer(bytes(value[0]), np.int64)
    return items, np.frombuffer(bytes(value[1]), np.int64), np.frombuffer(bytes(value[2]), np.int32), np.frombuffer(bytes(value[3]), np.int64).reshape(len(items), -1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the cells of a page, of up to about ``PACKED`` cells at once."""

    def give(parts: list) -> pa.RecordBatch:
        bucket, page, item = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("bucket", "page", "item"))
        order = np.lexsort((page, bucket))
        bucket, page, item = bucket[order], page[order], item[order]
        cut = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (page[1:] != page[:-1])))
        items = [item[lo:hi].tobytes() for lo, hi in zip(cut, np.append(cut[1:], len(item)))]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(page[cut]), pa.array(items, pa.binary())], names=["bucket", "page", "items"])

    parts, waiting = [], 0
    for batch in batches:
        if batch.num_rows:
            parts.append(batch)
            waiting += batch.num_rows
        if waiting >= PACKED:
            yield give(parts)
            parts, waiting = [], 0
    if parts:
        yield give(parts)


def _unpacked_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for items in batch.column("items"):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(items.as_py(), np.int64))], names=["item"])


def _answers(kind: str, **columns) -> pd.DataFrame:
    n = len(next(iter(columns.values())))
    empty = pd.Series([None] * n, dtype=object)
    out = {"kind": pd.Series([kind] * n, dtype=object)}
    for name, dtype in (("item", "Int64"), ("ord", "Int64"), ("mbucket", "Int32"), ("sketch", object), ("pages", "Int64"), ("items", object)):
        out[name] = pd.Series(columns[name], dtype=dtype) if name in columns else empty.astype(dtype)
    return pd.DataFrame(out)


class BatchMemory:
    """Sends a batch's requests through the stateful query; state lies under ``folder``.

    ``buckets`` and ``pages`` divide cells; choose them so that a page (of all cells ever
    seen) stays within a megabyte.  ``partitions`` state stores share the buckets.  A
    stream keeps the three numbers it began with.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, pages: int = 64, partitions: int | None = None):
        self.spark, self.folder, self.buckets, self.pages = spark, folder, buckets, pages
        self.partitions = partitions or min(spark.sparkContext.defaultParallelism, 2 * buckets)

    def cells(self, cells: DataFrame, told: bool) -> DataFrame:
        """Requests of (cell)."""
        return self._asked(cells.select(*self._place(F.xxhash64("cell")), F.col("cell").alias("item")), CELL, told)

    def kept(self, records: DataFrame) -> DataFrame:
        """What is told of kept records (key, ord, mbucket, sketch), a row per band key."""
        salt = F.pmod("ord", F.lit(SALTS)).cast("int")
        return records.select(
            F.lit(KEPT).alias("kind"), F.lit(True).alias("told"), *self._place(F.xxhash64("key", salt)), F.col("key").alias("item"),
            "ord", "mbucket", "sketch", F.lit(None).cast("binary").alias("items"),
        )

    def resembling(self, keys: DataFrame) -> DataFrame:
        """Requests for the kept records under (key)."""
        salted = keys.distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return self._asked(salted.select(*self._place(F.xxhash64("key", "salt")), F.col("key").alias("item")), KEPT, False)

    def _place(self, mixed: Column) -> list[Column]:
        return [
            F.pmod(mixed, F.lit(self.buckets)).cast("int").alias("bucket"),
            F.pmod(F.shiftright(mixed, 32), F.lit(self.pages)).cast("int").alias("page"),
        ]

    def _asked(self, rows: DataFrame, kind: str, told: bool) -> DataFrame:
        return rows.mapInArrow(_packed, "bucket int, page int, items binary").select(
            F.lit(kind).alias("kind"),
            F.lit(told).alias("told"),
            "bucket",
            "page",
            # Not null: numbers beside a null would come to Python as floats, and band keys have 64 bits.
            *[F.lit(0).cast(t).alias(c) for c, t in (("item", "bigint"), ("ord", "bigint"), ("mbucket", "int"))],
            F.lit(None).cast("array<bigint>").alias("sketch"),
            "items",
        )

    def answers(self, requests: DataFrame, run: str) -> DataFrame:
        """Send the requests of one run and return what the query answers."""
        requests.write.parquet(f"{self.folder}/requests/{run}")
        # Its own session, so that the caller's settings stay as they are.
        session = self.spark.newSession()
        session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        session.conf.set("spark.sql.shuffle.partitions", str(self.partitions))
        told = f"{self.folder}/answers/{run}"
        query = (
            session.readStream.schema(REQUEST).parquet(f"{self.folder}/requests/*")
            .groupBy("kind", "bucket")
            .transformWithStateInPandas(Memory(), ANSWER, "append", "none")
            .writeStream.outputMode("append")
            .foreachBatch(lambda df, part: df.write.mode("overwrite").parquet(f"{told}/part-{part}"))
            .option("checkpointLocation", f"{self.folder}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        found = self.spark.read.schema(ANSWER).parquet(f"{told}/*")
        others = found.where(F.col("kind") != CELL).drop("items")
        cells = found.where(F.col("kind") == CELL).select("items").mapInArrow(_unpacked_cells, "item bigint")
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in others.schema if f.name not in ("kind", "item")]
        return others.unionByName(cells.select(F.lit(CELL).alias("kind"), "item", *empty))
