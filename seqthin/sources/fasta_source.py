"""``spark.read.format("fasta")``: FASTA files as a data source, for batches, streams and writing.

    spark.dataSource.register(FastaSource)
    spark.read.format("fasta").load("in")                      # file, start, header, seq
    spark.read.format("fasta").schema("header string").load("in")  # other columns are never built
    df.select("header", "seq").write.format("fasta").mode("append").save("out")
    spark.readStream.format("fasta").load("in")

Files are cut into byte ranges when a read is planned.  A record belongs to the range that
holds its mark, and whoever reads the range reads on to the record's end; ``file`` and
``start`` (the mark's offset) order the records.  Text before a file's first mark is no
record.  Option ``splitBytes`` sets the size of a range, ``stripBlanks`` drops white space
at line ends.

A write goes to a hidden folder beside the files; when all its tasks have ended, the parts
get their names, which put them behind those of earlier writes.  A write that fails or is
killed leaves no file that a read would see.  A stream takes files in the order of their
time of change and name; a file must be complete when it appears.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

SPLIT_BYTES = 64 << 20
READ_BYTES = 4 << 20
ROWS_PER_BATCH, BYTES_PER_BATCH = 1000, 8 << 20
COLUMNS = {"file": pa.string(), "start": pa.int64(), "header": pa.string(), "seq": pa.string()}
SCHEMA = "file string, start bigint, header string, seq string"
HIDDEN = ("_", ".")


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


@dataclass
class Part(WriterCommitMessage):
    file: str | None
    records: int


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The store a path is in, and its name there."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[int, str, int]]:
    """(time of change, path, bytes) of a file, or of the files under a folder that aren't hidden."""
    store, root = opened(path)
    at = store.get_file_info(root)
    if at.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [at] if at.is_file else store.get_file_info(arrow_fs.FileSelector(root, recursive=True))
    below = len(root.rstrip("/")) + 1
    return [
        (f.mtime_ns or 0, f.path, f.size) for f in found
        if f.is_file and (at.is_file or not any(p.startswith(HIDDEN) for p in f.path[below:].split("/")))
    ]


def ranges_of(files: list[tuple[int, str, int]], split: int) -> list[Range]:
    return [Range(p, a, min(size, a + split)) for _, p, size in sorted(files, key=lambda f: f[1]) for a in range(0, size, split)]


def records_of(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset of its mark, text behind the mark) of each record whose mark is in the range."""
    # A mark stands behind a line end; one is put before the file's first byte.
    base = start - 1
    held = bytearray(b"\n" if start == 0 else b"")
    stream.seek(max(0, start - 1))
    done = False

    def find(at: int) -> int:
        """Place of the next line end with a mark behind it, or -1 at the file's end."""
        nonlocal done
        while True:
            found = held.find(b"\n>", at)
            if found >= 0 or done:
                return found
            at = max(at, len(held) - 1)
            more = stream.read(READ_BYTES)
            held.extend(more)
            done = not more
            if first and base + at + 1 >= end:
                return -1

    first = True
    at = find(0)
    first = False
    while at >= 0 and base + at + 1 < end:
        after = find(at + 1)
        yield base + at + 1, bytes(held[at + 2 : after if after >= 0 else len(held)])
        if after < 0:
            return
        at = after
        if at > READ_BYTES:
            del held[:at]
            base, at = base + at, 0


def fields_of(text: bytes, strip: bool, with_seq: bool) -> tuple[str, str | None]:
    head, _, body = text.partition(b"\n")
    head = head.rstrip() if strip else head.rstrip(b"\r\n")
    if not with_seq:
        return head.decode("utf-8", "replace"), None
    lines = body.split(b"\n")
    seq = b"".join(line.rstrip(None if strip else b"\r") for line in lines)
    return head.decode("utf-8", "replace"), seq.upper().decode("utf-8", "replace")


def batches_of(part: Range, names: list[str], strip: bool) -> Iterator[pa.RecordBatch]:
    store, path = opened(part.file)
    columns: dict[str, list] = {n: [] for n in names}
    rows = size = 0

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(columns[n], COLUMNS[n]) for n in names], names=names)
        for values in columns.values():
            values.clear()
        return out

    with store.open_input_file(path) as stream:
        for start, text in records_of(stream, part.start, part.end):
            header, seq = fields_of(text, strip, "seq" in columns)
            for n, value in (("file", part.file), ("start", start), ("header", header), ("seq", seq)):
                if n in columns:
                    columns[n].append(value)
            rows, size = rows + 1, size + len(text)
            if rows >= ROWS_PER_BATCH or size >= BYTES_PER_BATCH:
                yield batch()
                rows = size = 0
    if rows:
        yield batch()


class _Options:
    def __init__(self, options, schema: StructType):
        if "path" not in options:
            raise ValueError("the fasta source needs a path")
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.strip = str(options.get("stripBlanks", "false")).lower() == "true"
        self.names = schema.fieldNames()
        if unknown := set(self.names) - set(COLUMNS):
            raise ValueError(f"the fasta source has no columns {sorted(unknown)}")
        if self.split < 1:
            raise ValueError("splitBytes must be positive")


class FastaReader(DataSourceReader):
    def __init__(self, options: _Options):
        self.o = options

    def partitions(self) -> list[Range]:
        # Without files there is still one, empty, range to read.
        return ranges_of(files_of(self.o.path), self.o.split) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from batches_of(partition, self.o.names, self.o.strip)


class FastaStreamReader(DataSourceStreamReader):
    def __init__(self, options: _Options):
        self.o = options

    def _after(self, low: tuple[int, str], high: tuple[int, str] | None) -> list[tuple[int, str, int]]:
        return [f for f in files_of(self.o.path) if f[:2] > low and (high is None or f[:2] <= high)]

    def initialOffset(self) -> dict:
        return {"time": "-1", "file": ""}

    def latestOffset(self) -> dict:
        last = max((f[:2] for f in files_of(self.o.path)), default=(-1, ""))
        return {"time": str(last[0]), "file": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = ((int(o["time"]), o["file"]) for o in (start, end))
        return ranges_of(self._after(low, high), self.o.split) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from batches_of(partition, self.o.names, self.o.strip)


class FastaWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, names: list[str]):
        if missing := {"header", "seq"} - set(names):
            raise ValueError(f"a fasta file needs columns {sorted(missing)}")
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def _folder(self) -> tuple[arrow_fs.FileSystem, str, str]:
        store, root = opened(self.path)
        return store, root.rstrip("/"), f"{root.rstrip('/')}/_writing-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, _, folder = self._folder()
        store.create_dir(folder, recursive=True)
        # An attempt has a file of its own; only committed ones get a name.
        name, records = f"{task.partitionId():06d}-{task.taskAttemptId()}.fasta", 0
        with store.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                for header, seq in zip(batch.column("header").to_pylist(), batch.column("seq").to_pylist()):
                    out.write(f">{header or ''}\n{(seq or '').upper()}\n".encode())
                    records += 1
        return Part(name, records)

    def commit(self, messages: list[Part | None]) -> None:
        store, root, folder = self._folder()
        store.create_dir(root, recursive=True)
        earlier = [p for _, p, _ in files_of(root)]
        if self.overwrite:
            for path in earlier:
                store.delete_file(path)
            earlier = []
        number = 1 + max((int(p.rsplit("/", 1)[-1][5:11]) for p in earlier if p.rsplit("/", 1)[-1][5:11].isdigit()), default=-1)
        for part in sorted((m for m in messages if m is not None and m.file), key=lambda m: m.file):
            if part.records:
                store.move(f"{folder}/{part.file}", f"{root}/part-{number:06d}-{part.file[:6]}.fasta")
        if store.get_file_info(folder).type != arrow_fs.FileType.NotFound:
            store.delete_dir(folder)

    def abort(self, messages: list[Part | None]) -> None:
        store, _, folder = self._folder()
        if store.get_file_info(folder).type != arrow_fs.FileType.NotFound:
            store.delete_dir(folder)


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FastaReader:
        return FastaReader(_Options(self.options, schema))

    def streamReader(self, schema: StructType) -> FastaStreamReader:
        return FastaStreamReader(_Options(self.options, schema))

    def writer(self, schema: StructType, overwrite: bool) -> FastaWriter:
        if "path" not in self.options:
            raise ValueError("the fasta source needs a path")
        return FastaWriter(self.options["path"], overwrite, schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaSource)


def load_fasta(spark: SparkSession, path: str, ws, **options) -> DataFrame:
    """(ord, header, seq): records of the source, numbered from 1 by file and offset."""
    from seqthin.sources.order import with_ordinal

    register(spark)
    rows = ws.table(spark.read.format("fasta").options(**options).load(path), "fasta-source")
    placed = rows.select(F.struct("file", "start").alias("place"), "header", "seq")
    return with_ordinal(placed, ws, "place", "ord").select("ord", "header", "seq")
