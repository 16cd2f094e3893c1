"""The fasta data source: any cut, odd files, pruned columns, failed writes, streams."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from seqthin.sources import fasta_source
from seqthin.sources.fasta import read_fasta
from seqthin.workspace import Workspace


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    fasta_source.register(spark)
    root = tmp_path_factory.mktemp("in")
    rng = random.Random(4)
    seq = lambda n: "".join(rng.choice("ACGTNacgt") for _ in range(n))
    (root / "a.fasta").write_text("no record\n>one|2021-01-02 \nACGT\nAC\n>two\n>three\n" + seq(30) + "\n\n" + seq(7) + "\n>> odd > name\nA>C\nG")
    (root / "b.fasta").write_bytes(b">four\r\nAC\r\nGT\r\n>five\r\n\r\n>six\r\nacgt")
    (root / "c.fasta").write_text("".join(f">c{i}\n{seq(rng.randrange(50))}\n" for i in range(40)))
    (root / "d.fasta").write_text("")
    (root / "e.fasta").write_text("nothing here\n")
    (root / "_hidden.fasta").write_text(">hidden\nA\n")
    return str(root)


def rows(df):
    return [tuple(r) for r in df.select("ord", "header", "seq").orderBy("ord").collect()]


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_any_cut_gives_the_same_records(spark, folder, split):
    want = rows(read_fasta(spark, folder))
    assert len(want) == 47
    assert rows(fasta_source.load_fasta(spark, folder, Workspace(spark), splitBytes=split)) == want
    if split == 7:
        assert spark.read.format("fasta").option("splitBytes", 7).load(folder).rdd.getNumPartitions() > 100


def test_small_reads_and_long_records(tmp_path, monkeypatch):
    monkeypatch.setattr(fasta_source, "READ_BYTES", 5)
    text = b"x\n>a\n" + b"ACGT\n" * 50 + b">b\n>c\nA"
    path = tmp_path / "x.fasta"
    path.write_bytes(text)
    for split in (3, 11, 1000):
        got = []
        with open(path, "rb") as f:
            for lo in range(0, len(text), split):
                got += list(fasta_source.records_of(f, lo, min(len(text), lo + split)))
        assert got == [(2, b"a\n" + b"ACGT\n" * 49 + b"ACGT"), (text.index(b">b"), b"b"), (text.index(b">c"), b"c\nA")]


def test_columns_and_options(spark, folder):
    some = spark.read.format("fasta").schema("header string").load(folder)
    assert some.columns == ["header"] and some.where("header = 'two'").count() == 1
    strict = spark.read.format("fasta").option("stripBlanks", True).load(folder + "/a.fasta")
    assert strict.orderBy("start").first().header == "one|2021-01-02"
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("fasta").schema("nothing string").load(folder).collect()
    with pytest.raises(Exception, match="absent"):
        spark.read.format("fasta").load(folder + "/absent").collect()


def test_round_trip_append_and_overwrite(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.range(25).select(F.concat(F.lit("r"), "id").alias("header"), F.repeat(F.lit("acgt"), F.col("id").cast("int")).alias("seq"))
    df.repartition(3).write.format("fasta").mode("append").save(out)
    read = lambda: sorted((r.header, r.seq) for r in spark.read.format("fasta").load(out).collect())
    want = sorted((f"r{i}", "ACGT" * i) for i in range(25))
    assert read() == want
    df.limit(2).write.format("fasta").mode("append").save(out)
    assert len(read()) == 27
    df.coalesce(1).write.format("fasta").mode("overwrite").save(out)
    assert read() == want and len([f for f in os.listdir(out) if f.endswith(".fasta")]) == 1


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.range(0, 40, 1, 4).select(F.lit("h").alias("header"), F.lit("A").alias("seq"), "id")
    df.drop("id").write.format("fasta").mode("append").save(out)
    before = sorted(os.listdir(out))
    bad = df.select("header", F.when(F.col("id") == 35, F.raise_error(F.lit("stop"))).otherwise(F.col("seq")).alias("seq"))
    with pytest.raises(Exception):
        bad.write.format("fasta").mode("append").save(out)
    assert sorted(os.listdir(out)) == before
    # A write that was killed has left its hidden folder only.
    os.makedirs(f"{out}/_writing-x")
    shutil.copy(f"{out}/{before[0]}", f"{out}/_writing-x/000000-1.fasta")
    assert spark.read.format("fasta").load(out).count() == 40


def test_a_stream_gives_the_records_of_a_batch(spark, folder, tmp_path):
    source, sink = tmp_path / "in", str(tmp_path / "sink")
    source.mkdir()
    for name in ("a.fasta", "b.fasta"):
        shutil.copy(f"{folder}/{name}", source / name)

    def run():
        stream = spark.readStream.format("fasta").option("splitBytes", 50).load(str(source))
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).format("parquet").start(sink)
        query.awaitTermination()
        return sorted((os.path.basename(r.file), r.start, r.header, r.seq) for r in spark.read.parquet(sink).collect())

    def whole():
        return sorted((os.path.basename(r.file), r.start, r.header, r.seq) for r in spark.read.format("fasta").load(str(source)).collect())

    assert run() == whole()
    shutil.copy(f"{folder}/c.fasta", source / "c.fasta")
    os.utime(source / "c.fasta")
    # The query goes on from its checkpoint: only the new file is read.
    assert run() == whole() and len(whole()) == 47
