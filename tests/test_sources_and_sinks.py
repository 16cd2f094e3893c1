"""FASTA in and out, ordinals, shards, tab-separated text."""

import random

from pyspark.sql import functions as F

from seqthin.config import ReduceConfig
from seqthin.operators.emit import emitted, write_fasta, write_tsv
from seqthin.plans.reduce import Reducer, decision_lines
from seqthin.sources.fasta import parse_fasta, read_fasta, stream_fasta
from seqthin.sources.order import running_totals, chunked, shard_map, with_ordinal
from seqthin.workspace import Workspace
from tests import sequential

SCHEMA = "ord bigint, header string, seq string"


def test_fasta_details(spark, tmp_path):
    text = "junk before\nmore\n>a one\r\nacgt\r\nAC\r\n>\nTTT\n>empty\n>>odd|x\nNN-\n\nAA\n>last\nac"
    (tmp_path / "x.fa").write_bytes(text.encode())
    (tmp_path / "y.fa").write_bytes(b">y\nGG  \n")
    rows = read_fasta(spark, str(tmp_path / "*.fa")).orderBy("ord").collect()
    assert [tuple(r) for r in rows] == [
        (1, "a one", "ACGTAC"), (2, "", "TTT"), (3, "empty", ""), (4, ">odd|x", "NN-AA"),
        (5, "last", "AC"), (6, "y", "GG  "),
    ]
    stripped = read_fasta(spark, str(tmp_path / "y.fa"), strip_blanks=True).first()
    assert stripped["seq"] == "GG"
    (tmp_path / "z.txt").write_bytes(b">tab\t \nA\rC \r\nT\t\n")
    (row,) = read_fasta(spark, str(tmp_path / "z.txt"), strip_blanks=True).collect()
    assert (row["header"], row["seq"]) == ("tab", "A\rCT")
    # A stream of the same files gives the same records.
    seen = []
    query = stream_fasta(spark, str(tmp_path / "*.fa")).writeStream.foreachBatch(
        lambda df, _: seen.extend(map(tuple, parse_fasta(
            Workspace(spark).table(df.withColumn("row", F.monotonically_increasing_id()), "texts")
        ).collect()))
    ).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(seen) == [tuple(r) for r in rows]


def test_fasta_order_survives_splits(spark, tmp_path):
    rng = random.Random(2)
    lines, want = [], []
    for i in range(200):
        seq = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 90)))
        lines.append(f">r{i}\n" + "".join(seq[j : j + 20] + "\n" for j in range(0, len(seq), 20)))
        want.append((i + 1, f"r{i}", seq))
    (tmp_path / "x.fa").write_text("".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = read_fasta(spark, str(tmp_path / "x.fa"))
        assert df.rdd.getNumPartitions() > 1
        assert sorted(map(tuple, df.collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_running_totals_over_chunks(spark):
    rng = random.Random(3)
    rows = [(i % 3, rng.randrange(10**9) * 3 + i % 3, rng.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(rows, "part int, k bigint, v bigint")
    ws = Workspace(spark)
    cut = chunked(df, ws, ["part", "k"], 40)
    assert cut.select("chunk").distinct().count() > 3
    got = {(r["part"], r["k"]): r["t"] for r in running_totals(cut, ["part"], "k", {"t": F.col("v")}).collect()}
    for part, k, _ in rows:
        assert got[part, k] == sum(v for p, k2, v in rows if p == part and k2 < k)
    numbered = with_ordinal(df, ws, "k", "n", ["part"], 40).collect()
    for r in numbered:
        assert r["n"] == 1 + sum(p == r["part"] and k < r["k"] for p, k, _ in rows)


def test_shards_by_bytes(spark):
    records = sequential.random_records(random.Random(7), 60)
    got = {r["ord"]: r["shard"] for r in shard_map(spark.createDataFrame(records, SCHEMA), Workspace(spark), 4, 9).collect()}
    sizes = [len(h) + len(s) + 3 for _, h, s in records]
    share, at = sum(sizes) // 4, 0
    for (o, _, _), size in zip(records, sizes):
        assert got[o] == min(at // share, 3)
        at += size


def test_shards_of_wrapped_files(spark, tmp_path):
    """Offsets are those of the file, whatever its line length and line ends."""
    rng = random.Random(9)
    text, starts = b"", []
    for i in range(40):
        seq = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 200)))
        end = "\r\n" if i % 2 else "\n"
        starts.append(len(text))
        text += (f">r{i}{end}" + "".join(seq[j : j + 30] + end for j in range(0, len(seq), 30))).encode()
    (tmp_path / "w.fa").write_bytes(text)
    records = read_fasta(spark, str(tmp_path / "w.fa"), with_bytes=True)
    got = {r["ord"]: r["shard"] for r in shard_map(records, Workspace(spark), 3, 9).collect()}
    sizes = [b - a for a, b in zip(starts, [*starts[1:], len(text) + 1])]
    share = sum(sizes) // 3
    assert got == {i + 1: min(at // share, 2) for i, at in enumerate(starts)}


def test_parts_keep_the_order(spark, tmp_path):
    rows = [(i, f"r{i}", "ACGT") for i in range(400)]
    records = spark.createDataFrame(rows, SCHEMA).repartition(7)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        write_fasta(emitted(records, records.where("ord % 3 = 0")), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [l for p in sorted((tmp_path / "out").glob("part-*")) for l in p.read_text().splitlines()]
    assert lines[::2] == [f">r{i}" for i in range(0, 400, 3)]


def test_emission(spark, tmp_path):
    rows = [(1, "a|x", "ACGT"), (2, "b|x", "CC"), (3, "a|x", "NN"), (4, "h" * 255 + "1", "A"), (5, "h" * 255 + "2", "C")]
    records = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.col("ord") % 2)
    chosen = records.where("ord IN (1, 4)")
    assert sorted(r["ord"] for r in emitted(records, chosen).collect()) == [1, 4]
    assert sorted(r["ord"] for r in emitted(records, chosen, by="header").collect()) == [1, 3, 4, 5]
    write_fasta(emitted(records, chosen), str(tmp_path / "out"))
    assert {(r["header"], r["seq"]) for r in read_fasta(spark, str(tmp_path / "out")).collect()} == {rows[0][1:], rows[3][1:]}
    write_fasta(emitted(records, chosen), str(tmp_path / "by"), by_shard=True)
    assert sorted(p.name for p in (tmp_path / "by").glob("shard=*")) == ["shard=0", "shard=1"]


def test_decision_text(spark, tmp_path):
    records = spark.createDataFrame(sequential.random_records(random.Random(8), 40), SCHEMA)
    out = Reducer(spark, ReduceConfig(k=5, warmup=5, frequency="exact")).admission_only(records)
    write_tsv(decision_lines(out).coalesce(1), str(tmp_path / "tsv"))
    lines = [l for p in (tmp_path / "tsv").glob("part-*") for l in p.read_text().splitlines()]
    assert lines[0].split("\t") == ["decision", "len", "n_frac", "n_kmers", "n_singleton", "singleton_frac", "cutoff", "header"]
    assert all(len(l.split("\t")) == 8 and l.split("\t")[0] in ("ADMIT", "REJECT") for l in lines[1:])
