"""State of a stream: answers equal sets kept in plain Python, and only named pages are looked up."""

from collections import defaultdict

from pyspark.sql import functions as F

from seqthin.streaming.memory import CELL, KEPT, PAGE, READ, BatchMemory


def _run(spark, folder, run, told, asked, kept, keys):
    """Each run builds the memory anew, as a restarted stream does."""
    memory = BatchMemory(spark, folder, buckets=4, pages=8, partitions=2)
    cells = lambda some: spark.createDataFrame([(c,) for c in some], "cell bigint")
    rows = spark.createDataFrame(kept, "key bigint, ord bigint, mbucket int, sketch array<bigint>")
    requests = (
        memory.cells(cells(told), True)
        .unionByName(memory.cells(cells(asked), False))
        .unionByName(memory.kept(rows))
        .unionByName(memory.resembling(spark.createDataFrame([(k,) for k in keys], "key bigint")))
    )
    cell_pages = requests.where("kind = 'cell'").select("bucket", "page").distinct().count()
    answers = memory.answers(requests, run).collect()
    held = {r["item"] for r in answers if r["kind"] == CELL}
    found = sorted((r["item"], r["ord"], r["mbucket"], tuple(r["sketch"])) for r in answers if r["kind"] == KEPT)
    return held, found, sum(r["pages"] for r in answers if r["kind"] == READ), cell_pages


def test_answers_follow_what_was_told(spark, tmp_path):
    cells, records, looked = set(), defaultdict(set), []
    for run in range(4):
        told = [-5 - run, *range(100 * run, 100 * run + 40)]
        # Key 1 is crowded: beyond one page of each salt in the last runs.
        kept = [(1, run * 1000 + i, i % 3 - 1, [i, -i, run]) for i in range(2 * PAGE)] + [(10 + run, run, -1, [7, 8, 9])]
        asked, keys = [-5, -6, 3, 103, 203, 303, 999], [1, 10, 11, 99]
        if run == 2:  # sent by a run that failed afterwards
            _run(spark, str(tmp_path / "memory"), "2-failed", told, asked, kept, keys)
        held, found, pages, cell_pages = _run(spark, str(tmp_path / "memory"), f"{run}", told, asked, kept, keys)
        cells |= set(told)
        for key, ord_, month, sketch in kept:
            records[key].add((ord_, month, tuple(sketch)))
        assert held == cells & set(asked)
        assert found == sorted((k, *r) for k in keys for r in records[k])
        looked.append(pages - cell_pages)
    # Kept records are looked up under named keys only; key 1 alone grows, by two pages of its four salts at most a run.
    assert looked[-1] <= looked[0] + 3 * 4


def test_other_cells_cost_nothing(spark, tmp_path):
    folder = str(tmp_path / "memory")
    _run(spark, folder, "0", range(5000), [], [], [])
    held, _, pages, named = _run(spark, folder, "1", [], [17], [], [])
    assert held == {17} and pages == named == 1


def test_cells_travel_packed(spark, tmp_path):
    memory = BatchMemory(spark, str(tmp_path / "memory"), buckets=2, pages=2, partitions=2)
    many = spark.range(20_000).select((F.col("id") * 7919 - 5).alias("cell")).coalesce(1)
    assert memory.cells(many, True).count() == 4


def test_many_band_keys_are_looked_up_together(spark, tmp_path):
    """Lookups grow with pages, not with the keys asked for or the records told of."""
    # Keys have 64 bits, more than a float can tell.
    folder, keys = str(tmp_path / "memory"), [k * 4_000_000_000_000_007 - (1 << 62) for k in range(2000)]
    kept = [(k, 5 * n + i, -1, [k, i]) for n, k in enumerate(keys) for i in range(2)]
    _, found, pages, _ = _run(spark, folder, "0", [], [], kept, [*keys, *range(10_000, 15_000)])
    assert found == sorted((k, o, m, tuple(s)) for k, o, m, s in kept) and pages <= 4 * 8
    _, found, pages, _ = _run(spark, folder, "1", [], [], kept[:1], [*keys[::2], *range(10_000, 15_000)])
    assert found == sorted((k, o, m, tuple(s)) for k, o, m, s in kept if k in keys[::2])
    assert pages <= 4 * 8 + len(kept) // PAGE + 4 * 8
