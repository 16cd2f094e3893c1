"""The pipeline against plain Python, stage by stage, and its queries' contracts."""

import random

import pytest

import corpus_pipeline
from seqthin.llm import queries, word_cnn
from seqthin.llm.queries import tokenizer_path
from seqthin.llm.tokens import Encoder
from tests.llm import tables
from tests.llm.test_copies import brute_hits, brute_repeats, fingerprint, reachable
from tests.llm.test_tokens_and_packing import check_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = [r for r in tables.rows() if r[1] is None or len(r[1]) < 30_000]
    for i in range(1000, 1080):
        text = tables.prose(rng, rng.randrange(30, 150))
        if i % 3 == 0:
            text = text.replace(" ", f" {rng.choice(['scum', 'idiot'])} ", 2)
        rows.append((i, text, "en", "s", len(text)))
    passage = next(r[1] for r in rows if r[0] == 1001)
    rows.append((2000, tables.prose(rng, 10) + " " + " ".join(passage.split()[:30]) + " end", "en", "s", 0))
    items = [(7, " ".join(next(r[1] for r in rows if r[0] == 1004).split()[5:25])), (8, None), (9, "unseen words only")]
    labels = [(i, int(i % 4 > 0), int(i % 3 == 0)) for i in range(1000, 1080)]
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, tables.SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, rows, items


def test_stages(spark, folder):
    root, rows, items = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    net = word_cnn.fit_toxicity(docs, spark.read.parquet(f"{root}/labels.parquet"))
    toxic = {r.doc_id for r in word_cnn.score(docs, net).collect() if r.predicted}
    assert toxic and all(i >= 1000 and i % 3 == 0 for i in toxic)
    rows = [r for r in rows if r[0] not in toxic]
    group = reachable([fingerprint(r[1]) for r in rows])
    least = {g: min(r[0] for r, x in zip(rows, group) if x == g) for g in set(group)}
    rows = [r for r in rows if r[0] in set(least.values())]
    left = brute_repeats(rows)
    kept = [(r[0], left[r[0]][0][4].decode("utf-8", "ignore") if r[1] is not None else None, *r[2:]) for r in rows]
    bad = {h[0] for h in brute_hits(kept, items) if h[5]}
    want = [r for r in kept if str(r[0]) not in bad]
    assert bad == {"1004"}

    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, root)
        assert step.columns == COLUMNS, name
        path = f"{root}/{name}"
        step.write.parquet(path)
        step = spark.read.parquet(path)
    assert sorted(map(str, map(tuple, step.collect()))) == sorted(map(str, want))
    check_packing(corpus_pipeline.run(spark, root).collect(), want, Encoder(tokenizer_path()), 2048)


COLUMNS_OF = {
    "op1_repair": "doc_id start n_tokens ids_crc32",
    "op2_two_fit": "doc_id piece start length ids_crc32 sequence_id offset",
    "op3_boosted_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept score",
    "op4_byte_cnn": "doc_id held_out score predicted",
    "op5_bwt_merge": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op6_ppm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op7_simhash": "doc_id fingerprint component_id",
    "op8_word_cnn": "doc_id held_out score predicted",
    "op9_hash_tree": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_winnowing": "doc_id n_words n_hit n_items items_sha256 contaminated",
}
OTHER_COLUMNS = {
    "op11_tag_ratio": "page_id url text n_chars",
    "op12_parsed_phrases": "lang rank phrase a l r n score",
    "op13_adaptive_codes": "vec_id code error label_error codebooks_sha256",
}


@pytest.mark.parametrize("name", COLUMNS_OF)
def test_queries_give_every_document(spark, folder, name):
    root, rows, _ = folder
    got = queries.QUERIES[name](spark, root)
    assert got.columns == COLUMNS_OF[name].split()
    ids = sorted(r.doc_id for r in got.select("doc_id").distinct().collect())
    assert ids == sorted(r[0] for r in rows)
    assert set(queries.QUERIES) == set(COLUMNS_OF) | set(OTHER_COLUMNS)


@pytest.mark.parametrize("name", OTHER_COLUMNS)
def test_queries_over_other_rows(spark, tmp_path, name):
    root = str(tmp_path)
    documents = [(i, "one phrase of words. and more " * 9, None, "s", 1) for i in range(3)]
    spark.createDataFrame(documents, tables.SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, "u", "<p>x")], "page_id bigint, url string, html string").write.parquet(f"{root}/pages.parquet")
    vectors = [(i, [0.1 * i] * 8, None) for i in range(3)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    got = queries.QUERIES[name](spark, root)
    assert got.columns == OTHER_COLUMNS[name].split() and got.count() > 0


def test_empty_tables(spark, tmp_path):
    root = str(tmp_path)
    tables.empty(spark, tables.SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    assert corpus_pipeline.run(spark, root).count() == 0
