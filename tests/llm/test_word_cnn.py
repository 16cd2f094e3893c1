"""The word network's parts by hand, small languages, and workers without the package."""

import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa

from seqthin.llm import word_cnn
from tests.llm import tables


def test_filters_and_pooling_by_hand():
    rng = np.random.default_rng(3)
    d, f = word_cnn.DIMENSIONS, 4
    texts = ["one two three four five six", "", "alone", "two two overwhelmingly three", None]
    h, row, doc, n = word_cnn.word_parts(pa.array(texts))
    rows = np.unique(row[row >= 0])[::2]
    net = word_cnn.WordCnn(
        rows, np.concatenate([rng.normal(0, 1, (len(rows), d)), np.zeros((1, d))]).astype(np.float32),
        {w: rng.normal(0, 1, (w, d, f)).astype(np.float32) for w in (1, 2, 3)},
        {w: rng.normal(0, 1, f).astype(np.float32) for w in (1, 2, 3)}, rng.normal(0, 1, 3 * f).astype(np.float32), 0.7,
    )
    got = net.logits(row, doc, n)
    for i in range(n):
        mine = [sum((net.embedding[list(rows).index(r)] for r in pair if r in rows), np.zeros(d)) for pair in row[doc == i]]
        features = []
        for w in (1, 2, 3):
            answers = [
                sum(mine[at + j] @ net.filters[w][j] for j in range(w) if at + j < len(mine)) for at in range(len(mine))
            ] or [np.zeros(f)]
            features += list(np.maximum(np.max(answers, axis=0) + net.bias[w], 0))
        assert abs(got[i] - (np.array(features) @ net.out + 0.7)) < 1e-4


def test_words_are_told_by_their_share():
    n = np.array([1, 3, 50, 50, 50, 400] + [5] * 1000)
    bad = np.array([1, 3, 50, 5, 6, 2] + [0, 1] * 500)
    used = word_cnn.told(n, bad, 0.1)
    assert used[:6].tolist() == [False, False, True, False, False, True] and not used[6:].any()
    assert word_cnn.told(np.array([3]), np.array([3]), 0.1).all()


def test_thresholds_stay_above_silence():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.full(300, -2.0), rng.normal(3, 0.3, 60), [-2.0, -2.0, -2.0, 3.0]])
    y = np.array([0] * 300 + [1] * 60 + [1, 1, 1, 1])
    language = np.array([0] * 200 + [3] * 100 + [0] * 60 + [3] * 4)
    out = word_cnn.thresholds(x, y, language, -2.0)
    assert (out > -1.0).all() and (out < 3).all()


def corpus(seed, size, small=0.06):
    """Two languages; the small one has toxic words of its own, each rare."""
    rng = random.Random(seed)
    texts, bad, langs = [], [], []
    for _ in range(size):
        spanish, toxic = rng.random() < small * 2, rng.random() < 0.3
        w = tables.prose(rng, rng.randrange(20, 60)).split()
        if spanish:
            w = [f"{rng.choice('el los y del que una por con'.split())}" if rng.random() < 0.4 else "o" + x for x in w]
        if toxic:
            for _ in range(2):
                ending = "".join(rng.choice("aeiou") for _ in range(2))
                w.insert(rng.randrange(len(w)), ("malpalabra" + ending) if spanish else rng.choice(["scum", "idiot", "trash"]))
        texts.append(" ".join(w))
        bad.append(int(toxic))
        langs.append("es" if spanish else "en")
    return texts, np.array(bad), np.array(langs)


def test_no_language_is_lost():
    texts, bad, _ = corpus(1, 1500)
    net = word_cnn.fit(pa.array(texts), bad)
    texts, bad, langs = corpus(2, 800)
    said = net.scores(pa.array(texts), word_cnn.language_table()) >= 0.5
    for lang in ("en", "es"):
        mine = langs == lang
        assert (~said)[mine & (bad == 0)].mean() >= 0.95, lang
        assert said[mine & (bad == 1)].mean() >= 0.9, lang


def test_workers_need_no_copy_of_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, {root!r})
from seqthin.llm import codes, main_text, phrases, word_cnn
docs = spark.createDataFrame([(i, "some words here scum " * (i % 2) + "and other words", "en") for i in range(60)], "doc_id bigint, text string, lang string")
labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
net = word_cnn.fit_toxicity(docs, labels)
assert word_cnn.score(docs, net).count() == 60 and word_cnn.drop_toxic(docs, net).count() <= 60
assert phrases.collocations(docs).count() > 0
assert codes.compress(spark.createDataFrame([(i, [0.1 * i] * 8, 0) for i in range(9)], "vec_id int, embedding array<float>, label int")).count() == 9
assert main_text.extract(spark.createDataFrame([(1, "u", "<p>x")], "page_id int, url string, html string")).first().text == "x"
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]


def test_every_labelled_document_counts(spark):
    # One toxic word is in documents only whose ids have the largest hashes.
    docs = spark.range(12000).selectExpr(
        "id AS doc_id", """concat('plain', id % 40, ' number', id, ' of', id % 7, CASE WHEN id % 2 = 0 THEN ''
        WHEN xxhash64(id) > 6000000000000000000 THEN ' zorgword' ELSE ' scum' END) AS text""",
    )
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS toxic")
    net = word_cnn.fit_toxicity(docs, labels)
    _, row, _, _ = word_cnn.word_parts(pa.array(["zorgword scum"]))
    assert np.isin(row[:, 0], net.rows).all()
    said = net.scores(pa.array(["plain1 of2 zorgword", "plain1 scum", "plain1 of2", ""]), word_cnn.language_table()) >= 0.5
    assert said.tolist() == [True, True, False, False]


def test_words_far_from_answering_ones_change_nothing(spark):
    rng = random.Random(5)
    words = [["scum", "idiot"][rng.random() < 0.5] if rng.random() < 0.15 else rng.choice("abcdefgh") for _ in range(3000)]
    texts = [" ".join(words[i : i + rng.randrange(0, 30)]) for i in range(0, 2900, 20)] + ["", "scum", "a", "a b c d scum", "scum a b c d"]
    h, row, doc, n = word_cnn.word_parts(pa.array(texts))
    known = np.unique(word_cnn.word_parts(pa.array(["scum idiot"]))[1][:, 0])
    gen = np.random.default_rng(2)
    net = word_cnn.first_net(known, np.array([1.0, -2.0]), gen)
    rows = spark.createDataFrame([(t, i, i, False) for i, t in enumerate(texts)], "text string, doc_id bigint, order bigint, back boolean")
    left = word_cnn.answering_words(rows, net).orderBy("order").collect()
    at, of = word_cnn.placed([bytes(r.words) for r in left])
    assert np.allclose(net.placed_logits(at, of, n), net.logits(row, doc, n), atol=1e-5)
    assert len(at) < len(row)
