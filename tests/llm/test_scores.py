import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from seqthin.llm import boosted_rules, byte_cnn, ppm, word_cnn
from seqthin.llm.samples import labelled_sample
from seqthin.workspace import Workspace
from tests.llm import tables

LABELS = "doc_id bigint, quality int, toxic int, text string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def counts(text):
    w = words(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), base


def labels_for(spark, rows, toxic="scum"):
    made = [(r[0], int("#" not in (r[1] or "")), int(toxic in (r[1] or "")), "clash") for r in rows if r[0] is not None]
    return spark.createDataFrame(made + [(None, 1, 1, None), (rows[0][0], None, None, None)], LABELS)


def test_statistics(spark):
    docs, rows = tables.odd_documents(spark)
    for frame, made in ((tables.documents(spark), tables.rows()), (docs, rows)):
        got = boosted_rules.quality_rules(frame, boosted_rules.no_trees()).collect()
        want = [(r[0], *counts(r[1])) for r in made]
        assert sorted((str(tuple(g)[:7]) for g in got)) == sorted(map(str, want))
        assert all(g.kept == (not g.base_failed) for g in got)
    assert boosted_rules.quality_rules(tables.empty(spark), boosted_rules.no_trees()).count() == 0


def test_trees_learn_and_keep_the_constraint():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] - 2 * x[:, 1] + 0.3 * rng.normal(size=3000) > 0).astype(int)
    trees = boosted_rules.fit_trees(x, y, np.array([0, -1, 0]))
    assert ((trees.margin(x) > 0) == y).mean() > 0.93
    line = np.tile(x[:50], (60, 1))
    line[:, 1] = np.repeat(np.linspace(-4, 4, 60), 50)
    m = trees.margin(line).reshape(60, 50)
    assert (np.diff(m, axis=0) <= 1e-9).all()
    # Node arrays walk as plain recursion does.
    def walk(at, row):
        while trees.left[at] != at:
            at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
        return trees.value[at]
    assert np.allclose(trees.margin(x[:20]), [sum(walk(r, row) for r in trees.roots) for row in x[:20]])
    assert boosted_rules.fit_trees(x, np.ones(3000), np.zeros(3)).margin(x).min() > 0


def test_quality_without_labels_of_both_classes(spark):
    docs = tables.documents(spark)
    only = spark.createDataFrame([(1, 1, 0, "")], LABELS)
    trees = boosted_rules.fit_quality(docs, only)
    assert all(r.kept == (not r.base_failed) for r in boosted_rules.quality_rules(docs, trees).collect())
    net = byte_cnn.fit_quality(docs, only)
    assert {round(r.score, 6) for r in byte_cnn.score(docs, net).collect()} == {0.7}
    assert {r.predicted for r in word_cnn.score(docs, word_cnn.fit_toxicity(docs, only)).collect()} == {0}


def test_sample_is_bounded_and_clean(spark):
    docs, rows = tables.odd_documents(spark)
    both = [(7, 1, 0, ""), (7, 0, 0, "")]
    labels = labels_for(spark, rows).union(spark.createDataFrame(both, LABELS))
    got = labelled_sample(docs, labels, "quality", 5).collect()
    ids = [r.doc_id for r in got]
    assert len(ids) == len(set(ids)) and 7 not in ids and None not in ids
    assert max(Counter(r.label for r in got).values()) <= 5


def junk(rng, n):
    return " ".join(rng.choice(tables.WORDS) + rng.choice(["###", "%%%", "&&&"]) for _ in range(n))


def labelled(n, make_bad, seed):
    import random

    rng = random.Random(seed)
    y = np.array([i % 2 for i in range(n)])
    return [make_bad(rng, rng.randrange(20, 300)) if b else tables.prose(rng, rng.randrange(20, 300)) for b in y], y


def test_byte_network_learns():
    texts, bad = labelled(160, junk, 1)
    net = byte_cnn.fit([t.encode() for t in texts], 1 - bad)
    more, bad = labelled(80, junk, 2)
    s = net.scores([t.encode() for t in more])
    assert ((s >= 0.7) == (bad == 0)).mean() > 0.95
    # Texts don't influence each other, and all of a text counts.
    mixed = [b"", b"a", *(t.encode() for t in more[:6]), b"x" * 5000]
    assert np.allclose(net.scores(mixed), [net.scores([t])[0] for t in mixed], atol=1e-5)
    clean = more[int(np.flatnonzero(bad == 0)[0])].encode()
    assert net.logits([clean * 3 + junk(__import__("random").Random(3), 2000).encode()])[0] < net.logits([clean * 3])[0]


def test_byte_network_by_hand():
    """Scores equal a direct convolution over every chunk."""
    rng = np.random.default_rng(0)
    net = byte_cnn._untrained()
    net.tables = rng.normal(size=(byte_cnn.WIDTH, 256, 3)).astype(np.float32)
    net.bias, net.hidden = np.zeros(3, np.float32), rng.normal(size=(4, 5)).astype(np.float32)
    net.hidden_bias, net.out = np.zeros(5, np.float32), rng.normal(size=5).astype(np.float32)
    for n in (1, 255, 256, 257, 511, 512, 513, 1500, 4000):
        t = rng.integers(1, 255, n).astype(np.uint8).tobytes()
        padded = np.frombuffer(t + b"\0" * byte_cnn.WIDTH, np.uint8)
        answer = np.stack([sum(net.tables[j][padded[i + j]] for j in range(byte_cnn.WIDTH)) for i in range(n)])
        blocks = max(1, -(-n // 256))
        chunks = [answer[256 * k : 256 * k + 512] for k in range(max(1, blocks - 1))]
        pooled = np.stack([c.max(axis=0) for c in chunks])
        want = net.chunk_logits(pooled, np.array([len(c) / 512 for c in chunks], np.float32)).mean()
        assert abs(net.logits([t])[0] - want) < 1e-4


def toxic(rng, n):
    w = tables.prose(rng, n).split()
    w.insert(rng.randrange(len(w)), rng.choice(["Scum,", "idiot", "trash!"]))
    return " ".join(w)


def test_word_network_learns(spark):
    texts, bad = labelled(400, toxic, 1)
    net = word_cnn.fit(pa.array(texts), bad)
    more, bad = labelled(200, toxic, 2)
    s = net.scores(pa.array(more), word_cnn.language_table())
    assert ((s >= 0.5) == bad).mean() > 0.97
    alone = [net.scores(pa.array([t]), word_cnn.language_table())[0] for t in more[:20]]
    assert np.allclose(s[:20], alone, atol=1e-5)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(more)] + [(None, None, None, None, None), (900, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, tables.SCHEMA)
    kept = word_cnn.drop_toxic(docs, net)
    assert kept.columns == docs.columns
    got = {r.doc_id: r for r in word_cnn.score(docs, net).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert all(r.held_out == (zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 0) for i, r in got.items())
    assert word_cnn.drop_toxic(tables.empty(spark), net).count() == 0


def test_languages():
    texts = ["the cat of that house", "der hund und die katze", "le chat et les chiens", "el gato y los perros", "", "xyz"]
    h, doc, n = word_cnn.word_hashes(pa.array(texts))
    assert word_cnn.languages(h, doc, n, word_cnn.language_table()).tolist() == [0, 1, 2, 3, 0, 0]


def brute_ppm(train, order=3):
    contexts = [defaultdict(Counter) for _ in range(order + 1)]
    pad = b"\xff" * order
    for t in train:
        s = pad + t.encode() + b"\xff"
        for i in range(order, len(s)):
            for k in range(order + 1):
                contexts[k][s[i - k : i]][s[i]] += 1

    def score(text):
        s, total = pad + text.encode() + b"\xff", 0.0
        for i in range(order, len(s)):
            used, escape = set(), 1.0
            for k in range(order, -1, -1):
                left = {a: n for a, n in contexts[k].get(s[i - k : i], {}).items() if a not in used}
                n, q = sum(left.values()), len(left)
                if s[i] in left:
                    total += math.log10(escape * left[s[i]] / (n + q))
                    break
                if n:
                    escape *= q / (n + q)
                    used |= set(left)
            else:
                total += math.log10(escape / (257 - len(used)))
        return total

    return score


@pytest.mark.parametrize("odd", [False, True])
def test_language_scores(spark, odd):
    docs, rows = tables.odd_documents(spark) if odd else (tables.documents(spark), tables.rows())
    out = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0
    train = [low(r[1]) for r in rows if not out(r[0])]
    c = Counter(w for t in train for w in [*words(t), "\n"])
    n, v = sum(c.values()), len(c)
    score = brute_ppm(train, ppm.ORDER)
    want = []
    for r in rows:
        w = [*words(low(r[1])), "\n"]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want.append((str(r[0]), out(r[0]), len(w), sum(c[x] > 0 for x in w), n, base, score(low(r[1]))))
    got = [(str(g.doc_id), *tuple(g)[1:]) for g in ppm.language_scores(docs).collect()]
    assert len(got) == len(want)
    for g, x in zip(sorted(got), sorted(want)):
        assert g[:5] == x[:5] and g[5:] == pytest.approx(x[5:], rel=1e-4)


def test_language_scores_of_nothing(spark):
    assert ppm.language_scores(tables.empty(spark)).count() == 0
    one = spark.createDataFrame([(29, "ab", None, None, None)], tables.SCHEMA)  # held out
    (row,) = ppm.language_scores(one).collect()
    assert row.held_out and row.n_known == 0 and row.score == pytest.approx(3 * -math.log10(257), rel=1e-4)


def test_rare_strings_count(spark):
    """More different strings of four bytes than a driver would gather (2 ** 21); contexts of once count."""
    rng = np.random.default_rng(3)
    chars = np.frombuffer(bytes([32, *range(33, 65), *range(97, 127)]), np.uint8)
    made = [(i, rng.choice(chars, 100_000).tobytes().decode(), None, None, None) for i in range(27)]
    out = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(made))]
    made += [(100 + i, made[out.index(False)][1][50 * i : 50 * i + 30], None, None, None) for i in range(20)]
    out += [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(100, 120)]
    pad = b"\xff" * ppm.ORDER
    train = np.frombuffer(b"".join(pad + r[1].encode() + b"\xff" for r, o in zip(made, out) if not o), np.uint8)
    starts = np.concatenate([np.full(ppm.ORDER, False), np.ones(len(train) - ppm.ORDER, bool)])
    # A mark before a mark is no symbol but the beginning of the next text.
    starts[1:] &= ~((train[1:] == 255) & (train[:-1] == 255))
    before = np.lib.stride_tricks.sliding_window_view(train, ppm.ORDER + 1)

    def score(text):
        s, total = pad + text.encode() + b"\xff", 0.0
        for i in range(ppm.ORDER, len(s)):
            used, escape = set(), 1.0
            for k in range(ppm.ORDER, -1, -1):
                hit = starts[ppm.ORDER :].copy()
                for j in range(1, k + 1):
                    hit &= before[:, ppm.ORDER - j] == s[i - j]
                n = np.bincount(before[hit, ppm.ORDER], minlength=256)
                n[list(used)] = 0
                if n[s[i]]:
                    total += math.log10(escape * n[s[i]] / (n.sum() + (n > 0).sum()))
                    break
                if n.sum():
                    escape *= (n > 0).sum() / (n.sum() + (n > 0).sum())
                    used |= set(np.flatnonzero(n).tolist())
            else:
                total += math.log10(escape / (257 - len(used)))
        return total

    got = {g.doc_id: g for g in ppm.language_scores(spark.createDataFrame(made, tables.SCHEMA)).collect()}
    chosen = [27 + out[27:].index(True), 27 + out[27:].index(False)]
    for doc_id, text, *_ in (made[i] for i in chosen):
        assert got[doc_id].score == pytest.approx(score(text), rel=1e-6)


def test_parts_do_not_depend_on_splits(spark, tmp_path, monkeypatch):
    """Scans that cut the files elsewhere give every row the same part."""
    monkeypatch.setattr(ppm, "PART_BYTES", 4000)
    path = str(tmp_path / "docs")
    tables.documents(spark).coalesce(1).write.option("parquet.block.size", 4096).parquet(path)
    name, usual = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen, cuts = [], []
    try:
        for most in (usual, "16384"):
            spark.conf.set(name, most)
            docs = spark.read.parquet(path)
            cuts.append(docs.rdd.getNumPartitions())
            rows, _ = ppm.with_parts(docs, Workspace(spark))
            seen.append(sorted((r.doc_id, r.part) for r in rows.collect()))
    finally:
        spark.conf.set(name, usual)
    assert cuts[0] < cuts[1]
    assert seen[0] == seen[1] and len({p for _, p in seen[0]}) > 1


def test_missing_items_are_an_error():
    assert ppm.found(np.array([1, 3, 5]), np.array([5, 1])).tolist() == [2, 0]
    for known, wanted in (([1, 3], [2]), ([1, 3], [4]), ([], [1])):
        with pytest.raises(RuntimeError):
            ppm.found(np.array(known, np.int64), np.array(wanted, np.int64))


def test_probabilities_add_up():
    rng = np.random.default_rng(0)
    raw = rng.choice(np.frombuffer(b"abcd ", np.uint8), 500)
    grams = ppm.grams_of(np.append(raw, 10).astype(np.uint8), np.array([0]), np.array([500]))
    model = ppm.build(*ppm.counted(grams))
    known = model.table.shape[1] - 1
    total = (10.0 ** model.table[:, :known]).sum(axis=1) + (257 - known) * 10.0 ** model.table[:, known]
    assert np.allclose(total, 1, atol=1e-4)
