"""Phrases against counts over plain lists of words."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seqthin.llm import phrases
from tests.llm.tables import EXTRA, documents, empty, odd_documents, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
        yield [w for w in re.split("[ \t]+", piece) if w]


def brute(texts, max_words=3, min_count=10, top=2000, percent=50):
    f, n = {}, Counter()
    for lang, text in texts:
        own = f.setdefault(lang or "und", Counter())
        for w in pieces(text):
            n[lang or "und"] += len(w)
            for k in range(1, max_words + 1):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= min_count}
        longest = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longest[p[i : i + k]] = max(longest[p[i : i + k]], a)
        scored = []
        for p, a in candidates.items():
            if 100 * longest[p] >= percent * a and longest[p]:
                continue
            score, _, l, r = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def shuffled_texts(seed, n=60):
    rng = random.Random(seed)
    words = ["der", "die", "Straße", "of", "the", "x\x00y", "日本", "a"]
    line = "one very common line of many words here"
    made = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "; ", "\r\n"]) for _ in range(rng.randrange(0, 200)))
        made.append((("en", "de", None)[i % 3], text + (line if i % 2 else "")))
    return made + made[:20] * 5 + [("en", "loop " * 3000), ("en", None), (None, ""), ("fr", " .,")]


@pytest.mark.parametrize("max_words, every, bits", [(3, 4, 12), (3, 32, 27), (2, 3, 27), (4, 5, 27)])
def test_same_as_plain_counts(spark, max_words, every, bits):
    texts = shuffled_texts(max_words * every)
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id int, text string, lang string")
    assert got(phrases.collocations(df, max_words, 5, 40, 50, every, bits)) == brute(texts, max_words, 5, 40)


def test_the_filter_may_be_full(spark):
    texts = shuffled_texts(8)
    chunks = phrases.dictionary(spark.createDataFrame([(t, lang) for lang, t in texts], "text string, lang string"))
    full = np.full(64, np.iinfo(np.uint64).max, np.uint64)
    assert got(phrases.ranked(phrases.phrase_counts(chunks, full).where("n >= 10 OR words = 0"))) == brute(texts)


def test_odd_rows(spark):
    df, made = odd_documents(spark)
    assert got(phrases.collocations(df, min_count=3)) == brute([(r[2], r[1]) for r in made], min_count=3)
    assert got(phrases.collocations(documents(spark, schema=EXTRA))) == brute([(r[2], r[1]) for r in rows()])
    assert phrases.collocations(empty(spark)).collect() == []


def test_chunks_cover_texts_and_are_cut_alike():
    rng = random.Random(2)
    shared = " ".join(f"w{rng.randrange(500)}" for _ in range(400))
    raw, starts = phrases.flat(pa.array([shared, "before it " + shared, "", None, shared + " after it"]))
    row, final, a, b = phrases.chunks_of(raw, starts, 2, 8)
    held = [[], [], [], [], []]
    for r, i, j in zip(row, a, b):
        held[r].append(raw[i:j].tobytes())
    assert held[2] == held[3] == []
    assert len(held[0]) > 20 and set(held[0][1:-1]) <= set(held[1]) & set(held[4])
    for r in (0, 1, 4):
        # Each chunk but the last ends with the window that the next one starts with.
        for x, y in zip(held[r], held[r][1:]):
            assert x.split()[-2:] == y.split()[:2]
    assert final.sum() == 3
