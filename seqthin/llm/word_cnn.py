"""Toxicity: a convolutional text classifier over hashed word embeddings, in NumPy.

Words (runs of digits, letters and non-ASCII characters, A-Z lower-cased) are hashed
to rows of an embedding table, and so are the first bytes of longer words: a word's vector
is the sum of both rows, so kin of known words are not silent.  Filters over one, two and three neighbouring words,
the largest answer of each filter in the document, and one logistic unit give the
logit.  ``fit_toxicity`` learns from every labelled document, on Spark: it counts the documents
of each table row (copies once), lets shards of documents train copies of one network
whose mean the next round starts from, and counts the logits the thresholds are drawn from.
The driver holds the network and those counts, whose size the settings bound.  Rows of the
table answer only if their words' share of toxic documents is no accident: of the rows
let in (Benjamini-Hochberg over Chernoff bounds) at most a share of ``FALSE_SHARE`` is
expected to be.  They start from their log odds, so rare words start weaker, and the
penalty shrinks what training doesn't use.

A part of the documents is kept back to set a threshold per language; the language is read
from the text itself (its most frequent function words), never from a column.  A
language's threshold is drawn towards the common one the more, the fewer toxic documents
of it were kept back, and stays above the logit of a text without any answering word: such
a text is never toxic.  A score of one half marks the threshold.

Defined cases: a null or wordless text gets the logit of no words; equal rows get
equal scores; without labels of both classes every score is zero; an empty table
gives no rows; other columns are ignored by ``score`` and kept by ``drop_toxic``.  Training
takes every row whose id has a label; null ids and ids with contradicting labels have none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqthin.llm.batches import letting_go, small_batches, text_slices
from seqthin.llm.bytescan import U, joined, mix, owner, runs, span_hashes
from seqthin.llm.samples import id_remainder, known_labels
from seqthin.workspace import Workspace

ROWS_LOG2, DIMENSIONS, WIDTHS, FILTERS = 20, 8, (1, 2, 3), 8
STEM_BYTES = 8
MIN_DOCS = 3
#: Expected share of rows let in by accident.
FALSE_SHARE = 0.1
#: Kept-back toxic documents at which a language's own threshold weighs as much as the common one.
OWN_WEIGHT = 20
#: Share of the way from the logit of no words to the common threshold that no threshold undercuts.
LEAST_WAY = 0.5
EPOCHS, BATCH, RATE, PENALTY = 8, 64, 0.02, 1e-4
KEPT_BACK = 5
DOCS_AT_ONCE = 200
#: Bytes of text a task hashes at once.
BYTES_AT_ONCE = 1 << 19
#: Training documents of a shard, about.
SHARD_DOCS = 8192
#: Steps of a unit in sums of parameters (whole numbers add up to the same in any order) and in counted logits.
PARAMETER_STEPS, LOGIT_STEPS = 1 << 32, 1 << 10
SCALE = 1.0
#: Frequent function words of each language, fixed.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for with he be on this are by or from".split(),
    "de": "der die und das den von zu mit sich des auf für ist nicht ein eine dem auch".split(),
    "fr": "le la les et des du une que dans pour qui pas sur au par plus avec est".split(),
    "es": "el los las y del que una por con para al su lo como se es un no".split(),
}


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """64-bit hashes of all words, their rows, and the number of rows."""
    h, _, doc, n = word_parts(column)
    return h, doc, n


def word_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same, with two table rows for each word: its own and that of its first bytes (-1 for short words)."""
    raw, starts, _ = joined(column)
    raw = raw.copy()
    upper = (raw >= 65) & (raw <= 90)
    raw[upper] += 32
    inside = (raw >= 128) | ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57))
    lo, hi = runs(inside)
    h, stem = span_hashes(raw, lo, hi), span_hashes(raw, lo, np.minimum(hi, lo + STEM_BYTES))
    table = np.stack([h >> U(64 - ROWS_LOG2), (stem >> U(64 - ROWS_LOG2)) + U(1 << ROWS_LOG2)], axis=1).astype(np.int32)
    table[hi - lo <= STEM_BYTES, 1] = -1
    return h, table, owner(starts, lo), len(starts)


def hashed_in_slices(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same for many texts, with the work space of a few."""
    parts = [word_parts(texts[lo : lo + DOCS_AT_ONCE]) for lo in range(0, len(texts), DOCS_AT_ONCE)]
    doc = [(p[2] + i * DOCS_AT_ONCE).astype(np.int32) for i, p in enumerate(parts)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate(doc).astype(np.int64), len(texts)


def language_table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the function words, and the language of each."""
    words = [(w, i) for i, ws in enumerate(FUNCTION_WORDS.values()) for w in ws]
    h, _, _ = word_hashes(pa.array([w for w, _ in words]))
    order = np.argsort(h)
    return h[order], np.array([i for _, i in words])[order]


def languages(h: np.ndarray, doc: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Index of the language with most function words; the first where there are none."""
    at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
    known = table[0][at] == h
    k = len(FUNCTION_WORDS)
    return np.bincount(doc[known] * k + table[1][at[known]], minlength=n * k).reshape(n, k).argmax(axis=1)


def told(with_word: np.ndarray, bad_with: np.ndarray, share: float) -> np.ndarray:
    """Rows whose share of toxic documents differs from ``share``, at a false share of ``FALSE_SHARE``."""
    often = np.flatnonzero(with_word >= MIN_DOCS)
    n, q = with_word[often].astype(float), bad_with[often] / with_word[often]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(q > 0, q * np.log(q / share), 0.0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - share)), 0.0)
    # Log of a bound of the chance to be so far off; twice, for either side.
    chance = np.nan_to_num(-n * gain) + np.log(2)
    order = np.argsort(chance, kind="stable")
    fits = np.flatnonzero(chance[order] <= np.log(FALSE_SHARE * np.arange(1, len(often) + 1) / max(1, len(often))))
    used = np.zeros(len(with_word), bool)
    used[often[order[: fits[-1] + 1 if len(fits) else 0]]] = True
    return used


@dataclass
class WordCnn:
    rows: np.ndarray  # sorted hashes' table rows in use
    embedding: np.ndarray  # one vector for each of them, and a zero vector at the end
    filters: dict[int, np.ndarray]  # width -> (width, dimensions, filters)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS)))

    def place(self, row: np.ndarray) -> np.ndarray:
        """Index of the vector of each table row."""
        if not len(self.rows):
            return np.zeros(row.shape, np.int64)
        at = np.minimum(np.searchsorted(self.rows, row), len(self.rows) - 1)
        return np.where(self.rows[at] == row, at, len(self.rows))

    def pooled(self, at: np.ndarray, doc: np.ndarray, n: int):
        """Largest filter answers per document, and the word each came from (-1: no word)."""
        best, where = [], []
        edges = np.searchsorted(doc, np.arange(n + 1))
        some = edges[1:] > edges[:-1]
        e = self.embedding[at[:, 0]] + self.embedding[at[:, 1]]
        for width, w in self.filters.items():
            answer = np.zeros((len(at), w.shape[2]), np.float32)
            for j in range(width):
                part = e @ w[j]
                if j == 0:
                    answer += part
                else:
                    # Words behind the document's end are zero vectors.
                    same = doc[:-j] == doc[j:]
                    answer[: len(at) - j][same] += part[j:][same]
            top = np.zeros((n, w.shape[2]), np.float32)
            if some.any():
                top[some] = np.maximum.reduceat(answer, edges[:-1][some], axis=0)
            best.append(np.maximum(top + self.bias[width], 0))
            where.append((answer, top))
        return np.concatenate(best, axis=1), where, edges

    def logits(self, row: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        return self.placed_logits(self.place(row), doc, n)

    def placed_logits(self, at: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        pooled, _, _ = self.pooled(at, doc, n)
        return pooled @ self.out + self.out_bias

    def scores(self, column: pa.Array, table) -> np.ndarray:
        """Probabilities in which one half is the threshold of the text's language."""
        h, row, doc, n = word_parts(column)
        margin = self.logits(row, doc, n) - self.thresholds[languages(h, doc, n, table)]
        return 1 / (1 + np.exp(-np.clip(SCALE * margin, -30, 30).astype(float)))


def untrained() -> WordCnn:
    one = {1: np.zeros((1, DIMENSIONS, 1), np.float32)}
    return WordCnn(np.zeros(0, np.int64), np.zeros((1, DIMENSIONS), np.float32), one, {1: np.zeros(1, np.float32)}, np.zeros(1, np.float32), -30.0)


def first_net(rows: np.ndarray, odds: np.ndarray, rng: np.random.Generator) -> WordCnn:
    """An untrained network whose rows answer with their log odds."""
    vectors = rng.normal(0, 0.1, (len(rows) + 1, DIMENSIONS)).astype(np.float32)
    vectors[:-1, 0] = odds
    vectors[-1] = 0
    return WordCnn(
        rows, vectors, {w: rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS},
        {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0,
    )


def log_odds(with_word: np.ndarray, bad_with: np.ndarray, total: int, bad: int) -> np.ndarray:
    return np.log((bad_with + 0.5) / (bad + 1)) - np.log((with_word - bad_with + 0.5) / (total - bad + 1))


class Training:
    """A network in training: its parameters, changed in place, and the running squares of their steps."""

    def __init__(self, net: WordCnn):
        self.net = net
        self.dense = {"out": net.out, **{f"w{w}": net.filters[w] for w in WIDTHS}, **{f"b{w}": net.bias[w] for w in WIDTHS}}
        self.dense["out_bias"] = np.array([net.out_bias], np.float32)
        self.memory = {k: np.zeros_like(v) for k, v in self.dense.items()}
        self.row_memory = np.zeros(len(net.rows) + 1, np.float32)

    def step(self, a: np.ndarray, d: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """One step over documents: words' places, the document of each word, labels and weights."""
        net, dense = self.net, self.dense
        pooled, where, cuts = net.pooled(a, d, len(y))
        p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.out_bias, -30, 30)))
        g = (weight * (p - y) / len(y)).astype(np.float32)
        grads = {"out": pooled.T @ g, "out_bias": g.sum(keepdims=True)}
        back_pooled = np.outer(g, net.out) * (pooled > 0)
        moved_rows, moved = [], []
        for i, width in enumerate(WIDTHS):
            answer, top = where[i]
            gw = back_pooled[:, i * FILTERS : (i + 1) * FILTERS]
            grads[f"b{width}"] = gw.sum(axis=0)
            dw = np.zeros_like(net.filters[width])
            # The first word at which each document's filter answers most.
            doc_of, filter_of = np.nonzero(gw)
            is_top = answer == top[d]
            first = np.full(top.shape, -1)
            r, c = np.nonzero(is_top)
            first[d[r[::-1]], c[::-1]] = r[::-1]
            spot, value = first[doc_of, filter_of], gw[doc_of, filter_of]
            for j in range(width):
                # Wordless documents have no such word.
                inside = (spot >= 0) & (spot + j < cuts[doc_of + 1])
                s, f, v = spot[inside] + j, filter_of[inside], value[inside]
                e = net.embedding[a[s, 0]] + net.embedding[a[s, 1]]
                np.add.at(dw[j].T, f, v[:, None] * e)
                moved_rows += [a[s, 0], a[s, 1]]
                moved += [v[:, None] * net.filters[width][j].T[f]] * 2
            grads[f"w{width}"] = dw
        for k, v in dense.items():
            change = grads[k] + PENALTY * v
            self.memory[k] = 0.95 * self.memory[k] + 0.05 * change**2
            v -= RATE * change / (np.sqrt(self.memory[k]) + 1e-4)
        net.out_bias = float(dense["out_bias"][0])
        touched, index = np.unique(np.concatenate(moved_rows), return_inverse=True)
        total = np.zeros((len(touched), DIMENSIONS), np.float32)
        np.add.at(total, index, np.concatenate(moved))
        total += PENALTY * net.embedding[touched]
        self.row_memory[touched] += (total**2).mean(axis=1)
        net.embedding[touched] -= 3 * RATE * total / (np.sqrt(self.row_memory[touched])[:, None] + 1e-4)
        net.embedding[-1] = 0

    def flat(self) -> np.ndarray:
        """All parameters but the embedding, and their running squares."""
        return np.concatenate([v.ravel() for part in (self.dense, self.memory) for v in part.values()])

    def set_flat(self, values: np.ndarray) -> None:
        lo = 0
        for part in (self.dense, self.memory):
            for v in part.values():
                # Rounded sums of squares can end below zero.
                v.ravel()[:] = values[lo : lo + v.size] if part is self.dense else np.maximum(values[lo : lo + v.size], 0)
                lo += v.size
        self.net.out_bias = float(self.dense["out_bias"][0])

    def plain(self) -> dict:
        """Its arrays alone, for tasks that have no copy of this module."""
        return {"net": {f.name: getattr(self.net, f.name) for f in fields(self.net)}, "flat": self.flat(), "row_memory": self.row_memory}

    @classmethod
    def of(cls, plain: dict) -> "Training":
        """Another one with copies of the arrays."""
        net = WordCnn(**plain["net"])
        out = cls(replace(
            net, embedding=net.embedding.copy(), filters={w: v.copy() for w, v in net.filters.items()},
            bias={w: v.copy() for w, v in net.bias.items()}, out=net.out.copy(),
        ))
        out.set_flat(plain["flat"])
        out.row_memory[:] = plain["row_memory"]
        return out


def fit(texts: pa.Array, y: np.ndarray, seed: int = 7) -> WordCnn:
    """Train on whole texts in memory; every ``KEPT_BACK``-th sets the thresholds."""
    if len(np.unique(y)) < 2:
        return untrained()
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    back = np.zeros(len(y), bool)
    back[order[::KEPT_BACK]] = len(y) >= 10 * KEPT_BACK
    h, row, doc, n = hashed_in_slices(texts)
    learns = ~back[doc]
    least = least_pairs(h, doc, n)
    _, first, group = np.unique(least, return_index=True, return_inverse=True)
    seen = np.unique(np.concatenate([
        row[learns & (row[:, i] >= 0), i].astype(np.int64) * n + group[doc[learns & (row[:, i] >= 0)]] for i in (0, 1)
    ]))
    rows, index = np.unique(seen // n, return_inverse=True)
    with_word = np.bincount(index, minlength=len(rows))
    bad_with = np.bincount(index, y[first[seen % n]], len(rows))
    groups = first[np.unique(group[~back])]
    total, bad = len(groups), max(1, y[groups].sum())
    used = told(with_word, bad_with, bad / total)
    state = Training(first_net(rows[used], log_odds(with_word, bad_with, total, bad)[used], rng))
    net = state.net
    at = net.place(row)
    edges = np.searchsorted(doc, np.arange(n + 1))
    weight = np.where(y == 1, 0.5 / np.mean(y == 1), 0.5 / np.mean(y == 0))
    train = np.flatnonzero(~back)
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for lo in range(0, len(train), BATCH):
            batch = train[lo : lo + BATCH]
            sizes = edges[batch + 1] - edges[batch]
            ends = np.cumsum(sizes)
            pick = np.arange(int(ends[-1])) + np.repeat(edges[batch] - (ends - sizes), sizes)
            state.step(at[pick], np.repeat(np.arange(len(batch)), sizes), y[batch], weight[batch])
    del seen, index
    logits, language = np.zeros(n), np.zeros(n, np.int64)
    for lo in range(0, n, DOCS_AT_ONCE):
        hi = min(n, lo + DOCS_AT_ONCE)
        mine = slice(edges[lo], edges[hi])
        logits[lo:hi] = net.logits(row[mine], doc[mine] - lo, hi - lo)
        language[lo:hi] = languages(h[mine], doc[mine] - lo, hi - lo, language_table())
    checked = back if back.any() else np.ones(len(y), bool)
    net.thresholds = thresholds(logits[checked], y[checked], language[checked], silent_logit(net))
    return net


def silent_logit(net: WordCnn) -> float:
    return float(net.placed_logits(np.zeros((0, 2), np.int64), np.zeros(0, np.int64), 1)[0])


def least_pairs(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """A key for each document: its least word pair, which copies nearly always share."""
    pairs = mix(h[:-1] * U(3) + h[1:])
    pairs = np.append(np.where(doc[1:] == doc[:-1], pairs, ~U(0)), ~U(0)) if len(h) else h
    least = np.arange(n).astype(U)
    some = np.unique(doc)
    if len(some):
        least[some] = np.minimum.reduceat(pairs, np.searchsorted(doc, some))
    return least


def thresholds(logits: np.ndarray, y: np.ndarray, language: np.ndarray, silent: float, n: np.ndarray | None = None) -> np.ndarray:
    """One for each language, from kept-back documents; ``silent`` is the logit of a text without answering words.

    ``n`` says how many documents each entry stands for.
    """
    n = np.ones(len(y), np.int64) if n is None else n
    common = max(best_threshold(logits, y, n), silent + 1e-3)
    least = silent + LEAST_WAY * (common - silent)
    out = np.full(len(FUNCTION_WORDS), common)
    for i in range(len(out)):
        mine = language == i
        bad = int(n[mine & (y == 1)].sum())
        if bad and bad < n[mine].sum():
            own = best_threshold(logits[mine], y[mine], n[mine])
            out[i] = max(least, (bad * own + OWN_WEIGHT * common) / (bad + OWN_WEIGHT))
    return out


def best_threshold(logits: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """Middle of the widest gap among the cuts with the best balanced accuracy."""
    if len(np.unique(y)) < 2:
        return float(logits.max(initial=0.0) + 1)
    order = np.argsort(logits, kind="stable")
    x, t = logits[order].astype(float), y[order]
    n = np.ones(len(y), np.int64) if n is None else n[order]
    clean, bad = np.cumsum(n * (t == 0)), np.cumsum(n * (t == 1))
    right = np.concatenate(([0], clean)) / clean[-1] + 1 - np.concatenate(([0], bad)) / bad[-1]
    low, high = np.concatenate(([x[0] - 2], x)), np.concatenate((x, [x[-1] + 2]))
    # Equal logits can't be cut apart.
    right[high <= low] = 0
    if right.max() <= 1 + 1e-9:
        # No cut tells the classes apart: nothing is toxic.
        return float(x[-1] + 1)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    i = best[np.argmax((high - low)[best])]
    return float((low[i] + high[i]) / 2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 5, shard_docs: int = SHARD_DOCS, seed: int = 7) -> WordCnn:
    """From all labelled documents outside the held-out fifth."""
    small_batches(docs.sparkSession)
    # Labels grow with the documents, so they are never sent whole to every executor.
    known = known_labels(labels, "toxic", id_remainder(held_out) != 0).hint("merge")
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    n, n_bad = rows.select("doc_id").join(known, "doc_id").agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if n_bad in (0, n):
        return untrained()
    order = F.xxhash64("doc_id", "text")
    back = (F.pmod(F.xxhash64(F.lit(seed), order), F.lit(KEPT_BACK)) == 0) if n >= 10 * KEPT_BACK else F.lit(False)
    rows = rows.where(id_remainder(held_out) != 0).select("doc_id", "text", order.alias("order"), back.alias("back"))
    table_rows, with_word, bad_with, total, bad = counted(rows.where("NOT back"), known)
    bad = max(1, bad)
    used = told(with_word, bad_with, bad / max(total, 1))
    odds = log_odds(with_word, bad_with, total, bad)[used]
    state = Training(first_net(table_rows[used], odds, np.random.default_rng(seed)))
    ws = Workspace(docs.sparkSession)
    try:
        words = ws.table(answering_words(rows, state.net).join(known, "doc_id"), "answering-words")
        learning = words.where("NOT back")
        shards = max(1, round(learning.count() / shard_docs))
        weight = {1: 0.5 / (n_bad / n), 0: 0.5 / (1 - n_bad / n)}
        for epoch in range(EPOCHS):
            average(state, learning, shards, epoch, weight)
        checked = words.where("back") if n >= 10 * KEPT_BACK else words
        x, y, language, many = counted_logits(checked, state.net)
    finally:
        ws.release()
    state.net.thresholds = thresholds(x, y, language, silent_logit(state.net), many)
    return state.net


def counted(rows: DataFrame, known: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Table rows in ``MIN_DOCS`` documents or more, how many of all and of toxic ones hold each; the numbers of both.

    Of copies the first counts, in the order of the hashes.  Labels join what is left of the texts.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, BYTES_AT_ONCE):
                h, row, doc, n = word_parts(some.column("text"))
                edges = np.searchsorted(doc, np.arange(n + 1))
                held = [np.unique(row[lo:hi]) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
                least = least_pairs(h, doc, n)
                # Wordless texts are copies of each other.
                least[edges[1:] == edges[:-1]] = 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least.view(np.int64)), some.column("order"), some.column("doc_id"),
                     pa.array([r[r >= 0].tobytes() for r in held], pa.binary())],
                    names=["least", "order", "doc_id", "held"],
                )

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 2 << ROWS_LOG2
        # One more entry counts the documents themselves.
        n, bad = np.zeros(size + 1, np.int32), np.zeros(size + 1, np.int32)
        for batch in batches:
            for held, label in zip(batch.column("held").to_pylist(), batch.column("label").to_pylist(), strict=True):
                at = np.append(np.frombuffer(held, np.int32), size)
                n[at] += 1
                if label:
                    bad[at] += 1
        at = np.flatnonzero(n)
        for lo in range(0, len(at), 1 << 16):
            one = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.astype(np.int32)), pa.array(n[one]), pa.array(bad[one])], names=["row", "n", "bad"]
            )

    copies = rows.select("doc_id", "text", "order").mapInArrow(letting_go(parts), "least bigint, order bigint, doc_id bigint, held binary")
    copies = copies.join(known, "doc_id")
    first = copies.groupBy("least").agg(F.min(F.struct("order", "label", "held")).alias("first"))
    sums = (
        first.select("first.label", "first.held").mapInArrow(letting_go(tally), "row int, n int, bad int")
        .groupBy("row").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    )
    size = 2 << ROWS_LOG2
    got = sums.where((F.col("n") >= MIN_DOCS) | (F.col("row") == size)).toArrow()
    row, n, bad = (got.column(c).to_numpy().astype(np.int64) for c in ("row", "n", "bad"))
    at = np.argsort(row)
    at, all_docs = at[row[at] < size], np.flatnonzero(row == size)
    total, total_bad = (int(c[all_docs].sum()) for c in (n, bad))
    return row[at].astype(np.int32), n[at], bad[at], total, total_bad


def answering_words(rows: DataFrame, net: WordCnn) -> DataFrame:
    """(doc_id, order, back, language, words): places of the words that a filter can meet with an answering one.

    A window without such a word answers zero, wherever it lies; three words before and two behind
    an answering one leave every other window in place and one that answers zero where there was one.
    """
    shared, table = shipped(rows, net), language_table()
    reach = max(WIDTHS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, BYTES_AT_ONCE):
                h, row, doc, n = word_parts(some.column("text"))
                mine = WordCnn(**shared.value)
                at = mine.place(row)
                answers = (at < len(mine.rows)).any(axis=1)
                near = answers.copy()
                for j in range(1, reach + 1):
                    same = doc[j:] == doc[:-j]
                    near[:-j] |= answers[j:] & same
                    if j < reach:
                        near[j:] |= answers[:-j] & same
                edges = np.searchsorted(doc[near], np.arange(n + 1))
                left = at[near].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("order"), some.column("back"),
                     pa.array(languages(h, doc, n, table).astype(np.int32)),
                     pa.array([left[lo:hi].tobytes() for lo, hi in zip(edges[:-1], edges[1:], strict=True)], pa.binary())],
                    names=["doc_id", "order", "back", "language", "words"],
                )

    rows = rows.select("doc_id", "text", "order", "back")
    return rows.mapInArrow(letting_go(cut), "doc_id bigint, order bigint, back boolean, language int, words binary")


def placed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of some documents, and the document of each word."""
    at = np.frombuffer(b"".join(words), np.int32).reshape(-1, 2)
    return at, np.repeat(np.arange(len(words)), [len(w) // 8 for w in words])


def average(state: Training, learning: DataFrame, shards: int, epoch: int, weight: dict[int, float]) -> None:
    """Every shard goes through its documents from the same state; the mean of their changes is the next state."""
    spark = learning.sparkSession
    shared = spark.sparkContext.broadcast(state.plain())

    def changes(mine: Training) -> Iterator[pa.RecordBatch]:
        start = shared.value
        rows = np.concatenate([mine.net.embedding - start["net"]["embedding"], (mine.row_memory - start["row_memory"])[:, None]], axis=1)
        moved = np.flatnonzero(rows.any(axis=1))
        rows, flat = rows[moved], mine.flat() - start["flat"]
        flat = np.pad(flat, (0, -len(flat) % (DIMENSIONS + 1))).reshape(-1, DIMENSIONS + 1)
        at = np.concatenate([moved, len(mine.row_memory) + np.arange(len(flat))])
        values = np.rint(np.concatenate([rows, flat]).astype(float) * PARAMETER_STEPS).astype(np.int64)
        for lo in range(0, len(at), 1 << 15):
            some = slice(lo, lo + (1 << 15))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[some].astype(np.int32)), *[pa.array(c) for c in values[some].T.copy()]], names=["row", *names]
            )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, shard, labels, words = None, None, [], []

        def step() -> None:
            if words:
                at, doc = placed(words)
                y = np.array(labels)
                mine.step(at, doc, y, np.where(y == 1, weight[1], weight[0]))
                labels.clear()
                words.clear()

        for batch in batches:
            for of, label, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "label", "words")), strict=True):
                if of != shard:
                    if mine is not None:
                        step()
                        yield from changes(mine)
                    mine, shard = Training.of(shared.value), of
                labels.append(label)
                words.append(text)
                if len(words) == BATCH:
                    step()
        if mine is not None:
            step()
            yield from changes(mine)

    names = [f"v{i}" for i in range(DIMENSIONS + 1)]
    dealt = learning.select(F.pmod("order", F.lit(shards)).cast("int").alias("shard"), "label", "words", F.xxhash64(F.lit(epoch), "order").alias("turn"))
    # Equal hashes are equal texts, but labels may differ.
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "turn", "label").drop("turn")
    sums = (
        dealt.mapInArrow(letting_go(train), "row int, " + ", ".join(f"{c} bigint" for c in names))
        .groupBy("row").agg(F.count("*").alias("shards"), *[F.sum(c).alias(c) for c in names])
    )
    got = sums.toArrow()
    shared.destroy()
    row, by = got.column("row").to_numpy(), got.column("shards").to_numpy()
    mean = np.stack([got.column(c).to_numpy() for c in names], axis=1) / by[:, None] / PARAMETER_STEPS
    flat = row >= len(state.row_memory)
    state.net.embedding[row[~flat]] += mean[~flat, :-1].astype(np.float32)
    state.row_memory[row[~flat]] += mean[~flat, -1].astype(np.float32)
    change = mean[flat][np.argsort(row[flat])].ravel()
    now = state.flat()
    state.set_flat(now + change[: len(now)])


def counted_logits(words: DataFrame, net: WordCnn) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Logits (to a ``LOGIT_STEPS``-th), labels, languages, and how many of these documents have them."""
    shared = shipped(words, net)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCS_AT_ONCE):
                some = batch.slice(lo, DOCS_AT_ONCE)
                at, doc = placed(some.column("words").to_pylist())
                x = np.clip(WordCnn(**shared.value).placed_logits(at, doc, some.num_rows), -1000, 1000)
                x = np.rint(x.astype(float) * LOGIT_STEPS).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x), some.column("label"), some.column("language")], names=["logit", "label", "language"]
                )

    found = words.select("label", "language", "words").mapInArrow(letting_go(judge), "logit int, label int, language int")
    got = found.groupBy("logit", "label", "language").count().orderBy("logit", "label", "language").toArrow()
    x, y, language, n = (got.column(c).to_numpy().astype(np.int64) for c in ("logit", "label", "language", "count"))
    return x / LOGIT_STEPS, y, language, n


def shipped(docs: DataFrame, net: WordCnn):
    """The network's arrays for the tasks; executors need no copy of this module to read them."""
    return docs.sparkSession.sparkContext.broadcast({f.name: getattr(net, f.name) for f in fields(net)})


def score(docs: DataFrame, net: WordCnn, held_out: int = 5) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    shared, table = shipped(docs, net), language_table()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, BYTES_AT_ONCE):
                s = WordCnn(**shared.value).scores(rows.column("text"), table)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), (id_remainder(held_out) == 0).alias("held_out"), "text")
    return rows.mapInArrow(letting_go(judge), "doc_id bigint, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, net: WordCnn) -> DataFrame:
    """The documents whose score stays below one half, with all their columns."""
    shared, table = shipped(docs, net), language_table()
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, BYTES_AT_ONCE, at):
                yield rows.filter(pa.array(WordCnn(**shared.value).scores(rows.column(at), table) < 0.5))

    return docs.mapInArrow(letting_go(keep), docs.schema)
