"""Quality rules: fixed base rules, then boosted trees over document statistics.

Statistics of whole texts come from NumPy passes over their bytes.  Trees grow on a
bounded sample of labelled documents, on binned features and logistic loss; in
features with a monotonic constraint a split must order its sides, and both sides
keep to the bound between them further down, so the score never rises with, say,
the share of symbols.  Trees are flattened to arrays of nodes, and a batch of
documents walks each tree level by level.

Defined cases: a null text has no words and fails the base rules; equal rows get
equal verdicts; without labels of both classes the trees are empty and the base
rules decide; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqthin.llm.batches import small_batches, text_slices
from seqthin.llm.bytescan import SPACES, U, joined, mix, owner, repeated, runs, span_hashes, table_of
from seqthin.llm.samples import labelled_sample

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
PER_CLASS = 4000
ROUNDS, DEPTH, BINS, RATE, MIN_ROWS = 60, 3, 48, 0.2, 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Feature and the direction the quality may take as it grows (0: either).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
    "distinct_share": 0, "upper_share": -1, "digit_share": 0, "mark_share": 0, "words_per_line": 0,
    "longest_word": 0,
}
COUNT_SCHEMA = ", ".join(f"{c} bigint" for c in COUNTS)


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts (documents, 5) and features of whole texts."""
    raw, starts, ends = joined(column)
    n = len(starts)
    per_doc = lambda at, weights=None: np.bincount(owner(starts, at), weights, n)[:n]
    inside = ~table_of(SPACES)[raw]
    lo, hi = runs(inside)
    doc = owner(starts, lo)
    n_words = np.bincount(doc, minlength=n)
    points = np.concatenate(([0], np.cumsum(inside & ((raw & 0xC0) != 0x80))))
    chars = points[hi] - points[lo]
    word_chars = np.bincount(doc, chars, n).astype(np.int64)

    def share(flags: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(flags)))
        return upto[ends] - upto[starts]

    n_symbols = share(table_of(SYMBOLS)[raw])
    word_hash = span_hashes(raw, lo, hi)
    seed = mix(doc.astype(U) + U(1))

    # Lines with a word; a line's end is the next line end, a row's own or the added one.
    line_ends = np.flatnonzero(raw == 10)
    line_starts = np.concatenate(([0], line_ends[:-1] + 1)) if len(line_ends) else line_ends
    worded = np.searchsorted(lo, line_ends) > np.searchsorted(lo, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_doc = owner(starts, line_starts)
    lines = np.bincount(line_doc, minlength=n)
    keys = mix(span_hashes(raw, line_starts, line_ends) ^ mix(line_doc.astype(U) + U(1)))
    _, first = np.unique(keys, return_index=True)
    n_dup_lines = lines - np.bincount(line_doc[first], minlength=n)

    # Windows of words inside one document.
    covered = np.zeros(len(lo) + 1, np.int64)
    if len(lo) >= REPEAT_WINDOW:
        last = len(lo) - REPEAT_WINDOW + 1
        window = np.zeros(last, U)
        for j in range(REPEAT_WINDOW):
            window = window * U(0x100000001B3) + word_hash[j : j + last]
        whole = np.flatnonzero(doc[:last] == doc[REPEAT_WINDOW - 1 :])
        twice = whole[repeated(mix(window[whole] ^ seed[whole]))]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + REPEAT_WINDOW, -1)
    in_repeat = np.cumsum(covered[:-1]) > 0
    n_repeat = np.bincount(doc[in_repeat], minlength=n)

    distinct = np.bincount(doc[np.unique(mix(word_hash ^ seed), return_index=True)[1]], minlength=n)
    letters = np.zeros(256, bool)
    letters[65:91] = letters[97:123] = letters[128:] = True
    upper = np.zeros(256, bool)
    upper[65:91] = True
    digits = np.zeros(256, bool)
    digits[48:58] = True
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, chars)
    words = np.maximum(n_words, 1)
    bytes_ = np.maximum(share(inside), 1)
    features = np.stack([
        np.log1p(n_words), word_chars / words, n_symbols / words, n_dup_lines / np.maximum(lines, 1),
        n_repeat / words, distinct / words, share(upper[raw]) / bytes_, share(digits[raw]) / bytes_,
        share(inside & ~letters[raw] & ~digits[raw]) / bytes_, n_words / np.maximum(lines, 1), longest,
    ], axis=1)
    return np.stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat], axis=1), features


@dataclass
class Trees:
    """Nodes of all trees in flat arrays; a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out


def no_trees() -> Trees:
    none = np.zeros(0, np.int64)
    return Trees(none, none, none.astype(float), none, none, none.astype(float), 0, 1.0)


def fit_trees(
    x: np.ndarray, y: np.ndarray, monotone: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH,
    bins: int = BINS, rate: float = RATE, min_rows: int = MIN_ROWS,
) -> Trees:
    """Boosted trees for labels 0 and 1, both classes weighing the same."""
    if len(np.unique(y)) < 2:
        return no_trees()
    cuts = [np.unique(np.quantile(f, np.linspace(0, 1, bins + 1)[1:-1])) for f in x.T]
    binned = np.stack([np.searchsorted(c, f, side="left") for c, f in zip(cuts, x.T)], axis=1)
    weight = np.where(y == 1, 0.5 / np.mean(y == 1), 0.5 / np.mean(y == 0))
    margin, nodes, roots = np.zeros(len(y)), [], []

    def grow(rows: np.ndarray, left: int, low: float, high: float) -> int:
        at = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        node = [0, np.inf, at, at, rate * float(np.clip(-g / (h + 1.0), low, high))]
        nodes.append(node)
        best = (1e-6, None)
        if left and len(rows) >= 2 * min_rows:
            for f in range(x.shape[1]):
                size = len(cuts[f]) + 1
                b = binned[rows, f]
                count = np.cumsum(np.bincount(b, minlength=size))[:-1]
                gl = np.cumsum(np.bincount(b, grad[rows], size))[:-1]
                hl = np.cumsum(np.bincount(b, hess[rows], size))[:-1]
                vl = np.clip(-gl / (hl + 1.0), low, high)
                vr = np.clip(-(g - gl) / (h - hl + 1.0), low, high)
                gain = gl**2 / (hl + 1.0) + (g - gl) ** 2 / (h - hl + 1.0) - g**2 / (h + 1.0)
                good = (count >= min_rows) & (len(rows) - count >= min_rows)
                if monotone[f]:
                    good &= monotone[f] * (vr - vl) >= 0
                gain = np.where(good, gain, -1.0)
                if len(gain) and gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (float(gain[i]), (f, i, float(vl[i]), float(vr[i])))
        if best[1]:
            f, i, vl, vr = best[1]
            goes_left = binned[rows, f] <= i
            bounds = [(low, high), (low, high)]
            if monotone[f]:
                middle = (vl + vr) / 2
                bounds = [(low, middle), (middle, high)] if monotone[f] > 0 else [(middle, high), (low, middle)]
            node[0], node[1] = f, float(cuts[f][i])
            node[2] = grow(rows[goes_left], left - 1, *bounds[0])
            node[3] = grow(rows[~goes_left], left - 1, *bounds[1])
        return at

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = weight * (p - y), weight * p * (1 - p)
        roots.append(grow(np.arange(len(y)), depth, -4.0, 4.0))
        f, t, a, b, v = (np.array(c) for c in zip(*nodes))
        tree = Trees(np.array(roots[-1:]), f, t, a, b, v, depth, 0.0)
        margin += tree.margin(x)
    return Trees(np.array(roots), f, t, a, b, v, depth, 0.0)


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Trees:
    """Trees from at most ``per_class`` documents of either label; only features reach the driver."""
    small_batches(docs.sparkSession)
    names = list(FEATURES)
    schema = "doc_id bigint, label int, " + ", ".join(f"{f} double" for f in names)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch):
                _, x = statistics(rows.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("label"), *map(pa.array, x.T)], names=["doc_id", "label", *names]
                )

    sample = labelled_sample(docs, labels, "quality", per_class).mapInArrow(measure, schema).toPandas()
    sample = sample.sort_values("doc_id", kind="stable")
    return fit_trees(sample[names].to_numpy(float), sample["label"].to_numpy(int), np.array(list(FEATURES.values())))


def quality_rules(docs: DataFrame, trees: Trees, at_least: float = 0.5) -> DataFrame:
    """Per document: the counts, base_failed, kept, and the trees' score."""
    small_batches(docs.sparkSession)
    margin = float(np.log(at_least / (1 - at_least)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch):
                counts, x = statistics(rows.column("text"))
                failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
                m = trees.margin(x)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts.T), pa.array(failed),
                     pa.array(~failed & (m >= margin)), pa.array(1 / (1 + np.exp(-m)))],
                    names=["doc_id", *COUNTS, "base_failed", "kept", "score"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        judge, f"doc_id bigint, {COUNT_SCHEMA}, base_failed boolean, kept boolean, score double"
    )
