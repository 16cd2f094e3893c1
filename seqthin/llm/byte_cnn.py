"""Quality: a byte-level convolutional network in NumPy.

A text's UTF-8 bytes are covered, whole, by chunks that overlap by half.  Learned
filters slide over the bytes of a chunk (an embedding per byte, times weights per
place in the filter, is one table per place, so a filter is a sum of looked-up rows);
the largest answer of every filter in the chunk and the chunk's fill go through one
hidden layer to a logit.  A document's logit is the mean over its chunks, scaled so
that the cut found best on the training sample scores ``CUT``.

Training takes a bounded sample of labelled documents on the driver, drawing random
chunks of each.  Defined cases: a null or empty text is one empty chunk; equal rows
get equal scores; without labels of both classes every score is the cut; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqthin.llm.batches import small_batches, text_slices
from seqthin.llm.samples import id_remainder, labelled_sample

CHUNK, STRIDE = 512, 256
WIDTH, DIMENSIONS, FILTERS, HIDDEN = 6, 8, 16, 16
PER_CLASS = 1500
EPOCHS, CHUNKS_PER_DOC, BATCH, RATE = 14, 2, 64, 0.004
CUT = 0.7
SLICE = 1 << 20
EMPTY = -8.0


@dataclass
class ByteCnn:
    tables: np.ndarray  # (width, 256, filters)
    bias: np.ndarray
    hidden: np.ndarray  # (filters + 1, hidden)
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    middle: float = 0.0

    def chunk_logits(self, pooled: np.ndarray, fill: np.ndarray) -> np.ndarray:
        x = np.concatenate([np.maximum(pooled + self.bias, 0), fill[:, None]], axis=1)
        return np.tanh(x @ self.hidden + self.hidden_bias) @ self.out + self.out_bias

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Mean chunk logit of every text."""
        n, width, filters = np.array(list(map(len, texts)), np.int64), *self.tables[:, 0].shape
        raw = np.frombuffer((b"\0" * (width - 1)).join([*texts, b""]), np.uint8)
        first = np.cumsum(n + width - 1) - (n + width - 1)
        blocks = np.maximum(1, -(-n // STRIDE))
        doc = np.repeat(np.arange(len(n)), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = first[doc] + nth * STRIDE
        size = np.minimum(n[doc] - nth * STRIDE, STRIDE)
        top = np.full((len(doc), filters), EMPTY, np.float32)
        # Stretches of blocks, so that answers to one stretch fit in the processor's cache.
        some = np.flatnonzero(size > 0)
        step = max(1, (SLICE // 16) // STRIDE)
        for lo in range(0, len(some), step):
            mine = some[lo : lo + step]
            a, b = start[mine[0]], start[mine[-1]] + size[mine[-1]]
            answer = self.tables[0].take(raw[a:b], axis=0)
            for j in range(1, width):
                answer += self.tables[j].take(raw[a + j : b + j], axis=0)
            # Gaps between documents are stretches of their own.
            ends = start[mine] + size[mine] - a
            cuts = np.unique(np.concatenate([start[mine] - a, ends[ends < b - a]]))
            top[mine] = np.maximum.reduceat(answer, cuts, axis=0)[np.searchsorted(cuts, start[mine] - a)]
        # A chunk is a block and the next one; the last block alone only where it is the only one.
        chunk = np.flatnonzero((nth + 1 < blocks[doc]) | (blocks[doc] == 1))
        after = np.where(blocks[doc[chunk]] == 1, chunk, chunk + 1)
        pooled = np.maximum(top[chunk], top[after])
        fill = np.where(after > chunk, size[chunk] + size[after], size[chunk]) / CHUNK
        out = self.chunk_logits(pooled, fill.astype(np.float32))
        return np.bincount(doc[chunk], out, len(n)) / np.bincount(doc[chunk], minlength=len(n))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = self.scale * (self.logits(texts) - self.middle) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _untrained() -> ByteCnn:
    return ByteCnn(
        np.zeros((WIDTH, 256, 1), np.float32), np.zeros(1, np.float32), np.zeros((2, 1), np.float32),
        np.zeros(1, np.float32), np.zeros(1, np.float32), 0.0,
    )


def fit(texts: list[bytes], y: np.ndarray, seed: int = 11) -> ByteCnn:
    if len(np.unique(y)) < 2:
        return _untrained()
    rng = np.random.default_rng(seed)
    p = {
        "embedding": rng.normal(0, 0.5, (256, DIMENSIONS)), "filters": rng.normal(0, 0.25, (WIDTH, DIMENSIONS, FILTERS)),
        "bias": np.zeros(FILTERS), "hidden": rng.normal(0, 0.3, (FILTERS + 1, HIDDEN)), "hidden_bias": np.zeros(HIDDEN),
        "out": rng.normal(0, 0.3, HIDDEN), "out_bias": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    weight = np.where(y == 1, 0.5 / np.mean(y == 1), 0.5 / np.mean(y == 0))
    t = 0
    for _ in range(EPOCHS):
        for batch in np.array_split(order := rng.permutation(np.repeat(np.arange(len(y)), CHUNKS_PER_DOC)), -(-len(order) // BATCH)):
            x = np.zeros((len(batch), CHUNK + WIDTH - 1), np.uint8)
            size = np.zeros(len(batch), np.int64)
            for i, d in enumerate(batch):
                blocks = max(1, -(-len(texts[d]) // STRIDE) - 1)
                at = int(rng.integers(blocks)) * STRIDE
                # Filters that start in a chunk may look beyond its end.
                piece = texts[d][at : at + CHUNK + WIDTH - 1]
                x[i, : len(piece)] = np.frombuffer(piece, np.uint8)
                size[i] = min(CHUNK, len(texts[d]) - at)
            tables = np.einsum("be,jef->jbf", p["embedding"], p["filters"])
            answer = tables[0].take(x[:, :CHUNK], axis=0)
            for j in range(1, WIDTH):
                answer += tables[j].take(x[:, j : j + CHUNK], axis=0)
            answer[np.arange(CHUNK)[None, :] >= size[:, None]] = EMPTY
            at = answer.argmax(axis=1)
            top = np.take_along_axis(answer, at[:, None, :], axis=1)[:, 0, :]
            pooled = np.maximum(top + p["bias"], 0)
            features = np.concatenate([pooled, (size / CHUNK).astype(np.float32)[:, None]], axis=1)
            hidden = np.tanh(features @ p["hidden"] + p["hidden_bias"])
            z = np.clip(hidden @ p["out"] + p["out_bias"], -30, 30)
            g = (weight[batch] * (1 / (1 + np.exp(-z)) - y[batch]) / len(batch)).astype(np.float32)
            back = np.outer(g, p["out"]) * (1 - hidden**2)
            grad = {"out": hidden.T @ g, "out_bias": g.sum(keepdims=True), "hidden": features.T @ back, "hidden_bias": back.sum(0)}
            pool_back = (back @ p["hidden"].T)[:, :-1] * ((pooled > 0) & (size > 0)[:, None])
            grad["bias"] = pool_back.sum(0)
            moved = np.zeros_like(tables)
            rows = np.arange(len(batch))[:, None]
            for j in range(WIDTH):
                np.add.at(moved[j], (x[rows, at + j], np.arange(FILTERS)[None, :]), pool_back)
            grad["embedding"] = np.einsum("jbf,jef->be", moved, p["filters"])
            grad["filters"] = np.einsum("be,jbf->jef", p["embedding"], moved)
            t += 1
            for k in p:
                step = grad[k] + 1e-5 * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * step
                m2[k] = 0.99 * m2[k] + 0.01 * step**2
                p[k] -= RATE * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-7)
    net = ByteCnn(
        np.einsum("be,jef->jbf", p["embedding"], p["filters"]).astype(np.float32), p["bias"], p["hidden"],
        p["hidden_bias"], p["out"], float(p["out_bias"][0]),
    )
    z = np.concatenate([net.logits(texts[i : i + 200]) for i in range(0, len(texts), 200)])
    order = np.argsort(z, kind="stable")
    low_right = np.concatenate(([0], np.cumsum(y[order] == 0))) / (y == 0).sum()
    high_right = 1 - np.concatenate(([0], np.cumsum(y[order] == 1))) / (y == 1).sum()
    low, high = np.concatenate(([z[order[0]] - 1], z[order])), np.concatenate((z[order], [z[order[-1]] + 1]))
    good = low_right + high_right
    best = np.flatnonzero(good >= good.max() - 1e-12)
    i = best[np.argmax((high - low)[best])]
    net.middle = float((low[i] + high[i]) / 2)
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, parts: int = 4, held_out: int = 2) -> ByteCnn:
    """From at most ``per_class`` documents of either label outside the held-out quarter."""
    rows = labelled_sample(docs, labels, "quality", per_class, id_remainder(parts) != held_out).toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    return fit([(t or "").encode() for t in rows["text"]], rows["label"].to_numpy(int))


def score(docs: DataFrame, net: ByteCnn, parts: int = 4, held_out: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, SLICE):
                texts = [t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()]
                s = net.scores(texts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), (id_remainder(parts) == held_out).alias("held_out"), "text")
    return rows.mapInArrow(judge, "doc_id bigint, held_out boolean, score double, predicted int")
