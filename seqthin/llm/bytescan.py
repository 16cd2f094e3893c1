"""Words, lines and hashes of many texts at once, as NumPy over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from seqthin.llm.batches import worker_state

U = np.uint64
POWER = 0x9E3779B97F4A7C15 | 1
STEP = 0xD1342543DE82EF95
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column with a line end behind every row; starts and ends of the rows."""
    texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column.cast(pa.binary())]
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1) - 1
    return raw, ends - sizes, ends


def table_of(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches where ``inside`` holds (it must end with False)."""
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    return edges[::2], edges[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shift and multiply, twice."""
    x = (x ^ (x >> U(31))) * U(STEP)
    x = (x ^ (x >> U(29))) * U(POWER)
    return x ^ (x >> U(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    def make(base: int) -> np.ndarray:
        out = np.ones(n, U)
        out[1:] = U(base)
        return np.multiply.accumulate(out)

    held = worker_state("powers", dict)
    if len(held.get("up", ())) < n:
        n = 1 << (n - 1).bit_length()
        held["up"], held["down"] = make(POWER), make(pow(POWER, -1, 1 << 64))
    return held["up"], held["down"]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch of bytes, from running sums of a polynomial."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(STEP))


def owner(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the row each position lies in."""
    return np.searchsorted(starts, at, side="right") - 1


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    if not len(keys):
        return np.zeros(0, bool)
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys
