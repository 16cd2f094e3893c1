"""NumPy helpers run inside Arrow batches: 64-bit unsigned arithmetic on k-mers.

Spark has no unsigned 64-bit type and checks overflow, so the few steps that
need wrap-around arithmetic work on Arrow buffers.  Values cross into Spark as
BIGINT bit patterns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64

# They decide which sketch cells and slots a k-mer lands in.
BASES = "ACGT"
CMS_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
MIX_MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
XORSHIFT_START = 0x123456789ABCDEF
XORSHIFT_STEPS = (13, 7, 17)
PCG64_SEED = 42
BAND_START = 0x9E3779B97F4A7C15
BAND_STEP = 0xC2B2AE3D27D4EB4F
BAND_MONTH = 0x94D049BB133111EB
FOLD_PRIME = 0x100000001B3
EMPTY_SLOT = 0xFFFFFFFFFFFFFFFF

BASES_PER_BLOCK = 1 << 20
KMERS_PER_BLOCK = 1 << 16

_INVALID = 4
_BASE_CODE = np.full(256, _INVALID, dtype=np.uint8)
_BASE_CODE[np.frombuffer(BASES.encode(), dtype=np.uint8)] = np.arange(4, dtype=np.uint8)


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser: seeded xor, then two xor-shift-multiply steps."""
    h = x ^ U(seed)
    for shift, factor in zip((30, 27), MIX_MULTIPLIERS):
        h = (h ^ (h >> U(shift))) * U(factor)
    return h ^ (h >> U(31))


def sketch_salts(m: int, family: str = "xorshift") -> np.ndarray:
    """``m`` odd multipliers."""
    if family == "pcg64":
        drawn = np.random.default_rng(PCG64_SEED).integers(0, 2**63, size=m, dtype=np.uint64)
        return drawn | U(1)
    left, right, last = XORSHIFT_STEPS
    salts, state = [], XORSHIFT_START
    for _ in range(m):
        state ^= (state << left) & EMPTY_SLOT
        state ^= state >> right
        state ^= (state << last) & EMPTY_SLOT
        salts.append(state | 1)
    return np.array(salts, dtype=np.uint64)


def slot_hash(kmers: np.ndarray, salt) -> np.ndarray:
    h = kmers * salt
    h ^= h >> U(29)
    return h


def band_keys(month: np.ndarray, sketches: np.ndarray, bands: int) -> np.ndarray:
    """Fold each band of slots (and the month) to one key: shape (records, bands)."""
    rows = sketches.shape[1] // bands
    band_part = U(BAND_START) ^ (np.arange(bands, dtype=np.uint64) * U(BAND_STEP))
    month_part = (month.astype(np.int64) + 1).view(np.uint64) * U(BAND_MONTH)
    fold = lambda h: (h * U(FOLD_PRIME)) ^ ((h * U(FOLD_PRIME)) >> U(33))
    key = fold(band_part[None, :] ^ month_part[:, None])
    slots = sketches[:, : bands * rows].reshape(len(sketches), bands, rows)
    for r in range(rows):
        key = fold(key ^ slots[:, :, r])
    return key


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the record offsets into them, without copying rows."""
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(sizes: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of records whose sizes add up to about ``budget``."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + budget, side="right")))
        yield lo, hi
        lo = hi


def window_codes(bases: np.ndarray, k: int, U: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """2-bit codes of every length-``k`` window and of its reverse complement.

    Windows of length 1, 2, 4, … come from joining two half-length ones; those
    that make up ``k`` in binary are joined to the result.  ``U`` is the type of
    the codes; up to 16 bases fit 32 bits.
    """
    fwd = bases.astype(U)
    rev = U(3) - fwd
    out_f = out_r = None
    have, span = 0, 1
    while True:
        if k & span:
            if out_f is None:
                out_f, out_r = fwd, rev
            else:
                n = len(fwd) - have
                out_f = (out_f[:n] << U(2 * span)) | fwd[have:]
                out_r = out_r[:n] | (rev[have:] << U(2 * have))
            have += span
        if have == k:
            return out_f, out_r
        fwd, rev = (
            (fwd[:-span] << U(2 * span)) | fwd[span:],
            rev[:-span] | (rev[span:] << U(2 * span)),
        )
        span *= 2


def distinct_kmers(
    raw: np.ndarray, offsets: np.ndarray, k: int, cap: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct canonical k-mers of each record, as (record index, k-mer), sorted."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(raw) < k:
        return none
    bases = _BASE_CODE[raw]
    invalid = np.concatenate(([0], np.cumsum(bases == _INVALID)))
    record = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = (invalid[k:] == invalid[:-k]) & (record[k - 1 :] == record[: len(raw) - k + 1])
    start = np.flatnonzero(whole)
    if not len(start):
        return none
    fwd, rev = window_codes(bases & 3, k, np.uint32 if k <= 16 else U)
    rec, kmer = record[start], np.minimum(fwd[start], rev[start]).astype(U)
    if cap is not None:
        rank = np.arange(len(rec)) - np.searchsorted(rec, rec, side="left")
        rec, kmer = rec[rank < cap], kmer[rank < cap]
    if 2 * k + int(len(offsets)).bit_length() <= 64:
        both = np.sort((rec.astype(np.uint64) << U(2 * k)) | kmer)
        rec = (both >> U(2 * k)).astype(np.int64)
        kmer = both & U((1 << (2 * k)) - 1)
    else:
        order = np.lexsort((kmer, rec))
        rec, kmer = rec[order], kmer[order]
    first = np.ones(len(rec), bool)
    first[1:] = (rec[1:] != rec[:-1]) | (kmer[1:] != kmer[:-1])
    return rec[first], kmer[first]


def distinct_kmers_in_pieces(raw: np.ndarray, k: int, piece: int) -> np.ndarray:
    """Sorted distinct canonical k-mers of one long record, worked off in overlapping pieces."""
    found = np.zeros(0, np.uint64)
    for lo in range(0, max(1, len(raw) - k + 1), piece):
        part = raw[lo : lo + piece + k - 1]
        _, kmer = distinct_kmers(part, np.array([0, len(part)]), k)
        found = np.union1d(found, kmer)
    return found


def count_min_cells(kmers: np.ndarray, log2_width: int) -> np.ndarray:
    """Flat cell number of each k-mer in each of the four rows: shape (4, k-mers)."""
    mask = U((1 << log2_width) - 1)
    return np.stack([
        (U(row) << U(log2_width)) | (mix64(kmers, seed) & mask)
        for row, seed in enumerate(CMS_SEEDS)
    ])


def minhash(rec: np.ndarray, kmers: np.ndarray, n: int, salts: np.ndarray) -> np.ndarray:
    """Minimum slot hash per record and salt; records without k-mers keep empty slots."""
    out = np.full((n, len(salts)), EMPTY_SLOT, dtype=np.uint64)
    if not len(rec):
        return out
    first = np.flatnonzero(np.concatenate(([True], rec[1:] != rec[:-1])))
    sizes = np.diff(np.append(first, len(rec)))
    owner = rec[first]
    for lo, hi in blocks(sizes, KMERS_PER_BLOCK):
        a = first[lo]
        part = kmers[a : first[lo:hi][-1] + sizes[hi - 1]]
        at = first[lo:hi] - a
        for s, salt in enumerate(salts):
            out[owner[lo:hi], s] = np.minimum.reduceat(slot_hash(part, salt), at)
    return out
