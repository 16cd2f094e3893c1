"""Helpers for functions that run over Arrow batches of documents."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BYTES_PER_CALL = 2 << 20
ROWS_SETTING, ROWS_USUAL, ROWS_OF_TEXT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def small_batches(spark) -> None:
    """Batches of whole texts hold a thousand rows, unless the session sets a number of its own.

    Ten thousand texts in a batch would fill the buffers of both sides with tens of
    megabytes for every task.
    """
    if spark.conf.get(ROWS_SETTING, ROWS_USUAL) == ROWS_USUAL:
        spark.conf.set(ROWS_SETTING, ROWS_OF_TEXT)


def text_slices(batch: pa.RecordBatch, budget: int = BYTES_PER_CALL, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``budget`` bytes of text, one row at least."""
    column = batch.column(name)
    sizes = np.zeros(batch.num_rows, np.int64) if not batch.num_rows else np.asarray(
        pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64
    )
    ends, lo = np.cumsum(sizes), 0
    while lo < batch.num_rows:
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + budget, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def worker_state(key, make: Callable):
    """A value that a Python worker keeps between its tasks.

    One at a time: a worker that turns to another operator drops what the last one kept.
    """
    home = sys.modules.setdefault("_seqthin_worker_state", types.ModuleType("_seqthin_worker_state"))
    if getattr(home, "key", None) != key:
        if getattr(home, "value", None) is not None:
            home.value = None
            let_go()
        home.key, home.value = key, make()
    return home.value


def let_go() -> None:
    """Give memory of finished groups back: idle workers stay, and share their executor's."""
    pa.default_memory_pool().release_unused()
    # The C library keeps what was freed, in an arena for every thread of the tokenizer.
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def letting_go(task: Callable) -> Callable:
    """The task over batches, giving memory back when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        let_go()

    return run


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``start, start + 1, …`` of the given sizes."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)
