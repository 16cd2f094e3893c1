"""Sketch comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def equal_slots(a: Column, b: Column) -> Column:
    """How many positions of two sketches agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def jaccard(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: share of agreeing slots."""
    return equal_slots(a, b) / F.size(a)


def min_equal_slots(m: int, threshold: float) -> int:
    """Fewest agreeing slots that make two records redundant (similarity above 1 - threshold).

    ``m + 1`` when no pair can be redundant.
    """
    need = 1.0 - threshold
    return next((e for e in range(m + 1) if e / m > need), m + 1)


def min_covering_slots(m: int, threshold: float) -> int:
    """Fewest agreeing slots that put a record within ``threshold`` of another."""
    return next((e for e in range(m + 1) if 1.0 - e / m < threshold), m + 1)


def sketch_hex(sketch: Column) -> Column:
    """Unsigned slot values as fixed-width hexadecimal text."""
    return F.array_join(F.transform(sketch, lambda v: F.lpad(F.hex(v), 16, "0")), "")
