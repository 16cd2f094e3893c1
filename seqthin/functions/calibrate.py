"""Relations between the novelty threshold, sketch size and nucleotide divergence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def divergence_boundary(threshold: Column, k: Column) -> Column:
    return threshold / (2 * k)


def threshold_for(divergence: Column, k: Column) -> Column:
    return 2 * k * divergence


def resolution_floor(m: Column) -> Column:
    return F.lit(1.0) / m


def divergence_floor(m: Column, k: Column) -> Column:
    return F.lit(1.0) / (2 * k * m)


def sketch_bytes(m: Column) -> Column:
    return m.cast("bigint") * 8


def binomial_cutoff(trials: Column, p: float, mass: float) -> Column:
    """Smallest count whose cumulative Binomial(trials, p) mass reaches ``mass``.

    All trial numbers of a batch advance together, one count at a time.
    """

    @F.pandas_udf("bigint")
    def cutoff(n: pd.Series) -> pd.Series:
        draws, where = np.unique(n.to_numpy(np.int64), return_inverse=True)
        found = np.zeros(len(draws), np.int64)
        live = np.flatnonzero(draws > 0)
        term, total, i = np.power(1.0 - p, draws[live].astype(float)), np.zeros(len(live)), 0
        # Where the probability of no event underflows, terms advance as logarithms.
        tiny = term == 0.0
        log_term = draws[live] * np.log1p(-p)
        while len(live):
            total = total + np.where(tiny, np.exp(log_term), term)
            left = (draws[live] - i) / (i + 1)
            term = term * p / (1.0 - p) * left
            log_term = log_term + np.log(p / (1.0 - p) * left)
            i += 1
            found[live] = i
            keep = (total < mass) & (i < draws[live])
            live, term, total, tiny, log_term = (x[keep] for x in (live, term, total, tiny, log_term))
        return pd.Series(found[where])

    return cutoff(trials.cast("bigint"))
