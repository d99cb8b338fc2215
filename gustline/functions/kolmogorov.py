"""p-values of the two-sample Kolmogorov–Smirnov statistic."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

SERIES_TERMS = 100


def asymptotic_p(d: Column, n1: Column, n2: Column, terms: int = SERIES_TERMS) -> Column:
    """Limit distribution: 2 * sum((-1)^(k-1) exp(-2 k² z²)), z = d sqrt(n1 n2 / (n1 + n2))."""
    z2 = d * d * n1 * n2 / (n1 + n2)
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * k * k * z2))
    # the alternating series does not converge at 0, where the probability is 1
    return F.when(z2 < 0.01, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * total)))


def exact_two_sample(d: float, n1: int, n2: int) -> float:
    """P(D >= d) by counting lattice paths that stay inside the band (Hodges, 1958).

    A row of the lattice is held only where it lies inside the band, so the work is the smaller sample times 2 d times the larger.

    Without ties every merge order of the samples is equally likely; a merge order is a path
    from (0, 0) to (m, n), and D < d holds when all its points satisfy |i/m - j/n| < d.
    """
    m, n = min(n1, n2), max(n1, n2)
    h = int(round(d * m * n))
    if h <= 0:
        return 1.0

    def band(i: int) -> tuple[int, int]:
        """The first and last j with |i n - j m| < h."""
        return max(0, (i * n - h) // m + 1), min(n, -((-i * n - h) // m) - 1)

    first, last = band(0)
    row, log_scale = np.ones(last + 1), 0.0     # i = 0: one path along the edge
    for i in range(1, m + 1):
        lo, hi = band(i)
        if lo > hi or lo > last:
            return 1.0
        # paths that come from below inside the band, then along it
        come = np.zeros(hi - lo + 1)
        come[:last - lo + 1] = row[lo - first:]
        row = np.cumsum(come)
        first, last = lo, hi
        top = row[-1]
        row /= top
        log_scale += math.log(top)
    log_all = math.lgamma(m + n + 1) - math.lgamma(m + 1) - math.lgamma(n + 1)
    stay = math.exp(min(0.0, math.log(row[-1]) + log_scale - log_all))
    return min(1.0, max(0.0, 1.0 - stay))


@F.pandas_udf(DoubleType())
def exact_p(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Exact p-value; one row per test."""
    return pd.Series([None if pd.isna(x) else exact_two_sample(x, int(a), int(b)) for x, a, b in zip(d, n1, n2)],
                     dtype="float64")
