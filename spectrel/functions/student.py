"""Quantiles of Student's t, by integrating its density."""

from __future__ import annotations

import math

import numpy as np


def t_cdf(t: float, df: float) -> float:
    """P(T <= t). The angle a = atan(t / sqrt(df)) turns the density into a power of its cosine on a bounded range."""
    a = math.atan(abs(t) / math.sqrt(df))
    x, g = np.polynomial.legendre.leggauss(64)
    # Most of the mass lies within a few 1 / sqrt(df) of 0, so the range is cut there.
    ends = np.unique(np.minimum(a, np.array([0, 1, 2, 4, 8, 16, 1e9]) / math.sqrt(df)))
    half = np.diff(ends)[:, None] / 2
    area = float((half * g * np.cos(ends[:-1, None] + half + half * x) ** (df - 1)).sum())
    part = area * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 0.5 + math.copysign(part, t)


def t_quantile(p: float, df: float) -> float:
    """By bisection; with less than one degree of freedom there is no interval, and the result is infinite."""
    if df < 1:
        return math.copysign(math.inf, p - 0.5)
    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2
