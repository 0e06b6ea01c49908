"""Two special functions that Spark has no column function for, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after stepping the argument up to 8 or more."""
    x = np.asarray(x, dtype=float).copy()
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift[low] += np.log(x[low])
        x[low] += 1
    z = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / x - shift


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, evaluated from the front."""
    a, b, x = (np.array(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    turn = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    tiny = 1e-300
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    c, d = np.ones_like(y), 1 - (a + b) * y / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps + 1):
        for e in (m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + e * d, 1 + e / c
            d, c = np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            d = 1 / d
            h = h * c * d
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(y) + b * np.log1p(-y)) / a
    p = np.where(inside, front * h, np.where(x <= 0, 0.0, 1.0))
    return np.where(turn, 1 - p, p)


def pearson_p_values(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p-value of a correlation under no correlation; 1 for n = 2, 0 for |r| = 1, NaN where r or n say nothing."""
    r, n = np.asarray(r, dtype=float), np.asarray(n, dtype=float)
    ok = np.isfinite(r) & (n > 2)
    out = np.where(np.isfinite(r) & (n == 2), 1.0, np.nan)
    out[ok] = incomplete_beta((n[ok] - 2) / 2, 0.5, np.clip(1 - r[ok] ** 2, 0, 1))
    return out


def normal_quantiles(p: np.ndarray) -> np.ndarray:
    """Inverse of the normal distribution function: a rough start, then Newton steps on erfc."""
    import math

    erfc = np.vectorize(math.erfc, otypes=[float])
    p = np.asarray(p, dtype=float)
    q = np.minimum(p, 1 - p)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.sqrt(-2 * np.log(q))
        x = -(t - (2.30753 + 0.27061 * t) / (1 + t * (0.99229 + 0.04481 * t)))
        for _ in range(4):
            density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
            x = x - (erfc(-x / math.sqrt(2)) / 2 - q) / density
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, np.where(p > 0.5, -x, x)))


def pearson_pvalue(r: Column | str, n: Column | str) -> Column:
    """Column form of ``pearson_p_values``; NULL where it is NaN. For one row per cell, not per observation."""

    @F.pandas_udf(DoubleType())
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(pearson_p_values(r.to_numpy(dtype=float), n.to_numpy(dtype=float))).astype(object).where(lambda s: s.notna(), None)

    return p(r, n)


def normal_quantile(p: Column | str) -> Column:
    @F.pandas_udf(DoubleType())
    def q(p: pd.Series) -> pd.Series:
        return pd.Series(normal_quantiles(p.to_numpy(dtype=float)))

    return q(p)
