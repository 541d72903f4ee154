"""Numeric columns: lenient casts, unbiased moments, chi-square tail."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_number(col: str | Column, default: float | None = None, kind: str = "double") -> Column:
    """Numbers where the text is a number, else null or ``default``."""
    c = (F.col(col) if isinstance(col, str) else col).try_cast(kind)
    return c if default is None else F.coalesce(c, F.lit(default).cast(kind))


def round_halves_up(c: Column, digits: int) -> Column:
    """``digits`` decimals by the double ``c * 10^digits``, as SQL engines do; ``F.round`` goes by the shortest decimal text (1.005)."""
    scale = float(10**digits)
    return F.round(c.cast("double") * scale, 0) / scale


def one_decimal(c: Column) -> Column:
    """The text of C's ``%.1f`` for numbers from 0 to 10^15: by the exact binary value, ties to the even digit.

    Java formats the shortest decimal text and rounds its halves up (6.25 to 6.3, 0.15 to 0.2).
    """
    x = c.cast("double")
    low = F.floor(x * 10)
    middle = 2 * low + 1  # twentieths
    above = (16 * x - middle) + 4 * x  # its sign is exact: both differences are
    tenths = F.when((above > 0) | (above == 0) & (low % 2 == 1), low + 1).otherwise(low)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def sample_skewness(skew: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population one."""
    return F.when(n > 2, skew * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(kurt: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population one."""
    return F.when(n > 3, ((n + 1) * kurt + 6) * (n - 1) / ((n - 2) * (n - 3)))


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * math.exp(log_front))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return h * math.exp(log_front)


@F.pandas_udf(T.DoubleType())
def chi2_tail(stat: pd.Series, df: pd.Series) -> pd.Series:
    """Right tail of the chi-square distribution (runs on one summary row per table)."""
    vals = [
        _upper_gamma(k / 2.0, s / 2.0) if pd.notna(s) and pd.notna(k) and k > 0 else np.nan
        for s, k in zip(stat, df)
    ]
    return pd.Series(vals, dtype="float64")
