"""Two-sided tails of the normal and the t distribution, for result rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):  # the fraction converges quickly on the other side
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1) or 1e-300)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + step * d or tiny)
            c = 1.0 + step / c or tiny
            out *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


@F.pandas_udf(DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|) with df degrees of freedom; null without a statistic or a degree of freedom."""
    return pd.Series([t_two_sided(x, n) if x == x and n == n and n > 0 else None for x, n in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|)."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x == x else None).astype("float64")
