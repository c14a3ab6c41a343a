"""Aggregates and table functions in Python, for SQL and the DataFrame API."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import kernels as K


def _rmssd(d_ms: pd.Series) -> float:
    d = d_ms.dropna().to_numpy()
    return float(np.sqrt((d * d).mean())) if len(d) else float("nan")


def _sample_entropy(rr_ms: pd.Series) -> float:
    found = K.sample_entropy(rr_ms.to_numpy())
    return float("nan") if found is None else found


def rmssd():
    """Aggregate of successive differences; NaN without any."""
    return F.pandas_udf(_rmssd, "double")


def sample_entropy():
    """Aggregate of one bounded group's intervals, in the order given; NaN if undefined."""
    return F.pandas_udf(_sample_entropy, "double")


class SlidingWindows:
    """Starts of windows of ``length`` every ``step`` between two times, the last one reaching at most one step beyond."""

    def eval(self, t0: float, t1: float, length: float, step: float) -> Iterator[tuple[int, float, float]]:
        k = 0
        while None not in (t0, t1) and t0 + k * step <= t1 - length + step:
            yield k, t0 + k * step, t0 + k * step + length
            k += 1


def register(spark: SparkSession) -> None:
    """Names rmssd, sample_entropy and sliding_windows in SQL."""
    spark.udf.register("rmssd", rmssd())
    spark.udf.register("sample_entropy", sample_entropy())
    spark.udtf.register("sliding_windows", F.udtf(SlidingWindows, returnType="k int, start_s double, end_s double"))
