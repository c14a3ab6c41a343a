"""Input of an outside staging engine: recordings filtered, brought to 256 Hz, scaled by their beats and cut into epochs, with a person's data."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K

# Rate (Hz) and samples of an epoch, cut-off and mains (Hz), window around a beat (s), scale of the 90th percentile.
RATE_HZ, EPOCH_SAMPLES, HIGH_PASS_HZ, MAINS_HZ, AROUND_S, SCALE = 256.0, 7680, 0.5, (50.0, 60.0), 0.4, 0.5
#: What stands for an unknown age or sex.
UNKNOWN = 0.5


def prepare(ecg: np.ndarray, rate: float, beats_s: np.ndarray) -> np.ndarray:
    """The signal at 256 Hz without wander and hum, its median removed, scaled so that 90 % of beats reach at most half, cut at one."""
    x = K.zero_phase(K.butterworth(4, HIGH_PASS_HZ, rate, "high"), np.asarray(ecg, float))
    for hz in MAINS_HZ:
        if hz < 0.95 * rate / 2:
            x = K.zero_phase(K.notch(hz, rate), x)
    step = Fraction(RATE_HZ / rate).limit_denominator(10000)
    x = K.resampled(x, step.numerator, step.denominator)
    x = x - np.median(x)
    half = int(AROUND_S * RATE_HZ)
    at = np.round(np.asarray(beats_s, float) * RATE_HZ).astype(int)
    at = at[(at >= 0) & (at < len(x))]
    size = np.abs(x)
    if len(beats_s):
        high = float(np.percentile([size[max(0, i - half) : i + half].max() for i in at], 90)) if len(at) else 0.0
    else:
        high = float(np.percentile(size, 99))
    return np.clip(x * (SCALE / high) if high > 0 else x, -1.0, 1.0)


def epochs(samples: DataFrame, beats: DataFrame, rate: float) -> DataFrame:
    """session_id, epoch, ecg (7,680 floats): the whole epochs of recordings (session_id, i, t_s, x) with beats (session_id, t_s); none of a recording under 30 s."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        beat = d["beat"].to_numpy(bool)
        s = d[~beat].sort_values("i")
        n, x = 0, np.empty(0)
        if len(s) > 1:
            x = prepare(s["x"].to_numpy(float), rate, np.sort(d.loc[beat, "t_s"].to_numpy(float)) - s["t_s"].iloc[0])
            n = len(x) // EPOCH_SAMPLES
        parts = list(x[: n * EPOCH_SAMPLES].astype("float32").reshape(n, EPOCH_SAMPLES))
        return pd.DataFrame({"session_id": pd.Series([d["session_id"].iloc[0]] * n, dtype="int64"), "epoch": np.arange(n), "ecg": pd.Series(parts, dtype=object)})

    none = F.lit(None)
    both = samples.select("session_id", "i", "t_s", "x", F.lit(False).alias("beat")).union(beats.select("session_id", none.cast("long"), "t_s", none.cast("double"), F.lit(True)))
    return both.groupBy("session_id").applyInPandas(run, "session_id long, epoch long, ecg array<float>")


def demographics(sessions: DataFrame) -> DataFrame:
    """session_id, sex, age, midnight_offset (-1 to 1 over half a day) and note of sessions (session_id, started_at, age_years, sex); what is unknown is 0.5, and said."""
    sex = F.when(F.col("sex") == "female", 0.0).when(F.col("sex") == "male", 1.0).otherwise(UNKNOWN)
    at = F.col("started_at").cast("timestamp")
    second = F.hour(at) * 3600 + F.minute(at) * 60 + F.floor(F.second(at))
    signed = F.when(second > 43200, second - 86400).otherwise(second)
    note = F.when((sex == UNKNOWN) | F.col("age_years").isNull(), "age or sex is not known: the engine is less accurate")
    return sessions.select("session_id", sex.alias("sex"), F.coalesce(F.col("age_years") / 100.0, F.lit(UNKNOWN)).alias("age"), (signed / 43200.0).alias("midnight_offset"), note.alias("note"))
