"""Breathing from two channels of a recording: the rate of its beats and the height of their R peaks.

Both channels are put on one grid and band-passed in one grouped function for
each session, which gives the dominant frequency of either in windows of a
minute.  Gates and fusion are joins and aggregates over the windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .series import bucketed, by_session, islands

# Grid (Hz), window and hop (s), filter and searched band (Hz), beats and seconds of a usable recording.
GRID_HZ, WINDOW_S, HOP_S, FILTER_HZ, BAND_HZ, LEAST_BEATS, LEAST_S = 4.0, 60.0, 30.0, (0.066, 1.0), (0.06, 0.9), 30, 120.0
# Distance of the channels (a minute), excluded share, mean rate (bpm), windows of a result, paced band and run.
AGREEMENT, MOST_EXCLUDED, MOST_HR, LEAST_WINDOWS, PACED, PACED_RUN = 4.0, 0.25, 110.0, 5, (4.5, 7.5), 3


def _dominant(x: np.ndarray) -> float | None:
    f, p = K.welch(x - x.mean(), GRID_HZ, len(x))
    ok = (f >= BAND_HZ[0]) & (f <= BAND_HZ[1])
    return 60.0 * float(f[ok][p[ok].argmax()]) if (p[ok] > 0).any() else None


def windows(rr: DataFrame, beats: DataFrame) -> DataFrame:
    """session_id, k, start_s, end_s, hr_bpm, rate_brpm, amplitude_brpm of every window of intervals (session_id, n, t_s, rr_ms) and beats (session_id, t_s, amplitude).

    Sessions of under 30 intervals or beats, or of under two minutes, have no windows.
    """

    def run(d: pd.DataFrame) -> pd.DataFrame:
        rows = []
        d = d.sort_values("t_s")
        r, a = d[d["rr_ms"].notna()], d[d["amplitude"].notna()]
        t = r["t_s"].to_numpy()
        if min(len(r), len(a)) >= LEAST_BEATS and t[-1] - t[0] >= LEAST_S:
            grid = np.arange(t[0], t[-1], 1 / GRID_HZ)
            hr = np.interp(grid, t, 60000.0 / r["rr_ms"].to_numpy())
            height = np.interp(grid, a["t_s"].to_numpy(), a["amplitude"].to_numpy())
            sos, n, hop = K.butterworth(2, FILTER_HZ, GRID_HZ, "band"), int(WINDOW_S * GRID_HZ), int(HOP_S * GRID_HZ)
            channels = [K.zero_phase(sos, c) for c in (hr, height)]
            for k, i in enumerate(range(0, len(grid) - n + 1, hop)):
                rows.append((k, grid[i], grid[i + n - 1], hr[i : i + n].mean(), *(_dominant(c[i : i + n]) for c in channels)))
        out = pd.DataFrame(rows, columns=["k", "start_s", "end_s", "hr_bpm", "rate_brpm", "amplitude_brpm"]).astype({"k": "int64"})
        out.insert(0, "session_id", d["session_id"].iloc[0])
        return out

    none = F.lit(None).cast("double")
    both = rr.select("session_id", "t_s", "rr_ms", none.alias("amplitude")).union(beats.select("session_id", "t_s", none, "amplitude"))
    return both.groupBy("session_id").applyInPandas(run, "session_id long, k long, start_s double, end_s double, hr_bpm double, rate_brpm double, amplitude_brpm double")


def gated(windows_: DataFrame, segments: DataFrame, length: float | None = None) -> DataFrame:
    """Adds excluded_fraction (the part of ``length`` seconds, or of a window from its start to its end, under excluded segments), gate (null, or what a window failed) and brpm (the mean of both channels where it passed)."""
    # a pair is taken in the first bucket that both touch, so its overlap is one difference, and a window's are added in order of time
    w = bucketed(windows_, F.col("start_s"), F.col("end_s"), WINDOW_S)
    s = bucketed(segments.select("session_id", F.col("start_s").alias("_s"), F.col("end_s").alias("_e")), F.col("_s"), F.col("_e"), WINDOW_S)
    inside = F.least("end_s", "_e") - F.greatest("start_s", "_s")
    pairs = w.join(s, ["session_id", "bucket"]).where(F.col("bucket") == F.floor(F.greatest("start_s", "_s") / WINDOW_S))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_s", "_e", F.greatest(F.lit(0.0), inside).alias("x")))), lambda p: p["x"])
    over = pairs.groupBy("session_id", "k").agg(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).alias("_over"))
    share = F.coalesce(F.col("_over"), F.lit(0.0)) / (F.greatest(F.col("end_s") - F.col("start_s"), F.lit(1e-9)) if length is None else F.lit(length))
    gate = (
        F.when(F.col("excluded_fraction") > MOST_EXCLUDED, "excluded signal")
        .when(F.col("hr_bpm") > MOST_HR, "heart rate")
        .when(F.col("rate_brpm").isNull() | F.col("amplitude_brpm").isNull(), "no frequency")
        .when(F.abs(F.col("rate_brpm") - F.col("amplitude_brpm")) > AGREEMENT, "channels differ")
    )
    out = windows_.join(over, ["session_id", "k"], "left").withColumn("excluded_fraction", share).drop("_over").withColumn("gate", gate)
    return out.withColumn("brpm", F.when(F.col("gate").isNull(), (F.col("rate_brpm") + F.col("amplitude_brpm")) / 2))


def summary(gated_: DataFrame) -> DataFrame:
    """A row for each session with windows: n_windows, n_used, median, 5th and 95th percentile, paced and paced_brpm; no numbers under five used windows.

    Paced: at least three used windows in a row breathe 4.5 to 7.5 times a minute; the longest such run (the first of equals) gives the rate.
    """
    used = gated_.where(F.col("gate").isNull())
    slow = used.withColumn("_slow", F.col("brpm").between(*PACED))
    runs = islands(slow, F.col("_slow") != F.coalesce(F.lag("_slow").over(by_session("start_s")), ~F.col("_slow")), ["start_s"]).where("_slow")
    runs = runs.groupBy("session_id", "run_id").agg(F.count("*").alias("n"), F.percentile("brpm", F.lit(0.5)).alias("rate")).where(F.col("n") >= PACED_RUN)
    longest = runs.groupBy("session_id").agg(F.max_by("rate", F.struct("n", -F.col("run_id"))).alias("_rate"))
    p = lambda q: F.percentile("brpm", F.lit(q))
    out = gated_.groupBy("session_id").agg(F.count("*").alias("n_windows"), F.count_if(F.col("gate").isNull()).alias("n_used"), p(0.5).alias("_m"), p(0.05).alias("_lo"), p(0.95).alias("_hi"))
    enough = F.col("n_used") >= LEAST_WINDOWS
    out = out.join(longest, "session_id", "left")
    numbers = [F.when(enough, F.col(a)).alias(b) for a, b in (("_m", "median_brpm"), ("_lo", "p5_brpm"), ("_hi", "p95_brpm"))]
    return out.select("session_id", "n_windows", "n_used", *numbers, (enough & F.col("_rate").isNotNull()).alias("paced"), F.when(enough, F.col("_rate")).alias("paced_brpm"))


def respiration(rr: DataFrame, beats: DataFrame, segments: DataFrame) -> DataFrame:
    """Breathing of recordings with intervals, beats with amplitudes, and excluded segments."""
    return summary(gated(windows(rr, beats), segments))
