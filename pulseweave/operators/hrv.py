"""Heart-rate variability of interval series (session_id, n, t_s, rr_ms, discontinuity)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import anchored, by_session, differences, sliding


def time_domain(rr: DataFrame) -> DataFrame:
    """Beats, mean RR and HR (60000 / mean RR), SDNN, RMSSD and pNN50 over contiguous pairs, SD1/SD2 with at least ten pairs."""
    d = differences(rr)
    some = F.count("d_ms") >= 10
    half = 0.5 * F.var_samp("d_ms")
    sd1, sd2 = F.sqrt(half), F.sqrt(F.greatest(F.lit(0.0), 2 * F.var_samp("rr_ms") - half))
    return d.groupBy("session_id").agg(
        F.count("*").alias("n_beats"),
        F.count_if("discontinuity").alias("n_seams"),
        F.avg("rr_ms").alias("mean_rr_ms"),
        (60000.0 / F.avg("rr_ms")).alias("mean_hr_bpm"),
        F.stddev_samp("rr_ms").alias("sdnn_ms"),
        F.sqrt(F.avg(F.col("d_ms") * F.col("d_ms"))).alias("rmssd_ms"),
        F.avg(F.when(F.col("d_ms").isNotNull(), F.when(F.abs("d_ms") > 50, 100.0).otherwise(0.0))).alias("pnn50_pct"),
        F.when(some, sd1).alias("sd1_ms"),
        F.when(some, sd2).alias("sd2_ms"),
        F.when(some & (sd2 > 0), sd1 / sd2).alias("sd1_sd2_ratio"),
    )


def windowed_sdnn(rr: DataFrame, width: float = 60.0, least: int = 10) -> DataFrame:
    return anchored(rr, width).groupBy("session_id", "window").agg(F.stddev_samp("rr_ms").alias("sdnn_ms"), F.count("*").alias("n")).where(F.col("n") >= least)


def per_minute_hr(rr: DataFrame, width: float = 60.0, least: int = 10) -> DataFrame:
    return anchored(rr, width).groupBy("session_id", "window").agg((60000.0 / F.avg("rr_ms")).alias("hr_bpm"), F.count("*").alias("n")).where(F.col("n") >= least)


def per_minute_rmssd(rr: DataFrame, width: float = 60.0, least: int = 10) -> DataFrame:
    """Differences count in the minute of their ending beat, if both beats are in it."""
    d = anchored(differences(rr), width)
    d = d.withColumn("d_ms", F.when(F.lag("window").over(by_session("n")) == F.col("window"), F.col("d_ms")))
    return d.groupBy("session_id", "window").agg(F.sqrt(F.avg(F.col("d_ms") * F.col("d_ms"))).alias("rmssd_ms"), F.count("d_ms").alias("n")).where(F.col("n") >= least)


def sustained_hr(rr: DataFrame, width: float = 45.0, step: float = 5.0, least: int = 10) -> DataFrame:
    """Mean HR in sliding windows anchored at the first beat; intervals are added up in their order, on which a mean at a limit depends."""
    return sliding(rr, width, step, order="n").groupBy("session_id", "window", "window_start_s").agg((60000.0 / F.avg("rr_ms")).alias("hr_bpm"), F.count("*").alias("n")).where(F.col("n") >= least)


def lowest_sustained_hr(rr: DataFrame) -> DataFrame:
    """The least mean HR of 60 s windows every 10 s, of sessions with at least 20 intervals."""
    n = rr.withColumn("_n", F.count("*").over(Window.partitionBy("session_id"))).where("_n >= 20").drop("_n")
    return sustained_hr(n, 60.0, 10.0).groupBy("session_id").agg(F.min("hr_bpm").alias("lowest_hr_bpm"))


def poincare_pairs(rr: DataFrame) -> DataFrame:
    """Contiguous pairs of intervals."""
    w = by_session("n")
    return rr.select("session_id", "n", "rr_ms", F.lead("rr_ms").over(w).alias("next_ms"), F.lead("discontinuity").over(w).alias("_s")).where(~F.col("_s")).drop("_s")


def prematurity(rr_all: DataFrame) -> DataFrame:
    """session_id, n, prematurity_pct: 100 (rr - median) / median of the five intervals on either side; null with under three."""
    w = by_session("n")
    around = F.concat(F.collect_list("rr_ms").over(w.rowsBetween(-5, -1)), F.collect_list("rr_ms").over(w.rowsBetween(1, 5)))
    return rr_all.withColumn("_a", F.array_sort(around)).select("session_id", "n", _relative().alias("prematurity_pct"))


def _relative():
    k = F.size("_a")
    mid = (F.element_at("_a", F.floor((k + 1) / 2).cast("int")) + F.element_at("_a", F.floor((k + 2) / 2).cast("int"))) / 2
    return F.when((k >= 3) & (mid > 0), 100.0 * (F.col("rr_ms") - mid) / mid)


def rolling_peak(rr: DataFrame, width: float = 30.0, least: int = 5, intervals: int = 10) -> DataFrame:
    """The highest mean HR of the ``width`` seconds that begin at a beat, and the last beat of all such windows within 1 bpm of it; for sessions of at least ``intervals``."""
    all_, w = Window.partitionBy("session_id"), Window.partitionBy("session_id").orderBy(F.round(F.col("t_s") * 100000).cast("long")).rangeBetween(0, int(width * 100000) - 1)
    r = rr.select("session_id", (60000.0 / F.avg("rr_ms").over(w)).alias("hr"), F.count("*").over(w).alias("n"), F.max("t_s").over(w).alias("end_s"), F.count("*").over(all_).alias("_all"))
    r = r.where((F.col("n") >= least) & (F.col("_all") >= intervals)).withColumn("peak", F.max("hr").over(all_))
    return r.groupBy("session_id").agg(F.max("peak").alias("peak_hr_bpm"), F.max(F.when(F.col("hr") >= F.col("peak") - 1.0, F.col("end_s"))).alias("peak_end_s"))


def histogram(rr: DataFrame, bins: int = 40) -> DataFrame:
    """Counts in equal bins between least and greatest; the last bin is closed."""
    w = Window.partitionBy("session_id")
    b = rr.withColumns({"_lo": F.min("rr_ms").over(w), "_hi": F.max("rr_ms").over(w)})
    width = (F.col("_hi") - F.col("_lo")) / bins
    k = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("rr_ms") - F.col("_lo")) / width), F.lit(bins - 1)))
    return b.withColumn("bin", k.cast("long")).groupBy("session_id", "bin").agg(F.count("*").alias("n"))


def contiguous_entropy_windows(rr: DataFrame, length: int = 30, step: int = 5) -> DataFrame:
    """Windows of ``length`` intervals every ``step``: session_id, k, rr (array), has_seam (inside), cv."""
    w = by_session("n")
    d = rr.withColumns(
        {
            "i": F.row_number().over(w) - 1,
            "rr": F.collect_list("rr_ms").over(w.rowsBetween(0, length - 1)),
            "has_seam": F.coalesce(F.max(F.col("discontinuity").cast("int")).over(w.rowsBetween(1, length - 1)) == 1, F.lit(False)),
        }
    ).where((F.col("i") % step == 0) & (F.size("rr") == length))
    mean = F.aggregate("rr", F.lit(0.0), lambda a, x: a + x) / length
    sd = F.sqrt(F.aggregate("rr", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / (length - 1))
    return d.select("session_id", (F.col("i") / step).cast("long").alias("k"), F.col("t_s").alias("start_s"), "rr", "has_seam", mean.alias("mean")).withColumn("sd", sd).withColumn("cv", F.col("sd") / F.col("mean"))


def _matches(rr: pd.Series, limit: pd.Series) -> pd.DataFrame:
    """Pairs of values of a window closer than its limit, and those whose successors are so too."""
    one, two = np.zeros(len(rr), dtype=np.int64), np.zeros(len(rr), dtype=np.int64)
    lengths = rr.map(len).to_numpy()
    for n in np.unique(lengths[lengths > 1]):
        rows, pairs = np.flatnonzero(lengths == n), np.triu_indices(n, 1)
        for some in np.array_split(rows, -(-len(rows) // 1024)):
            x = np.stack(rr.iloc[some].to_numpy())
            near = np.abs(x[:, :, None] - x[:, None, :]) < limit.to_numpy()[some, None, None]
            one[some] = near[:, pairs[0], pairs[1]].sum(axis=1)
            both = near[:, :-1, :-1] & near[:, 1:, 1:]
            at = np.triu_indices(n - 1, 1)
            two[some] = both[:, at[0], at[1]].sum(axis=1)
    return pd.DataFrame({"one": one, "two": two})


def cosen(windows: DataFrame) -> DataFrame:
    """Coefficient of sample entropy of each window: SampEn(1, 0.2 sd) + ln(2r) - ln(mean); null without spread or matches.

    The pairs of a window are counted as matrices in Arrow batches.
    """
    r = 0.2 * F.col("sd")
    w = windows.withColumn("_m", F.pandas_udf(_matches, "one long, two long")("rr", r))
    ok = (F.col("sd") > 0) & (F.col("_m.two") > 0) & (F.col("_m.one") > 0)
    value = -F.log(F.col("_m.two") / F.col("_m.one")) + F.log(2 * r) - F.log("mean")
    return w.withColumn("cosen", F.when(ok, value)).drop("_m")
