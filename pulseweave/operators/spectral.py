"""Spectra, entropy, scaling, peaks and artifact classes: one session (bounded to a recording) in one grouped function.

A session that cannot be computed gives a row with a status, not an exception.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .series import by_session

# Bands in Hz, resampling rate, shortest run of a spectrum in s.
BANDS = {"vlf": (0.0033, 0.04), "lf": (0.04, 0.15), "hf": (0.15, 0.40)}
RATE, SHORTEST_RUN_S, SEGMENT = 4.0, 120.0, 1024


def _runs(d: pd.DataFrame, shortest: float) -> list[tuple[np.ndarray, np.ndarray]]:
    cut = np.flatnonzero(d["discontinuity"].to_numpy(bool))
    t, r = d["t_s"].to_numpy(), d["rr_ms"].to_numpy()
    parts = zip(np.split(t, cut), np.split(r, cut), strict=True)
    return [(a, b) for a, b in parts if len(a) >= 4 and a[-1] - a[0] >= shortest]


def frequency_domain(rr: DataFrame, shortest: float = SHORTEST_RUN_S) -> DataFrame:
    """Band powers (ms2), LF/HF and LF peak: Welch over spline-resampled contiguous runs, averaged by duration."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("n")
        out = {"session_id": d["session_id"].iloc[0], "n_runs": 0, "vlf": None, "lf": None, "hf": None, "lf_hf": None, "lf_peak_hz": None}
        even = []
        for t, r in _runs(d, shortest):
            at = np.arange(t[0], t[-1], 1 / RATE)
            x = K.spline(t, r, at)
            even.append((t[-1] - t[0], x - x.mean()))
        if even:
            # one segment length for all runs, so that their spectra share frequencies
            segment = min(SEGMENT, int(min(s for s, _ in even) * RATE))
            spectra = [K.welch(x, RATE, segment) for _, x in even]
            f, weight = spectra[0][0], np.array([s for s, _ in even])
            p = (np.stack([q for _, q in spectra]) * weight[:, None]).sum(axis=0) / weight.sum()
            power = {k: K.band(f, p, *b) for k, b in BANDS.items()}
            inside = (f >= BANDS["lf"][0]) & (f < BANDS["lf"][1])
            out |= power | {"n_runs": len(even), "lf_hf": power["lf"] / power["hf"] if power["hf"] > 0 else None, "lf_peak_hz": float(f[inside][p[inside].argmax()]) if inside.any() else None}
        return pd.DataFrame([out])

    return rr.groupBy("session_id").applyInPandas(run, "session_id long, n_runs long, vlf double, lf double, hf double, lf_hf double, lf_peak_hz double")


def nonlinear(rr: DataFrame, least: int = 100) -> DataFrame:
    """Sample entropy (m 2, r 0.2 sd) and the short-term scaling exponent of sessions with at least ``least`` intervals."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        x = d.sort_values("n")["rr_ms"].to_numpy()
        ok = len(x) >= least
        return pd.DataFrame([{"session_id": d["session_id"].iloc[0], "sampen": K.sample_entropy(x) if ok else None, "dfa_alpha1": K.dfa(x) if ok else None}])

    return rr.groupBy("session_id").applyInPandas(run, "session_id long, sampen double, dfa_alpha1 double")


def band_powers(rr: DataFrame, bands: dict[str, tuple[float, float]], epoch_s: float = 30.0) -> DataFrame:
    """Mean power of the interval series in each band (a column) by epoch, over runs of 50 s or more; the series is resampled once for all bands."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        filters, at, power = {k: K.butterworth(4, b, RATE, "band") for k, b in bands.items()}, [], {k: [] for k in bands}
        for t, r in _runs(d.sort_values("n"), 50.0):
            grid = np.arange(t[0], t[-1], 1 / RATE)
            if len(grid) >= 40:
                x = K.spline(t, r, grid)
                at.append(grid)
                for k, sos in filters.items():
                    power[k].append(K.zero_phase(sos, x - x.mean()) ** 2)
        if not at:
            return pd.DataFrame({"session_id": pd.Series(dtype="int64"), "epoch": pd.Series(dtype="int64"), **{k: pd.Series(dtype="float64") for k in bands}})
        e = pd.DataFrame({"epoch": np.floor(np.concatenate(at) / epoch_s).astype("int64"), **{k: np.concatenate(v) for k, v in power.items()}}).groupby("epoch", as_index=False).mean()
        return e.assign(session_id=d["session_id"].iloc[0])[["session_id", "epoch", *bands]]

    return rr.groupBy("session_id").applyInPandas(run, "session_id long, epoch long, " + ", ".join(f"{k} double" for k in bands))


def band_power_epochs(rr: DataFrame, low: float, high: float, epoch_s: float = 30.0) -> DataFrame:
    """``band_powers`` of one band, as power."""
    return band_powers(rr, {"power": (low, high)}, epoch_s)


def detect_peaks(samples: DataFrame, rate: float) -> DataFrame:
    """session_id, beat, sample, t_s, engine, status, reason: R peaks of samples (session_id, i, t_s, x) by the first detector that finds ten; where none does, one row tells why."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("i")
        _, p, engine, reason = K.detect(d["x"].to_numpy(float), rate)
        if engine is None:
            return pd.DataFrame([{"session_id": d["session_id"].iloc[0], "beat": None, "sample": None, "t_s": None, "engine": None, "status": "too few peaks", "reason": reason}])
        return pd.DataFrame({"session_id": d["session_id"].iloc[0], "beat": np.arange(len(p)), "sample": p, "t_s": d["t_s"].to_numpy()[p], "engine": engine, "status": "ok" if reason is None else "fallback", "reason": reason})

    return samples.groupBy("session_id").applyInPandas(run, "session_id long, beat long, sample long, t_s double, engine string, status string, reason string")


def artifact_classes(rr_all: DataFrame) -> DataFrame:
    """Adds class (ectopic, missed, extra, longshort or normal) to (session_id, n, rr_ms), after Lipponen and Tarvainen (2019).

    Thresholds are 5.2 quartile deviations of the differences, and of the
    deviations from the running median, over 91 beats.
    """
    w = by_session("n")
    wide, med = w.rowsBetween(-45, 45), w.rowsBetween(-5, 5)
    quartiles = lambda c: 5.2 * (F.percentile(F.abs(F.col(c)), F.lit(0.75)).over(wide) - F.percentile(F.abs(F.col(c)), F.lit(0.25)).over(wide)) / 2
    d = rr_all.withColumns({"_d": F.col("rr_ms") - F.lag("rr_ms").over(w), "_med": F.percentile("rr_ms", F.lit(0.5)).over(med)}).withColumn("_m", F.col("rr_ms") - F.col("_med"))
    d = d.withColumn("_m", F.when(F.col("_m") < 0, 2 * F.col("_m")).otherwise(F.col("_m")))
    d = d.withColumns({"_t1": quartiles("_d"), "_t2": quartiles("_m")})
    d = d.withColumns({"_d": F.when(F.col("_t1") > 0, F.col("_d") / F.col("_t1")), "_m": F.when(F.col("_t2") > 0, F.col("_m") / F.col("_t2"))})
    around = F.array(F.lag("_d").over(w), F.lead("_d").over(w))
    d = d.withColumns({"_s12": F.when(F.col("_d") > 0, F.array_max(around)).otherwise(F.array_min(around)), "_n1": F.lead("_d").over(w), "_next": F.lead("rr_ms").over(w)})
    ectopic = ((F.col("_d") > 1) & (F.col("_s12") < -0.13 * F.col("_d") - 0.17)) | ((F.col("_d") < -1) & (F.col("_s12") > -0.13 * F.col("_d") + 0.17))
    odd = (F.abs("_d") > 1) | (F.abs("_m") > 3)
    missed = F.abs(F.col("rr_ms") / 2 - F.col("_med")) < F.col("_t2")
    extra = F.abs(F.col("rr_ms") + F.col("_next") - F.col("_med")) < F.col("_t2")
    c = F.when(ectopic, "ectopic").when(odd & (F.col("_m") > 3) & missed, "missed").when(odd & (F.col("_m") < -1) & extra, "extra").when(odd, "longshort").otherwise("normal")
    return d.select("session_id", "n", "rr_ms", c.alias("class"))


def correct(classified: DataFrame) -> DataFrame:
    """n, rr_ms, corrected: a missed interval becomes two halves, an extra one joins its successor, others are replaced by the mean of normal neighbours."""
    w = by_session("n")
    ok = F.when(F.col("class") == "normal", F.col("rr_ms"))
    before, after = F.last(ok, True).over(w.rowsBetween(-2**31, -1)), F.first(ok, True).over(w.rowsBetween(1, 2**31 - 1))
    mid = (F.coalesce(before, after) + F.coalesce(after, before)) / 2
    d = classified.withColumns({"_mid": mid, "_prev": F.lag("class").over(w), "_prev_rr": F.lag("rr_ms").over(w)}).where("class <> 'extra' OR class IS NULL")
    value = F.when(F.col("_prev") == "extra", F.col("rr_ms") + F.col("_prev_rr")).when(F.col("class").isin("ectopic", "longshort"), F.coalesce("_mid", F.col("rr_ms"))).otherwise(F.col("rr_ms"))
    parts = F.when(F.col("class") == "missed", F.array(value / 2, value / 2)).otherwise(F.array(value))
    return d.select("session_id", "n", F.posexplode(parts).alias("part", "rr_ms"), ((F.col("class") != "normal") | (F.coalesce("_prev", F.lit("")) == "extra")).alias("corrected"))


def recovery_tau(rr: DataFrame, peaks: DataFrame) -> DataFrame:
    """Time constant of the rate's fall after its peak (peaks: session_id, peak_end_s)."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d[d["t_s"] >= d["peak_end_s"]].sort_values("n") if len(d) else d
        tau = K.recovery_tau(d["t_s"].to_numpy(), 60000.0 / d["rr_ms"].to_numpy()) if len(d) else None
        return pd.DataFrame([{"session_id": d["session_id"].iloc[0] if len(d) else None, "tau_s": tau}])

    return rr.join(peaks.select("session_id", "peak_end_s"), "session_id").groupBy("session_id").applyInPandas(run, "session_id long, tau_s double").where("session_id IS NOT NULL")


def device_agreement(pairs: DataFrame, limit: float = 50.0) -> DataFrame:
    """Mean absolute difference of our interval and the nearest device value, and the share within ``limit`` ms."""
    d = F.abs(F.col("rr_ms") - F.col("nearest_value"))
    return pairs.groupBy("session_id").agg(F.count("*").alias("n"), F.avg(d).alias("mean_abs_ms"), (100.0 * F.avg((d <= limit).cast("double"))).alias("within_pct"))
