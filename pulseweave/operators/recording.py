"""From the samples of recordings to variability: filters, beats, quality, corrected intervals, metrics.

A recording is bounded (a night has some four million samples), so filters run
in one grouped function for each session, which gives the figures of its
windows and its peaks; all else is joins and windows over these small tables.
No sample is shuffled but for the grouping itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..session import written
from . import hrv, quality, series, spectral

# Cut-offs in Hz, share of corrected beats beyond which a session has reduced confidence.
WANDER_HZ, GRAVITY_HZ, MOVEMENT_HZ, REDUCED_PCT = 0.7, 0.25, (0.25, 3.0), 5.0


def conditioned(samples: DataFrame, rate: float) -> DataFrame:
    """Samples (session_id, i, t_s, x in mV) with the cleaned signal, wander (low-passed), sqi (likeness to the mean beat, null where there is none), peak (an R peak), and the recording's detector and why others failed.

    The first detector that finds ten peaks is taken; ``engine`` is null where none does.
    """

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("i")
        x = d["x"].to_numpy(float)
        clean, peaks, engine, reason = K.detect(x, rate)
        sqi = K.signal_index(clean, peaks, rate)
        at = np.zeros(len(x), dtype=bool)
        at[peaks] = True
        wander = K.zero_phase(K.butterworth(2, WANDER_HZ, rate, "low"), x) if len(x) > 1 else np.zeros(len(x))
        return d.assign(clean=clean, wander=wander, sqi=pd.Series(sqi, index=d.index).where(~np.isnan(sqi), None), peak=at, engine=engine, reason=reason)

    cols = "session_id long, i long, t_s double, x double"
    return samples.select("session_id", "i", "t_s", "x").groupBy("session_id").applyInPandas(run, f"{cols}, clean double, wander double, sqi double, peak boolean, engine string, reason string")


def _signal(d: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Times and values of one recording in order, from rows or blocks of samples."""
    place = d["i"].to_numpy()
    if len(place) > 1 and (np.diff(place) < 0).any():
        d = d.take(np.argsort(place, kind="stable"))
    values = lambda c: c.combine_chunks().flatten() if pa.types.is_list(c.type) or pa.types.is_large_list(c.type) else c
    return values(d["t_s"]).to_numpy(zero_copy_only=False).astype(float), values(d["x"]).to_numpy(zero_copy_only=False).astype(float)


def summaries(samples: DataFrame, rate: float) -> DataFrame:
    """A row for each quality window of recordings: its figures (see ``quality.judged``), its peaks (t_s, amplitude), and the recording's detector and why others failed.

    ``samples`` has session_id, i, t_s and x in mV, as rows or as blocks: then t_s
    and x are arrays of samples in order, and i is the first one's number.
    """
    peak = pa.list_(pa.struct([("t_s", pa.float64()), ("amplitude", pa.float64())]))
    kinds = {"session_id": pa.int64(), "k": pa.int64(), "start_s": pa.float64(), "end_s": pa.float64(), "n": pa.int64(), "_gap": pa.bool_(), "_clip": pa.bool_(), "_p99": pa.float64(), "_sd": pa.float64(), "_sqi": pa.float64(), "_wander": pa.float64()}

    def run(d: pa.Table) -> pa.Table:
        t, x = _signal(d)
        clean, peaks, engine, reason = K.detect(x, rate)
        wander = K.zero_phase(K.butterworth(2, WANDER_HZ, rate, "low"), x) if len(x) > 1 else np.zeros(len(x))
        f = K.window_figures(t, x, K.signal_index(clean, peaks, rate), wander, quality.WINDOW_S, quality.RAIL_MV, quality.RAIL_SHARE, quality.CLIP_RUN, quality.GAP_MEDIANS)
        count, of = len(f["k"]), f["of"][peaks]
        at = peaks[np.argsort(of, kind="stable")]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=count))])
        inside = pa.StructArray.from_arrays([pa.array(t[at]), pa.array(clean[at].astype(float))], ["t_s", "amplitude"])
        cols = [pa.array([d["session_id"][0].as_py()] * count, kinds["session_id"])]
        cols += [pa.array(f[c], kind, from_pandas=True) for c, kind in kinds.items() if c != "session_id"]
        cols += [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inside).cast(peak), pa.array([engine] * count, pa.string()), pa.array([reason] * count, pa.string())]
        return pa.Table.from_arrays(cols, names=[*kinds, "peaks", "engine", "reason"])

    cols = "session_id long, k long, start_s double, end_s double, n long, _gap boolean, _clip boolean, _p99 double, _sd double, _sqi double, _wander double"
    return samples.select("session_id", "i", "t_s", "x").groupBy("session_id").applyInArrow(run, f"{cols}, peaks array<struct<t_s:double,amplitude:double>>, engine string, reason string")


def quality_windows(samples: DataFrame, rate: float) -> DataFrame:
    """``quality.windows`` of recordings (rows or blocks of samples)."""
    return quality.judged(summaries(samples, rate))


def gravity(axes: DataFrame, rate: float) -> DataFrame:
    """Axes (session_id, i, t_s, x, y, z in mg) with their low-passed parts gx, gy, gz and the band-passed magnitude, movement."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("i")
        low = K.butterworth(4, GRAVITY_HZ, rate, "low")
        g = {f"g{c}": K.zero_phase(low, d[c].to_numpy(float)) for c in "xyz"}
        size = np.sqrt(sum(d[c].to_numpy(float) ** 2 for c in "xyz"))
        band = K.butterworth(4, (MOVEMENT_HZ[0], min(MOVEMENT_HZ[1], 0.9 * rate / 2)), rate, "band")
        return d.assign(**g, movement=np.abs(K.zero_phase(band, size)))

    cols = "session_id long, i long, t_s double, x double, y double, z double"
    return axes.select("session_id", "i", "t_s", "x", "y", "z").groupBy("session_id").applyInPandas(run, f"{cols}, gx double, gy double, gz double, movement double")


def movement_epochs(axes: DataFrame, rate: float, epoch_s: float = 30.0, offset_s: float = 0.0, least: float = 0.5) -> DataFrame:
    """session_id, epoch, counts, coverage, gx, gy, gz of ``gravity``'s rows on the clock of another stream, ``offset_s`` behind it; counts are null under ``least`` of an epoch."""
    e = gravity(axes, rate).withColumn("epoch", F.floor((F.col("t_s") + offset_s) / epoch_s).cast("long")).where("epoch >= 0")
    e = e.groupBy("session_id", "epoch").agg((F.sum("movement") / rate).alias("counts"), (F.count("*") / (rate * epoch_s)).alias("coverage"), *[F.avg(c).alias(c) for c in ("gx", "gy", "gz")])
    return e.withColumn("counts", F.when(F.col("coverage") >= least, F.col("counts")))


@dataclass
class Recording:
    """windows and segments of quality, raw beats (with amplitude), corrected beats, intervals (rr), and a row for each session: correction, detection."""

    windows: DataFrame
    segments: DataFrame
    beats: DataFrame
    corrected: DataFrame
    rr: DataFrame
    correction: DataFrame
    detection: DataFrame


def correction(beats: DataFrame) -> DataFrame:
    """Raw beats (session_id, beat, t_s) as rows of kind raw, with class (normal, ectopic, missed, extra, longshort: the first that holds), and corrected ones of kind corrected.

    The raw beats are classified once; the corrected ones come from a repeated correction.
    """

    def run(d: pd.DataFrame) -> pd.DataFrame:
        t = d.sort_values("beat")["t_s"].to_numpy(float)
        kind = np.full(len(t), "normal", dtype=object)
        for name, at in reversed(K.artifacts(t).items()):
            kind[at] = name
        fixed = K.corrected_peaks(t)
        raw = pd.DataFrame({"kind": "raw", "beat": np.arange(len(t)), "t_s": t, "class": kind})
        out = pd.concat([raw, pd.DataFrame({"kind": "corrected", "beat": np.arange(len(fixed)), "t_s": fixed, "class": None})])
        return out.assign(session_id=d["session_id"].iloc[0])[["session_id", "kind", "beat", "t_s", "class"]]

    return beats.select("session_id", "beat", "t_s").groupBy("session_id").applyInPandas(run, "session_id long, kind string, beat long, t_s double, class string")


def correction_summary(classified: DataFrame) -> DataFrame:
    """session_id, a count for each class, pct_corrected (beats in any class, of all) and reduced_confidence."""
    names = ("ectopic", "missed", "extra", "longshort")
    out = classified.groupBy("session_id").agg(*[F.count_if(F.col("class") == c).alias(c) for c in names], (100.0 * F.count_if(F.col("class") != "normal") / F.count("*")).alias("pct_corrected"))
    return out.withColumn("reduced_confidence", F.col("pct_corrected") > REDUCED_PCT)


def process(samples: DataFrame, rate: float) -> Recording:
    """The tables of recordings (session_id, i, t_s, x, as rows or blocks).  The figures of windows and corrected beats are written once, for all that reads them."""
    d = written(summaries(samples, rate), "windows")
    windows = quality.judged(d)
    segments = quality.merge_excluded(windows)
    peaks = d.select("session_id", "k", F.posexplode("peaks").alias("place", "peak"))
    order = series.by_session("k", "place")
    beats = peaks.select("session_id", (F.row_number().over(order) - 1).cast("long").alias("beat"), "peak.t_s", "peak.amplitude")
    both = written(correction(beats), "beats")
    corrected = both.where("kind = 'corrected'").select("session_id", "beat", "t_s")
    return Recording(windows, segments, beats, corrected, series.build_rr(corrected, segments), correction_summary(both.where("kind = 'raw'")), detection(d))


def detection(found: DataFrame) -> DataFrame:
    """From ``summaries`` or ``conditioned``: session_id, status (ok, fallback or failed), engine, reason, n_peaks: which detector served a recording, and why not an earlier one."""
    status = F.when(F.col("engine").isNull(), "failed").when(F.col("reason").isNotNull(), "fallback").otherwise("ok")
    n = F.sum(F.size("peaks")) if "peaks" in found.columns else F.count_if("peak")
    found = found.groupBy("session_id").agg(F.max("engine").alias("engine"), F.max("reason").alias("reason"), n.alias("n_peaks"))
    return found.select("session_id", status.alias("status"), "engine", "reason", "n_peaks")


def variability(r: Recording) -> DataFrame:
    """A row for each session with intervals: time, frequency and nonlinear metrics, correction and reduced confidence."""
    out = hrv.time_domain(r.rr).join(spectral.frequency_domain(r.rr), "session_id", "left").join(spectral.nonlinear(r.rr), "session_id", "left")
    return out.join(r.correction.select("session_id", "pct_corrected", "reduced_confidence"), "session_id", "left")
