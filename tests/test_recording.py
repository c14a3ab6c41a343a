"""Recordings from samples to metrics, held against a recording whose intervals are known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseweave.functions import kernels as K
from pulseweave.operators import quality, recording, series, spectral

RATE = 130.03
# Fixed values of the fixture: place in s, height in mV and width in s of the waves P, Q, R, S, T.
WAVES = ((-0.170, 0.08, 0.030), (-0.030, -0.08, 0.012), (0.000, 0.60, 0.012), (0.035, -0.15, 0.012), (0.250, 0.22, 0.060))


@pytest.fixture(scope="module")
def known():
    """Times, values and R times of a seeded recording of 300 s: 800 ms, a swing of 30 ms at 0.1 Hz, jitter of 10 ms."""
    g, rr, t = np.random.default_rng(42), [], 0.0
    while t < 300:
        rr.append(800 + 30 * math.sin(2 * math.pi * 0.1 * t) + g.normal(0, 10))
        t += rr[-1] / 1000
    at = np.concatenate(([0.5], 0.5 + np.cumsum(rr) / 1000))
    n = int((at[-1] + 1) * RATE)
    t, x = np.arange(n) / RATE, np.random.default_rng(43).normal(0, 0.01, n)
    for b in at:
        a, e = max(0, int((b - 0.4) * RATE)), min(n, int((b + 0.5) * RATE))
        x[a:e] += sum(h * np.exp(-0.5 * ((t[a:e] - b - c) / w) ** 2) for c, h, w in WAVES)
    return t, np.round(x, 4), at


def frame(spark, t, x, session=1):
    return spark.createDataFrame([(session, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, x, strict=True))], "session_id long, i long, t_s double, x double")


def test_known_recording(spark, known):
    r = recording.process(frame(spark, *known[:2]), RATE)
    assert r.segments.count() == 0
    m = recording.variability(r).first()
    assert m.n_beats == 376
    for name, value, tolerance in (
        ("mean_rr_ms", 799.53, 0.005), ("mean_hr_bpm", 75.04, 0.005), ("sdnn_ms", 23.78, 0.005), ("rmssd_ms", 17.74, 0.005), ("pnn50_pct", 0.53, 0.005), ("sd1_ms", 12.56, 0.005), ("sd2_ms", 31.20, 0.005),
        ("lf", 520.18, 0.01), ("hf", 47.57, 0.01), ("lf_hf", 10.93, 0.005), ("lf_peak_hz", 0.10, 0.005), ("sampen", 2.07, 0.005), ("dfa_alpha1", 1.34, 0.006), ("pct_corrected", 0.27, 0.01),
    ):
        assert abs(m[name] - value) <= tolerance, (name, m[name])
    assert not m.reduced_confidence


def test_outage_is_excluded_as_a_whole(spark, known):
    t, x, _ = known
    keep = (t < 60.2) | (t > 83.1)
    r = recording.process(frame(spark, t[keep], x[keep]), RATE)
    got = r.segments.collect()
    assert [(s.start_s, s.end_s) for s in got] == [(60.0, 85.0)] and "gap" in got[0].reasons
    total = quality.totals(r.segments, spark.createDataFrame([(1, float(t[-1] - t[0]))], "session_id long, duration_s double")).first()
    assert total.excluded_s == 25.0 and abs(total.analysed_s - (t[-1] - 25.0)) < 1e-6
    assert r.windows.count() == math.ceil(t[-1] / 5) and r.windows.where("n < 2").count() == 3
    assert series.overlap_join(r.rr.select("session_id", (F.col("t_s") - F.col("rr_ms") / 1000).alias("start_s"), F.col("t_s").alias("end_s")), r.segments, "left_semi").count() == 0


def test_filters_by_blocks_equal_the_recursion():
    g = np.random.default_rng(3)
    for sos in (K.butterworth(2, 0.7, RATE, "low"), K.butterworth(5, 0.5, RATE, "high"), K.butterworth(4, (0.25, 3.0), 50.0, "band")):
        for n in (50, 5000, 40000):
            x = g.standard_normal(n).cumsum()
            assert np.allclose(K._filter(sos, x, 0.0), K._sections(sos, x), atol=1e-7)
            # a constant past is the same as many samples of it
            long = K._sections(sos, np.concatenate([np.full(20000, x[0]), x]))[20000:]
            assert np.allclose(K._filter(sos, x, x[0]), long, atol=1e-6)


def test_gravity_and_movement(spark):
    t = np.arange(0, 120, 1 / 50.0)
    shake = np.where((t >= 60) & (t < 90), 200 * np.sin(2 * np.pi * 1.5 * t), 0.0)
    rows = [(1, i, float(a), 120.0, 0.0, 990.0 + float(s)) for i, (a, s) in enumerate(zip(t, shake, strict=True))]
    e = recording.movement_epochs(spark.createDataFrame(rows, "session_id long, i long, t_s double, x double, y double, z double"), 50.0).orderBy("epoch").collect()
    assert len(e) == 4 and e[2].counts > 50 * max(e[0].counts, 1e-3) and all(abs(r.gx - 120) < 1 and abs(r.gz - 990) < 5 for r in e)


def test_recovery_follows_the_last_beat_of_the_peak(spark):
    """A steady rate that falls by a known curve: the peak ends with its last beat, the time constant is found within its bounds."""
    t, rows, n = 0.0, [], 0
    while t < 400:
        hr = 150.0 if t < 60 else 80 + 70 * math.exp(-(t - 60) / 45.0)
        t += 60 / hr
        rows.append((1, n, t, 60000 / hr, False))
        n += 1
    from pulseweave.operators import activity, hrv

    rr = spark.createDataFrame(rows, "session_id long, n long, t_s double, rr_ms double, discontinuity boolean")
    peak = hrv.rolling_peak(rr)
    p = peak.first()
    assert abs(p.peak_hr_bpm - 150) < 0.5 and p.peak_end_s in [r[2] for r in rows] and 59 < p.peak_end_s < 70
    want = 150 - (80 + 70 * math.exp(-p.peak_end_s / 45.0))
    assert abs(activity.recovery(rr, peak).first().hrr60 - want) < 5
    assert abs(spectral.recovery_tau(rr, peak).first().tau_s - 45) < 3
    few = rr.where("n < 9")
    assert hrv.rolling_peak(few).count() == 0
    steady = spark.createDataFrame([(1, i, 0.8 * (i + 1), 800.0, False) for i in range(60)], rr.schema)
    assert abs(hrv.rolling_peak(steady).first().peak_end_s - 48.0) < 1e-9
    assert spectral.recovery_tau(rr.where("t_s < 100"), peak).first().tau_s is None


def test_correction_of_known_artifacts():
    g = np.random.default_rng(5)
    t = np.cumsum(0.8 + 0.01 * g.standard_normal(200))
    early = t.copy()
    early[100] -= 0.25  # a premature beat
    found = K.artifacts(early)
    assert {100, 101} <= set(found["ectopic"]) | set(found["longshort"]) and abs(K.corrected_peaks(early)[100] - t[100]) < 0.03
    extra = np.sort(np.append(t, t[60] + 0.3))
    assert len(K.corrected_peaks(extra)) == 200 and len(K.artifacts(extra)["extra"]) == 1
    missed = np.delete(t, 140)
    assert len(K.artifacts(missed)["missed"]) == 1 and len(K.corrected_peaks(missed)) == 200
    assert not sum(map(len, K.artifacts(t[:3]).values()))


def test_the_second_detector_serves_where_the_first_finds_too_few(spark, known):
    t, x, at = known
    t, x = t[: int(120 * RATE)], x[: int(120 * RATE)]
    at = at[(at > 1) & (at < 119)]
    hum = x + 1.2 * np.sin(2 * np.pi * 29.0 * t)  # as steep as the beats all the time
    assert len(K.r_peaks(K.clean_ecg(hum, RATE), RATE)) < 10
    _, peaks, engine, reason = K.detect(hum, RATE)
    assert engine == "adaptive" and reason.startswith("slope: only")
    found = peaks / RATE
    assert all(np.abs(found - b).min() < 0.03 for b in at) and abs(len(found) - len(at)) <= 4
    # both agree on a clean recording; a long pause is searched again
    _, clean, engine, reason = K.detect(x, RATE)
    assert engine == "slope" and reason is None
    band, second = K.adaptive_r_peaks(x, RATE)
    assert all(np.abs(second / RATE - b).min() < 0.03 for b in at) and len(band) == len(x)
    low = x.copy()
    k = int(at[60] * RATE)
    low[k - 20 : k + 20] *= 0.62
    assert np.abs(K.adaptive_r_peaks(low, RATE)[1] / RATE - at[60]).min() < 0.03
    df = frame(spark, t, hum).union(frame(spark, t, x, 2)).union(frame(spark, t[:400], x[:400], 3)).union(frame(spark, t, 0 * x, 4))
    got = {r.session_id: r for r in recording.detection(recording.conditioned(df, RATE)).collect()}
    assert [got[k].status for k in (1, 2, 3, 4)] == ["fallback", "ok", "failed", "failed"]
    assert [got[k].engine for k in (1, 2, 3, 4)] == ["adaptive", "slope", None, None] and "adaptive: only" in got[3].reason and got[4].n_peaks == 0
    r = recording.process(df, RATE)
    assert {b.session_id for b in r.beats.select("session_id").distinct().collect()} == {1, 2}


def test_sample_entropy_by_blocks():
    g = np.random.default_rng(6)
    for n in (300, 700):
        x = np.round(g.standard_normal(n), 1)
        tol, pairs = 0.2 * x.std(ddof=1), [0, 0]
        for i in range(n - 2):
            for j in range(i):
                d = np.abs(x[i : i + 3] - x[j : j + 3])
                pairs[0] += d[:2].max() <= tol
                pairs[1] += d.max() <= tol
        assert abs(K.sample_entropy(x, block=64) + math.log(pairs[1] / pairs[0])) < 1e-12
