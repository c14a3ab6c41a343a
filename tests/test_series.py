import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseweave.operators import ectopy, hrv, posture, quality, screening, series, sleep, spectral, stats


def beats(spark, times, session=1):
    return spark.createDataFrame([(session, i, float(t)) for i, t in enumerate(times)], "session_id long, beat long, t_s double")


def segments(spark, *spans, session=1):
    return spark.createDataFrame([(session, float(a), float(b)) for a, b in spans], "session_id long, start_s double, end_s double")


def rr_of(spark, values, session=1):
    t = np.cumsum(values) / 1000.0
    return spark.createDataFrame([(session, i, float(a), float(v), False) for i, (a, v) in enumerate(zip(t, values, strict=True))], "session_id long, n long, t_s double, rr_ms double, discontinuity boolean")


def test_seams_follow_what_was_dropped(spark):
    b = beats(spark, range(30))
    rr = series.build_rr(b, segments(spark, (10, 15))).orderBy("n").collect()
    assert len(rr) == 24 and [r.t_s for r in rr if r.discontinuity] == [16.0]
    c = series.drop_counts(beats(spark, [0, 1, 1.2, 2, 5.5, 6.5]), segments(spark)).first()
    assert (c.n_kept, c.dropped_ceiling, c.dropped_floor) == (3, 1, 1)
    assert series.build_rr(beats(spark, [1.0]), segments(spark)).count() == 0


def test_time_domain_by_hand(spark):
    r = hrv.time_domain(rr_of(spark, [800.0, 860.0, 800.0, 860.0] * 4)).first()
    assert r.n_beats == 16 and math.isclose(r.mean_hr_bpm, 60000 / 830) and math.isclose(r.rmssd_ms, 60.0) and r.pnn50_pct == 100.0
    assert hrv.time_domain(rr_of(spark, [800.0, 810.0])).first().sd1_ms is None


@pytest.mark.parametrize(("make", "low", "high"), [(lambda g: 800 + g.normal(0, 2, 30), -5.4, -4.2), (lambda g: 800 + g.normal(0, 30, 30), -2.4, -1.2), (lambda g: g.uniform(450, 1250, 30), -0.4, 0.8)])
def test_entropy_anchors(spark, make, low, high):
    g = np.random.default_rng(0)
    rows = [rr_of(spark, make(g).tolist(), s) for s in range(8)]
    df = rows[0]
    for r in rows[1:]:
        df = df.union(r)
    got = [x.cosen for x in hrv.cosen(hrv.contiguous_entropy_windows(df)).collect() if x.cosen is not None]
    assert low < np.mean(got) < high
    assert hrv.cosen(hrv.contiguous_entropy_windows(rr_of(spark, [800.0] * 30))).first().cosen is None


def test_bigeminy_and_events(spark):
    b = spark.createDataFrame([(1, i) for i in (100, 102, 104, 106, 300, 301, 302)], "session_id long, beat long")
    p = ectopy.patterns(b, 2).collect()
    assert [(x.start_beat, x.end_beat, x.n_beats) for x in p] == [(100, 106, 4)]
    assert {(x.start_beat, x.kind) for x in ectopy.groups(b).collect()} == {(100, "single"), (102, "single"), (104, "single"), (106, "single"), (300, "run")}


def test_confirmation_takes_the_premature_neighbour(spark):
    f = spark.createDataFrame([(1, 9, -30.0, False), (1, 10, 5.0, False), (1, 19, -30.0, True), (1, 20, None, False)], "session_id long, beat long, prematurity_pct double, motion boolean")
    c = spark.createDataFrame([(1, 10), (1, 20)], "session_id long, beat long")
    assert [x.beat for x in ectopy.confirm(c, f).collect()] == [9]


def test_posture_vectors(spark):
    v = [("supine", 0, 0, 1000), ("prone", 0, 0, -1000), ("left", 1000, 0, 0), ("right", -1000, 0, 0), ("upright", 100, 950, 100), ("unknown", 10, 10, 10)]
    d = spark.createDataFrame([(1, i, float(x), float(y), float(z), 1.0, 0.0, 1.0, n) for i, (n, x, y, z) in enumerate(v)], "session_id long, epoch long, gx double, gy double, gz double, coverage double, counts double, threshold double, want string")
    assert posture.classify(d).where("posture <> want").count() == 0


def test_collapse_never_invents(spark):
    d = spark.createDataFrame([(s,) for s in (-1, 0, 1, 2, 3, 4)], "stage int")
    assert [r[0] for r in d.select(sleep.collapse(F.col("stage"), "aasm_5", "wldr_4")).collect()] == [-1, 0, 1, 1, 2, 3]
    with pytest.raises(ValueError):
        sleep.collapse(F.col("stage"), "wake_sleep_2", "aasm_5")


def test_viterbi_equals_the_plain_recursion(spark):
    g = np.random.default_rng(3)
    p = g.dirichlet(np.ones(4), 40)
    a, d, back = np.log(sleep.TRANSITIONS), np.log(sleep.INITIAL) + np.log(p[0]), []
    for row in p[1:]:
        c = d[:, None] + a
        back.append(c.argmax(axis=0))
        d = c.max(axis=0) + np.log(row)
    want = [int(d.argmax())]
    for b in reversed(back):
        want.insert(0, int(b[want[0]]))
    e = spark.createDataFrame([(1, i, x.tolist()) for i, x in enumerate(p)], "session_id long, epoch long, p array<double>")
    assert [r.stage for r in sleep.viterbi(e).orderBy("epoch").collect()] == want


def test_spectrum_finds_the_modulation(spark):
    t, out = 0.0, []
    while t < 300:
        v = 800 + 30 * math.sin(2 * math.pi * 0.1 * t)
        out.append(v)
        t += v / 1000
    r = spectral.frequency_domain(rr_of(spark, out)).first()
    assert abs(r.lf_peak_hz - 0.1) < 0.01 and 300 < r.lf < 600 and r.lf_hf > 5


def test_peaks_of_a_synthetic_recording(spark):
    rate, g = 130.0, np.random.default_rng(42)
    at = np.cumsum(0.8 + 0.03 * np.sin(np.arange(70) / 3)) + 0.5
    t = np.arange(0, at[-1] + 1, 1 / rate)
    x = g.normal(0, 0.01, len(t))
    for c, amp, w in ((-0.17, 0.08, 0.03), (0.0, 0.6, 0.012), (0.035, -0.15, 0.012), (0.25, 0.22, 0.06)):
        for b in at:
            x += amp * np.exp(-0.5 * ((t - b - c) / w) ** 2)
    d = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, x, strict=True))], "session_id long, i long, t_s double, x double")
    got = [r.t_s for r in spectral.detect_peaks(d, rate).orderBy("beat").collect()]
    assert sum(min(abs(p - b) for p in got) < 0.02 for b in at) >= len(at) - 1 and abs(len(got) - len(at)) <= 1
    few = spectral.detect_peaks(d.where("t_s < 3"), rate).collect()
    assert [r.status for r in few] == ["too few peaks"]


def test_rate_ratio_recovers_three(spark):
    g = np.random.default_rng(42)
    rows = [(i, "t", i % 2 == 0, int(g.poisson(30.0 if i % 2 == 0 else 10.0)), 1.0, float(g.integers(0, 24)), "a") for i in range(60)]
    d = spark.createDataFrame(rows, "session_id long, tag string, exposed boolean, ectopy_count long, hours double, hour double, comparison_key string")
    r = stats.rate_ratio(d, ["tag"]).first()
    assert r.status == "ok" and 2.4 < r.estimate < 3.7 and r.ci_low < 3 < r.ci_high
    m = stats.effects(d.drop("session_id"), ["tag"]).first()
    assert m.status in ("ok", "poisson_fallback") and 2.4 < m.estimate < 3.7
    assert stats.rate_ratio(d.where("session_id < 6"), ["tag"]).first().status == "insufficient"


def test_no_description_has_a_banned_phrase(spark):
    d = spark.createDataFrame([("This INDICATES something",), ("Longest stretch of irregular windows: 4",)], "t string")
    assert [r[0] for r in d.select(F.size(screening.banned(F.col("t")))).collect()] == [1, 0]


def test_missing_quality_never_excludes(spark):
    d = spark.createDataFrame([(1, i, i * 0.5, 0.1 * (i % 3), None, 0.01) for i in range(40)], "session_id long, i long, t_s double, x double, sqi double, wander double")
    assert quality.windows(d).where("excluded").count() == 0
