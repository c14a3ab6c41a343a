"""Breathing from two channels, with a known rate."""

import math

import pytest

from pulseweave.operators import respiration as R

SEG = "session_id long, start_s double, end_s double, reasons array<string>"


def recording(spark, session, brpm, other=None, seconds=420, hr=65.0):
    """Intervals that swing with the breath, R peaks that swing with it too (or with another rate)."""
    t, rr, beats, n = 0.0, [], [], 0
    while t < seconds:
        v = 60000 / (hr + 5 * math.sin(2 * math.pi * brpm / 60 * t))
        t += v / 1000
        rr.append((session, n, t, v, False))
        beats.append((session, t, 1.0 + 0.1 * math.sin(2 * math.pi * (other or brpm) / 60 * t)))
        n += 1
    return spark.createDataFrame(rr, "session_id long, n long, t_s double, rr_ms double, discontinuity boolean"), spark.createDataFrame(beats, "session_id long, t_s double, amplitude double")


@pytest.mark.parametrize("brpm", [15.0, 6.0])
def test_known_rate(spark, brpm):
    rr, beats = recording(spark, 1, brpm)
    r = R.respiration(rr, beats, spark.createDataFrame([], SEG)).first()
    assert r.n_windows == r.n_used == 12 and abs(r.median_brpm - brpm) <= 1 and abs(r.p95_brpm - brpm) <= 1
    assert r.paced == (brpm == 6.0) and (not r.paced or abs(r.paced_brpm - 6) <= 1)


def test_gates(spark):
    none = spark.createDataFrame([], SEG)
    rr, beats = recording(spark, 1, 15.0, 24.0)
    w = R.gated(R.windows(rr, beats), none)
    assert {x.gate for x in w.collect()} == {"channels differ"}
    r = R.summary(w).first()
    assert (r.n_used, r.median_brpm, r.paced) == (0, None, False)
    rr, beats = recording(spark, 1, 15.0, hr=130.0)
    assert {x.gate for x in R.gated(R.windows(rr, beats), none).collect()} == {"heart rate"}
    rr, beats = recording(spark, 1, 15.0)
    start = rr.first().t_s
    cut = spark.createDataFrame([(1, start + 120.0, start + 130.0, ["gap"]), (1, start + 150.0, start + 156.0, ["gap"]), (2, 0.0, 400.0, ["gap"])], SEG)
    got = {x.k: x for x in R.gated(R.windows(rr, beats), cut).collect()}
    assert [k for k in sorted(got) if got[k].gate == "excluded signal"] == [4]  # 16 of 60 s; its neighbours have 10 and 6 s
    assert abs(got[4].excluded_fraction - 16 / 59.75) < 1e-6 and abs(got[3].excluded_fraction - 10 / 59.75) < 1e-6
    assert R.summary(R.gated(R.windows(rr, beats), cut)).first().n_used == 11


def test_short_or_empty_recordings_have_no_windows(spark):
    rr, beats = recording(spark, 1, 15.0, seconds=100)
    assert R.windows(rr, beats).count() == 0
    rr, beats = recording(spark, 1, 15.0)
    assert R.windows(rr, beats.limit(20)).count() == 0 and R.windows(rr, beats.limit(0)).count() == 0
    assert R.respiration(rr.limit(0), beats.limit(0), spark.createDataFrame([], SEG)).count() == 0
    assert R.respiration(*(d.where("t_s < 170") for d in (rr, beats)), spark.createDataFrame([], SEG)).first().median_brpm is None
