"""Preparation for an outside engine against plain forms."""

import datetime as dt

import numpy as np
import pytest

from pulseweave.functions import kernels as K
from pulseweave.operators import external


@pytest.mark.parametrize(("up", "down"), [(2, 1), (3, 7), (128, 65), (1, 3), (997, 500)])
def test_polyphase_equals_a_plain_convolution(up, down):
    x = np.random.default_rng(1).standard_normal(300)
    most = max(up, down)
    h = np.sinc(np.arange(-10 * most, 10 * most + 1) / most) * np.kaiser(20 * most + 1, 5.0)
    sparse = np.zeros(len(x) * up)
    sparse[::up] = x
    want = np.convolve(sparse, h / h.sum() * up)[10 * most :][: len(sparse)][::down]
    got = K.resampled(x, up, down, chunk=64)
    assert len(got) == len(want) == -(-300 * up // down) and np.allclose(got, want, atol=1e-9)


def test_resampling_keeps_a_tone_and_the_notch_stops_one():
    t = np.arange(0, 20, 1 / 130.0)
    y = K.resampled(np.sin(2 * np.pi * 7 * t), 128, 65)
    at = np.arange(len(y)) / 256.0
    assert np.abs(y - np.sin(2 * np.pi * 7 * at))[300:-300].max() < 2e-3
    hum = K.zero_phase(K.notch(50.0, 130.0), np.sin(2 * np.pi * 50 * t) + np.sin(2 * np.pi * 7 * t))
    assert np.abs(hum - np.sin(2 * np.pi * 7 * t))[400:-400].max() < 0.02


def test_epochs(spark):
    t = np.arange(0, 95, 1 / 130.0)
    beats = np.arange(0.5, 95, 0.8)
    x = 0.3 * np.sin(2 * np.pi * 0.05 * t) + 0.2 * np.sin(2 * np.pi * 50 * t) + sum(1.4 * np.exp(-0.5 * ((t - b) / 0.015) ** 2) for b in beats)
    s = spark.createDataFrame([(k, i, float(a), float(b)) for k, n in ((1, len(t)), (2, 2000)) for i, (a, b) in enumerate(zip(t[:n], x, strict=False))], "session_id long, i long, t_s double, x double")
    b = spark.createDataFrame([(1, float(v)) for v in beats] + [(3, 1.0)], "session_id long, t_s double")
    got = external.epochs(s, b, 130.0).orderBy("session_id", "epoch").collect()
    assert [(r.session_id, r.epoch, len(r.ecg)) for r in got] == [(1, e, 7680) for e in range(3)]
    y = np.concatenate([r.ecg for r in got])
    peak = [np.abs(y[int(v * 256) - 20 : int(v * 256) + 20]).max() for v in beats[3:110]]
    assert abs(np.median(peak) - 0.5) < 0.02 and np.abs(y).max() <= 1.0
    far = np.abs(np.concatenate([y[int(v * 256) + 77 : int(v * 256) + 128] for v in beats[3:100]]))
    assert np.median(far) < 0.05  # neither wander nor hum
    assert external.epochs(s.limit(0), b, 130.0).count() == 0


def test_demographics(spark):
    rows = [(1, dt.datetime(2026, 8, 14, 23, 0, 0), 40.0, "female"), (2, dt.datetime(2026, 8, 14, 6, 0, 30), None, "male"), (3, dt.datetime(2026, 8, 14, 12, 0, 0), 50.0, None)]
    d = spark.createDataFrame(rows, "session_id long, started_at timestamp_ntz, age_years double, sex string")
    got = {r.session_id: r for r in external.demographics(d).collect()}
    assert (got[1].sex, got[1].age, got[1].note) == (0.0, 0.4, None) and abs(got[1].midnight_offset + 3600 / 43200) < 1e-12
    assert got[2].age == got[3].sex == 0.5 and got[2].note and got[3].note and got[3].midnight_offset == 1.0
