"""Profiles: nine output sets equal to the separate operators, a tenth, rules."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseweave.operators import activity, hrv, profiles, spectral
from pulseweave.operators.profiles import Inputs, Profile

KEYS = [k for k, *_ in activity.PROFILES]


@pytest.fixture(scope="module")
def inputs(spark):
    g, rr, markers, move = np.random.default_rng(4), [], [], []
    for s in range(9):
        t = 0.0
        for n in range(900):
            hr = 75 + 25 * math.sin(t / 110) + g.normal(0, 2)
            t += 60 / hr
            rr.append((s, n, t, float(60000 / hr), False))
        markers.append((s, 150.0))
        move += [(s, k, float(50 + 25 * math.sin(5 * k / 110) + g.normal(0, 3))) for k in range(int(t // 5))]
    sessions = spark.createDataFrame([(s, KEYS[s], 180.0 + s, "age", 0.1, 0.09) for s in range(9)], "session_id long, profile_key string, max_hr double, max_hr_basis string, excluded_fraction double, lf_peak_hz double")
    return Inputs(sessions, spark.createDataFrame(rr, "session_id long, n long, t_s double, rr_ms double, discontinuity boolean"), spark.createDataFrame(markers, "session_id long, t_s double"), spark.createDataFrame(move, "session_id long, k long, movement double"))


def read(df):
    return {r.profile_key: json.loads(r.extras.toJson()) for r in df.collect()}


def test_nine_sets_equal_the_separate_operators(inputs):
    got = read(profiles.outputs(inputs))
    assert set(got) == set(KEYS) == set(profiles.OUTPUTS)
    for k in KEYS:
        assert set(got[k]) <= set(profiles.REGISTRY[k].outputs), k
        assert set(profiles.REGISTRY[k].outputs) - set(got[k]) <= {"settled_at_min", "settled_hr_bpm", "recovery_tau_s"}, k
    one = lambda df, s, c: {r.session_id: r[c] for r in df.collect()}[s]
    near = lambda a, b: abs(a - b) < 1e-9 * max(1.0, abs(b))
    s = {k: i for i, k in enumerate(KEYS)}
    rr = inputs.rr
    for k in ("supine", "sitting", "standing", "walking"):
        assert near(got[k]["hr_trend_bpm_per_min"], one(activity.hr_trend(rr), s[k], "bpm_per_min"))
    for k in ("running", "cycling"):
        assert near(got[k]["cardiac_drift_proxy_bpm_per_min"], one(activity.hr_trend(rr, 300.0, 60), s[k], "bpm_per_min"))
        peaks = hrv.rolling_peak(rr)
        assert near(got[k]["hrr60_bpm"], one(activity.recovery(rr, peaks), s[k], "hrr60")) and near(got[k]["peak_hr_bpm"], one(peaks, s[k], "peak_hr_bpm"))
        zones = {f"zone{r.zone}": r.fraction for r in activity.zones(rr.where(f"session_id = {s[k]}"), F.lit(180.0 + s[k])).collect()}
        assert got[k]["hr_zones_fraction"].keys() == zones.keys() and all(near(v, zones[z]) for z, v in got[k]["hr_zones_fraction"].items())
    assert near(got["recovery"]["hrr120_bpm"], one(activity.recovery(rr, hrv.rolling_peak(rr)), s["recovery"], "hrr120"))
    tau = one(spectral.recovery_tau(rr, hrv.rolling_peak(rr)), s["recovery"], "tau_s")
    assert got["recovery"].get("recovery_tau_s") == tau or near(got["recovery"]["recovery_tau_s"], tau)
    assert near(got["recovery"]["rmssd_reactivation_ms_per_min"], one(activity.reactivation_slope(hrv.per_minute_rmssd(rr)), s["recovery"], "slope_ms_per_min"))
    assert near(got["walking"]["motion_hr_coupling_r"], one(activity.motion_coupling(rr, inputs.movement), s["walking"], "r"))
    assert near(got["standing"]["orthostatic_response"]["rise_bpm"], one(activity.orthostatic(rr, inputs.markers), s["standing"], "rise_bpm")) and got["standing"]["mayer_peak_hz"] == 0.09
    assert near(got["sleep"]["lowest_sustained_hr_bpm"], one(hrv.lowest_sustained_hr(rr), s["sleep"], "lowest_hr_bpm"))
    minutes = [r.hr_bpm for r in hrv.per_minute_hr(rr).where(f"session_id = {s['sleep']}").orderBy("window").collect()]
    assert len(got["sleep"]["per_minute_hr_bpm"]) == len(minutes) == len(got["sleep"]["per_minute_hr_t_s"]) and all(map(near, got["sleep"]["per_minute_hr_bpm"], minutes))
    assert got["swimming"]["excluded_fraction"] == 0.1 and got["swimming"]["max_hr_basis"] == "age"


def test_a_tenth_profile(inputs, monkeypatch):
    monkeypatch.setattr(profiles, "REGISTRY", dict(profiles.REGISTRY))
    profiles.register(Profile("rowing", "Rowing", (90, 180), ("peak_hr_bpm", "excluded_fraction"), 0.2))
    with pytest.raises(ValueError, match="key"):
        profiles.register(Profile("rowing", "Rowing", (90, 180), ()))
    with pytest.raises(ValueError, match="nothing provides"):
        profiles.register(Profile("other", "Other", (90, 180), ("vo2max",)))
    s = inputs.sessions.where("session_id = 4").replace("running", "rowing")
    got = read(profiles.outputs(Inputs(s, inputs.rr, inputs.markers, inputs.movement)))
    assert set(got) == {"rowing"} and set(got["rowing"]) == {"peak_hr_bpm", "excluded_fraction"}
    assert profiles.table(inputs.rr.sparkSession).where("profile = 'rowing' AND max_excluded = 0.2").count() == 1


def test_rules_and_families(spark):
    rows = [(1, "swimming", 0.31, 120.0), (2, "swimming", 0.30, 120.0), (3, "running", 0.1, 170.0), (4, "running", 0.9, 120.0), (5, "sleep", 0.6, 50.0), (6, "unheard", 0.9, 190.0), (7, "supine", None, None)]
    d = spark.createDataFrame(rows, "session_id long, profile_key string, excluded_fraction double, mean_hr_bpm double").selectExpr("*", "60D AS rest_hr", "190D AS max_hr", "1D AS sdnn_ms", "2D AS lf", "3D AS sampen", "4D AS mean_hr")
    j = profiles.judged(d)
    got = {r.session_id: r for r in profiles.suppress_families(j, F.col("suppressed")).collect()}
    assert [got[i].not_analysable for i in range(1, 8)] == [True, False, False, False, True, False, False]
    assert [got[i].sdnn_ms is None and got[i].lf is None and got[i].sampen is None for i in range(1, 8)] == [True, False, True, False, True, False, False]
    assert all(r.mean_hr == 4 for r in got.values()) and got[3].cautions == ["frequency"] and got[5].cautions == [] and got[6].cautions == []
