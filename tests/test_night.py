"""A night with known stages, from intervals to summary."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseweave.operators import night, sleep

# minutes, stage (wake, light, deep, REM), mean rate, swing at 0.1 Hz and at 0.25 Hz in ms
PLAN = [
    (12, 0, 74, 30, 12), (25, 1, 59, 22, 18), (40, 2, 54, 9, 42), (25, 1, 59, 22, 18), (20, 3, 63, 45, 12), (30, 1, 59, 22, 18), (35, 2, 54, 9, 42),
    (25, 1, 59, 22, 18), (30, 3, 63, 45, 12), (30, 1, 59, 22, 18), (35, 3, 63, 45, 12), (8, 0, 74, 30, 12),
]


@pytest.fixture(scope="module")
def known():
    g, t, n, rr, truth = np.random.default_rng(11), 0.0, 0, [], []
    for minutes, stage, hr, slow, fast in PLAN:
        end = t + minutes * 60
        truth += [stage] * (2 * minutes)
        while t < end:
            v = 60000 / hr + slow * math.sin(2 * math.pi * 0.1 * t) + fast * math.sin(2 * math.pi * 0.25 * t) + g.normal(0, 6)
            t += v / 1000
            rr.append((1, n, t, float(v), False))
            n += 1
    return rr, np.array(truth), t


RR = "session_id long, n long, t_s double, rr_ms double, discontinuity boolean"


def test_known_night(spark, known):
    rows, truth, end = known
    rr = spark.createDataFrame(rows, RR)
    durations = spark.createDataFrame([(1, end + 150.0), (2, 95.0)], "session_id long, duration_s double")
    windows = spark.createDataFrame([], "session_id long, start_s double, wander_rms_mv double")
    done = night.stage(rr, durations, windows)
    h = done.hypnogram.where("session_id = 1").orderBy("epoch").collect()
    assert len(h) == math.ceil((end + 150) / 30) and [r.epoch for r in h] == list(range(len(h)))
    staged = np.array([r.stage for r in h])[: len(truth)]
    assert [r.stage for r in h[-4:]] == [-1] * 4  # nothing was recorded there
    scored = staged >= 0
    assert (staged[scored] == truth[scored]).mean() >= 0.70
    assert (staged[truth == 2] == 2).mean() > 0.6 and (staged[truth == 3] == 3).mean() > 0.6 and (staged[truth == 3] == 2).mean() < 0.1
    s = {r.session_id: r for r in done.summary.collect()}
    assert s[1].source == "wander_proxy" and len(s[1].notes) == 2 and s[1].n_unscored >= 4 and 5 <= s[1].latency_min <= 30
    assert s[2].n_unscored == 4 and s[2].tst_min == 0
    found = {r.metric: r for r in done.plausibility.where("session_id = 1").collect()}
    assert {"Light_pct", "Deep_pct", "REM_pct", "efficiency_pct"} <= set(found)
    assert abs(sum(found[m].value for m in ("Light_pct", "Deep_pct", "REM_pct")) - 100) < 1e-9


def test_movement_by_counts_or_by_wander(spark):
    grid = sleep.epoch_grid(spark.createDataFrame([(1, 310.0), (2, 290.0), (3, 0.0), (4, 30.0)], "session_id long, duration_s double"))
    assert {r.session_id: r["count"] for r in grid.groupBy("session_id").count().collect()} == {1: 11, 2: 10, 4: 1}
    wander = [(k, 30.0 * e + 5 * j, 0.02 + 0.001 * (e % 3) + (0.5 if e == 6 else 0)) for k in (1, 2) for e in range(10) for j in range(6)]
    windows = spark.createDataFrame([*wander, (1, 3.0, None)], "session_id long, start_s double, wander_rms_mv double")
    counts = spark.createDataFrame([(2, e, 100.0 if e == 2 else 1.0 + e % 2) for e in range(10)], "session_id long, epoch long, counts double")
    m = night.movement(grid, windows, counts)
    assert sorted((r.session_id, r.epoch) for r in m.where("moving").collect()) == [(1, 6), (2, 2)]
    assert {(r.session_id, r.source) for r in m.select("session_id", "source").distinct().collect()} == {(1, "wander_proxy"), (2, "acc"), (4, "wander_proxy")}
    moved = {r.epoch: r.movement for r in m.where("session_id = 1").collect()}
    assert moved[10] is None and abs(moved[6] - 0.52) < 1e-9 and m.count() == 22


def test_ratio_uses_the_epochs_that_have_power(spark):
    grid = spark.createDataFrame([(1, e) for e in range(20)], "session_id long, epoch long")
    powers = spark.createDataFrame([(1, 0, 4.0, 1.0), (1, 3, 8.0, 3.0)], "session_id long, epoch long, lf double, hf double")
    got = {r.epoch: r.lf_hf for r in night.lf_hf(grid, powers).collect()}
    assert got[0] == got[5] == 3.0 and got[7] == 8.0 / 3 and got[9] is None and len(got) == 20


def test_an_engine_that_fails_while_it_runs_leaves_the_others(spark):
    h = spark.createDataFrame([(1, e, e % 3) for e in range(6)], "session_id long, epoch long, stage int")
    broken = F.udf(lambda x: 1 // 0, "int")
    out = sleep.run_engines(h, {"good": lambda d: d, "broken": lambda d: d.withColumn("stage", broken("stage"))}).collect()
    assert sum(r.engine == "good" for r in out) == 6
    bad = [r for r in out if r.engine == "broken"]
    assert len(bad) == 1 and bad[0].status.startswith("failed")


def test_all_norms_have_a_verdict(spark):
    h = spark.createDataFrame([(1, e, s) for e, s in enumerate([0, 1, 1, 2, 2, 2, 3, 4, 0, 2])], "session_id long, epoch long, stage int")
    shares = sleep.stage_shares(h, "aasm_5")
    got = {r.metric: r.verdict for r in sleep.plausibility(sleep.summarize(h, rem=4), shares=shares).collect()}
    assert {"N1_pct", "N2_pct", "N3_pct", "REM_pct"} <= set(got) and got["N1_pct"] == "above range" and got["N3_pct"] == "within range" and got["REM_pct"] == "below range"
    assert set(sleep.SHARE_NORMS) == {"Light", "N1", "N2", "Deep", "N3", "REM", "NREM"}
