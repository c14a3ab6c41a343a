"""Cases at edges: halves and signs in texts, windows that end where another begins, shares at their limit, lists of rates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pulseweave.functions import text
from pulseweave.operators import context, hrv, quality, respiration, screening
from pulseweave.plans import relational


def test_numbers_round_in_binary_and_keep_their_sign(spark):
    d = spark.createDataFrame([(v,) for v in (-0.04, 0.04, -655.305, 999.995, -0.25)], "v double")
    r = [(x.s, x.n) for x in d.select(text.signed(F.col("v")).alias("s"), text.number(F.col("v")).alias("n")).collect()]
    assert r == [("-0.0", "-0.04"), ("+0.0", "0.04"), ("-655.3", "-655.30"), ("+1000.0", "1000.00"), ("-0.3", "-0.25")]


def test_spans_are_written_by_their_exact_value(spark):
    # 0.95 as a double lies below 0.95, 100.25 is itself
    starts = [0.95, 100.25, 200.35, 300.45]
    w = spark.createDataFrame([(k, s, 120.0 + k) for k, s in enumerate(starts)], "session_id long, window_start_s double, hr_bpm double")
    for kind, limit in (("sustained_high_hr", 80.0), ("sustained_low_hr", 200.0)):
        got = {r.session_id: r.spans for r in screening.sustained(w, kind, limit).collect()}
        assert got == {k: "%.1f-%.1f" % (s, s + 45.0) for k, s in enumerate(starts)}


def test_share_at_its_limit_is_not_excluded(spark):
    rows, parts = [], []
    for k in range(200):
        t = 123.45678 + 7.03125 * k
        rows.append((k, 0, t, t + 60.0, 60.0, 12.0, 12.0))
        parts += [(k, t + 2.0**-6 + 8.0 * j, t + 2.0**-6 + 8.0 * j + 5.0) for j in range(3)]
    w = spark.createDataFrame(rows, "session_id long, k long, start_s double, end_s double, hr_bpm double, rate_brpm double, amplitude_brpm double")
    s = spark.createDataFrame(parts, "session_id long, start_s double, end_s double")
    got = {r.session_id: (r.excluded_fraction, r.gate) for r in respiration.gated(w, s, 60.0).collect()}
    for k in range(200):
        whole = 0.0
        for _, a, b in parts[3 * k : 3 * k + 3]:
            whole += b - a
        assert got[k] == (whole / 60.0, "excluded signal" if whole / 60.0 > 0.25 else None)


def _edges(spark):
    """Sessions with a beat at the start of a window that the window before holds too by its last bit, and then a gap."""
    rows = []
    for sid, (t0, k) in enumerate([(0.48653, 26), (0.5126, 26), (0.41861, 2), (0.55221, 103)]):
        at = round(t0 + 5 * k, 5)
        assert at < (t0 + (k - 1) * 5.0) + 5.0
        rows += [(sid, i, t) for i, t in enumerate([t0 + 0.5 * j for j in range(10 * k)] + [at, at + 3.0, at + 3.5, at + 4.0])]
    s = spark.createDataFrame(rows, "session_id long, i long, t_s double")
    return s.withColumns({"x": F.lit(0.5) + F.col("i") % 2, "sqi": F.lit(0.9), "wander": F.lit(0.1)})


def test_a_gap_that_begins_at_the_last_bit_of_a_window(spark):
    s = _edges(spark)
    gaps = [(r.session_id, r.start_s, r.end_s) for r in quality.gaps(s).collect()]
    assert len(gaps) == 4
    for w in quality.windows(s).collect():
        if w.n >= 2:
            assert ("gap" in w.reasons) == any(g[0] == w.session_id and g[1] < w.end_s and g[2] > w.start_s for g in gaps)


def test_motion_is_that_of_the_windows_that_hold_a_beat(spark):
    s = _edges(spark)
    w = quality.windows(s)
    windows = [(r.session_id, r.start_s, r.end_s, r.excluded) for r in w.collect()]
    want = []
    for r in s.collect():
        found = [x[3] for x in windows if x[0] == r.session_id and x[1] <= r.t_s < x[2]]
        want += [(r.session_id, r.i, m) for m in found or [False]]
    assert sorted((r.session_id, r.i, r.motion) for r in quality.motion_degraded(s, w).collect()) == sorted(want)


def test_rates_by_tag_has_both_lists_for_every_tag(spark):
    rates = spark.createDataFrame([(1, 3), (2, 0), (3, 3), (4, 1)], "session_id long, rate long")
    tags = spark.createDataFrame([(1, "a"), (1, "a"), (3, "a"), (2, "b"), (9, "c"), (4, None)], "session_id long, tag string")
    got = {r.tag: (r.tagged, r.untagged) for r in context.rates_by_tag(rates, tags).collect()}
    assert got == {"a": ([3, 3], [0, 1]), "b": ([0], [1, 3, 3]), "c": ([], [0, 1, 3, 3])}


def test_observations_are_dealt_by_the_size_of_the_input(spark):
    d = "/root/testdata/sf0.001"
    splits = lambda: spark.read.parquet(f"{d}/lineitem.parquet").rdd.getNumPartitions()
    found, before = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("16777216", "16384"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found.append((splits(), relational._observations(spark, d).rdd.getNumPartitions()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0][0] < found[1][0]
    assert all(parts == relational.PARTS_A_SPLIT * n for n, parts in found)


def test_windows_add_intervals_in_their_order(spark):
    g, rows = np.random.default_rng(9), []
    for sid in range(20):
        at = np.cumsum(25000 + 8 * np.round(g.exponential(5000, 400)).astype(int)) / 1e5
        rows += [(sid, i + 1, float(b), float((b - a) * 1000.0), False) for i, (a, b) in enumerate(zip(at, at[1:], strict=False))]
    mixed = [rows[i] for i in g.permutation(len(rows))]
    rr = spark.createDataFrame(mixed, "session_id long, n long, t_s double, rr_ms double, discontinuity boolean").repartition(7)
    got = {(r.session_id, r.window): (r.hr_bpm, r.n) for r in hrv.sustained_hr(rr).collect()}
    sums = {}
    for sid, _, t, v, _ in rows:
        x = t - rows[399 * sid][2]
        for k in range(max(0, int((x - 45.0) // 5.0) + 1), int(x // 5.0) + 1):
            total, n = sums.get((sid, k), (0.0, 0))
            sums[sid, k] = total + v, n + 1
    assert len(got) > 700 and all(got[k] == (60000.0 / (sums[k][0] / sums[k][1]), sums[k][1]) for k in got)
