"""Report data: strips, minutes, comparison, quality from stored windows."""

import math

from pyspark.sql import functions as F

from pulseweave.operators import quality, report


def test_strips_fetch_the_samples_around_their_places(spark):
    s = spark.createDataFrame([(k, i, i / 20.0, float(i)) for k, n in ((1, 2000), (2, 300), (3, 5)) for i in range(n)], "session_id long, i long, t_s double, x double")
    durations = spark.createDataFrame([(1, 100.0), (2, 15.0), (3, 0.25)], "session_id long, duration_s double")
    worst = spark.createDataFrame([(1, 98.0), (2, 6.0)], "session_id long, t_s double")
    where = report.places(durations, worst)
    got = {(r.session_id, r.label): (r.start_s, r.end_s) for r in where.collect()}
    assert got == {(1, "opening"): (0, 10), (1, "middle"): (45, 55), (1, "closing"): (90, 100), (1, "worst"): (90, 100), (2, "opening"): (0, 10), (2, "worst"): (1, 11), (3, "opening"): (0, 0.25)}
    cut = report.strips(s, where)
    n = {(r.session_id, r.label): (r.n, r.a, r.b) for r in cut.groupBy("session_id", "label").agg(F.count("*").alias("n"), F.min("at_s").alias("a"), F.max("x").alias("b")).collect()}
    assert n == {(1, "opening"): (200, 0, 199), (1, "middle"): (200, 0, 1099), (1, "closing"): (200, 0, 1999), (1, "worst"): (200, 0, 1999), (2, "opening"): (200, 0, 199), (2, "worst"): (200, 0, 219)}


def test_least_likely_beats_are_cut_before_the_shuffle(spark):
    b = spark.createDataFrame([(s, i, None if i == 3 else float((i * 37) % 101)) for s in (1, 2) for i in range(300)], "session_id long, beat long, r double")
    got = report.least_likely(b, "r", 5)
    plain = sorted((float((i * 37) % 101), i) for i in range(300) if i != 3)[:5]
    for s in (1, 2):
        assert [(r.r, r.beat) for r in got.where(f"session_id = {s}").orderBy("place").collect()] == plain
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()  # noqa: SLF001


def test_sixteen_rows(spark):
    cols = [c for c, _, _ in report.ROWS if c not in ("analysed_min", "ln_rmssd")]
    rows = [(1, k, 600.0 * k, *[None if (c == "rmssd_ms" and k == 2) else float(k + i) for i, c in enumerate(cols)]) for k in range(3)]
    d = spark.createDataFrame(rows, "person long, night long, analysed_s double, " + ", ".join(f"{c} double" for c in cols))
    got = report.comparison(d, ["person"], ["night"]).orderBy("night", "place").collect()
    assert len(got) == 48 and [r.label for r in got[:16]] == [x for _, x, _ in report.ROWS]
    by = {(r.night, r.metric): r for r in got}
    assert by[0, "analysed_min"].value is None and by[1, "analysed_min"].value == 10.0 and by[1, "analysed_min"].delta is None
    assert by[1, "mean_hr_bpm"].delta == 1.0 and by[2, "rmssd_ms"].value is None and by[2, "ln_rmssd"].delta is None and abs(by[1, "ln_rmssd"].value - math.log(by[1, "rmssd_ms"].value)) < 1e-12


def test_quality_from_stored_windows(spark):
    s = spark.createDataFrame([(k, i, i * 0.1, 0.2 * math.sin(i) if not 300 <= i < 420 else 0.0, 0.9 if i < 600 else 0.2, 0.01) for k in (1, 2) for i in range(733)], "session_id long, i long, t_s double, x double, sqi double, wander double")
    live = quality.windows(s)
    stored = quality.to_store(live).withColumn("version", F.when(F.col("session_id") == 2, 2).otherwise(quality.STORED_VERSION))
    got = quality.from_stored(stored, spark.createDataFrame([(1,), (2,), (9,)], "session_id long"))
    assert {r.session_id for r in got.stale.collect()} == {2, 9} and {r.session_id for r in got.totals.collect()} == {1}
    one = lambda d: [(r.start_s, r.end_s) for r in d.where("session_id = 1").orderBy("start_s").collect()]
    a, b = one(quality.merge_excluded(live)), one(got.segments)
    assert len(a) == len(b) == 2 and a[0] == b[0] == (30.0, 40.0) and a[1][0] == b[1][0] == 60.0 and b[1][1] == 75.0 and abs(a[1][1] - 73.2) < 1e-9
    t = got.totals.first()
    assert t.excluded_s == 25.0 and t.analysed_s == 50.0
    beats = spark.createDataFrame([(1, 0.5 + j) for j in range(72)], "session_id long, t_s double")
    motion = lambda w: sorted((r.t_s, r.motion) for r in quality.motion_degraded(beats, w).collect())
    assert [m for m in motion(live.where("session_id = 1")) if m[0] < 70] == [m for m in motion(got.windows) if m[0] < 70]


def test_steps_end_at_gaps(spark):
    h = spark.createDataFrame([(1, e, s) for e, s in ((0, 1), (1, 1), (2, None), (3, None), (5, None), (6, 2))], "session_id long, epoch long, stage int")
    got = [(r.stage, r.start_s, r.end_s, r.epochs) for r in report.steps(h, "stage").orderBy("start_s").collect()]
    assert got == [(1, 0.0, 60.0, 2), (None, 60.0, 120.0, 2), (None, 150.0, 180.0, 1), (2, 180.0, 210.0, 1)]
