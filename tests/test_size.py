"""Work that has to grow no faster than its tables."""

from __future__ import annotations

import time
import warnings

import numpy as np
from pyspark.sql import functions as F

from pulseweave.functions import kernels as K
from pulseweave.operators import quality, recording, stats
from pulseweave.plans import adapter, relational, signal_queries


def test_rolling_quantiles_sort_all_windows_at_once():
    x = np.random.default_rng(4).standard_normal(20000)
    x[[7, *range(100, 230)]] = np.nan
    begun = time.process_time()
    low, high = K._rolling(x, 91, (0.25, 0.75))
    assert time.process_time() - begun < 0.6  # a call for each window takes 1 s and more
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # a window without values has none
        for at in (0, 3, 45, 120, 165, 300, 19990, 19999):
            here = x[max(0, at - 45) : at + 46]
            assert np.array_equal(np.nanquantile(here, (0.25, 0.75)), (low[at], high[at]), equal_nan=True)


def test_artifacts_of_a_long_recording_are_quick():
    g = np.random.default_rng(5)
    t = np.cumsum(0.25 + 0.4 * g.exponential(1, 5000))
    begun = time.process_time()
    found = K.artifacts(t)
    assert time.process_time() - begun < 0.5 and sum(map(len, found.values()))


def test_recordings_shuffle_events_and_no_samples(spark):
    d = "/root/testdata/sf0.001"
    for q in (signal_queries.detector_chain, signal_queries.recording_quality):
        plan = q(spark, d)._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
        below = plan[plan.index("FlatMapGroupsInArrow") :]
        assert below.count("Exchange") == 1 and "Generate" not in below and "Join" not in below


def test_traces_are_the_highest_triangles_of_near_beats(spark, tmp_path):
    # values below -31.25 give intervals of no time or back in time, so that beats overlap
    values = [5.0, None, -30.0, -30.5, -31.25, -29.0, 100.0, -40.0, 3.0, 0.0, 250.0, -31.0, 700.0]
    rows = [(i, i // 13 * 10, v, f'{{"k": {i}}}') for i, v in enumerate(values * 2)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, value double, props string")
    e.select("event_id", F.timestamp_seconds("event_id").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    beats = adapter.beats(spark, str(tmp_path)).collect()
    blocks = adapter.traces(spark, str(tmp_path)).collect()
    for sid in (0, 1):
        mine = [(b.t_s, 0.6 + (b.value or 0.0) / 1000) for b in beats if b.session_id == sid]
        got = {b.i + n: (t, x) for b in blocks if b.session_id == sid for n, (t, x) in enumerate(zip(b.t_s, b.x, strict=True))}
        assert sorted(got) == list(range(int(np.ceil((max(mine)[0] + 0.5) * adapter.TRACE_HZ)) + 1)) and sum(len(b.x) for b in blocks if b.session_id == sid) == len(got)
        for i, (t, x) in got.items():
            want = [a * (1 - abs(t - at) / 0.06) for at, a in mine if abs(t - at) <= 0.06]
            assert t == i / adapter.TRACE_HZ and abs(x - max(want, default=0.0)) < 1e-12


def test_summaries_judge_windows_as_samples_do(spark):
    g, rows = np.random.default_rng(8), []
    for sid, n in enumerate((4000, 900, 30, 1, 2500)):
        t = np.arange(n) / 40.0 + 3.25
        x = 0.02 * g.standard_normal(n) + np.maximum(0, 1 - np.abs((t % 0.8) - 0.4) / 0.06) * (3.0 + 2.0 * (sid == 4))
        x[300:320] = 2.98  # pinned to a rail of 3
        x[800:1200] = 0.0
        keep = (t < 40) | (t > 47.3) if sid != 1 else t > 0
        rows += [(sid, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t[keep], x[keep], strict=True))]
    df = spark.createDataFrame(rows, "session_id long, i long, t_s double, x double").repartition(3)
    blocks = df.groupBy("session_id", F.floor(F.col("i") / 70).alias("b")).agg(F.array_sort(F.collect_list(F.struct("i", "t_s", "x"))).alias("s"))
    blocks = blocks.select("session_id", F.col("s")[0]["i"].alias("i"), F.col("s.t_s").alias("t_s"), F.col("s.x").alias("x"))
    one = recording.conditioned(df, 40.0).cache()
    show = lambda w: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in w.orderBy("session_id", "k").collect()]
    want, status = show(quality.windows(one)), sorted(map(tuple, recording.detection(one).collect()))
    assert {r for w in want for r in w[7]} >= {"gap", "clipping", "amplitude", "flat", "too few samples"}
    for samples in (df, blocks):
        d = recording.summaries(samples, 40.0)
        assert show(recording.quality_windows(samples, 40.0)) == want
        assert sorted(map(tuple, recording.detection(d).collect())) == status
        peaks = sorted((r.session_id, p.t_s, p.amplitude) for r in d.collect() for p in r.peaks)
        assert peaks == sorted((r.session_id, r.t_s, r.clean) for r in one.where("peak").collect())


def test_observations_have_partitions_of_so_many_rows_at_most(spark, tmp_path):
    rows = 24 * relational.ROWS_A_PART
    l = spark.range(0, rows, 1, 4).select(F.floor(F.col("id") / 4).alias("l_orderkey"), F.lit(2.0).alias("l_quantity"), F.lit(3.0).alias("l_extendedprice"), F.lit(0.1).alias("l_discount"))
    l.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(rows // 4).withColumnRenamed("id", "o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "134217728")  # one split
        o = relational._observations(spark, str(tmp_path))
        assert o.rdd.getNumPartitions() == 24 and o.count() == rows // 4 and o.agg(F.sum("ectopy_count")).first()[0] == rows
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_count_models_of_cells_equal_those_of_rows(spark):
    g, rows, tags = np.random.default_rng(3), [], []
    for i in range(1600):
        mine, key = [t for t in ("x", "y") if g.random() < 0.3], ["a", "b", None][i % 3]
        rows.append((i, None if i == 5 else i // 7 % 2, int(g.negative_binomial(2, 0.4)) * (2 if "x" in mine else 1), float(g.integers(2, 4)), float(i % 5 * 3), key))
        tags += [(i // 7 % 2, i, t) for t in mine + mine[:1]]
    o = spark.createDataFrame(rows, "session_id long, person long, ectopy_count long, hours double, hour double, comparison_key string")
    t = spark.createDataFrame([*tags, (0, 10**6, "nobody")], "person long, session_id long, tag string")
    cells = stats.arm_cells(o, t, ["ectopy_count", "hours", "hour", "comparison_key"], ["person"])
    plain = stats.arms(o, t, ["person"])
    per = lambda d, n: sorted(tuple(map(str, r)) for r in d.groupBy("person", "tag", "exposed").agg(n).collect())
    assert per(cells, F.sum("weight")) == per(plain, F.count("*"))
    assert cells.groupBy("person", "tag").count().agg(F.max("count")).first()[0] < 500  # of 800 observations
    one, two = ({(r.person, r.tag): r for r in stats.effects(a, ["person", "tag"]).collect()} for a in (plain, cells))
    assert set(one) == set(two) and {r.status for r in one.values()} == {"ok", "insufficient"}
    for k, r in one.items():
        assert r.status == two[k].status
        for c in ("estimate", "ci_low", "ci_high"):
            assert (r[c] is None and two[k][c] is None) or abs(r[c] - two[k][c]) < 1e-6 * r[c]
