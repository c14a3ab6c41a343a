"""Replacing sessions by buckets, batches given again, late and empty nights, state that is forgotten."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulseweave import sinks
from pulseweave.operators import nightly
from pulseweave.streaming import streams


def held(spark, path, *cols):
    return sorted(tuple(r) for r in spark.read.parquet(path).select(*cols).collect())


def test_sessions_are_replaced_by_buckets(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda ids, v: spark.createDataFrame([(i, k, v) for i in ids for k in range(2)], "session_id long, k int, v string")
    sinks.replace_sessions(rows(range(300), "a"), path, buckets=4)
    for _ in range(2):
        sinks.replace_sessions(rows([7, 11, 999], "b"), path, buckets=4)
        want = {(i, k, "b" if i in (7, 11, 999) else "a") for i in [*range(300), 999] for k in range(2)}
        assert held(spark, path, "session_id", "k", "v") == sorted(want)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("bucket=")]) == 4
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    one = spark.createDataFrame([(7, 0, "c")], "session_id long, k int, v string")
    sinks.replace_sessions(one, path, buckets=4)
    assert sum(p in before for p in (tmp_path / "t").rglob("*.parquet")) > 0  # other buckets are not written anew
    assert [r for r in held(spark, path, "session_id", "k", "v") if r[0] == 7] == [(7, 0, "c")]
    sinks.replace_sessions(one.limit(0), path, buckets=4)
    assert spark.read.parquet(path).count() == 601


def test_a_failed_batch_leaves_the_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.replace_sessions(spark.createDataFrame([(1, "a")], "session_id long, v string"), path, buckets=2)
    boom = F.udf(lambda v: 1 // 0, "string")
    with pytest.raises(Exception, match="ZeroDivision"):
        sinks.replace_sessions(spark.createDataFrame([(1, "b")], "session_id long, v string").withColumn("v", boom("v")), path, buckets=2)
    assert held(spark, path, "session_id", "v") == [(1, "a")]


def test_repeats_change_nothing(spark, tmp_path):
    one = spark.createDataFrame([(1, 2)], "session_id long, v int")
    for _ in range(2):
        sinks.append(one, f"{tmp_path}/a", 5)
    sinks.append(one, f"{tmp_path}/a", 6)
    assert spark.read.parquet(f"{tmp_path}/a").count() == 2
    write = streams.replace_keys(f"{tmp_path}/r", "session_id", 2)
    write(one, 0)
    write(one.withColumn("v", F.lit(9)), 1)
    write(one, 0)  # given again
    assert held(spark, f"{tmp_path}/r", "session_id", "v") == [(1, 9)]


def test_late_and_empty_nights_through_a_stream(spark, tmp_path):
    schema = "person_id long, date date, score int, hrv double, fetched int"
    day = lambda n: dt.date(2026, 3, n)
    batches = [
        [(1, day(1), 80, None, 1), (1, day(2), None, None, 1), (2, day(1), 70, 40.0, 1), (1, day(1), 81, None, 2)],
        [(1, day(1), 90, 50.0, 3), (1, day(3), 60, None, 3), (3, day(9), None, None, 3)],
    ]
    target = f"{tmp_path}/nights"
    write = nightly.upsert_nights(target, ["score", "hrv"], "fetched", buckets=2)
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        streams.each_batch(spark.readStream.schema(schema).parquet(str(folder)), write, f"{tmp_path}/state")
        write(spark.createDataFrame(batches[0], schema), 0)  # an old batch comes again
    assert held(spark, target, "person_id", "date", "score") == [(1, day(1), 90), (1, day(3), 60), (2, day(1), 70)]
    counts = sorted(tuple(r) for r in spark.read.parquet(f"{target}-counts").select("batch", "person_id", "created", "updated", "empty").collect())
    assert counts == [(0, 1, 1, 0, 1), (0, 2, 1, 0, 0), (1, 1, 1, 1, 0), (1, 3, 0, 0, 1)]


def test_plan_stops_and_islands(spark):
    day = lambda n: dt.date(2026, 1, 1) + dt.timedelta(n)
    r = spark.createDataFrame([(1, day(0), day(60), day(60)), (2, day(50), day(60), day(60)), (3, day(0), day(9), day(60)), (4, day(9), day(3), day(60))], "person_id long, start_date date, end_date date, today date")
    a = spark.createDataFrame([(p, day(n)) for p in (1, 2, 4) for n in (3, 5, 31, 32, 40)] + [(1, day(3))], "person_id long, date date")
    calls = nightly.plan(r, a)
    got = {}
    for c in calls.orderBy("person_id", "seq").collect():
        got.setdefault(c.person_id, []).append((c.kind, c.call, c.from_date, c.to_date))
    night = [("night", x, day(n), day(n)) for n in (3, 5, 31) for x in ("sleep", "recharge")]
    assert got == {1: [("list", "sleep", day(32), day(60)), ("list", "recharge", day(32), day(60)), ("available", "available", day(0), day(31)), *night], 2: [("list", x, day(50), day(60)) for x in ("sleep", "recharge")], 3: [("available", "available", day(0), day(9))]}
    answers = calls.select("person_id", "seq", F.when((F.col("person_id") == 1) & (F.col("seq") == 5), 429).otherwise(200).alias("status"))
    out = [x.outcome for x in nightly.until_stopped(calls, answers).where("person_id = 1").orderBy("seq").collect()]
    assert out == ["made"] * 4 + ["stopped"] + ["skipped"] * 4
    wanted = spark.createDataFrame([(1, day(n)) for n in range(70)], "person_id long, date date")
    runs = nightly.missing_islands(wanted, spark.createDataFrame([(1, day(4)), (1, day(5))], "person_id long, date date")).orderBy("from_date").collect()
    assert [(x.from_date, x.to_date, x.nights) for x in runs] == [(day(0), day(3), 4), (day(6), day(33), 28), (day(34), day(61), 28), (day(62), day(69), 8)]


def test_progress_and_forgotten_state(spark, tmp_path):
    schema, at = "k long, t timestamp", lambda h: dt.datetime(2026, 1, 1, tzinfo=dt.UTC) + dt.timedelta(hours=h)
    folder, listener = str(tmp_path / "in"), streams.Progress()
    spark.streams.addListener(listener)
    try:
        for hours in ([(1, 0), (1, 1), (2, 1)], [(2, 100)], [(2, 101)], [(1, 200), (2, 102)]):
            spark.createDataFrame([(k, at(h)) for k, h in hours], schema).coalesce(1).write.mode("append").parquet(folder)
            s = streams.intervals(spark.readStream.schema(schema).parquet(folder), "k", "t", keep_s=3600 * 24)
            table = streams.run_available(s, f"{tmp_path}/out")
        got = sorted((r.k, r.rr_ms / 3.6e6) for r in table.collect())
        assert got == [(1, 1.0), (2, 1.0), (2, 1.0)] or got == [(1, 1.0), (2, 1.0), (2, 1.0), (2, 99.0)]  # key 1 was forgotten before hour 200
        assert (1, 199.0) not in got
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()  # noqa: SLF001
        assert len(listener.last) >= 1 and all(p["failed"] is None for p in listener.last.values() if "failed" in p)
    finally:
        spark.streams.removeListener(listener)
