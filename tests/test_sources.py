import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulseweave.functions import text
from pulseweave.sources import recordings

NOW = "2026-08-16 12:00:00"
START = dt.datetime(2026, 8, 14, 10, tzinfo=dt.UTC)


def write(path, n=400, rate=130.03, amplitude=0.5, shift=0, header="time,ecg,hr,rr,marker", row=None, sep=","):
    t0 = int((START.timestamp() - shift) * 1e9)
    lines = [header]
    for i in range(n):
        fields = [str(t0 + int(i * 1e9 / rate)), f"{amplitude * ((i % 7) - 3) / 3:.4f}"]
        if i % 130 == 0:
            fields += ["72", "", "stand"] if i == 130 else ["72"]
        lines.append(sep.join(fields) if row is None or i != 50 else row)
    path.write_text("﻿" + "\r\n".join(lines) + "\n\n", encoding="utf-8")


@pytest.fixture(scope="module")
def outcomes(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("ecg")
    device = recordings.DEVICE_EPOCH_S
    write(d / "plain_2026-08-14.csv")
    write(d / "device.csv", shift=device)
    write(d / "micro.csv", amplitude=500)
    write(d / "between.csv", amplitude=10)
    write(d / "semicolon.csv", header="time;ecg", sep=";")
    write(d / "names.csv", header="when,what")
    write(d / "wide.csv", row="1,2,3,4,5,6")
    write(d / "garbage.csv", row="x,y")
    write(d / "short.csv", n=50)
    write(d / "slow.csv", rate=20)
    write(d / "old.csv", shift=50 * 365 * 86400)
    (d / "empty.csv").write_text("time,ecg\n")
    rows = recordings.recordings(spark, str(d), NOW).collect()
    return {r.path.rsplit("/", 1)[1]: r for r in rows}, d


def test_detection(outcomes):
    got, _ = outcomes
    assert {k: (r.status, r.question or r.error) for k, r in got.items()} == {
        "plain_2026-08-14.csv": ("ok", None), "device.csv": ("ok", None), "micro.csv": ("ok", None), "between.csv": ("question", "unit"), "semicolon.csv": ("question", "delimiter"), "names.csv": ("question", "columns"),
        "wide.csv": ("question", "wide row"), "garbage.csv": ("question", "bad rows"), "short.csv": ("error", "too short"), "slow.csv": ("error", "sampling rate"), "old.csv": ("question", "implausible time"), "empty.csv": ("error", "empty"),
    }
    assert got["device.csv"].epoch == "device" and got["plain_2026-08-14.csv"].epoch == "unix" and got["micro.csv"].unit == "uV"
    assert abs(got["plain_2026-08-14.csv"].rate_hz - 130.03) < 0.01 and got["plain_2026-08-14.csv"].days_from_name == 0


def test_samples_are_in_millivolts(spark, outcomes):
    s = recordings.samples(spark, str(outcomes[1] / "micro.csv"), NOW)
    r = s.agg(F.count("*").alias("n"), F.max("ecg_mv").alias("m"), F.count("hr").alias("hr"), F.count("marker").alias("k"), F.min("t_s").alias("t")).first()
    assert (r.n, r.hr, r.k, r.t) == (400, 4, 1, 0.0) and abs(r.m - 0.5) < 1e-6


def test_accelerometer(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Phone timestamp;sensor timestamp [ns];X [g];Y [g];Z [g]\nx;1000;0,12;0;0,99\nx;2000;;0;1\n")
    rows = recordings.accelerometer(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.t_ns, round(r.x_mg, 6), r.y_mg, round(r.z_mg, 6)) for r in rows] == [(1000, 120.0, 0.0, 990.0)]


def test_text(spark):
    d = spark.createDataFrame([("Zoë & Co.", "log_20261399_2026-08-14.csv", "a, ,b ,")], "n string, f string, t string")
    r = d.select(text.slugify(F.col("n")).alias("s"), text.filename_date(F.col("f")).alias("d"), text.tag_list(F.col("t")).alias("t"), text.duration(F.lit(27000)).alias("u"), text.signed(F.lit(-0.25)).alias("g")).first()
    assert (r.s, r.d, r.t, r.u, r.g) == ("zo-co", dt.date(2026, 8, 14), ["a", "b"], "7 h 30 m", "-0.3")


def test_each_question_is_gone_with_its_answer(spark, outcomes, tmp_path):
    _, d = outcomes
    t0 = int(START.timestamp() * 1e9)
    comma = ["Zeit;Wert;Puls;Rest"] + [f"{t0 + int(i * 1e9 / 130)};{'-' if i % 2 else ''}0,{100 + i % 7};72,5;x" for i in range(300)]
    (tmp_path / "comma.csv").write_text("\n".join(comma))
    write(tmp_path / "semicolon.csv", header="time;ecg;hr;rr;marker", sep=";")
    for name in ("between.csv", "old.csv", "plain_2026-08-14.csv"):
        (tmp_path / name).write_text((d / name).read_text(encoding="utf-8"), encoding="utf-8")
    given = dict.fromkeys(("delimiter", "decimal", "column_map", "unit", "epoch"))

    def ask(answers):
        table = spark.createDataFrame([(p, *(a.get(k) for k in given)) for p, a in answers.items()], recordings.ANSWERS)
        found = recordings.recordings(spark, str(tmp_path), NOW, table)
        return {r.path.rsplit("/", 1)[1]: r for r in found.collect()}, {r.path.rsplit("/", 1)[1]: r for r in recordings.questions(found).collect()}, table

    answers = {}
    steps = {"comma.csv": [("delimiter", "delimiter", ";"), ("columns", "column_map", {"zeit": "time", "WERT": "ecg", "puls": "hr", "rest": "ignored"}), ("decimal", "decimal", ",")], "between.csv": [("unit", "unit", "uV")], "old.csv": [("implausible time", "epoch", "device")], "semicolon.csv": [("delimiter", "delimiter", ";")]}
    for turn in range(4):
        found, asked, table = ask(answers)
        for name, parts in steps.items():
            if turn < len(parts):
                assert asked[name].key == parts[turn][0] and asked[name].question and (found[name].status, found[name].question) == ("question", parts[turn][0])
                answers.setdefault(found[name].path, {})[parts[turn][1]] = parts[turn][2]
            else:
                assert name not in asked and found[name].status == "ok" and found[name].answered == [p[1] for p in sorted(parts, key=lambda p: list(given).index(p[1]))]
        assert found["plain_2026-08-14.csv"].answered == []
    assert "0.667" not in (found["between.csv"].observed or "") and found["comma.csv"].n_samples == 300
    s = recordings.samples(spark, str(tmp_path / "comma.csv"), NOW, table)
    r = s.agg(F.max("ecg_mv").alias("m"), F.min("ecg_mv").alias("l"), F.max("hr").alias("hr"), F.count("*").alias("n")).first()
    assert (r.m, r.l, r.hr, r.n) == (0.106, -0.106, 72.5, 300)
