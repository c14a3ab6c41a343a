"""Queries of grouped signal functions and of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hrv, recording, respiration as breathing, series, spectral
from ..session import new_folder, table
from ..streaming import streams
from .adapter import BEATS_SQL, RR_SQL, TRACE_HZ, beats, excluded, raw_intervals, rr_series, traces
from .registry import Registry, tidy

R = Registry()


@R.add()
def welch_psd(spark, sf_dir):
    return spectral.frequency_domain(rr_series(spark, sf_dir))


@R.add()
def sampen_dfa(spark, sf_dir):
    return spectral.nonlinear(rr_series(spark, sf_dir))


@R.add()
def band_power_epochs(spark, sf_dir):
    return spectral.band_power_epochs(rr_series(spark, sf_dir), 0.04, 0.15)


def _amplitudes(spark, sf_dir):
    return beats(spark, sf_dir).select("session_id", "t_s", (F.col("value") / 400.0).alias("amplitude")).where("amplitude IS NOT NULL")


@R.add()
def respiration(spark, sf_dir):
    return breathing.respiration(rr_series(spark, sf_dir), _amplitudes(spark, sf_dir), excluded(beats(spark, sf_dir)))


#: Windows of a minute each half minute, with made estimates of both channels from counts and numbers of their intervals.
_BREATHS = RR_SQL + """,
bw AS (SELECT *, min(t_s) OVER (PARTITION BY session_id) AS t0, max(t_s) OVER (PARTITION BY session_id) AS t1 FROM rr),
bk AS (SELECT *, unnest(generate_series(greatest(0, CAST(floor((t_s - t0 - 60.0) / 30.0) AS BIGINT) + 1), CAST(floor((t_s - t0) / 30.0) AS BIGINT))) AS k FROM bw),
bi AS (
  SELECT session_id, k, t0 + k * 30.0::DOUBLE AS start_s, t0 + k * 30.0::DOUBLE + 60.0::DOUBLE AS end_s, avg(60000.0::DOUBLE / rr_ms) AS hr_bpm,
         CASE WHEN count(*) % 13 > 0 THEN 5 + (count(*) % 9) * 0.5::DOUBLE END AS rate_brpm, 5 + (count(*) % 9) * 0.5::DOUBLE + (max(n) % 11 - 5) AS amplitude_brpm
  FROM bk WHERE t0 + k * 30.0::DOUBLE <= t1 - 30.0 GROUP BY session_id, k, t0),
bo AS (SELECT bi.session_id, k, sum(greatest(0.0, least(bi.end_s, seg.end_s) - greatest(bi.start_s, seg.start_s))) AS o FROM bi JOIN seg ON seg.session_id = bi.session_id AND seg.start_s < bi.end_s AND seg.end_s > bi.start_s GROUP BY 1, 2),
bg AS (
  SELECT bi.*, coalesce(o, 0.0) / 60.0 AS excluded_fraction, CASE WHEN coalesce(o, 0.0) / 60.0 > 0.25 THEN 'excluded signal' WHEN hr_bpm > 110 THEN 'heart rate' WHEN rate_brpm IS NULL THEN 'no frequency'
         WHEN abs(rate_brpm - amplitude_brpm) > 4 THEN 'channels differ' END AS gate
  FROM bi LEFT JOIN bo ON bo.session_id = bi.session_id AND bo.k = bi.k),
bx AS (SELECT *, CASE WHEN gate IS NULL THEN (rate_brpm + amplitude_brpm) / 2 END AS brpm FROM bg)"""


def _breaths(spark, sf_dir):
    n = F.count("*") % 9 * 0.5 + 5
    w = series.sliding(rr_series(spark, sf_dir), 60.0, 30.0).groupBy("session_id", F.col("window").alias("k"), F.col("window_start_s").alias("start_s"))
    w = w.agg(F.avg(60000.0 / F.col("rr_ms")).alias("hr_bpm"), F.when(F.count("*") % 13 > 0, n).alias("rate_brpm"), (n + F.max("n") % 11 - 5).alias("amplitude_brpm"))
    return breathing.gated(w.withColumn("end_s", F.col("start_s") + 60.0), excluded(beats(spark, sf_dir)), 60.0)


@R.add(_BREATHS + " SELECT session_id, k, round(excluded_fraction, 6) AS excluded_fraction, gate, round(brpm, 6) AS brpm FROM bx")
def respiration_gates(spark, sf_dir):
    return tidy(_breaths(spark, sf_dir).select("session_id", "k", "excluded_fraction", "gate", "brpm"))


@R.add(
    _BREATHS
    + """,
bu AS (SELECT *, brpm BETWEEN 4.5 AND 7.5 AS slow, row_number() OVER (PARTITION BY session_id ORDER BY start_s) AS r FROM bx WHERE gate IS NULL),
br AS (SELECT session_id, r - row_number() OVER (PARTITION BY session_id ORDER BY r) AS run, r, brpm FROM bu WHERE slow),
bl AS (SELECT session_id, run, count(*) AS c, min(r) AS f, quantile_cont(brpm, 0.5) AS rate FROM br GROUP BY 1, 2 HAVING count(*) >= 3),
bp AS (SELECT session_id, rate FROM bl QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY c DESC, f) = 1),
bs AS (SELECT session_id, count(*) AS n_windows, count(*) FILTER (gate IS NULL) AS n_used, quantile_cont(brpm, 0.5) AS m, quantile_cont(brpm, 0.05) AS lo, quantile_cont(brpm, 0.95) AS hi FROM bx GROUP BY 1)
SELECT bs.session_id, n_windows, n_used, CASE WHEN n_used >= 5 THEN round(m, 6) END AS median_brpm, CASE WHEN n_used >= 5 THEN round(lo, 6) END AS p5_brpm, CASE WHEN n_used >= 5 THEN round(hi, 6) END AS p95_brpm,
       n_used >= 5 AND rate IS NOT NULL AS paced, CASE WHEN n_used >= 5 THEN round(rate, 6) END AS paced_brpm
FROM bs LEFT JOIN bp ON bp.session_id = bs.session_id"""
)
def respiration_fusion(spark, sf_dir):
    return tidy(breathing.summary(_breaths(spark, sf_dir)))


@R.add()
def artifact_classes(spark, sf_dir):
    return spectral.artifact_classes(raw_intervals(spark, sf_dir)).groupBy("session_id", "class").agg(F.count("*").alias("n"))


@R.add()
def artifact_correction(spark, sf_dir):
    return spectral.correct(spectral.artifact_classes(raw_intervals(spark, sf_dir)))


@R.add()
def recovery_tau(spark, sf_dir):
    r = rr_series(spark, sf_dir)
    return spectral.recovery_tau(r, hrv.rolling_peak(r))


@R.add(
    BEATS_SQL
    + """, d AS (SELECT session_id, t_s, value * 8 + 250 AS v FROM beats WHERE event_type = 'purchase'),
c AS (SELECT raw.session_id, raw.n, rr_ms, v, row_number() OVER (PARTITION BY raw.session_id, raw.n ORDER BY abs(raw.end_s - d.t_s), d.t_s) AS k
      FROM raw JOIN d ON d.session_id = raw.session_id AND abs(raw.end_s - d.t_s) <= 0.5)
SELECT session_id, count(*) AS n, round(avg(abs(rr_ms - v)), 6) AS mean_abs_ms, round(100.0 * avg(CASE WHEN abs(rr_ms - v) <= 50 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS within_pct FROM c WHERE k = 1 GROUP BY 1"""
)
def device_agreement(spark, sf_dir):
    device = beats(spark, sf_dir).where("event_type = 'purchase'").select("session_id", "t_s", (F.col("value") * 8 + 250).alias("value"))
    return tidy(spectral.device_agreement(series.nearest(raw_intervals(spark, sf_dir), device, 0.5)))


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return streams.read_folder(spark, sf_dir, schema, "events.parquet", "ts")


def _ran(stream, mode="complete"):
    return streams.run_available(stream, new_folder(stream.sparkSession, "stream"), mode)


@R.add("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    s = streams.tumbling(_stream(spark, sf_dir), "ts", "value", "1 day", "10 minutes", "event_type")
    return _ran(s).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@R.add("WITH e AS (SELECT value, unnest(generate_series(CAST(floor(epoch(ts) / 43200) AS BIGINT) - 1, CAST(floor(epoch(ts) / 43200) AS BIGINT))) AS k FROM events) SELECT CAST(to_timestamp(k * 43200) AT TIME ZONE 'UTC' AS TIMESTAMP) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM e GROUP BY 1")
def stream_sliding(spark, sf_dir):
    s = streams.sliding(_stream(spark, sf_dir), "ts", "value", "24 hours", "12 hours")
    return _ran(s).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"))


@R.add(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b, event_id FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_session(spark, sf_dir):
    s = streams.sessions(_stream(spark, sf_dir), "ts", "6 hours", "1 hour", "user_id")
    return _ran(s).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@R.add("SELECT user_id, event_type, CAST(date_trunc('day', min(ts)) AS TIMESTAMP) AS day FROM events WHERE value > 300 GROUP BY user_id, event_type, date_trunc('day', ts)")
def stream_dedup(spark, sf_dir):
    s = _stream(spark, sf_dir).where("value > 300").withColumn("day", F.date_trunc("day", "ts"))
    return _ran(streams.deduplicated(s, "ts", ["user_id", "event_type", "day"], "2 days").select("user_id", "event_type", F.col("day").cast("timestamp_ntz").alias("day")), "append")


@R.add(
    """SELECT user_id, epoch_us(ts) AS t_us, (epoch_us(ts) - epoch_us(p)) / 1000.0::DOUBLE AS rr_ms FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL"""
)
def stream_stateful_rr(spark, sf_dir):
    s = streams.intervals(_stream(spark, sf_dir).select("user_id", "ts"), "user_id", "ts")
    return _ran(s, "append")


@R.add("SELECT event_id, c_name FROM events JOIN customer ON c_custkey = user_id")
def stream_static_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return _ran(_stream(spark, sf_dir).select("event_id", "user_id").join(c, "user_id").select("event_id", "c_name"), "append")


@R.add("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def stream_write_new(spark, sf_dir):
    target = new_folder(spark, "new")
    s = _stream(spark, sf_dir).select(F.concat_ws(":", "user_id", "event_type").alias("key"), "user_id")
    streams.each_batch(s, streams.write_new(f"{target}/table", "key"), f"{target}/state")
    return spark.read.parquet(f"{target}/table").groupBy("user_id").agg(F.count("*").alias("n"))


@R.add("SELECT user_id, count(*) AS n, round(max(value), 6) AS most FROM events GROUP BY 1")
def stream_replace(spark, sf_dir):
    """Every batch replaces the rows of the users that it has, in a table of buckets."""
    target = new_folder(spark, "replaced")
    s = _stream(spark, sf_dir).select("user_id", "value")
    streams.each_batch(s, streams.replace_keys(f"{target}/table", "user_id", 8), f"{target}/state")
    return tidy(spark.read.parquet(f"{target}/table").groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("most")))


@R.add(
    BEATS_SQL
    + """ SELECT session_id, n, round(rr_ms, 6) AS rr_ms FROM raw
WHERE EXISTS (SELECT 1 FROM seg WHERE seg.session_id = raw.session_id AND raw.start_s < seg.end_s AND raw.end_s > seg.start_s)"""
)
def excluded_recovered(spark, sf_dir):
    b = beats(spark, sf_dir)
    return tidy(series.overlap_join(series.intervals(b), excluded(b), "left_semi").select("session_id", "n", "rr_ms"))


@R.add()
def recording_variability(spark, sf_dir):
    return recording.variability(recording.process(traces(spark, sf_dir), TRACE_HZ))


@R.add()
def recording_quality(spark, sf_dir):
    return recording.quality_windows(traces(spark, sf_dir), TRACE_HZ)


@R.add()
def detector_chain(spark, sf_dir):
    return recording.detection(recording.summaries(traces(spark, sf_dir), TRACE_HZ))


@R.add()
def beat_correction(spark, sf_dir):
    return recording.correction_summary(recording.correction(beats(spark, sf_dir)).where("kind = 'raw'"))
