"""Queries over interval series, their variability and their windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hrv, series
from .adapter import BEATS_SQL, RR_SQL, beats, excluded, raw_intervals, rr_series
from .registry import Registry, tidy

R = Registry()


@R.add(
    RR_SQL
    + """
SELECT session_id, count(*) AS n_beats, CAST(sum(CASE WHEN discontinuity THEN 1 ELSE 0 END) AS BIGINT) AS n_seams,
  round(avg(rr_ms), 6) AS mean_rr_ms, round(60000.0 / avg(rr_ms), 6) AS mean_hr_bpm, round(stddev_samp(rr_ms), 6) AS sdnn_ms,
  round(sqrt(avg(d_ms * d_ms)), 6) AS rmssd_ms,
  round(avg(CASE WHEN d_ms IS NULL THEN NULL WHEN abs(d_ms) > 50 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS pnn50_pct,
  round(CASE WHEN count(d_ms) >= 10 THEN sqrt(0.5 * var_samp(d_ms)) END, 6) AS sd1_ms,
  round(CASE WHEN count(d_ms) >= 10 THEN sqrt(greatest(0.0, 2 * var_samp(rr_ms) - 0.5 * var_samp(d_ms))) END, 6) AS sd2_ms,
  round(CASE WHEN count(d_ms) >= 10 AND 2 * var_samp(rr_ms) - 0.5 * var_samp(d_ms) > 0
        THEN sqrt(0.5 * var_samp(d_ms)) / sqrt(greatest(0.0, 2 * var_samp(rr_ms) - 0.5 * var_samp(d_ms))) END, 6) AS sd1_sd2_ratio
FROM dd GROUP BY session_id"""
)
def hrv_time_domain(spark, sf_dir):
    return tidy(hrv.time_domain(rr_series(spark, sf_dir)))


@R.add(RR_SQL + " SELECT session_id, n, round(t_s, 6) AS t_s, round(rr_ms, 6) AS rr_ms, discontinuity FROM rr")
def rr_build(spark, sf_dir):
    return tidy(rr_series(spark, sf_dir))


@R.add(
    RR_SQL
    + """
SELECT session_id, count(*) FILTER (fate = 'kept') AS n_kept, count(*) FILTER (fate = 'excluded') AS dropped_excluded,
  count(*) FILTER (fate = 'ceiling') AS dropped_ceiling, count(*) FILTER (fate = 'floor') AS dropped_floor
FROM fated GROUP BY 1"""
)
def rr_drop_counts(spark, sf_dir):
    b = beats(spark, sf_dir)
    return series.drop_counts(b, excluded(b))


@R.add(
    RR_SQL
    + """,
runs AS (SELECT *, sum(CASE WHEN discontinuity OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS r
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n) AS rn FROM rr))
SELECT session_id, count(*) AS n_beats, round(min(t_s), 6) AS start_s, round(max(t_s), 6) AS end_s FROM runs GROUP BY session_id, r HAVING count(*) >= 4"""
)
def rr_runs(spark, sf_dir):
    return tidy(series.runs(rr_series(spark, sf_dir)).drop("run_id"))


@R.add(
    BEATS_SQL
    + """
SELECT session_id, n, round(rr_ms, 6) AS rr_ms FROM raw
WHERE NOT EXISTS (SELECT 1 FROM seg WHERE seg.session_id = raw.session_id AND raw.start_s < seg.end_s AND raw.end_s > seg.start_s)"""
)
def rr_exclusion_anti(spark, sf_dir):
    b = beats(spark, sf_dir)
    return tidy(series.overlap_join(series.intervals(b), excluded(b)).select("session_id", "n", "rr_ms"))


@R.add(
    RR_SQL
    + """,
dev AS (SELECT b.session_id, b.t_s, b.value FROM beats b WHERE event_type = 'purchase'),
c AS (SELECT rr.session_id, rr.n, rr.rr_ms, dev.value AS v, abs(rr.t_s - dev.t_s) AS gap,
        row_number() OVER (PARTITION BY rr.session_id, rr.n ORDER BY abs(rr.t_s - dev.t_s), dev.t_s) AS k
      FROM rr JOIN dev ON rr.session_id = dev.session_id AND dev.t_s BETWEEN rr.t_s - 0.6 AND rr.t_s + 0.6)
SELECT session_id, n, round(rr_ms, 6) AS rr_ms, round(v, 6) AS nearest_value, round(gap, 6) AS distance_s FROM c WHERE k = 1 AND gap <= 0.5"""
)
def device_rr_nearest(spark, sf_dir):
    b = beats(spark, sf_dir)
    device = b.where(F.col("event_type") == "purchase").select("session_id", "t_s", "value")
    return tidy(series.nearest(build(b), device, 0.5).select("session_id", "n", "rr_ms", "nearest_value", "distance_s"))


def build(b):
    return series.build_rr(b, excluded(b))


@R.add(RR_SQL + " SELECT session_id, n, round(60000.0 / rr_ms, 6) AS hr_bpm FROM rr")
def inst_hr(spark, sf_dir):
    return tidy(rr_series(spark, sf_dir).select("session_id", "n", (60000.0 / F.col("rr_ms")).alias("hr_bpm")))


_ANCHORED = (
    RR_SQL
    + """,
a AS (SELECT *, CAST(floor((t_s - t0) / 60.0) AS BIGINT) AS w FROM (SELECT *, min(t_s) OVER (PARTITION BY session_id) AS t0 FROM dd))"""
)


@R.add(_ANCHORED + ' SELECT session_id, w AS "window", round(stddev_samp(rr_ms), 6) AS sdnn_ms, count(*) AS n FROM a GROUP BY 1, 2 HAVING count(*) >= 10')
def sdnn_per_minute(spark, sf_dir):
    return tidy(hrv.windowed_sdnn(rr_series(spark, sf_dir)))


@R.add(_ANCHORED + ' SELECT session_id, w AS "window", round(60000.0 / avg(rr_ms), 6) AS hr_bpm, count(*) AS n FROM a GROUP BY 1, 2 HAVING count(*) >= 10')
def hr_per_minute(spark, sf_dir):
    return tidy(hrv.per_minute_hr(rr_series(spark, sf_dir)))


@R.add(
    _ANCHORED
    + """, b AS (SELECT *, lag(w) OVER (PARTITION BY session_id ORDER BY n) AS pw FROM a)
SELECT session_id, w AS "window", round(sqrt(avg(CASE WHEN pw = w THEN d_ms * d_ms END)), 6) AS rmssd_ms, count(CASE WHEN pw = w THEN d_ms END) AS n
FROM b GROUP BY 1, 2 HAVING count(CASE WHEN pw = w THEN d_ms END) >= 10"""
)
def rmssd_per_minute(spark, sf_dir):
    return tidy(hrv.per_minute_rmssd(rr_series(spark, sf_dir)))


_SLIDING = (
    RR_SQL
    + """,
ends AS (SELECT session_id, min(t_s) AS t0, max(t_s) AS t1, count(*) AS m FROM rr GROUP BY 1),
win AS (SELECT session_id, t0, t1, m, unnest(generate_series(0, CAST(floor((t1 - t0) / {step}) AS BIGINT) + 1)) AS w FROM ends),
sw AS (
  SELECT win.session_id, w, m, t0 + w * {step} AS window_start_s, 60000.0 / avg(rr_ms) AS hr, count(*) AS n
  FROM win JOIN rr ON rr.session_id = win.session_id AND floor((rr.t_s - t0) / {step}) >= w AND floor((rr.t_s - t0 - {width}) / {step}) + 1 <= w
  WHERE t0 + w * {step} <= t1 - {width} + {step}
  GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10)"""
)


@R.add(_SLIDING.format(width="45.0", step="5.0") + ' SELECT session_id, w AS "window", round(window_start_s, 6) AS window_start_s, round(hr, 6) AS hr_bpm, n FROM sw')
def sustained_hr_45_5(spark, sf_dir):
    return tidy(hrv.sustained_hr(rr_series(spark, sf_dir)))


@R.add(_SLIDING.format(width="60.0", step="10.0") + " SELECT session_id, round(min(hr), 6) AS lowest_hr_bpm FROM sw WHERE m >= 20 GROUP BY 1")
def lowest_sustained_60_10(spark, sf_dir):
    return tidy(hrv.lowest_sustained_hr(rr_series(spark, sf_dir)))


@R.add(
    RR_SQL
    + """,
q AS (
  SELECT session_id, max(t_s) OVER w AS e, 60000.0 / avg(rr_ms) OVER w AS hr, count(*) OVER w AS n, count(*) OVER (PARTITION BY session_id) AS m
  FROM (SELECT *, CAST(round(t_s * 100000) AS BIGINT) AS c FROM rr)
  WINDOW w AS (PARTITION BY session_id ORDER BY c RANGE BETWEEN CURRENT ROW AND 2999999 FOLLOWING)),
p AS (SELECT *, max(hr) OVER (PARTITION BY session_id) AS peak FROM q WHERE n >= 5 AND m >= 10)
SELECT session_id, round(max(peak), 6) AS peak_hr_bpm, round(max(CASE WHEN hr >= peak - 1.0 THEN e END), 6) AS peak_end_s FROM p GROUP BY 1"""
)
def rolling_peak_30(spark, sf_dir):
    return tidy(hrv.rolling_peak(rr_series(spark, sf_dir)))


@R.add(
    BEATS_SQL
    + """,
l AS (
  SELECT session_id, n, rr_ms, list(rr_ms) OVER (PARTITION BY session_id ORDER BY n ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b,
         list(rr_ms) OVER (PARTITION BY session_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS f FROM raw),
m AS (SELECT *, len(list_concat(coalesce(b, []), coalesce(f, []))) AS k, list_median(list_concat(coalesce(b, []), coalesce(f, []))) AS med FROM l)
SELECT session_id, n, round(CASE WHEN k >= 3 AND med > 0 THEN 100.0 * (rr_ms - med) / med END, 6) AS prematurity_pct FROM m"""
)
def prematurity(spark, sf_dir):
    return tidy(hrv.prematurity(raw_intervals(spark, sf_dir)))


@R.add(
    RR_SQL
    + """
SELECT session_id, n, round(rr_ms, 6) AS rr_ms, round(nx, 6) AS next_ms
FROM (SELECT *, lead(rr_ms) OVER (PARTITION BY session_id ORDER BY n) AS nx, lead(discontinuity) OVER (PARTITION BY session_id ORDER BY n) AS s FROM rr) WHERE NOT s"""
)
def poincare_pairs(spark, sf_dir):
    return tidy(hrv.poincare_pairs(rr_series(spark, sf_dir)))


@R.add(
    RR_SQL
    + """,
h AS (SELECT session_id, rr_ms, min(rr_ms) OVER (PARTITION BY session_id) AS lo, max(rr_ms) OVER (PARTITION BY session_id) AS hi FROM rr)
SELECT session_id, CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((rr_ms - lo) / ((hi - lo) / 40)) AS BIGINT), 39) END AS bin, count(*) AS n FROM h GROUP BY 1, 2"""
)
def histogram40(spark, sf_dir):
    return hrv.histogram(rr_series(spark, sf_dir))


COSEN_SQL = (
    RR_SQL
    + """,
i AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n) - 1 AS i FROM rr),
st AS (SELECT session_id, i AS s, t_s AS start_s FROM i WHERE i % 5 = 0),
mem AS (SELECT st.session_id, st.s, st.start_s, i.i - st.s AS p, i.rr_ms, i.discontinuity FROM st JOIN i ON i.session_id = st.session_id AND i.i BETWEEN st.s AND st.s + 29),
sz AS (
  SELECT session_id, s, min(start_s) AS start_s, avg(rr_ms) AS mean, stddev_samp(rr_ms) AS sd, bool_or(discontinuity AND p > 0) AS has_seam FROM mem GROUP BY 1, 2 HAVING count(*) = 30),
pr AS (
  SELECT a.session_id, a.s, count(*) FILTER (abs(a.rr_ms - b.rr_ms) < 0.2 * sd) AS nb,
         count(*) FILTER (abs(a.rr_ms - b.rr_ms) < 0.2 * sd AND abs(a2.rr_ms - b2.rr_ms) < 0.2 * sd) AS na
  FROM sz JOIN mem a ON a.session_id = sz.session_id AND a.s = sz.s JOIN mem b ON b.session_id = a.session_id AND b.s = a.s AND b.p > a.p
  LEFT JOIN mem a2 ON a2.session_id = a.session_id AND a2.s = a.s AND a2.p = a.p + 1
  LEFT JOIN mem b2 ON b2.session_id = a.session_id AND b2.s = a.s AND b2.p = b.p + 1
  GROUP BY 1, 2),
cw AS (
  SELECT sz.session_id, CAST(sz.s / 5 AS BIGINT) AS k, start_s, has_seam, sd / mean AS cv,
         CASE WHEN sd > 0 AND na > 0 AND nb > 0 THEN -ln(na / nb::DOUBLE) + ln(2 * 0.2 * sd) - ln(mean) END AS cosen
  FROM sz JOIN pr ON sz.session_id = pr.session_id AND sz.s = pr.s)"""
)


@R.add(COSEN_SQL + " SELECT session_id, k, has_seam, round(cv, 6) AS cv, round(cosen, 6) AS cosen FROM cw")
def cosen_windows(spark, sf_dir):
    return tidy(hrv.cosen(hrv.contiguous_entropy_windows(rr_series(spark, sf_dir))).select("session_id", "k", "has_seam", "cv", "cosen"))
