"""Queries over activity metrics, comparison and report data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import activity, compare, hrv, profiles, report
from ..session import table
from .adapter import BEATS_SQL, RR_SQL, beats, excluded, rr_series
from .registry import Registry, tidy
from .rhythm import _ANCHORED

R = Registry()


@R.add(RR_SQL + " SELECT session_id, round(regr_slope(60000.0 / rr_ms, t_s) * 60.0, 6) AS bpm_per_min, count(*) AS n FROM rr GROUP BY 1 HAVING count(*) >= 30")
def hr_trend(spark, sf_dir):
    return tidy(activity.hr_trend(rr_series(spark, sf_dir)))


@R.add(RR_SQL + " SELECT session_id, round(regr_slope(60000.0 / rr_ms, t_s) * 60.0, 6) AS bpm_per_min, count(*) AS n FROM (SELECT *, min(t_s) OVER (PARTITION BY session_id) AS t0 FROM rr) WHERE t_s - t0 >= 300 GROUP BY 1 HAVING count(*) >= 60")
def cardiac_drift(spark, sf_dir):
    return tidy(activity.hr_trend(rr_series(spark, sf_dir), 300.0, 60))


_MINUTES = _ANCHORED + ", pm AS (SELECT session_id, w, 60000.0 / avg(rr_ms) AS hr, count(*) AS n FROM a GROUP BY 1, 2 HAVING count(*) >= 10)"


@R.add(
    _MINUTES
    + """, tl AS (SELECT session_id, w, regr_slope(hr, w::DOUBLE) OVER q AS s, avg(hr) OVER q AS m, count(*) OVER q AS n FROM pm WINDOW q AS (PARTITION BY session_id ORDER BY w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT session_id, min(w) AS settled_window, round(arg_min(m, w), 6) AS settled_hr_bpm FROM tl WHERE n >= 3 AND abs(s) <= 0.5 GROUP BY 1"""
)
def settling(spark, sf_dir):
    return tidy(activity.settling(hrv.per_minute_hr(rr_series(spark, sf_dir))))


@R.add(
    _MINUTES
    + """, st AS (SELECT session_id, w, hr - lag(hr) OVER q AS s, lag(hr) OVER q AS b, lead(hr) OVER q AS a FROM pm WINDOW q AS (PARTITION BY session_id ORDER BY w))
SELECT session_id, round(s, 6) AS step_bpm, w AS "window" FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY s DESC, w) AS k FROM st WHERE s >= 8 AND a > b + 0.5 * s) WHERE k = 1"""
)
def orthostatic_step(spark, sf_dir):
    return tidy(activity.orthostatic_step(hrv.per_minute_hr(rr_series(spark, sf_dir))))


@R.add(
    RR_SQL
    + """, z AS (SELECT session_id, rr_ms, 100.0 * (60000.0 / rr_ms) / 190.0 AS p FROM rr),
y AS (SELECT session_id, CAST((p >= 50)::INT + (p >= 60)::INT + (p >= 70)::INT + (p >= 80)::INT + (p >= 90)::INT AS BIGINT) AS zone, sum(rr_ms) AS t FROM z GROUP BY 1, 2)
SELECT session_id, zone, round(t / sum(t) OVER (PARTITION BY session_id), 6) AS fraction FROM y"""
)
def hr_zones(spark, sf_dir):
    return tidy(activity.zones(rr_series(spark, sf_dir), F.lit(190.0)))


@R.add(
    RR_SQL
    + """,
q AS (SELECT session_id, max(t_s) OVER w AS we, 60000.0 / avg(rr_ms) OVER w AS hr, count(*) OVER w AS n, count(*) OVER (PARTITION BY session_id) AS m FROM (SELECT *, CAST(round(t_s * 100000) AS BIGINT) AS c FROM rr) WINDOW w AS (PARTITION BY session_id ORDER BY c RANGE BETWEEN CURRENT ROW AND 2999999 FOLLOWING)),
p AS (SELECT *, max(hr) OVER (PARTITION BY session_id) AS peak FROM q WHERE n >= 5 AND m >= 10),
e AS (SELECT session_id, max(peak) AS peak, max(CASE WHEN hr >= peak - 1.0 THEN we END) AS pe FROM p GROUP BY 1)
SELECT rr.session_id, round(CASE WHEN count(*) FILTER (t_s >= pe + 50 AND t_s < pe + 70) >= 3 THEN max(peak) - 60000.0 / avg(rr_ms) FILTER (t_s >= pe + 50 AND t_s < pe + 70) END, 6) AS hrr60,
  round(CASE WHEN count(*) FILTER (t_s >= pe + 110 AND t_s < pe + 130) >= 3 THEN max(peak) - 60000.0 / avg(rr_ms) FILTER (t_s >= pe + 110 AND t_s < pe + 130) END, 6) AS hrr120
FROM rr JOIN e ON e.session_id = rr.session_id GROUP BY 1"""
)
def recovery_hrr(spark, sf_dir):
    r = rr_series(spark, sf_dir)
    return tidy(activity.recovery(r, hrv.rolling_peak(r)))


@R.add(
    RR_SQL
    + """, h AS (SELECT session_id, CAST(floor(t_s / 5.0) AS BIGINT) AS k, 60000.0 / avg(rr_ms) AS hr FROM rr GROUP BY 1, 2 HAVING count(*) >= 3),
m AS (SELECT session_id, CAST(floor(t_s / 5.0) AS BIGINT) AS k, avg(value) AS mv FROM beats GROUP BY 1, 2), j AS (SELECT h.session_id, hr, mv FROM h JOIN m ON m.session_id = h.session_id AND m.k = h.k WHERE mv IS NOT NULL)
SELECT session_id, count(*) AS n_windows, round(CASE WHEN count(*) >= 6 AND stddev_pop(hr) > 0 AND stddev_pop(mv) > 0 THEN corr(hr, mv) END, 6) AS r FROM j GROUP BY 1"""
)
def motion_coupling(spark, sf_dir):
    w = beats(spark, sf_dir).withColumn("k", F.floor(F.col("t_s") / 5.0).cast("long")).groupBy("session_id", "k").agg(F.avg("value").alias("movement"))
    return tidy(activity.motion_coupling(rr_series(spark, sf_dir), w))


@R.add(
    RR_SQL
    + """, m AS (SELECT session_id, min(t_s) AS m FROM beats WHERE event_type = 'view' AND beat >= 100 GROUP BY 1), d AS (SELECT rr.session_id, rr_ms, t_s - m AS x FROM rr JOIN m ON m.session_id = rr.session_id),
o AS (SELECT session_id, CASE WHEN count(*) FILTER (x >= -60 AND x < 0) >= 5 THEN 60000.0 / avg(rr_ms) FILTER (x >= -60 AND x < 0) END AS b, CASE WHEN count(*) FILTER (x >= 5 AND x < 65) >= 5 THEN 60000.0 / avg(rr_ms) FILTER (x >= 5 AND x < 65) END AS a FROM d GROUP BY 1)
SELECT session_id, round(b, 6) AS before_bpm, round(a, 6) AS after_bpm, round(a - b, 6) AS rise_bpm FROM o"""
)
def orthostatic(spark, sf_dir):
    m = beats(spark, sf_dir).where((F.col("event_type") == "view") & (F.col("beat") >= 100))
    return tidy(activity.orthostatic(rr_series(spark, sf_dir), m))


_PERSON = "SELECT c_custkey AS person_id, c_acctbal AS b, c_nationkey AS k FROM customer"


@R.add(
    f"""WITH p AS ({_PERSON}), q AS (SELECT person_id, coalesce(CASE WHEN k % 3 = 0 THEN 190.0::DOUBLE END, 208 - 0.7 * CASE WHEN k % 5 <> 0 THEN 20.0 + k END, 185.0) AS mx, CASE WHEN k % 2 = 0 THEN 55.0::DOUBLE ELSE 60.0 END AS rest, 100 + k * 3.0::DOUBLE AS hr FROM p)
SELECT person_id, round(mx, 6) AS max_hr, rest, round(greatest(0.0, (hr - rest) / greatest(1.0, mx - rest)), 6) AS reserve, CASE WHEN greatest(0.0, (hr - rest) / greatest(1.0, mx - rest)) > 0.7 THEN NULL ELSE hr END AS rmssd_ms FROM q"""
)
def reserve_suppression(spark, sf_dir):
    k = F.col("c_nationkey")
    p = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("person_id"),
        activity.effective_max_hr(F.when(k % 3 == 0, 190).otherwise(0), F.when(k % 5 != 0, 20.0 + k)).alias("max_hr"),
        activity.effective_rest(F.when(k % 2 == 0, 55)).alias("rest"),
        (100 + k * 3.0).alias("rmssd_ms"),
    )
    p = p.withColumn("reserve", activity.reserve(F.col("rmssd_ms"), F.col("rest"), F.col("max_hr")))
    return tidy(activity.suppress(p, F.col("reserve") > activity.SUPPRESS_RESERVE, ["rmssd_ms"]))


_PROFILES = ", ".join(f"('{k}', {lo}, {hi})" for k, _, lo, hi, _ in activity.PROFILES)


@R.add(
    f"""WITH pr(profile, lo, hi) AS (VALUES {_PROFILES}), t AS (SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN 'supine' WHEN 1 THEN 'running' WHEN 2 THEN 'sleep' ELSE 'custom' END AS profile, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size END AS own FROM part)
SELECT p_partkey, t.profile, CAST(coalesce(nullif(own, 0), lo) AS BIGINT) AS expected_hr_min, CAST(hi AS BIGINT) AS expected_hr_max FROM t LEFT JOIN pr ON pr.profile = t.profile"""
)
def profile_resolve(spark, sf_dir):
    s = F.col("p_size")
    t = table(spark, sf_dir, "part").select("p_partkey", F.when(s % 10 == 0, "supine").when(s % 10 == 1, "running").when(s % 10 == 2, "sleep").otherwise("custom").alias("profile"), F.when(s % 4 == 0, 0).otherwise(s).alias("expected_hr_min"), F.lit(0).alias("expected_hr_max"))
    return tidy(activity.resolve(t, activity.profiles(spark)))


@R.add(
    """WITH s AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice AS price, CAST(length(o_orderpriority) AS DOUBLE) AS size FROM orders),
l AS (SELECT o_custkey, o_orderdate, o_orderkey, 'price' AS metric, price AS value FROM s UNION ALL SELECT o_custkey, o_orderdate, o_orderkey, 'size', size FROM s)
SELECT *, round(value - first_value(value) OVER (PARTITION BY o_custkey, metric ORDER BY o_orderdate, o_orderkey), 6) AS delta FROM (SELECT o_custkey, o_orderdate, o_orderkey, metric, round(value, 6) AS value FROM l)"""
)
def comparison_rows(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("price"), F.length("o_orderpriority").cast("double").alias("size"))
    return tidy(compare.deltas(s, ["price", "size"], ["o_custkey"], ["o_orderdate", "o_orderkey"]))


@R.add(
    """WITH w AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER q AS k, avg(o_totalprice) OVER r AS m, stddev_samp(o_totalprice) OVER r AS sd, count(o_totalprice) OVER r AS n, count(*) OVER (PARTITION BY o_custkey) AS t
  FROM orders WINDOW q AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), r AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT o_custkey, o_orderkey, round(CASE WHEN k >= 5 AND n >= 3 THEN m END, 4) AS baseline, round(CASE WHEN k >= 5 AND n >= 3 THEN m - 1.96 * sd END, 4) AS low, round(CASE WHEN k >= 5 AND n >= 3 THEN m + 1.96 * sd END, 4) AS high, t < 5 AS provisional FROM w"""
)
def baseline_band(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return tidy(compare.trend(o, "o_totalprice", ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate", "o_totalprice"), 4)


@R.add(
    """WITH a AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS op, count(DISTINCT o_orderpriority) AS ks, max(o_totalprice) AS hi, min(o_totalprice) AS lo, bool_or(o_totalprice < 2000) AS rc FROM orders GROUP BY 1),
w AS (SELECT o_custkey, n, list_filter([CASE WHEN n < 2 THEN 'fewer than two sessions' END, CASE WHEN op > 0 THEN 'unfinished session' END, CASE WHEN ks > 1 THEN 'mixed activities' END, CASE WHEN lo > 0 AND hi / lo > 1.25 THEN 'durations differ' END,
  CASE WHEN rc THEN 'reduced confidence' END], lambda x: x IS NOT NULL) AS w FROM a)
SELECT o_custkey, n, array_to_string(w, ';') AS warnings, NOT list_has_any(w, ['fewer than two sessions', 'unfinished session', 'mixed activities']) AS comparable FROM w"""
)
def comparison_guards(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("comparison_key"), F.col("o_totalprice").alias("duration_s"), (F.col("o_orderstatus") == "F").alias("done"), (F.col("o_totalprice") < 2000).alias("reduced_confidence"))
    return compare.guards(o, ["o_custkey"]).withColumn("warnings", F.array_join("warnings", ";"))


@R.add(
    RR_SQL
    + """, b AS (SELECT session_id, rr_ms, CAST(floor((row_number() OVER (PARTITION BY session_id ORDER BY t_s) - 1) * 50 / (count(*) OVER (PARTITION BY session_id))::DOUBLE) AS BIGINT) AS bucket FROM rr)
SELECT session_id, bucket, round(min(rr_ms), 6) AS low, round(max(rr_ms), 6) AS high FROM b GROUP BY 1, 2"""
)
def minmax_decimate(spark, sf_dir):
    return tidy(compare.decimate(rr_series(spark, sf_dir), "t_s", "rr_ms", 50))


_MINUTE_ROWS = """, e AS (SELECT session_id, CASE WHEN max(t_s) > 10800 THEN 5 ELSE 1 END AS w, max(t_s) AS t1 FROM rr GROUP BY 1),
g AS (SELECT session_id, w, unnest(generate_series(0, CAST(floor(t1 / (60 * w)) AS BIGINT))) AS bucket FROM e),
bt AS (SELECT rr.session_id, CAST(floor(t_s / (60 * w)) AS BIGINT) AS bucket, count(*) AS n, 60000.0 / avg(rr_ms) AS hr FROM rr JOIN e ON e.session_id = rr.session_id GROUP BY 1, 2),
ex AS (SELECT g.session_id, g.bucket, sum(greatest(0.0, least(end_s, (g.bucket + 1) * 60.0 * w) - greatest(start_s, g.bucket * 60.0 * w))) AS x FROM g JOIN seg ON seg.session_id = g.session_id GROUP BY 1, 2)"""


@R.add(
    RR_SQL
    + _MINUTE_ROWS
    + """
SELECT g.session_id, g.bucket, CAST(w AS BIGINT) AS width, coalesce(n, 0) AS n_beats, round(CASE WHEN n >= 5 * w THEN hr END, 6) AS hr_bpm, round(coalesce(x, 0), 6) AS excluded_s
FROM g LEFT JOIN bt ON bt.session_id = g.session_id AND bt.bucket = g.bucket LEFT JOIN ex ON ex.session_id = g.session_id AND ex.bucket = g.bucket"""
)
def minute_table(spark, sf_dir):
    return tidy(compare.minute_table(rr_series(spark, sf_dir), excluded(beats(spark, sf_dir))))


_KEYS = tuple(k for k, *_ in activity.PROFILES)
_NINE = ", ".join(f"({i}, '{k}', {'NULL' if m is None else m}, [{', '.join(repr(c) for c in activity.CAUTIONS.get(k, ()))}]::VARCHAR[], {str(k in ('running', 'cycling')).lower()})" for i, (k, _, _, _, m) in enumerate(activity.PROFILES))


@R.add(
    f"""WITH pr(i, profile, most, ca, hard) AS (VALUES {_NINE}),
s AS (SELECT o_orderkey, o_orderkey % 9 AS i, (o_orderkey % 100) / 100.0::DOUBLE AS x, 100 + o_orderkey % 90 AS hr FROM orders),
j AS (SELECT o_orderkey, profile, coalesce(x > most, false) AS na, hard AND greatest(0.0, (hr - 60.0) / 130.0) > 0.7 AS h, ca FROM s JOIN pr ON pr.i = s.i)
SELECT o_orderkey AS session_id, profile AS profile_key, na AS not_analysable, CASE WHEN na OR h THEN 'time,frequency,nonlinear' ELSE '' END AS suppressed, CASE WHEN na THEN '' ELSE array_to_string(ca, ',') END AS cautions FROM j"""
)
def profile_rules(spark, sf_dir):
    k = F.col("o_orderkey")
    key = F.array(*map(F.lit, _KEYS))[(k % 9).cast("int")]
    s = table(spark, sf_dir, "orders").select(k.alias("session_id"), key.alias("profile_key"), (k % 100 / 100.0).alias("excluded_fraction"), (100 + k % 90).alias("mean_hr_bpm"), F.lit(60.0).alias("rest_hr"), F.lit(190.0).alias("max_hr"))
    return profiles.judged(s).select("session_id", "profile_key", "not_analysable", F.array_join("suppressed", ",").alias("suppressed"), F.array_join("cautions", ",").alias("cautions"))


def profile_inputs(spark, sf_dir) -> profiles.Inputs:
    """Sessions of the events, each of a profile by its number; movement is the mean value of five seconds."""
    b, rr = beats(spark, sf_dir), rr_series(spark, sf_dir)
    key = F.array(*map(F.lit, _KEYS))[(F.col("session_id") % 9).cast("int")]
    s = b.select("session_id").distinct().withColumns({"profile_key": key, "max_hr": F.lit(190.0), "max_hr_basis": F.lit("measured"), "excluded_fraction": F.lit(0.05), "lf_peak_hz": F.lit(0.1)})
    movement = b.withColumn("k", F.floor(F.col("t_s") / 5.0).cast("long")).groupBy("session_id", "k").agg(F.avg("value").alias("movement"))
    return profiles.Inputs(s, rr, b.where((F.col("event_type") == "view") & (F.col("beat") >= 100)).select("session_id", "t_s"), movement)


@R.add()
def profile_outputs(spark, sf_dir):
    out = profiles.outputs(profile_inputs(spark, sf_dir))
    return out.select("session_id", "profile_key", F.to_json("extras").alias("extras"))


@R.add(
    RR_SQL
    + _MINUTE_ROWS
    + """,
mt AS (SELECT *, CAST(floor((t_s - min(t_s) OVER (PARTITION BY session_id)) / 60.0) AS BIGINT) AS k, min(t_s) OVER (PARTITION BY session_id) AS t0 FROM dd),
md AS (SELECT *, CASE WHEN lag(k) OVER (PARTITION BY session_id ORDER BY n) = k THEN d_ms END AS d FROM mt),
mk AS (SELECT session_id, k, t0 + 60.0 * k AS start_s, CASE WHEN count(*) >= 10 THEN stddev_samp(rr_ms) END AS sdnn, CASE WHEN count(d) >= 10 THEN sqrt(avg(d * d)) END AS rmssd FROM md GROUP BY session_id, k, t0),
mb AS (SELECT mk.session_id, CAST(floor(start_s / (60.0 * w)) AS BIGINT) AS bucket, avg(sdnn) AS sdnn, avg(rmssd) AS rmssd FROM mk JOIN e ON e.session_id = mk.session_id GROUP BY 1, 2),
mq AS (SELECT beats.session_id, CAST(floor(t_s / (60.0 * w)) AS BIGINT) AS bucket, avg(k / 97.0::DOUBLE) AS sqi FROM beats JOIN e ON e.session_id = beats.session_id WHERE k IS NOT NULL GROUP BY 1, 2)
SELECT g.session_id, g.bucket, CAST(w AS BIGINT) AS width, coalesce(bt.n, 0) AS n_beats, round(CASE WHEN bt.n >= 5 * w THEN bt.hr END, 6) AS hr_bpm, round(coalesce(x, 0), 6) AS excluded_s, round(sdnn, 6) AS sdnn_ms, round(rmssd, 6) AS rmssd_ms, round(sqi, 6) AS sqi
FROM g LEFT JOIN bt ON bt.session_id = g.session_id AND bt.bucket = g.bucket LEFT JOIN ex ON ex.session_id = g.session_id AND ex.bucket = g.bucket
LEFT JOIN mb ON mb.session_id = g.session_id AND mb.bucket = g.bucket LEFT JOIN mq ON mq.session_id = g.session_id AND mq.bucket = g.bucket"""
)
def report_minutes(spark, sf_dir):
    b = beats(spark, sf_dir)
    windows = b.select("session_id", F.col("t_s").alias("start_s"), (F.col("k") / 97.0).alias("sqi_mean"))
    return tidy(report.minutes(rr_series(spark, sf_dir), excluded(b), windows))


@R.add(BEATS_SQL + " SELECT session_id, beat, place FROM (SELECT session_id, beat, row_number() OVER (PARTITION BY session_id ORDER BY value, beat) AS place FROM beats WHERE value IS NOT NULL) WHERE place <= 60")
def least_likely_beats(spark, sf_dir):
    return tidy(report.least_likely(beats(spark, sf_dir), "value").select("session_id", "beat", "place"))


@R.add(
    BEATS_SQL
    + """,
du AS (SELECT session_id, max(t_s) AS d FROM beats GROUP BY 1), wo AS (SELECT session_id, t_s FROM beats WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY value, beat) = 1),
pl AS (SELECT session_id, 'opening' AS label, 0.0 AS s, d FROM du UNION ALL SELECT session_id, 'middle', (d - 10.0) / 2.0, d FROM du WHERE d > 30 UNION ALL SELECT session_id, 'closing', d - 10.0, d FROM du WHERE d > 20
  UNION ALL SELECT du.session_id, 'worst', greatest(0.0, least(t_s - 5.0, d - 10.0)), d FROM du JOIN wo ON wo.session_id = du.session_id),
sa AS (SELECT session_id, beat AS i, t_s, value AS x FROM beats),
hi AS (SELECT sa.session_id, label, i, t_s - s AS at_s, x, count(*) OVER (PARTITION BY sa.session_id, label) AS n FROM sa JOIN pl ON pl.session_id = sa.session_id AND t_s >= s AND t_s < s + least(10.0, d))
SELECT session_id, label, i, round(at_s, 6) AS at_s, round(x, 6) AS x FROM hi WHERE n >= 10"""
)
def report_strips(spark, sf_dir):
    b = beats(spark, sf_dir)
    worst = report.least_likely(b, "value", 1)
    where = report.places(b.groupBy("session_id").agg(F.max("t_s").alias("duration_s")), worst)
    return tidy(report.strips(b.select("session_id", F.col("beat").alias("i"), "t_s", F.col("value").alias("x")), where))


@R.add(
    BEATS_SQL
    + """, hs AS (SELECT session_id, beat AS epoch, CAST(k % 3 AS BIGINT) AS stage FROM beats WHERE beat % 10 <> 7),
hr AS (SELECT *, sum(CASE WHEN lag_s IS NOT DISTINCT FROM stage AND lag_e = epoch - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY epoch) AS run FROM (SELECT *, lag(stage) OVER w AS lag_s, lag(epoch) OVER w AS lag_e FROM hs WINDOW w AS (PARTITION BY session_id ORDER BY epoch)))
SELECT session_id, any_value(stage) AS stage, min(epoch) * 30.0::DOUBLE AS start_s, (max(epoch) + 1) * 30.0::DOUBLE AS end_s, count(*) AS epochs FROM hr GROUP BY session_id, run"""
)
def hypnogram_steps(spark, sf_dir):
    h = beats(spark, sf_dir).where("beat % 10 <> 7").select("session_id", F.col("beat").alias("epoch"), (F.col("k") % 3).alias("stage"))
    return tidy(report.steps(h, "stage"))


_SIXTEEN = {
    "analysed_min": "CASE WHEN n <> 0 THEN n / 60.0::DOUBLE END", "excluded_s": "t", "pct_corrected": "d * 100", "mean_hr_bpm": "sqrt(p)", "ectopy_per_hour": "q", "resting_hr_bpm": "q + 1", "rmssd_ms": "q - 5",
    "ln_rmssd": "CASE WHEN q - 5 > 0 THEN ln(q - 5) END", "sdnn_ms": "p", "pnn50_pct": "d", "sd1_ms": "q", "sd2_ms": "p", "sd1_sd2_ratio": "q / sqrt(p)", "sampen": "t", "dfa_alpha1": "d", "lf_hf": "CASE WHEN q > 10 THEN sqrt(p) / q END",
}


@R.add(
    """WITH a AS (SELECT o_custkey, o_orderkey, CAST(count(*) AS DOUBLE) AS n, avg(CAST(l_tax AS DOUBLE)) AS t, avg(CAST(l_discount AS DOUBLE)) AS d, avg(CAST(l_quantity AS DOUBLE)) AS q, avg(CAST(l_extendedprice AS DOUBLE)) AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
l AS ("""
    + " UNION ALL ".join(f"SELECT o_custkey, o_orderkey, {i + 1} AS place, '{m}' AS metric, {x} AS value FROM a" for i, (m, x) in enumerate(_SIXTEEN.items()))
    + """)
SELECT o_custkey, o_orderkey, CAST(place AS BIGINT) AS place, metric, round(value, 5) AS value, round(value - first_value(value) OVER (PARTITION BY o_custkey, metric ORDER BY o_orderkey), 5) AS delta FROM l"""
)
def comparison_table(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_tax", "l_discount", "l_quantity", "l_extendedprice")
    a = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(l, "o_orderkey").groupBy("o_custkey", "o_orderkey")
    a = a.agg(F.count("*").cast("double").alias("n"), *[F.avg(F.col(c).cast("double")).alias(k) for k, c in (("t", "l_tax"), ("d", "l_discount"), ("q", "l_quantity"), ("p", "l_extendedprice"))])
    q, p, t, d = (F.col(c) for c in "qptd")
    values = {"analysed_s": F.col("n"), "excluded_s": t, "pct_corrected": d * 100, "mean_hr_bpm": F.sqrt(p), "ectopy_per_hour": q, "resting_hr_bpm": q + 1, "rmssd_ms": q - 5, "sdnn_ms": p, "pnn50_pct": d, "sd1_ms": q, "sd2_ms": p, "sd1_sd2_ratio": q / F.sqrt(p), "sampen": t, "dfa_alpha1": d, "lf_hf": F.when(q > 10, F.sqrt(p) / q)}
    s = a.select("o_custkey", "o_orderkey", *[c.alias(k) for k, c in values.items()])
    return tidy(report.comparison(s, ["o_custkey"], ["o_orderkey"]).drop("label", "unit"), 5)
