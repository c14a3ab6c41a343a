"""Queries over nights: epochs, stages, agreement.

An epoch's stage under engine ``rules`` is k mod 5 - 1 of a session's events by
rank, under ``net`` that of k / 5; -1 is unscored.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import night, sleep
from ..session import table
from .adapter import BEATS_SQL, RR_SQL, beats, rr_series
from .registry import Registry, tidy

R = Registry()

HYP_SQL = BEATS_SQL + ",\nhy AS (SELECT session_id, beat AS epoch, CAST(k % 5 - 1 AS BIGINT) AS stage, CAST((k // 5) % 5 - 1 AS BIGINT) AS other, value AS counts FROM beats)"


def _hypnogram(spark, sf_dir):
    return beats(spark, sf_dir).select("session_id", F.col("beat").alias("epoch"), (F.col("k") % 5 - 1).alias("stage"), (F.floor(F.col("k") / 5) % 5 - 1).alias("other"), F.col("value").alias("counts"))


_EPOCHS = (
    RR_SQL
    + """,
e0 AS (SELECT *, CAST(floor(t_s / 30.0) AS BIGINT) AS epoch FROM dd),
e1 AS (SELECT *, CASE WHEN lag(epoch) OVER (PARTITION BY session_id ORDER BY n) = epoch THEN d_ms END AS d FROM e0),
e2 AS (SELECT session_id, epoch, count(*) AS n_beats, sum(rr_ms) AS s, sum(d * d) AS q, count(d) AS m FROM e1 GROUP BY 1, 2),
gr AS (SELECT session_id, unnest(generate_series(0, CAST(floor(max(t_s) / 30.0) AS BIGINT))) AS epoch FROM rr GROUP BY session_id),
e3 AS (SELECT gr.session_id, gr.epoch, coalesce(n_beats, 0) AS n_beats, coalesce(s, 0) AS s, q, coalesce(m, 0) AS m FROM gr LEFT JOIN e2 ON e2.session_id = gr.session_id AND e2.epoch = gr.epoch),
e4 AS (SELECT *, least(1.0, s / 1000.0 / 30.0) AS coverage, CASE WHEN n_beats >= 10 THEN 60000.0 / (s / n_beats) END AS hr,
         CASE WHEN sum(m) OVER w >= 10 THEN sqrt(sum(q) OVER w / sum(m) OVER w) END AS rmssd FROM e3 WINDOW w AS (PARTITION BY session_id ORDER BY epoch ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
ep AS (SELECT e4.*, hr - (SELECT quantile_cont(hr, 0.1) FROM e4 b WHERE b.session_id = e4.session_id) AS hr_delta FROM e4)"""
)


@R.add(_EPOCHS + " SELECT session_id, epoch, n_beats, round(coverage, 6) AS coverage, round(hr, 6) AS hr_bpm, round(rmssd, 6) AS rmssd_ms, round(hr_delta, 6) AS hr_delta FROM ep")
def epoch_features(spark, sf_dir):
    return tidy(sleep.epoch_features(rr_series(spark, sf_dir)))


_SCORES = (
    _EPOCHS
    + """,
fe AS (SELECT *, epoch % 7 = 0 AS moving, CASE WHEN epoch % 11 <> 0 THEN (epoch % 5) * 1.0::DOUBLE END AS lf_hf FROM ep),
md AS (SELECT session_id, quantile_cont(rmssd, 0.5) AS med, max(epoch) AS last FROM fe GROUP BY 1),
ma AS (SELECT fe.session_id, med, last, quantile_cont(abs(rmssd - med), 0.5) AS mad FROM fe JOIN md ON md.session_id = fe.session_id GROUP BY 1, 2, 3),
zz AS (SELECT fe.*, CASE WHEN moving THEN 1.0::DOUBLE ELSE 0.0 END AS mv, (rmssd - med) / CASE WHEN mad > 1e-9 THEN mad ELSE greatest(0.1 * med, 1e-9) END AS z, CASE WHEN last > 0 THEN epoch / last::DOUBLE ELSE 0.0 END AS frac
  FROM fe JOIN ma ON ma.session_id = fe.session_id),
sg AS (SELECT *, coalesce(1.0 / (1.0 + exp(-greatest(-60.0, least(60.0, (hr_delta - 12.0) / 3.0)))), 0) AS a1, coalesce(1.0 / (1.0 + exp(-greatest(-60.0, least(60.0, (-z - 1.0) / 0.5)))), 0) AS a2,
  coalesce(1.0 / (1.0 + exp(-greatest(-60.0, least(60.0, (1.0 - lf_hf) / 0.25)))), 0) AS a3, coalesce(1.0 / (1.0 + exp(-greatest(-60.0, least(60.0, (z - 0.3) / 0.4)))), 0) AS a4,
  coalesce(1.0 / (1.0 + exp(-greatest(-60.0, least(60.0, (4.0 - hr_delta) / 2.0)))), 0) AS a5, coalesce(1.0 / (1.0 + exp(-greatest(-60.0, least(60.0, (lf_hf - 2.5) / 0.5)))), 0) AS a6,
  coalesce(1.0 / (1.0 + exp(-greatest(-60.0, least(60.0, (hr_delta - 3.0) / 2.0)))), 0) AS a7 FROM zz)
SELECT session_id, epoch, round(2.0 * mv + 1.6 * a1 + 0.4 * a2, 5) AS s_wake, round(1.1 - 1.5 * mv, 5) AS s_light, round(1.2 * a3 + 0.9 * a4 + 0.6 * a5 - 2.5 * mv, 5) AS s_deep,
  round(1.5 * a6 + 0.5 * a7 + 0.3 * greatest(0.0, least(1.0, frac / 0.25)) - 2.5 * mv, 5) AS s_rem FROM sg"""
)


def _scored(spark, sf_dir):
    f = sleep.epoch_features(rr_series(spark, sf_dir)).withColumns({"moving": F.col("epoch") % 7 == 0, "lf_hf": F.when(F.col("epoch") % 11 != 0, (F.col("epoch") % 5).cast("double"))})
    return sleep.scores(f)


@R.add(_SCORES)
def stage_scores(spark, sf_dir):
    return tidy(_scored(spark, sf_dir).select("session_id", "epoch", "s_wake", "s_light", "s_deep", "s_rem"), 5)


_PATH = (
    _SCORES.replace("WITH ev", "WITH RECURSIVE ev", 1).split("SELECT session_id, epoch, round(2.0 * mv")[0].rstrip()
    + """,
sc AS (SELECT session_id, epoch, coalesce(coverage >= 0.5 AND hr IS NOT NULL, false) AS ok, [2.0 * mv + 1.6 * a1 + 0.4 * a2, 1.1 - 1.5 * mv, 1.2 * a3 + 0.9 * a4 + 0.6 * a5 - 2.5 * mv,
  1.5 * a6 + 0.5 * a7 + 0.3 * greatest(0.0, least(1.0, frac / 0.25)) - 2.5 * mv]::DOUBLE[] AS s FROM sg),
ex AS (SELECT *, list_transform(s, lambda x: exp(x - list_max(s))) AS e FROM sc),
lp AS (SELECT session_id, epoch, ok, list_transform(CASE WHEN ok THEN list_transform(e, lambda x: x / list_sum(e)) ELSE [0.25, 0.25, 0.25, 0.25]::DOUBLE[] END, lambda x: ln(greatest(x, 1e-12))) AS l FROM ex),
st AS (SELECT unnest(range(4)) AS j),
tr(i, t) AS (VALUES (0, [0.900, 0.080, 0.005, 0.015]::DOUBLE[]), (1, [0.030, 0.900, 0.045, 0.025]), (2, [0.010, 0.085, 0.900, 0.005]), (3, [0.025, 0.070, 0.005, 0.900])),
walk(session_id, epoch, j, best) AS (
  SELECT session_id, epoch, j, {'v': ln(([0.70, 0.28, 0.01, 0.01]::DOUBLE[])[j + 1]) + l[j + 1], 'p': [CAST(3 - j AS INTEGER)]} FROM lp, st WHERE epoch = 0
  UNION ALL
  SELECT session_id, epoch, j, max({'v': v, 'p': p}) FROM (
    SELECT lp.session_id, lp.epoch, st.j, (w.best).v + ln(tr.t[st.j + 1]) + lp.l[st.j + 1] AS v, list_prepend(CAST(3 - st.j AS INTEGER), (w.best).p) AS p
    FROM walk w JOIN lp ON lp.session_id = w.session_id AND lp.epoch = w.epoch + 1 JOIN tr ON tr.i = w.j, st) GROUP BY 1, 2, 3),
en AS (SELECT session_id, max(epoch) AS epoch FROM lp GROUP BY 1),
pa AS (SELECT walk.session_id, max(best) AS best FROM walk JOIN en ON en.session_id = walk.session_id AND en.epoch = walk.epoch GROUP BY 1)
SELECT lp.session_id, lp.epoch, CAST(CASE WHEN ok THEN 3 - list_reverse(best.p)[lp.epoch + 1] ELSE -1 END AS BIGINT) AS stage FROM lp JOIN pa ON pa.session_id = lp.session_id"""
)


@R.add(_PATH)
def viterbi_path(spark, sf_dir):
    f = sleep.epoch_features(rr_series(spark, sf_dir)).withColumns({"moving": F.col("epoch") % 7 == 0, "lf_hf": F.when(F.col("epoch") % 11 != 0, (F.col("epoch") % 5).cast("double"))})
    return tidy(night.rules(f).select("session_id", "epoch", "stage"))


def _night(spark, sf_dir):
    """Nights that end a minute behind their last beat; a window's wander is a beat's value."""
    b = beats(spark, sf_dir)
    durations = b.groupBy("session_id").agg((F.max("t_s") + 60.0).alias("duration_s"))
    return durations, b.select("session_id", F.col("t_s").alias("start_s"), (F.col("value") / 1000.0).alias("wander_rms_mv"))


_MOVEMENT = BEATS_SQL + """,
du AS (SELECT session_id, unnest(generate_series(0, CAST(ceil((max(t_s) + 60.0) / 30.0) AS BIGINT) - 1)) AS epoch FROM beats GROUP BY session_id),
wm AS (SELECT session_id, CAST(floor(t_s / 30.0) AS BIGINT) AS epoch, avg(value / 1000.0) AS m FROM beats WHERE value IS NOT NULL GROUP BY 1, 2),
me AS (SELECT session_id, quantile_cont(m, 0.5) AS med FROM wm GROUP BY 1),
li AS (SELECT wm.session_id, med, quantile_cont(abs(m - med), 0.5) AS mad FROM wm JOIN me ON me.session_id = wm.session_id GROUP BY 1, 2),
mo AS (SELECT du.session_id, du.epoch, m, CASE WHEN mad > 0 THEN med + 5 * mad ELSE 2.0 * med + 1e-9 END AS th FROM du LEFT JOIN wm ON wm.session_id = du.session_id AND wm.epoch = du.epoch LEFT JOIN li ON li.session_id = du.session_id)
SELECT session_id, epoch, round(m, 6) AS movement, round(th, 6) AS threshold, 'wander_proxy' AS source, coalesce(m > th, false) AS moving FROM mo"""


@R.add(_MOVEMENT)
def night_movement(spark, sf_dir):
    durations, windows = _night(spark, sf_dir)
    return tidy(night.movement(sleep.epoch_grid(durations), windows))


@R.add()
def night_hypnogram(spark, sf_dir):
    return night.stage(rr_series(spark, sf_dir), *_night(spark, sf_dir)).hypnogram.select("session_id", "epoch", "stage")


@R.add()
def night_report(spark, sf_dir):
    return night.stage(rr_series(spark, sf_dir), *_night(spark, sf_dir)).summary


@R.add(HYP_SQL + " SELECT session_id, epoch, CAST(CASE stage WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE -1 END AS BIGINT) AS stage FROM hy")
def collapse_vocab(spark, sf_dir):
    return _hypnogram(spark, sf_dir).select("session_id", "epoch", sleep.collapse(F.col("stage"), "wldr_4", "wake_rem_nrem_3").cast("long").alias("stage"))


@R.add(
    HYP_SQL
    + """,
o AS (SELECT *, min(epoch) FILTER (stage >= 1) OVER w AS on_, max(epoch) FILTER (stage >= 1) OVER w AS off_, lag(stage) OVER (PARTITION BY session_id ORDER BY epoch) AS p FROM hy WINDOW w AS (PARTITION BY session_id))
SELECT session_id, count(*) * 0.5::DOUBLE AS tib_min, count(*) FILTER (stage >= 1) * 0.5::DOUBLE AS tst_min, round(100.0 * count(*) FILTER (stage >= 1) / count(*) FILTER (stage <> -1), 6) AS efficiency_pct,
  max(on_) * 0.5::DOUBLE AS latency_min, count(*) FILTER (epoch > on_ AND epoch <= off_ AND stage = 0) * 0.5::DOUBLE AS waso_min,
  count(*) FILTER (epoch > on_ AND epoch <= off_ AND stage = 0 AND p >= 1) AS awakenings, min(epoch - on_) FILTER (stage = 3) * 0.5::DOUBLE AS rem_latency_min FROM o GROUP BY 1"""
)
def sleep_summary(spark, sf_dir):
    return tidy(sleep.summarize(_hypnogram(spark, sf_dir)))


@R.add(
    RR_SQL
    + """, hy AS (SELECT session_id, beat AS epoch, CAST(k % 5 - 1 AS BIGINT) AS stage FROM beats),
s0 AS (SELECT dd.*, stage FROM (SELECT *, CAST(floor(t_s / 30.0) AS BIGINT) AS epoch FROM dd) dd JOIN hy ON hy.session_id = dd.session_id AND hy.epoch = dd.epoch),
s1 AS (SELECT *, CASE WHEN lag(stage) OVER w = stage AND lag(n) OVER w = n - 1 THEN d_ms END AS d FROM s0 WINDOW w AS (PARTITION BY session_id ORDER BY n))
SELECT session_id, stage, count(*) AS n_beats, round(60000.0 / avg(rr_ms), 6) AS hr_bpm, round(CASE WHEN count(d) >= 10 THEN sqrt(avg(d * d)) END, 6) AS rmssd_ms FROM s1 WHERE stage <> -1 GROUP BY 1, 2"""
)
def stage_stats(spark, sf_dir):
    return tidy(sleep.stage_statistics(rr_series(spark, sf_dir), _hypnogram(spark, sf_dir)))


_KAPPA = """
n AS (SELECT {key}, count(*) AS t, count(*) FILTER (a = b) AS s FROM pr GROUP BY ALL),
ma AS (SELECT {key}, a AS v, count(*) AS na FROM pr GROUP BY ALL), mb AS (SELECT {key}, b AS v, count(*) AS nb FROM pr GROUP BY ALL),
ch AS (SELECT {key}, sum(na * nb) AS c FROM ma JOIN mb USING ({key}, v) GROUP BY ALL)
SELECT {key}, t AS n_epochs, round(100.0 * s / t, 6) AS agree_pct, round((s / t::DOUBLE - coalesce(c, 0) / (t * t)::DOUBLE) / (1 - coalesce(c, 0) / (t * t)::DOUBLE), 6) AS kappa
FROM n LEFT JOIN ch USING ({key}) WHERE t >= 20"""


@R.add(HYP_SQL + ", pr AS (SELECT session_id, 'rules' AS engine_a, 'net' AS engine_b, stage AS a, other AS b FROM hy WHERE stage <> -1 AND other <> -1)," + _KAPPA.format(key="session_id, engine_a, engine_b"))
def kappa_pairwise(spark, sf_dir):
    h = _hypnogram(spark, sf_dir)
    both = h.select("session_id", "epoch", F.lit("rules").alias("engine"), "stage").union(h.select("session_id", "epoch", F.lit("net"), "other"))
    pairs = sleep.pairwise(both, F.when(F.col("engine") == "rules", 0).otherwise(1))
    return tidy(sleep.kappa(pairs, ["session_id", "engine_a", "engine_b"]))


@R.add("WITH pr AS (SELECT 1 AS one, quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)," + _KAPPA.format(key="one"))
def kappa_raters(spark, sf_dir):
    p = table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").select(F.lit(1).alias("one"), F.col("quality").alias("a"), F.col("toxic").alias("b"))
    return sleep.kappa(p, ["one"]).select("one", "n_epochs", F.round("agree_pct", 6).alias("agree_pct"), F.round("kappa", 6).alias("kappa"))


@R.add(HYP_SQL + " SELECT stage AS a, other AS b, count(*) AS n FROM hy GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return sleep.confusion(_hypnogram(spark, sf_dir).select(F.col("stage").alias("a"), F.col("other").alias("b")))


@R.add(
    HYP_SQL
    + """ SELECT session_id, CAST(floor((row_number() OVER (PARTITION BY session_id ORDER BY epoch) - 1) * 3 / (count(*) OVER (PARTITION BY session_id))::DOUBLE) AS BIGINT) AS third, stage, 1 AS one FROM hy""".replace(" SELECT session_id, CAST", " SELECT session_id, third, stage, count(*) AS n FROM (SELECT session_id, CAST")
    + ") GROUP BY 1, 2, 3"
)
def thirds(spark, sf_dir):
    return sleep.thirds(_hypnogram(spark, sf_dir))


@R.add(
    HYP_SQL
    + """,
th AS (SELECT *, coalesce(counts > 200, false) AS o FROM hy),
ru AS (SELECT *, epoch - row_number() OVER (PARTITION BY session_id, o ORDER BY epoch) AS g FROM th),
sz AS (SELECT *, count(*) OVER (PARTITION BY session_id, o, g) AS size FROM ru)
SELECT session_id, epoch, CAST(CASE WHEN o AND size >= 2 AND stage > 0 THEN 0 ELSE stage END AS BIGINT) AS stage, o AND size >= 2 AND stage > 0 AS overridden FROM sz"""
)
def wake_override(spark, sf_dir):
    h = _hypnogram(spark, sf_dir).select("session_id", "epoch", "stage", "counts", F.lit(200.0).alias("threshold"))
    return sleep.override_wake(h).select("session_id", "epoch", F.col("stage").cast("long").alias("stage"), "overridden")


@R.add(BEATS_SQL + " SELECT session_id, arg_min(event_type, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END) AS engine FROM beats WHERE event_type IN ('purchase', 'signup', 'view') AND k % 3 = 0 GROUP BY 1")
def engine_precedence(spark, sf_dir):
    b = beats(spark, sf_dir).select("session_id", F.col("event_type").alias("engine"), (F.col("k") % 3 == 0).alias("available"))
    return sleep.first_available(b, ["purchase", "signup", "view"])
